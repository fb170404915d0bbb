"""What keeps large inputs within their limits: few tables per pass, few ranges, no broadcast of packed rows."""

from __future__ import annotations

import numpy as np
import pytest
from caseweave.functions import ordered
from caseweave.operators import explain, quality
from caseweave.operators.cases import attach
from caseweave.plans import base as plans_base
from caseweave.plans import explain as plans_explain
from caseweave.plans import load, reports
from caseweave.session import store, tune
from pyspark.sql import functions as F

load()


def test_shift_stores_the_values_but_no_pass_over_them(spark, monkeypatch):
    rng = np.random.default_rng(11)
    sides = {"a": (rng.normal(0, 9, 700), rng.normal(4, 5, 900)), "b": (np.round(rng.lognormal(2, 2, 800), 1), rng.uniform(-50, 90, 300)), "c": (rng.integers(0, 3, 400) * 1e6, rng.integers(0, 2, 500) - 1e6)}
    rows = [(c, float(x), i == 0) for c, ab in sides.items() for i, side in enumerate(ab) for x in side]
    signals = spark.createDataFrame(rows, "constraint_id string, x double, in_slice boolean")
    for name, value in {"VALUES_PER_BLOCK": 60, "SORTED_AT_ONCE": 500}.items():
        monkeypatch.setattr(explain, name, value, raising=False)
    kept = []
    monkeypatch.setattr(explain, "store", lambda df: kept.append(store(df)) or kept[-1])
    monkeypatch.setattr(ordered, "store", lambda df: kept.append(store(df)) or kept[-1])
    for r in explain.hodges_lehmann(signals).collect():
        a, b = sides[r["constraint_id"]]
        d = np.subtract.outer(a, b)
        assert r["hl_shift"] == pytest.approx(np.median(d), rel=1e-9, abs=1e-10 * np.ptp(d))
    assert sum(df.count() for df in kept) <= 3 * len(rows)


def test_packed_case_values_are_joined_without_a_broadcast(spark):
    cases = store(spark.range(2_000_000).select(F.col("id").alias("case_id"), F.lit("a type of flow that every case has").alias("flow_type")))
    events = spark.range(0, 60_000_000, 1, 8).select((F.col("id") % 2_000_000).alias("case_id"), F.col("id").alias("seq"))
    plan = attach(events, cases, ["flow_type"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_ranges_of_long_cases_follow_the_rows_and_not_the_limit(spark, monkeypatch):
    events = spark.range(3_000).select((F.col("id") % 7).alias("case_id"), F.lit("a").alias("activity"), F.timestamp_seconds(F.col("id") % 11).alias("ts"), F.col("id").alias("seq"))
    dealt = []
    monkeypatch.setattr(ordered, "store", lambda df: dealt.append(df.rdd.getNumPartitions()) or store(df))
    rows, cut = ordered.chunked(events, 5)
    assert cut and rows.count() == 3_000 and max(dealt[1:]) == 2
    assert rows.groupBy("case_id", ordered.CHUNK).count().agg(F.max("count")).first()[0] <= 5
    placed = ordered.with_next(events, hot_events=5).select("case_id", "seq", "pos", "nxt_ts").collect()
    for case in range(7):
        want = sorted((i % 11, i) for i in range(case, 3_000, 7))
        assert [s for _, s in want] == [r["seq"] for r in sorted((r for r in placed if r["case_id"] == case), key=lambda r: r["pos"])]


def test_large_shuffles_are_cut_by_their_size(spark):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        rows = spark.range(3_000_000).select((F.col("id") * 3).alias("id"), F.rand(1).alias("x")).groupBy("id").agg(F.max("x").alias("x"))
        assert rows.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)


def _written(monkeypatch, module):
    """The tables that a module of plans stores, as it stores them."""
    kept = []
    monkeypatch.setattr(module, "store", lambda df: kept.append(store(df)) or kept[-1])
    return kept


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Eighty orders of ten customers, with up to four lines."""
    root = tmp_path_factory.mktemp("tables")
    day = F.date_add(F.lit("1995-01-01").cast("date"), F.col("d")).cast("timestamp_ntz")
    tables = {
        "nation": spark.range(3).selectExpr("cast(id AS int) AS n_nationkey", "concat('NATION_', id + 6) AS n_name"),
        "customer": spark.range(10).selectExpr("id AS c_custkey", "cast(id % 3 AS int) AS c_nationkey", "if(id % 2 = 0, 'BUILDING', 'FURNITURE') AS c_mktsegment"),
        "orders": spark.range(80).selectExpr("id AS o_orderkey", "id % 10 AS o_custkey", "if(id % 4 = 0, 'P', 'F') AS o_orderstatus", "id * 9000.0D AS o_totalprice", "cast(id * 7 AS int) AS d", "if(id % 3 = 0, '5-LOW', '2-HIGH') AS o_orderpriority").withColumn("o_orderdate", day).drop("d"),
        "lineitem": spark.range(200).selectExpr("id % 75 AS l_orderkey", "id % 11 AS l_partkey", "id % 5 AS l_suppkey", "cast(id div 75 AS int) AS l_linenumber", "id * 400.0D AS l_extendedprice", "if(id % 3 = 0, 'R', 'N') AS l_returnflag", "if(id % 2 = 0, 'O', 'F') AS l_linestatus", "cast(id * 5 AS int) AS d").withColumn("l_shipdate", day).drop("d"),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{root}/{name}.parquet")
    return str(root)


def test_flow_reports_store_only_the_columns_they_read(spark, monkeypatch, small):
    kept = _written(monkeypatch, reports)
    plans_base.REGISTRY["K35_facets_flow_type"].run(spark, small).count()
    plans_base.REGISTRY["K34_flow_top_groups"].run(spark, small).count()
    assert [set(df.columns) for df in kept] == [
        {"case_id", "censored", "exposure", "score__A", "flow_type"},
        {"case_id", "nation", "score__A", "flow_type"},
    ]


def test_selection_drivers_store_the_clause_and_not_the_scored_cases(spark, monkeypatch, small):
    kept = _written(monkeypatch, reports)
    plans_base.REGISTRY["K44_selection_drivers"].run(spark, small).count()
    assert [set(df.columns) for df in kept] == [{"case_id", "hit"}]


def test_sensitivity_gathers_the_events_once(spark, monkeypatch, small):
    calls = []
    for module in (plans_base, plans_explain):
        monkeypatch.setattr(module, "gather", lambda *a, g=module.gather: calls.append(a) or g(*a))
    monkeypatch.setattr(plans_base, "_STORED", {})
    plans_base.REGISTRY["X10_sensitivity"].run(spark, small).count()
    assert len(calls) == 1


def test_scores_are_not_left_to_code_that_the_jvm_never_compiles(spark, small):
    limit = int(tune(spark).conf.get("spark.sql.codegen.hugeMethodLimit"))
    scored = plans_base.score_table(plans_base.log_o(spark, small), plans_base.norm_o())
    rows = sorted(map(str, scored.collect()))
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    try:
        assert limit <= 8000 and rows == sorted(map(str, plans_base.score_table(plans_base.log_o(spark, small), plans_base.norm_o()).collect()))
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(limit))


def test_asymmetry_stores_the_pairs_and_not_the_events(spark, monkeypatch):
    kept = _written(monkeypatch, quality)
    rows = [(1, "Set x"), (1, "Release x"), (1, "Release x"), (2, "Release x"), (None, "Release x"), (3, "Set x"), (3, None), (4, "Other")]
    events = spark.createDataFrame(rows, "case_id long, activity string")
    pairs = spark.createDataFrame([("Set x", "Release x")] * 2 + [("Set x", "Absent x"), ("No x", "Nor x")], "setting string, releasing string")
    out = {(r["setting"], r["releasing"]): r for r in quality.logging_asymmetry(events, pairs).collect()}
    assert [set(df.columns) for df in kept] == [{"setting", "releasing", "pair"}]
    shown = ("n_setting_events", "n_releasing_events", "cases_with_release", "cases_release_without_set")
    assert {k: tuple(r[c] for c in shown) for k, r in out.items()} == {("Set x", "Release x"): (2, 4, 3, 2), ("Set x", "Absent x"): (2, 0, 0, 0)}


def test_types_are_not_stored_where_only_the_type_is_read(spark, monkeypatch, small):
    kept = _written(monkeypatch, plans_base)
    monkeypatch.setattr(plans_base, "_STORED", {})
    for name in ("C15_attach_case_values", "C8_assignment_preview"):
        out = plans_base.REGISTRY[name].run(spark, small)
        assert out.count() > 0 and "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert kept == []


def test_selected_cases_are_stored_by_their_ids(spark, monkeypatch, small):
    kept = _written(monkeypatch, plans_base)
    monkeypatch.setattr(plans_base, "_STORED", {})
    out = plans_base.REGISTRY["T5_set_attribute"].run(spark, small)
    assert [df.columns for df in kept] == [["case_id"]]
    rush = {r["case_id"] for r in out.where("flag = 'x' AND status = 'rush'").collect()}
    assert rush == set(range(80))


def test_operators_on_texts_keep_the_sizes_they_were_measured_with(spark):
    from caseweave.llm.common import SIZES, prepared
    from caseweave.session import RUNTIME

    try:
        prepared(spark)
        assert {k: spark.conf.get(k) for k in SIZES} == SIZES
    finally:
        tune(spark)
    assert all(spark.conf.get(k) == RUNTIME[k] != SIZES[k] for k in SIZES)
