"""Bootstrap ranks of groups that some replicates miss, and replicate sums against single draws."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from caseweave.operators import uncertainty
from caseweave.operators.uncertainty import poisson_weight, unit_hash


def test_a_group_that_is_not_drawn_comes_last(spark):
    rows = [("only", 0.2, "lonely")] + [(f"c{i}", 0.9 - 0.01 * (i % 3), "many") for i in range(30)]
    scored = spark.createDataFrame(rows, "case_id string, score__A double, `the.group` string")
    out = {r["the.group"]: r for r in uncertainty.bootstrap_backlog(scored, ["the.group"], "A", gamma=0, replicates=100, top=(1,)).collect()}
    assert all(r["n_draws"] == 100 for r in out.values()) and out["many"]["n_draws_present"] == 100
    assert 40 < out["lonely"]["n_draws_present"] < 90
    # Where it is drawn it leads, else it stands behind the other group.
    assert [(out[g]["rank_lo"], out[g]["rank_hi"]) for g in ("lonely", "many")] == [(1.0, 2.0), (1.0, 2.0)]
    assert out["lonely"]["p_top1"] == out["lonely"]["n_draws_present"] / 100


@pytest.mark.parametrize("at_once, kept", [(2_000_000, 8_000_000), (40, 100)])
def test_replicate_sums_equal_single_draws(spark, monkeypatch, at_once, kept):
    monkeypatch.setattr(uncertainty, "DRAWN_AT_ONCE", at_once)
    monkeypatch.setattr(uncertainty, "SUMS_KEPT", kept)
    rows = [(f"c{i}", f"u{i % 37}", None if i % 5 == 0 else f"k \"{i % 4}", float(i % 11)) for i in range(300)]
    df = spark.createDataFrame(rows, "case_id string, unit string, key string, x double").repartition(4)
    h1, h2 = unit_hash(F.col("unit"), 3)
    single = df.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn("w", poisson_weight(h1, h2, F.col("b")))
    want = {(r["b"], r["key"]): (r["n"], r["s"]) for r in single.groupBy("b", "key").agg(F.sum("w").cast("double").alias("n"), F.sum(F.col("w") * F.col("x")).alias("s")).collect()}
    got = {(r["b"], r["key"]): (r["n"], r["s"]) for r in uncertainty.replicate_sums(df, ["key"], "unit", {"n": F.lit(1), "s": F.col("x")}, 12, 3).collect()}
    assert got == want


def test_no_rows_no_sums(spark):
    df = spark.createDataFrame([], "case_id string, key string, x double")
    assert uncertainty.replicate_sums(df, ["key"], "case_id", {"n": F.lit(1)}, 5, 1).count() == 0
