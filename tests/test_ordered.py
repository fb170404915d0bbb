"""Order statistics and the cutting of very long cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseweave.functions import ordered
from caseweave.functions.ordered import PART, next_time, quantile_rows, quantiles, ranged, rank_rows, running, with_next
from caseweave.operators import explain
from caseweave.operators.flow import case_sequences, top_variants, variant_steps, variants
from caseweave.operators.profile import average_rank
from caseweave.session import store


def frame(spark, values):
    return spark.createDataFrame([("g" if i % 3 else None, float(v)) for i, v in enumerate(values)], "k string, x double")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e9, 1e9, allow_nan=False), min_size=1, max_size=60))
def test_quantiles_equal_numpy(spark, values):
    got = quantiles(frame(spark, values), ["k"], "x", {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0})
    rows = {r["k"]: r for r in got.collect()}
    for key in {"g" if i % 3 else None for i in range(len(values))}:
        mine = [v for i, v in enumerate(values) if ("g" if i % 3 else None) == key]
        expected = np.quantile(mine, [0.0, 0.37, 0.5, 1.0])
        assert np.allclose([rows[key][c] for c in "abcd"], expected, rtol=1e-12, atol=1e-9)


def test_quantile_rows_equal_numpy(spark):
    values = [random.Random(1).gauss(0, 10) for _ in range(500)] + [0.0] * 200
    probs = [i / 20 for i in range(21)]
    got = sorted((r["f"], r["x"]) for r in quantile_rows(frame(spark, values), [], "x", probs).collect())
    assert np.allclose([x for _, x in got], np.quantile(values, probs))


def test_rank_orders_across_buckets(spark):
    rng = random.Random(2)
    rows = [(f"g{i:03d}", rng.choice([0.0, 1e-9, 3e-8, 0.5, 7.0, 7.0000001, 1e6]) * rng.choice([0, 1, 1]), rng.randint(1, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, p double, n int")
    got = rank_rows(df, [F.desc("p"), F.desc("n"), F.asc("k")], sums={"cum": F.col("n")}).collect()
    expected = sorted(rows, key=lambda r: (-r[1], -r[2], r[0]))
    assert [r["k"] for r in sorted(got, key=lambda r: r["rank"])] == [r[0] for r in expected]
    assert [r["cum"] for r in sorted(got, key=lambda r: r["rank"])] == list(np.cumsum([r[2] for r in expected]))


@pytest.fixture
def small_sorts(monkeypatch):
    """Ranges of 10,000 rows instead of a million."""
    monkeypatch.setattr(ordered, "SORTED_AT_ONCE", 10_000)
    monkeypatch.setattr(explain, "SORTED_AT_ONCE", 10_000)


CLOSE = {
    "near a billion": lambda n: 1e9 + np.arange(n) / 1e3,
    "one busy hour": lambda n: 1.7e15 + np.arange(n).astype(float),
    "wide": lambda n: np.exp(np.linspace(-30, 30, n)),
}


@pytest.mark.parametrize("kind", CLOSE)
def test_ranges_are_even_whatever_the_values(spark, small_sorts, kind):
    values = CLOSE[kind](100_000)
    df = store(spark.createDataFrame([(float(v),) for v in np.random.default_rng(1).permutation(values)], "x double"))
    rows, cut = ranged(df, [], [F.col("x").asc()])
    sizes = [r["n"] for r in rows.groupBy(PART).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert cut and len(sizes) == 10 and max(sizes) < 0.25 * len(values)
    q = quantiles(df, [], "x", {"low": 0.05, "mid": 0.5, "high": 0.999}).first()
    assert np.allclose(list(q), np.quantile(values, [0.05, 0.5, 0.999]), rtol=1e-15, atol=0)
    top = running(df, [], [F.asc("x")], {"n": F.lit(1)}, rank="r").where("r in (1, 50000, 100000)").orderBy("r").collect()
    assert [r["x"] for r in top] == [values[0], values[49_999], values[-1]] and [r["n"] for r in top] == [1, 50_000, 100_000]


def test_groups_tied_on_priority_and_size_are_cut_by_their_names(spark, small_sorts):
    df = store(spark.range(60_000).select(F.format_string("g%06d", "id").alias("k"), F.lit(0.25).alias("p"), F.lit(3).alias("n")))
    order = [F.desc("p"), F.desc("n"), F.asc("k")]
    rows, _ = ranged(df, [], order)
    assert rows.groupBy(PART).count().agg(F.max("count")).first()[0] < 15_000
    got = rank_rows(df, order, sums={"cum": F.col("n")}).where("rank % 9999 = 1").orderBy("rank").collect()
    assert [(r["k"], r["rank"], r["cum"]) for r in got] == [(f"g{i:06d}", i + 1, 3 * (i + 1)) for i in range(0, 60_000, 9999)]


def test_effect_sizes_over_ranges_equal_those_of_one_sort(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(c, float(v), bool(i % 3)) for c in ("a", "b") for i, v in enumerate(np.round(rng.normal(1e6, 3, 900), 2))]
    signals = spark.createDataFrame(rows, "constraint_id string, x double, in_slice boolean")
    reports = [explain.cliffs_delta, explain.hodges_lehmann, explain.ecdf_pair, lambda s: explain.quantile_shifts(s, {"a": 2.0})]
    one = [sorted(map(tuple, r(signals).collect())) for r in reports]
    for module in (ordered, explain):
        monkeypatch.setattr(module, "SORTED_AT_ONCE", 150)
    many = [sorted(map(tuple, r(signals).collect())) for r in reports]
    assert one == many


def test_average_rank_handles_ties(spark):
    df = spark.createDataFrame([(float(x),) for x in [3, 1, 3, 3, 2]], "x double")
    got = {r["x"]: r["avg_rank"] for r in average_rank(df, "x").collect()}
    assert got == {1.0: 1.0, 2.0: 2.0, 3.0: 4.0}


@pytest.fixture(scope="module")
def long_log(make_log):
    """One case with a third of all events, many ties and missing stamps; the rest small."""
    rng = random.Random(3)
    rows = []
    for i in range(400):
        day = rng.choice([None, *range(1, 9)])
        rows.append(("hot", rng.choice(["A", "B", None]), None if day is None else f"2024-01-0{day}"))
    for c in range(80):
        for i in range(10):
            rows.append((f"c{c}", rng.choice("AB"), f"2024-02-{rng.randint(1, 9):02d}"))
    rng.shuffle(rows)
    return make_log(rows)


def test_cut_cases_give_the_same_sequence(long_log):
    whole = with_next(long_log).select("case_id", "seq", "pos", "nxt_activity", "nxt_ts", "has_next", "is_first")
    cut = with_next(long_log, hot_events=50).select(*whole.columns)
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))


def test_sequence_equals_a_plain_sort(long_log):
    rows = [r for r in long_log.collect() if r["case_id"] == "hot"]
    rows.sort(key=lambda r: (r["ts"] is None, r["ts"] or 0, r["seq"]) if r["ts"] else (True, 0, r["seq"]))
    got = {r["seq"]: r for r in with_next(long_log, hot_events=50).where("case_id = 'hot'").collect()}
    for i, r in enumerate(rows):
        assert got[r["seq"]]["pos"] == i
        assert got[r["seq"]]["nxt_activity"] == (rows[i + 1]["activity"] if i + 1 < len(rows) else None)


def test_next_time_is_the_first_match_at_or_after(long_log):
    b = F.col("activity") == "B"
    got = next_time(long_log, b, "t", hot_events=50).collect()
    plain = next_time(long_log, b, "t").collect()
    assert sorted(map(str, got)) == sorted(map(str, plain))
    stamps: dict = {}
    for r in got:
        if r["activity"] == "B" and r["ts"]:
            stamps.setdefault(r["case_id"], []).append(r["ts"])
    for r in got:
        later = [t for t in stamps.get(r["case_id"], []) if r["ts"] and t >= r["ts"]]
        assert r["t"] == (min(later) if later else None)


def test_long_variants_keep_their_identity(spark, make_log):
    """Chunked digests tell sequences apart exactly as the full sequences do."""
    rng = random.Random(4)
    base = [rng.choice("AB") for _ in range(23)]
    shapes = {"x1": base, "x2": base, "y": base[:-1] + ["C"], "z": base[:10], "z2": base[:10], "n": [None, *base[1:]]}
    rows = [(c, a, f"2024-01-{i + 1:02d}") for c, seq in shapes.items() for i, a in enumerate(seq)]
    log = make_log(rows)
    for chunk, hot in ((1000, 1_000_000), (4, 7), (3, 1_000_000)):
        got = {r["case_id"]: r for r in case_sequences(log, chunk=chunk, hot_events=hot).collect()}
        ids = {c: r["variant"] for c, r in got.items()}
        assert ids["x1"] == ids["x2"] and ids["z"] == ids["z2"]
        assert len(set(ids.values())) == 4
        assert {c: r["n_steps"] for c, r in got.items()} == {c: len(s) for c, s in shapes.items()}
    example = case_sequences(log, chunk=4, hot_events=7).where("case_id = 'y'")
    steps = sorted((r["pos"], r["activity"]) for r in variant_steps(log, example, hot_events=7).collect())
    assert steps == list(enumerate(shapes["y"]))


def test_long_variants_have_the_identity_and_labels_of_short_ones(make_log):
    """Neither the digest, the labels nor the choice among ties depends on the length from which cases are cut."""
    rng = random.Random(5)
    shapes = {f"c{k}": [rng.choice(["A", "é\"", None]) for _ in range(rng.choice([3, 9, 14]))] for k in range(12)}
    log = make_log([(c, a, f"2024-01-{i + 1:02d}") for c, seq in shapes.items() for i, a in enumerate(seq)])
    found = []
    for chunk, hot in ((1000, 1_000_000), (5, 4)):
        ids = {r["case_id"]: (r["variant"], r["n_steps"]) for r in case_sequences(log, chunk=chunk, hot_events=hot).collect()}
        table = store(variants(log, F.lit(12), chunk=chunk, hot_events=hot))
        top = [(r["labels"], r["n_cases"], r["variant"]) for r in top_variants(table, 4).collect()]
        found.append((ids, sorted(top, key=str)))
    assert found[0] == found[1] and all(labels for labels, *_ in found[1][1])
