"""Semantics on small logs, validation and identities."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseweave.functions.intervals import newcombe, wilson, z_of
from caseweave.operators import backlog, eda, explain, filters, match, norm, prepare, profile, quality, transforms, uncertainty
from caseweave.operators.cases import build_cases, exclude_cases, recipe_columns
from caseweave.plans import base
from caseweave.sources import sinks


@pytest.fixture(scope="module")
def relations(make_log):
    return make_log(
        [
            ("pq", "P", "2024-03-04"),
            ("pq", "Q", "2024-03-04"),
            ("p_r_q", "P", "2024-03-04"),
            ("p_r_q", "R", "2024-03-05"),
            ("p_r_q", "Q", "2024-03-06"),
            ("q_p", "Q", "2024-03-04"),
            ("q_p", "P", "2024-03-07"),
            ("only_p", "P", "2024-03-09"),
            ("same_stamp", "Q", "2024-03-08"),
            ("same_stamp", "P", "2024-03-08"),
            ("no_dates", "P", None),
            ("no_dates", "Q", None),
        ]
    )


def picked(log, clause):
    rows = filters.select_cases(log, {"and": [clause]}, {"n_events": F.count(F.lit(1))})
    return {r["case_id"] for r in rows.collect() if r["selected"]}


def test_follows_and_their_complements(relations):
    everything = {r["case_id"] for r in relations.select("case_id").distinct().collect()}
    direct = {"kind": "follows", "a": "P", "b": "Q", "directly": True}
    eventual = {"kind": "follows", "a": "P", "b": "Q"}
    assert picked(relations, direct) == {"pq", "no_dates"}
    assert picked(relations, eventual) == {"pq", "p_r_q", "same_stamp"}
    for c in (direct, eventual):
        assert picked(relations, {**c, "never": True}) == everything - picked(relations, c)


def test_labels_with_odd_characters_stay_apart(make_log):
    log = make_log([("x", "A.B, `c`", "2024-01-01"), ("x", "D", "2024-01-02"), ("y", "A_B, `c`", "2024-01-01"), ("y", "D", "2024-01-03")])
    both = [{"kind": "count", "activity": "A.B, `c`", "min": 1}, {"kind": "count", "activity": ["A_B, `c`"], "max": 0}]
    rows = filters.select_cases(log, {"and": both}, {"n_events": F.count(F.lit(1))})
    assert {r["case_id"] for r in rows.collect() if r["selected"]} == {"x"}
    assert picked(log, {"kind": "lag", "a": "A_B, `c`", "b": "D", "min": 2}) == {"y"}
    assert lag_value(log, "x", a="A.B, `c`", b="D", delta=0, width=2) == pytest.approx(0.5)


def test_lag_is_inclusive(relations):
    assert picked(relations, {"kind": "lag", "a": "P", "b": "Q", "unit": "D", "min": 2, "max": 2}) == {"p_r_q"}
    assert picked(relations, {"kind": "lag", "a": "P", "b": "Q", "max": 0}) == {"pq", "same_stamp"}


@pytest.mark.parametrize(
    "bad",
    [
        {"kind": "unknown"},
        {"kind": "time", "field": "middle", "from": "2024-01-01"},
        {"kind": "time"},
        {"kind": "time", "from": "now"},
        {"kind": "time", "from": "2024-01-01", "to": "2023-01-01"},
        {"kind": "time", "from": "2024-01-01T00:00:00+00:00", "to": "2024-02-01"},
        {"kind": "attribute", "field": "a"},
        {"kind": "attribute", "field": "a", "eq": 1, "in": [1]},
        {"kind": "attribute", "field": "a", "in": []},
        {"kind": "activity", "op": "sometimes", "activity": "A"},
        {"kind": "activity", "activity": []},
        {"kind": "follows", "a": "A", "b": "B", "never": "yes"},
        {"kind": "lag", "a": "A", "b": "B"},
        {"kind": "lag", "a": "A", "b": "B", "min": 1, "unit": "Y"},
        {"kind": "count", "activity": "A", "min": 1.5},
        {"kind": "count", "activity": "A", "min": 3, "max": 2},
        {"kind": "count", "activity": "A", "min": True},
        {"kind": "open", "value": 1},
        {"kind": "open", "surprise": 1},
    ],
)
def test_bad_clauses_are_errors(bad):
    with pytest.raises(filters.FilterError):
        filters.check({"and": [bad]})


def test_filter_text_forms():
    assert filters.parse('{"kind": "open"}') == {"and": [{"kind": "open"}]}
    for text in ("[]", "{", '{"or": []}', '{"and": [], "x": 1}'):
        with pytest.raises(filters.FilterError):
            filters.parse(text)


# --------------------------------------------------------------------------- missing policies
def lag_value(log, case, **params):
    c = norm.Constraint("c", "l", "lag", {"a": "A", "b": "B", "delta": 30, "width": 60, **params})
    n = norm.Norm(("l",), (), (c,), window_end="2024-12-30 00:00:00")
    rows = norm.evaluate(norm.gather(log, n, {"n_events": F.count(F.lit(1))}), n, [])
    return {r["case_id"]: r["v__c"] for r in rows.collect()}[case]


def test_missing_ends_of_a_lag(make_log):
    log = make_log([("unanswered", "A", "2024-01-01"), ("recent", "A", "2024-10-31"), ("neither", "X", "2024-01-01"), ("answered", "A", "2024-01-01"), ("answered", "B", "2024-03-01")])
    policies = {p: [lag_value(log, c, missing=p) for c in ("unanswered", "recent")] for p in ("skip", "violate", "censor")}
    assert policies == {"skip": [None, None], "violate": [1.0, 1.0], "censor": [1.0, pytest.approx(0.5)]}
    assert lag_value(log, "neither") is None and lag_value(log, "neither", missing_a="violate") == 1.0
    assert lag_value(log, "answered") == pytest.approx(0.5)


def test_unscored_case_has_no_score(make_log):
    log = make_log([("a", "A", "2024-01-01"), ("b", "X", "2024-01-01")])
    c = norm.Constraint("c", "l", "presence", {"activity": "A"}, applicability={"has": "A"})
    n = norm.Norm(("l",), (norm.View("V", {"l": 1.0}),), (c,))
    rows = {r["case_id"]: r["score__V"] for r in norm.score(log, n, {"n_events": F.count(F.lit(1))}, []).collect()}
    assert rows == {"a": 1.0, "b": None}


def test_unknown_types_and_policies_are_errors():
    with pytest.raises(ValueError):
        norm.Constraint("c", "l", "absence", {})
    with pytest.raises(ValueError):
        norm.Constraint("c", "l", "lag", {"missing": "maybe"}).missing("missing_b")
    with pytest.raises(ValueError):
        norm.applies({"attr": "x", "like": "y"})


# --------------------------------------------------------------------------- identities on the real tables
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scored(spark):
    return base.scored_o(spark, SF)


def test_weights_sum_to_one(scored):
    n = base.norm_o()
    for view in n.views:
        w = norm.with_weights(scored, n, view, "w_")
        total = sum((F.col(f"w_w_{c}") for c in n.ids()), F.lit(0.0))
        row = w.where(F.col(f"score__{view.name}").isNotNull()).agg(F.min(total).alias("a"), F.max(total).alias("b")).first()
        assert row["a"] == pytest.approx(1.0, abs=1e-12) and row["b"] == pytest.approx(1.0, abs=1e-12)


def test_rescoring_the_same_view_changes_nothing(scored):
    n = base.norm_o()
    again = norm.with_scores(scored.select("case_id", *[f"v__{c}" for c in n.ids()]), n, [n.view("A")])
    both = again.select("case_id", F.col("score__A").alias("x")).join(scored.select("case_id", "score__A"), "case_id")
    assert both.where(F.abs(F.col("x") - F.col("score__A")) > 0).count() == 0


def test_gap_decomposition_is_exact_for_any_slice(scored):
    n = base.norm_o()
    for salt in range(3):
        where = F.pmod(F.xxhash64("case_id", F.lit(salt)), F.lit(3)) == 0
        delta = explain.contrast(scored, n, "A", where).agg(F.sum("delta")).first()[0]
        gap = scored.agg(F.avg("score__A") - F.avg(F.when(where, F.col("score__A")))).first()[0]
        assert delta == pytest.approx(gap, abs=1e-9)
        room = explain.headroom(scored, n, "A", where).agg(F.sum("mean_penalty")).first()[0]
        mean = scored.where(where).agg(F.avg("score__A")).first()[0]
        assert room == pytest.approx(1 - mean, abs=1e-9)


def test_threshold_settings_are_two_per_graded_constraint():
    n = base.norm_o()
    graded = [c for c in n.constraints if c.type not in ("presence", "exclusion")]
    assert len(uncertainty.scaled_constraints(n, (0.8, 1.25))) == 2 * len(graded)


def test_cliffs_delta_and_shift_equal_brute_force(scored):
    n = base.norm_o()
    where = F.col("priority") == "5-LOW"
    sides = explain.sides(scored, n, "A", where)
    rows = sides.toPandas()
    got = {r["constraint_id"]: r["cliffs_delta"] for r in explain.cliffs_delta(sides).collect()}
    shift = {r["constraint_id"]: r["hl_shift"] for r in explain.hodges_lehmann(sides).collect()}
    for cid, g in rows.groupby("constraint_id"):
        a, b = g.x[g.in_slice].to_numpy(), g.x[~g.in_slice].to_numpy()
        d = np.subtract.outer(a, b)
        assert got[cid] == pytest.approx((d > 0).mean() - (d < 0).mean(), abs=1e-12)
        assert shift[cid] == pytest.approx(np.median(d), abs=1e-6)


def test_shift_of_small_empty_and_infinite_sides(spark):
    rows = [
        ("empty", 1.0, True), ("one", 1.0, True), ("one", 3.5, False), ("even", 2.0, True), ("even", 4.0, True), ("even", 0.0, False), ("even", 0.0, False),
        ("far", -1e15, True), ("far", 1e15, True), ("far", 0.25, False), ("nan", float("nan"), True), ("nan", 1.0, False), ("inf", float("inf"), True), ("inf", 5.0, True), ("inf", 1.0, False),
    ]
    df = spark.createDataFrame(rows, "constraint_id string, x double, in_slice boolean")
    got = {r["constraint_id"]: r["hl_shift"] for r in explain.hodges_lehmann(df).collect()}
    assert got.pop("far") == pytest.approx(-0.25, abs=1e4)
    assert got == {"empty": None, "one": -2.5, "even": 3.0, "nan": None, "inf": 4.0}
    assert explain.hodges_lehmann(df.where("x is null")).count() == 0


def test_shift_equals_brute_force_on_unequal_sides(spark):
    rng = np.random.default_rng(5)
    sizes = {"wide": (3, 4000), "ties": (700, 900), "small": (40, 41)}
    values = {"wide": lambda n: rng.lognormal(3, 4, n), "ties": lambda n: rng.integers(-3, 4, n).astype(float), "small": lambda n: rng.normal(0, 1e-5, n)}
    sides = {c: (values[c](n), values[c](m)) for c, (n, m) in sizes.items()}
    rows = [(c, float(x), i == 0) for c, ab in sides.items() for i, side in enumerate(ab) for x in side]
    df = spark.createDataFrame(rows, "constraint_id string, x double, in_slice boolean")
    for r in explain.hodges_lehmann(df).collect():
        a, b = sides[r["constraint_id"]]
        d = np.subtract.outer(a, b)
        assert r["hl_shift"] == pytest.approx(np.median(d), rel=1e-9, abs=1e-11 * np.ptp(d))


def test_bootstrap_weights_are_poisson_and_reproducible(spark):
    units = spark.range(4000).select(F.col("id").alias("u"))
    h1, h2 = uncertainty.unit_hash(F.col("u"), 5)
    rows = units.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(20))))
    w = rows.select("b", uncertainty.poisson_weight(h1, h2, F.col("b")).alias("w"))
    m = w.agg(F.avg("w").alias("m"), F.var_samp("w").alias("v")).first()
    assert m["m"] == pytest.approx(1.0, abs=0.02) and m["v"] == pytest.approx(1.0, abs=0.04)
    per_b = [r["s"] for r in w.groupBy("b").agg(F.sum("w").alias("s")).collect()]
    assert len(set(per_b)) > 15
    again = rows.select("b", uncertainty.poisson_weight(h1, h2, F.col("b")).alias("w"))
    assert again.agg(F.sum(F.col("w") * F.col("b"))).first() == w.agg(F.sum(F.col("w") * F.col("b"))).first()


def test_bootstrap_interval_contains_the_point(scored):
    rows = uncertainty.bootstrap_backlog(scored, ["priority"], "A", gamma=20, replicates=60, top=(2,), seed=1).collect()
    inside = [r["stable_PI_lo"] - 1e-9 <= r["stable_PI"] <= r["stable_PI_hi"] + 1e-9 for r in rows]
    assert sum(inside) >= len(rows) - 1


def test_chart_sums_equal_totals(spark):
    cases = eda.with_keys(eda.prepared(base.cases_o(spark, SF)), ["nation", "segment"])
    marked = eda.mark(cases, {"event_ranges": [[3, None]]}).cache()
    total = marked.agg(F.count(F.lit(1)), F.count_if("selected")).first()
    charts = [
        eda.category_counts(marked, "nation"),
        eda.trend(marked),
        eda.histogram(marked, "span_days", eda.SPAN_CUTS),
        eda.histogram(marked, "events", eda.EVENT_CUTS),
        eda.joint_counts(marked, "nation", "segment"),
        eda.density(marked),
        eda.hierarchy(marked, ["nation", "segment"]),
    ]
    for chart in charts:
        assert tuple(chart.agg(F.sum("total"), F.sum("selected")).first()) == tuple(total)


def test_selection_errors(spark):
    cases = eda.prepared(base.cases_o(spark, SF))
    with pytest.raises(ValueError):
        eda.selection(cases, {"numeric": [{"field": "segment", "ranges": [[1, 2]]}]})
    with pytest.raises(ValueError):
        eda.selection(cases.withColumn("n", F.lit(1)), {"numeric": [{"field": "n", "ranges": [["0." + "1" * 40, None]]}]})


# --------------------------------------------------------------------------- transforms
@pytest.fixture(scope="module")
def steps(make_log):
    return make_log(
        [
            ("a", "A", "2024-01-01"),
            ("a", "B", "2024-01-11"),
            ("a", "B", "2024-01-11"),
            ("a", "C", "2024-01-11"),
            ("a", "D", "2024-01-21"),
            ("b", "A", "2024-01-01"),
            ("b", "B", "2024-01-03"),
            ("b", "A", "2024-01-04"),
        ]
    )


def days(log):
    return sorted((r["case_id"], r["activity"], r["ts"].day) for r in log.collect())


def test_cap_lag_moves_every_event_at_the_instant(steps):
    plain = days(transforms.cap_lag(steps, "A", "B", 5))
    assert ("a", "B", 6) in plain and plain.count(("a", "B", 6)) == 2 and ("a", "C", 11) in plain and ("a", "D", 21) in plain
    shifted = days(transforms.cap_lag(steps, "A", "B", 5, shift_following=True))
    assert ("a", "C", 11) in shifted and ("a", "D", 16) in shifted and ("b", "B", 3) in shifted


def test_keep_first_and_move_first(steps):
    kept = days(transforms.keep_first(steps, ["A", "B"]))
    assert kept.count(("a", "B", 11)) == 1 and ("b", "A", 1) in kept and ("b", "A", 4) not in kept
    moved = days(transforms.move_event(steps, ["A", "B"], 1, "D", "first"))
    assert ("a", "A", 2) in moved and ("b", "A", 2) in moved and ("b", "A", 4) in moved and ("b", "B", 3) in moved


def test_norm_edits():
    edited, lines = transforms.edit_norm(base.NORM_DOC, {"constraints": [{"id": "c_lag", "delta": 10}], "remove": ["c_bal"]})
    assert len(lines) == 2 and len(edited["constraints"]) == len(base.NORM_DOC["constraints"]) - 1
    assert base.NORM_DOC["constraints"][1]["params"]["delta"] == 90
    for bad in ({}, {"remove": ["nothing"]}, {"constraints": [{"id": "nothing"}]}, {"add": [{"id": "c_lag"}]}):
        with pytest.raises(ValueError):
            transforms.edit_norm(base.NORM_DOC, bad)


# --------------------------------------------------------------------------- preparation, sinks, matching, bands
def test_mapping_errors(spark):
    raw = spark.createDataFrame([("1", "A", "x")], "c string, a string, t string")
    with pytest.raises(ValueError):
        prepare.check_mapping(raw, prepare.Mapped("c", "nothing", "t"))
    row = prepare.check_mapping(raw, prepare.Mapped("c", "a", "t")).first()
    assert (row["n_rows"], row["n_parsed"]) == (1, 0)


def test_excluding_every_case_is_an_error(steps):
    with pytest.raises(ValueError):
        exclude_cases(steps, build_cases(steps))


def test_eval_recipe_sees_case_columns_only(steps):
    cases = build_cases(steps)
    out = recipe_columns(cases, {"x": {"kind": "eval", "expr": "n_events * 2"}})
    assert {r["x"] for r in out.collect()} == {10, 6}
    with pytest.raises(Exception, match="cannot be resolved"):
        recipe_columns(cases, {"x": {"kind": "eval", "expr": "secret + 1"}})


def test_selection_is_bound_to_its_source(spark, steps, tmp_path):
    cases = build_cases(steps)
    path = str(tmp_path / "sel")
    sinks.save_selection(cases.where("case_id = 'a'"), path, "v1")
    assert [r["case_id"] for r in sinks.resolve_selection(cases, path, "v1").collect()] == ["a"]
    with pytest.raises(ValueError):
        sinks.resolve_selection(cases, path, "v2")
    with pytest.raises(ValueError):
        sinks.save_selection(cases.unionByName(cases), path, "v1")


def test_labels_match_their_activity(spark):
    texts = spark.createDataFrame(
        [("record_gr", "Record Goods Receipt", "name"), ("cancel_gr", "Cancel goods receipt", "name"), ("pay", "Clear invoice", "synonym"), ("block", "MRBR", "code")],
        "activity_id string, text string, method string",
    )
    seen = spark.createDataFrame([(x,) for x in ("Recorded GR", "Cancelled goods receipts", "Clearing Invoices", "Release MRBR", "clear invoic", "zzz")], "label string")
    got = {r["label"]: (r["activity_id"], r["tier"]) for r in match.match(seen, texts, top=1).collect()}
    assert got["Recorded GR"] == ("record_gr", "high")
    assert got["Cancelled goods receipts"] == ("cancel_gr", "high")
    assert got["Clearing Invoices"][0] == "pay"
    assert got["Release MRBR"] == ("block", "high")
    assert got["clear invoic"] == ("pay", "high")
    assert "zzz" not in got


def test_a_label_that_is_only_a_code(spark):
    texts = spark.createDataFrame([("block", "MRBR", "code"), ("the", "of the", "name")], "activity_id string, text string, method string")
    seen = spark.createDataFrame([("MRBR",), ("the",)], "label string")
    assert [(r["label"], r["activity_id"]) for r in match.match(seen, texts).collect()] == [("MRBR", "block")]


def test_one_group_has_no_shrinkage_estimate(spark):
    one = spark.createDataFrame([(5, 0.1, 0.5)], "n_cases bigint, sd_score double, mean_score double")
    assert spark.range(1).select(uncertainty.estimate_gamma(one)).first()[0] is None


def test_bounds_with_a_zone_are_taken_in_utc(relations):
    clause = {"kind": "time", "field": "case_start", "from": "2024-03-08T01:00:00+01:00"}
    rows = filters.select_cases(relations, {"and": [clause]}, {"first_ts": F.min("ts"), "last_ts": F.max("ts")})
    assert {r["case_id"] for r in rows.collect() if r["selected"]} == {"same_stamp", "only_p"}


def test_boolean_attributes_are_spelled_true_and_false(spark):
    cases = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "case_id string, flag boolean")
    hit = cases.where(filters.case_clause({"kind": "attribute", "field": "flag", "eq": True})).collect()
    assert [r["case_id"] for r in hit] == ["a"]


def test_band_edges_drop_degenerate_quantiles(spark):
    cases = spark.createDataFrame([(float(x),) for x in [1, 1, 1, 1, 2, 9]], "x double")
    edges = backlog.band_edges(cases, "x", 4)
    assert edges == [1.75]
    labels = {r[0] for r in cases.select(backlog.band("x", edges)).collect()}
    assert labels == {"< 1.75", "≥ 1.75"}
    assert backlog.band_labels([]) == ["all"] and backlog.short_number(1_250_000.0) == "1.25M"


def test_intervals_at_the_ends(spark):
    z = z_of(0.95)
    low, high = wilson(F.lit(0), F.lit(10), z)
    row = spark.range(1).select(low.alias("a"), high.alias("b"), newcombe(F.lit(5), F.lit(10), F.lit(0), F.lit(0), z)[0].alias("c")).first()
    assert row["a"] == 0.0 and row["b"] == pytest.approx(0.2775328, abs=1e-6) and row["c"] is None


# --------------------------------------------------------------------------- inputs outside the given tables
def test_csv_quotes_line_breaks_and_encodings(spark, tmp_path):
    from caseweave.sources.readers import read_csv

    def rows(name, data):
        (tmp_path / name).write_bytes(data)
        return [tuple(r) for r in read_csv(spark, str(tmp_path / name)).collect()]

    assert rows("quoted.csv", b'a, b\n1,"He said ""hi, there"" ok"\n') == [("1", 'He said "hi, there" ok')]
    assert rows("broken.csv", b'a,b\n1,"two\nlines"\n2,x\n') == [("1", "two\nlines"), ("2", "x")]
    assert rows("written.csv", "a,b\n1,Café \ufffd\n".encode()) == [("1", "Café \ufffd")]
    assert rows("latin.csv", "a,b\n1,Café – €\n".encode("cp1252")) == [("1", "Café – €")]


def test_zones_and_day_first(spark):
    raw = spark.createDataFrame([("2024-01-01T00:30:00+02:00",), ("2024-01-01 10:00:00",), ("31/12/2023 10:00",), ("x",), (None,)], "t string")
    mapped = prepare.Mapped("c", "a", "t")
    stamps = lambda m: [None if r[0] is None else str(r[0]) for r in raw.select(prepare.parse_timestamp(F.col("t"), raw, m)).collect()]
    assert stamps(mapped) == ["2023-12-31 22:30:00", "2024-01-01 10:00:00", None, None, None]
    assert stamps(prepare.Mapped("c", "a", "t", day_first=True))[2] == "2023-12-31 10:00:00"


def test_missing_labels_are_not_removed(make_log):
    log = make_log([("a", None, "2024-01-01"), ("a", "X", "2024-01-02")])
    record = transforms.change_record(log, log, 1, "none").first().asDict()
    assert record["events_removed"] == 0


def test_infinite_values_have_quantiles(spark):
    from caseweave.functions.ordered import quantiles

    df = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),), (float("-inf"),), (3.0,)], "x double")
    assert quantiles(df, [], "x", {"low": 0.0, "mid": 0.5, "high": 1.0}).first().asDict() == {"low": float("-inf"), "mid": 2.0, "high": float("inf")}


def test_norm_documents_with_objects_and_lists(spark, make_log):
    from caseweave.operators.cases import recipe_aggregates

    doc = {
        "layers": [{"id": "L.1", "name": "first"}, {"id": "L2", "name": "second"}],
        "views": [{"name": "V", "layer_weights": {"L.1": 0.7, "L2": 0.3}}],
        "derived_attributes": [
            {"name": "hands", "kind": "count_events", "where": {"column": "event org:res.", "regex": "^(?!batch)."}},
            {"name": "all", "kind": "eval", "expr": "n_events * 2"},
            {"name": "share", "kind": "ratio", "numerator": "hands", "denominator": "n_events"},
        ],
        "constraints": [{"id": "c", "layer": "L.1", "type": "presence", "params": {"activity": ["A"], "m": 1}, "weight": 1.2, "description": "d"}],
    }
    n = norm.load_norm(doc)
    assert list(n.layers) == ["L.1", "L2"] and norm.weights(n, n.view("V")) == {"c": 0.7}
    log = make_log([("x", "A", "2024-01-01", "ann"), ("x", "B", "2024-01-02", "batch_1")], "`event org:res.` string")
    cases = recipe_columns(build_cases(log, recipe_aggregates(n.derived)), n.derived)
    assert cases.select("hands", "all", "share").first() == (1, 4, 0.5)
    for text in ("java_method('java.lang.System', 'getProperty', 'user.name')", "unknown + 1", "n_events.real", "[1]"):
        with pytest.raises(ValueError):
            recipe_columns(cases, {"e": {"kind": "eval", "expr": text}})


def test_columns_are_guessed_by_name():
    assert profile.guess_columns(["Start Date", "STATUS", "Case ID", "case_id", "Time_Stamp"]) == {"case_id": "Case ID", "activity": "STATUS", "ts": "Time_Stamp"}
    assert profile.guess_columns(["event", "Concept:Name", "x"]) == {"case_id": None, "activity": "Concept:Name", "ts": None}


def test_log_details(spark):
    rows = [("b", "start", 1, None), ("b", "end", None, None), ("a", "end", 2, None), ("a", None, 3, None), ("c", "end", 4, None), (None, "end", 5, None)]
    events = spark.createDataFrame(rows, "`act.ivity` string, n string, `a.b` int, `none` string")
    got = profile.log_details(events, activity="act.ivity", lifecycle="n", attributes=["a.b", "none"], top=2)
    assert sorted(map(tuple, got.collect())) == [("activity", "a", 2), ("activity", "b", 2), ("attribute", "a.b", 5), ("lifecycle", "end", 4), ("lifecycle", "start", 1)]
    only = profile.log_details(events.limit(0), activity="act.ivity", attributes=["a.b"])
    assert only.columns == ["part", "name", "n"] and only.count() == 0
    assert [tuple(r) for r in profile.log_details(events, activity="act.ivity", top=1).collect()] == [("activity", "a", 2)]


def test_flow_types_of_a_mapping(spark):
    rows = [("1", "a", "2024-01-01", "s"), ("1", "b", "bad", "s"), ("2", "b", "2024-01-02", None), ("3", "c", None, "t"), (None, "a", "2024-01-02", "s")]
    raw = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "c string, a string, t string, g string, seq int")
    rules = [{"name": "with a", "rule": {"and": [{"kind": "activity", "activity": "a"}]}}, {"name": "of t", "rule": {"kind": "attribute", "field": "g", "eq": "t"}}]
    mapping = prepare.Mapped("c", "a", "t", attributes=("g",))
    assert sorted(map(tuple, prepare.mapped_flow_types(raw, mapping, rules, "rest").collect())) == [("of t", 1, 1), ("rest", 1, 1), ("with a", 1, 2)]
    assert prepare.mapped_flow_types(raw.limit(0), mapping, rules, "rest").count() == 0
    with pytest.raises(ValueError, match="no timestamp"):
        prepare.mapped_flow_types(raw.withColumn("t", F.lit("soon")), mapping, rules, "rest")
    with pytest.raises(ValueError, match="not in the log"):
        prepare.mapped_flow_types(raw, prepare.Mapped("c", "a", "when"), rules, "rest")


def test_vocabulary_against_a_named_period(spark):
    rows = [("2024-01-05", "a")] * 3 + [("2024-01-06", "b")] + [("2024-02-01", "a")] * 2 + [("2024-03-01", "c")] * 4 + [(None, "z")]
    events = spark.createDataFrame(rows, "t string, activity string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = {r["period"]: r for r in quality.vocabulary_drift(events, min_events=3, reference="2024-02", expected=["b", "c", "q", "b"]).collect()}
    assert [got[f"2024-0{m}"]["new_labels"] for m in (1, 2, 3)] == ["b", "", "c"]
    assert [got[f"2024-0{m}"]["vanished_labels"] for m in (1, 2, 3)] == ["", "", "a"]
    assert [got[f"2024-0{m}"]["missing_labels"] for m in (1, 2, 3)] == ["c, q", "b, c, q", "b, q"]
    assert [got[f"2024-0{m}"]["jsd"] for m in (2, 3)] == [0.0, 1.0] and not got["2024-02"]["eligible"]
    plain = quality.vocabulary_drift(events, min_events=3)
    absent = quality.vocabulary_drift(events, min_events=3, reference="1999-01")
    assert "missing_labels" not in plain.columns and sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, absent.collect()), key=str)
    assert {r["missing_labels"] for r in quality.vocabulary_drift(events, expected=[]).collect()} == {""}
