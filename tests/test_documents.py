"""Norm documents scored as they are, and names that hold dots, quotes and backticks in every report."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from caseweave.operators import backlog, derived, explain, norm, profile, uncertainty
from caseweave.operators.cases import build_cases, case_aggregates
from caseweave.session import store

RECIPES = [
    {"name": "times", "kind": "indicator_times", "activities": ["B"], "attribute": "scaled"},
    {"name": "scaled", "kind": "quantile_scale", "attribute": "double", "q": 0.5},
    {"name": "double", "kind": "eval", "expr": "n_events * 2"},
    {"name": "share", "kind": "ratio", "numerator": "hands", "denominator": "double"},
    {"name": "hands", "kind": "count_events", "where": {"column": "event org:res.", "regex": "(?i)^(?!(?:batch|none|\\s*$))."}},
]


def test_recipes_in_the_order_they_need():
    recipes = {r["name"]: r for r in RECIPES}
    order = derived.in_order(recipes)
    assert order.index("double") < order.index("scaled") < order.index("times") and "hands" not in order
    with pytest.raises(ValueError, match="circle"):
        derived.in_order({"a": {"kind": "eval", "expr": "b + 1"}, "b": {"kind": "ratio", "numerator": "a", "denominator": "n"}})


def test_a_document_needs_nothing_but_the_log(make_log):
    doc = {
        "layers": [{"id": "L.1"}],
        "views": [{"name": "V", "layer_weights": {"L.1": 1.0}}],
        "derived_attributes": RECIPES,
        "constraints": [
            {"id": "c_times", "layer": "L.1", "type": "metric", "params": {"attribute": "times", "threshold": 0.0, "width": 1.0}, "applicability": {"attr": "share", "gt": 0}},
            {"id": "c_hands", "layer": "L.1", "type": "metric", "params": {"attribute": "hands", "threshold": 0, "width": 4}},
        ],
    }
    log = make_log(
        [("x", "A", "2024-01-01", "ann"), ("x", "B", "2024-01-02", "batch_1"), ("y", "A", "2024-01-01", "bob"), ("z", "A", "2024-01-01", " "), ("z", "A", None, None), ("z", "C", "2024-01-03", "Bob")],
        "`event org:res.` string",
    )
    n = norm.load_norm(doc)
    out = {r["case_id"]: r for r in norm.score(log, n, case_aggregates(log), ["n_events"]).collect()}
    # double: 4, 2, 6 with median 4; only x has a B.
    assert [(out[c]["hands"], out[c]["double"], out[c]["scaled"], out[c]["times"]) for c in "xyz"] == [(1, 4, 1.0, 1.0), (1, 2, 0.5, 0.0), (1, 6, 1.0, 0.0)]
    assert [out[c]["v__c_times"] for c in "xyz"] == [1.0, 0.0, 0.0] and out["x"]["score__V"] == pytest.approx(1 - 0.5 - 0.5 * 0.25)
    broken = norm.load_norm({**doc, "derived_attributes": [{"name": "times", "kind": "ratio", "numerator": "nowhere", "denominator": "n_events"}]})
    with pytest.raises(ValueError, match="nowhere"):
        norm.score(log, broken, case_aggregates(log), [])


@pytest.fixture(scope="module")
def odd(make_log):
    rows = [(f"c{i}", a, f"2024-01-{1 + i % 20:02d} 0{j}:00:00", f"v{i % 3}", float(i), "x`y") for i in range(40) for j, a in enumerate(["A", "B", "C"][: 1 + i % 3])]
    log = make_log(rows, "`a.b` string", "`net.worth (EUR)` double", "`q``t` string")
    doc = {
        "layers": ["L.1", "L`2"],
        "views": [{"name": "V.1", "layer_weights": {"L.1": 0.7, "L`2": 0.3}}, {"name": "W", "constraint_weights": {"c.1": 1}}],
        "constraints": [
            {"id": "c.1", "layer": "L.1", "type": "presence", "params": {"activity": ["C"]}, "applicability": {"a.b": ["v1", "v2"]}},
            {"id": "c`2", "layer": "L`2", "type": "lag", "params": {"a": "A", "b": "B", "delta": 0.01, "width": 0.1, "activation": "each"}},
            {"id": "m.3", "layer": "L`2", "type": "metric", "params": {"attribute": "net.worth (EUR)", "threshold": 3, "width": 5}},
            {"id": "b.4", "layer": "L`2", "type": "balance", "params": {"attr_x": "net.worth (EUR)", "attr_y": "net.worth (EUR)"}},
            {"id": "s.5", "layer": "L.1", "type": "singularity", "params": {"activity": "B", "k": 1, "K": 1, "after": "A"}},
        ],
    }
    n = norm.load_norm(doc)
    aggs = case_aggregates(log, attributes=["a.b", "q`t", "net.worth (EUR)"], exposure="net.worth (EUR)", exposure_agg="first")
    scored = store(norm.score(log, n, aggs, ["n_events", "first_ts", "last_ts", "exposure", "a.b", "q`t"]))
    return log, n, aggs, scored


def test_reports_with_odd_names(odd):
    log, n, aggs, scored = odd
    keys, here = ["a.b", "q`t"], F.col("`a.b`") == "v1"
    table = backlog.backlog(scored, keys, "V.1", gamma=20)
    assert {r["a.b"] for r in table.collect()} == {"v0", "v1", "v2"}
    assert backlog.layer_drivers(scored, keys, "V.1", n).count() == 3
    assert backlog.constraint_drivers(scored, n, "V.1", here).count() == 5
    assert backlog.top_constraint(scored, keys, "V.1", n).count() == 3
    assert backlog.problem_kind(table, keys).count() == backlog.concentration(table, keys).count() == 3
    assert backlog.problem_kinds(scored, keys, ["V.1", "W"]).count() == 3
    assert backlog.view_agreement(scored, keys, ["V.1", "W"]).count() == 1
    assert backlog.top_k_overlap(table, table, keys, 3).count() == 1
    assert backlog.slicing_preview(scored, keys).count() == 1 and backlog.grouping_options(scored, keys).count() == 2
    assert backlog.worst_cases(scored, n, "V.1", 5, here).count() > 0
    assert norm.run_summary(scored, n).count() > 0 and norm.long_form(scored, n, "V.1", keys).count() == 200
    assert explain.contrast(scored, n, "V.1", here).count() == 5
    assert explain.headroom(scored, n, "V.1", here).count() == 5 and explain.headroom_by(scored, n, keys, "V.1").count() == 15
    assert uncertainty.bootstrap_backlog(scored, keys, "V.1", replicates=5, cluster="a.b").count() == 3
    assert uncertainty.sensitivity(norm.gather(log, uncertainty.scaled_norm(n), aggs), scored, n, "V.1", keys)[0].count() == 3
    assert profile.attribute_inventory(scored, keys).count() == 2


def test_case_tables_with_odd_names(odd):
    log = odd[0]
    row = build_cases(log, attributes=["a.b", "q`t"], exposure="net.worth (EUR)", exposure_agg="last").where("case_id = 'c4'").first()
    assert (row["a.b"], row["q`t"], row["exposure"]) == ("v1", "x`y", 4.0)


def test_all_each_lags_take_one_pass(make_log):
    """Three lags over each activation, two of them waiting for the same label, equal the lags one by one."""
    rows = [(f"c{i % 7}", "ABCD"[(i * 5) % 4], None if i % 11 == 0 else f"2024-01-{1 + i % 23:02d} 0{i % 9}:00:00") for i in range(160)]
    log = make_log(rows)
    lag = lambda cid, a, b, **more: {"id": cid, "layer": "L", "type": "lag", "params": {"a": a, "b": b, "delta": 1, "width": 9, "activation": "each", **more}}
    lags = [lag("ab", "A", "B"), lag("cb", ["C", "D"], "B", missing_b="skip"), lag("bd", "B", ["D", "A"], unit="h")]
    score = lambda some: norm.gather(log, norm.load_norm({"layers": ["L"], "constraints": some}), case_aggregates(log))
    together = score(lags)
    plan = together._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1
    got = {r["case_id"]: r for r in together.collect()}
    for one in lags:
        for r in score([one]).collect():
            for c in ("each__", "eachv__"):
                assert got[r["case_id"]][c + one["id"]] == r[c + one["id"]]
    stamps = {}
    for c, a, t in rows:
        stamps.setdefault(c, []).append((t, a))
    import datetime as dt

    for c, events in stamps.items():
        dated = [(dt.datetime.fromisoformat(t), a) for t, a in events if t]
        waits = [min((u - t for u, b in dated if b == "B" and u >= t), default=None) for t, a in dated if a == "A"]
        days = [w / dt.timedelta(days=1) for w in waits if w is not None]
        assert got[c]["each__ab"] == (pytest.approx(sum(days) / len(days)) if days else None)
