"""Every clause of the filter grammar, its complements and previews."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import cases as C
from ..operators import eda, filters
from ..operators.norm import applies, count_name
from .base import CENSOR_DAYS, WINDOW_END, aggregates_o, case_table_o, log_o, log_wd, norm_o, register
from .eda import REQUEST, marked_sql

# Clause -> the condition it must equal, over one row per case of log o.
CLAUSES = {
    "F1_time_start": (
        {"kind": "time", "field": "case_start", "from": "1996-01-01", "to": "1997-06-30T00:00:00"},
        "first_ts >= TIMESTAMP '1996-01-01' AND first_ts <= TIMESTAMP '1997-06-30'",
    ),
    "F1_time_end": ({"kind": "time", "field": "case_end", "from": "2001-01-01"}, "last_ts >= TIMESTAMP '2001-01-01'"),
    "F2_attribute_in": ({"kind": "attribute", "field": "segment", "in": ["BUILDING", "(missing)"]}, "segment = 'BUILDING' OR segment IS NULL"),
    "F2_attribute_eq": ({"kind": "attribute", "field": "status", "eq": "F"}, "status = 'F'"),
    "F2_attribute_bounds": (
        {"kind": "attribute", "field": "exposure", "min": 100000, "max": 200000},
        "exposure >= 100000 AND exposure <= 200000",
    ),
    "F3_activity_contains": ({"kind": "activity", "op": "contains", "activity": ["Return item"]}, "n_return > 0"),
    "F3_activity_never": ({"kind": "activity", "op": "never", "activity": "Return item"}, "n_return = 0"),
    "F4_starts_with": (
        {"kind": "activity", "op": "starts_with", "activity": "Place order"},
        "(SELECT arg_min(activity, (ts, seq)) FROM o WHERE o.case_id = co.case_id) = 'Place order'",
    ),
    "F4_ends_with": (
        {"kind": "activity", "op": "ends_with", "activity": ["Return item"]},
        "(SELECT arg_max(activity, (ts, seq)) FROM o WHERE o.case_id = co.case_id) = 'Return item'",
    ),
    "F5_directly_follows": (
        {"kind": "follows", "a": "Place order", "b": ["Ship item"], "directly": True},
        "case_id IN (SELECT case_id FROM nx WHERE activity = 'Place order' AND nxt = 'Ship item')",
    ),
    "F5_never_directly_follows": (
        {"kind": "follows", "a": "Place order", "b": ["Ship item"], "directly": True, "never": True},
        "case_id NOT IN (SELECT case_id FROM nx WHERE activity = 'Place order' AND nxt = 'Ship item')",
    ),
    "F6_eventually_follows": (
        {"kind": "follows", "a": "Place order", "b": "Return item"},
        "case_id IN (SELECT b.case_id FROM o b JOIN co c USING (case_id) WHERE b.activity = 'Return item' AND b.ts >= c.t_place)",
    ),
    "F6_never_eventually_follows": (
        {"kind": "follows", "a": "Place order", "b": "Return item", "never": True},
        "case_id NOT IN (SELECT b.case_id FROM o b JOIN co c USING (case_id) WHERE b.activity = 'Return item' AND b.ts >= c.t_place)",
    ),
    "F7_lag": (
        {"kind": "lag", "a": "Place order", "b": ["Ship item", "Return item"], "unit": "D", "min": 30, "max": 200},
        "case_id IN (SELECT b.case_id FROM o b JOIN co c USING (case_id) WHERE b.activity <> 'Place order' AND b.ts >= c.t_place GROUP BY b.case_id, c.t_place"
        " HAVING (epoch_us(min(b.ts)) - epoch_us(c.t_place)) / 86400000000.0 BETWEEN 30 AND 200)",
    ),
    "F8_count": ({"kind": "count", "activity": ["Ship item", "Return item"], "min": 2, "max": 4}, "n_ship + n_return BETWEEN 2 AND 4"),
    "F9_open": ({"kind": "open", "value": True}, "n_ship = 0 AND last_ts > TIMESTAMP '2001-06-02'"),
    "F9_not_open": ({"kind": "open", "value": False}, "NOT (n_ship = 0 AND last_ts > TIMESTAMP '2001-06-02')"),
}
NEXT = "nx AS (SELECT case_id, activity, lead(activity) OVER (PARTITION BY case_id ORDER BY ts, seq) AS nxt FROM o)"


def resolved(spark, d, clauses):
    events = log_o(spark, d)
    aggs = {**aggregates_o(events), "n_ship": F.count_if(F.col("activity") == "Ship item")}
    out = filters.resolve(events, clauses, aggs)
    return out.withColumn("censored", C.right_censored(F.col("n_ship"), F.lit(WINDOW_END).cast("timestamp_ntz"), CENSOR_DAYS))


def _register(name: str, clause: dict, condition: str) -> None:
    @register(name, f"SELECT * FROM (WITH {NEXT} SELECT case_id, coalesce({condition}, FALSE) AS selected FROM co)", with_=["o", "co"])
    def _(spark, d):
        parsed = filters.check(filters.parse(json.dumps(clause)))
        cases = resolved(spark, d, parsed)
        return cases.select("case_id", filters.case_clause(parsed[0]).alias("selected"))


for _name, (_clause, _condition) in CLAUSES.items():
    _register(_name, _clause, _condition)


@register(
    "F4_first_label_skips_null",
    "SELECT case_id, coalesce(arg_min(activity, CASE WHEN ts IS NULL THEN (1, TIMESTAMP '2000-01-01', seq) ELSE (0, ts, seq) END)"
    " FILTER (WHERE activity IS NOT NULL) IN ('view', 'view page'), FALSE) AS selected FROM wd GROUP BY case_id",
    with_=["wd"],
)
def _(spark, d):
    clause = {"kind": "activity", "op": "starts_with", "activity": ["view", "view page"]}
    cases = filters.resolve(log_wd(spark, d), [clause], {"n_events": F.count(F.lit(1))})
    return cases.select("case_id", filters.case_clause(clause).alias("selected"))


F10 = ("F2_attribute_eq", "F3_activity_contains", "F8_count", "F6_eventually_follows")


@register(
    "F10_conjunction",
    "SELECT case_id, coalesce(" + " AND ".join(f"({CLAUSES[n][1]})" for n in F10) + ", FALSE) AS selected FROM co",
    with_=["o", "co"],
)
def _(spark, d):
    events = log_o(spark, d)
    return filters.select_cases(events, {"and": [CLAUSES[n][0] for n in F10]}, aggregates_o(events)).select("case_id", "selected")


def _preview_sql() -> str:
    conds = [f"coalesce({CLAUSES[n][1]}, FALSE)" for n in F10]
    cols = ", ".join(f"{c} AS m{i}" for i, c in enumerate(conds))
    every = " AND ".join(f"m{i}" for i in range(len(conds)))
    parts = [
        f"SELECT 'cases_in' AS measure, '' AS item, count(*) FILTER (WHERE {every}) AS cases FROM t",
        f"SELECT 'cases_out', '', count(*) FILTER (WHERE NOT ({every})) FROM t",
    ]
    for i in range(len(conds)):
        others = " AND ".join(f"m{j}" for j in range(len(conds)) if j != i)
        parts.append(f"SELECT 'kept_alone', '{i}', count(*) FILTER (WHERE m{i}) FROM t")
        parts.append(f"SELECT 'removed_marginally', '{i}', count(*) FILTER (WHERE {others} AND NOT m{i}) FROM t")
    parts.append(f"SELECT 'in_scope', 'c_noret', count(*) FILTER (WHERE {every} AND status IN ('F', 'O')) FROM t")
    parts.append(f"SELECT 'in_scope', 'c_over', count(*) FILTER (WHERE {every} AND segment IN ('BUILDING', 'MACHINERY')) FROM t")
    return f"SELECT * FROM (WITH t AS (SELECT *, {cols} FROM co) {' UNION ALL '.join(parts)})"


@register("F11_preview", _preview_sql(), with_=["o", "co"])
def _(spark, d):
    clauses = [CLAUSES[n][0] for n in F10]
    norm = norm_o()
    scopes = {c: applies(norm.constraint(c).applicability) for c in ("c_noret", "c_over")}
    return filters.preview(resolved(spark, d, clauses), clauses, scopes)


@register(
    "F12_slice_mask",
    "SELECT case_id, (priority = '5-LOW' OR priority = '1-URGENT') AND segment = 'BUILDING' AS inside FROM co",
    with_=["co"],
)
def _(spark, d):
    mask = filters.slice_mask({"priority": ["5-LOW", "1-URGENT"], "segment": "BUILDING"})
    return case_table_o(spark, d).select("case_id", mask.alias("inside"))


RULES = {
    "short": ({"segment": ["BUILDING", "FURNITURE"]}, "segment IN ('BUILDING', 'FURNITURE')"),
    "eq_ne": ({"all": [{"attr": "status", "eq": "F"}, {"attr": "segment", "ne": "BUILDING"}]}, "status = 'F' AND segment <> 'BUILDING'"),
    "bounds": ({"attr": "exposure", "gt": 100000, "lte": 300000}, "exposure > 100000 AND exposure <= 300000"),
    "not_in": ({"attr": "priority", "not_in": ["1-URGENT", "2-HIGH"]}, "priority NOT IN ('1-URGENT', '2-HIGH')"),
    "known": ({"attr": "segment", "notna": True}, "segment IS NOT NULL"),
    "has": ({"any": [{"has": "Return item"}, {"not": {"lacks": ["Ship item"]}}]}, "n_return > 0 OR n_ship > 0"),
    "deep": (
        {"all": [{"any": [{"attr": "status", "in": ["O"]}, {"lacks": "Return item"}]}, {"not": {"attr": "exposure", "lt": 50000}}]},
        "(status = 'O' OR n_return = 0) AND NOT exposure < 50000",
    ),
}


@register("F13_applicability", "SELECT case_id, " + ", ".join(f"coalesce({c}, FALSE) AS {n}" for n, (_, c) in RULES.items()) + " FROM co", with_=["co"])
def _(spark, d):
    events = log_o(spark, d)
    counts = {count_name([a]): F.count_if(F.col("activity") == a) for a in ("Ship item", "Return item")}
    cases = C.build_cases(events, {**counts, **{k: v for k, v in aggregates_o(events).items()}})
    return cases.select("case_id", *[applies(rule).alias(n) for n, (rule, _) in RULES.items()])


@register("F14_exploratory_predicates", f"SELECT * FROM ({marked_sql()} SELECT case_id, selected FROM marked)", with_=["co"])
def _(spark, d):
    cases = eda.with_keys(eda.prepared(case_table_o(spark, d)), ["nation", "segment"])
    return eda.mark(cases, REQUEST).select("case_id", "selected")
