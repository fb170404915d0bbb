"""Event preparation, case table, derived attributes and flow typing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import join_on
from ..operators import cases as C
from ..operators import flow, prepare
from .base import (
    CENSOR_DAYS,
    WINDOW_END,
    aggregates_o,
    cases_o,
    cte,
    log_o,
    log_w,
    log_wd,
    register,
    stamps,
    stored,
)


def window_end():
    return F.lit(WINDOW_END).cast("timestamp_ntz")


@register(
    "C1_case_table",
    "SELECT case_id, n_events, first_ts, last_ts, exposure, priority, status, segment, nation FROM co",
    doubles="exposure",
    with_=["co"],
)
def _(spark, d):
    return cases_o(spark, d)


@register(
    "C1_exposure_kinds",
    "SELECT case_id, max(value) AS x_max, sum(value) AS x_sum, min(value) AS x_min, avg(value) AS x_mean, arg_min(value, (ts, seq)) AS x_first,"
    " arg_max(value, (ts, seq)) AS x_last FROM w GROUP BY case_id",
    doubles="x_max x_sum x_min x_mean x_first x_last",
    with_=["w"],
)
def _(spark, d):
    w = log_w(spark, d)
    kinds = {f"x_{k}": C.case_aggregates(w, exposure="value", exposure_agg=k)["exposure"] for k in C.EXPOSURE}
    return w.groupBy("case_id").agg(*[c.alias(n) for n, c in kinds.items()])


@register(
    "C2_exact_duplicates",
    "SELECT case_id, activity, ts, min(seq) AS seq, value, k, resource FROM wd GROUP BY case_id, activity, ts, value, k, resource",
    doubles="value",
    with_=["wd"],
)
def _(spark, d):
    return prepare.drop_exact_duplicates(log_wd(spark, d))


@register(
    "C3_key_duplicates",
    "SELECT case_id, activity, ts, seq, value, k, resource FROM (SELECT *, row_number() OVER (PARTITION BY case_id, activity, ts ORDER BY seq) AS r FROM wd) WHERE r = 1",
    doubles="value",
    with_=["wd"],
)
def _(spark, d):
    return prepare.drop_key_duplicates(log_wd(spark, d))


@register(
    "C4_outside_window",
    "SELECT * FROM wd WHERE ts IS NULL OR (ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-25')",
    doubles="value",
    with_=["wd"],
)
def _(spark, d):
    start, end = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-02", "2024-01-25"))
    return prepare.drop_outside_window(log_wd(spark, d), start, end)


@register(
    "C5_sentinel_as_missing",
    "SELECT * REPLACE (CASE WHEN ts = TIMESTAMP '1900-01-01' AND activity IN ('error', 'view') THEN NULL ELSE ts END AS ts) FROM wd",
    doubles="value",
    with_=["wd"],
)
def _(spark, d):
    return prepare.placeholder_as_missing(log_wd(spark, d), ["1900-01-01"], ["error", "view"])


@register(
    "C6_exclude_cases",
    "SELECT case_id, count(*) AS n_events FROM o WHERE case_id NOT IN (SELECT case_id FROM co WHERE (n_ship = 0 AND last_ts > TIMESTAMP '2001-06-02')"
    " OR coalesce(exposure, 0) <= 10000) GROUP BY case_id",
    with_=["o", "co"],
)
def _(spark, d):
    events = log_o(spark, d)
    ship = F.count_if(F.col("activity") == "Ship item")
    cases = C.build_cases(events, {"n_ship": ship}, exposure="exposure")
    open_ = C.right_censored(F.col("n_ship"), window_end(), CENSOR_DAYS)
    dropped = cases.where(open_ | (F.coalesce("exposure", F.lit(0.0)) <= 10000))
    return C.exclude_cases(events, dropped).groupBy("case_id").agg(F.count(F.lit(1)).alias("n_events"))


_C7 = {
    "drop_outside_window": "ts < TIMESTAMP '2024-01-02' OR ts > TIMESTAMP '2024-01-25'",
    "sentinel_as_missing": "ts = TIMESTAMP '1900-01-01'",
    "day_precision": "activity IN ('click')",
    "header_events": "activity IN ('signup')",
}


@register(
    "C7_decision_preview",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{k}' AS decision, count(*) FILTER (WHERE h > 0) AS cases, CAST(sum(h) AS BIGINT) AS events,"
        f" count(*) FILTER (WHERE h > 0 AND h = n) AS cases_emptied FROM (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE {c}) AS h FROM wd GROUP BY case_id)"
        for k, c in _C7.items()
    )
    + " UNION ALL SELECT 'open_cases', count(*), CAST(coalesce(sum(n), 0) AS BIGINT), count(*) FROM (SELECT case_id, count(*) AS n, max(ts) AS l, count(*) FILTER (WHERE activity = 'purchase') AS p"
    " FROM wd GROUP BY case_id) WHERE p < 10 AND l > TIMESTAMP '2024-01-29'"
    " UNION ALL SELECT 'zero_exposure', count(*), CAST(coalesce(sum(n), 0) AS BIGINT), count(*) FROM (SELECT case_id, count(*) AS n, sum(value) AS v FROM wd GROUP BY case_id) WHERE v <= 400)",
    with_=["wd"],
)
def _(spark, d):
    events = log_wd(spark, d)
    start, end = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-02", "2024-01-25"))
    masks = {
        "drop_outside_window": prepare.outside_window(start, end),
        "sentinel_as_missing": prepare.placeholder(["1900-01-01"]),
        "day_precision": F.col("activity").isin("click"),
        "header_events": F.col("activity").isin("signup"),
    }
    cases = C.build_cases(events, {"n_buy": F.count_if(F.col("activity") == "purchase")}, exposure="value", exposure_agg="sum")
    late = F.col("last_ts") > F.lit("2024-01-29").cast("timestamp_ntz")
    case_masks = {"open_cases": (F.col("n_buy") < 10) & late, "zero_exposure": F.col("exposure") <= 400}
    return prepare.decision_preview(events, cases, masks, case_masks)


@register(
    "C7_duplicate_preview",
    "SELECT 'collapse_duplicates' AS decision, count(*) FILTER (WHERE x > 0) AS cases, CAST(sum(x) AS BIGINT) AS events,"
    " (SELECT CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM wd GROUP BY case_id, activity, ts)) AS key_collisions"
    " FROM (SELECT case_id, sum(c - 1) AS x FROM (SELECT case_id, count(*) AS c FROM wd GROUP BY case_id, activity, ts, value, k, resource) GROUP BY case_id)",
    with_=["wd"],
)
def _(spark, d):
    return prepare.duplicate_preview(log_wd(spark, d))


FLOW_RULES = [
    {"name": "large", "rule": {"attr": "exposure", "gte": 400000}},
    {"name": "open line", "rule": {"kind": "attribute", "field": "linestatus", "eq": "O"}},
    {"name": "returned", "rule": {"and": [{"kind": "activity", "activity": "Return item"}, {"kind": "count", "activity": "Ship item", "max": 1}]}},
    {"name": "never", "rule": {"kind": "attribute", "field": "segment", "in": ["no such segment"]}},
]
cte(
    "ft_o",
    "SELECT c.*, CASE WHEN exposure >= 400000 THEN 'large' WHEN f.open_line THEN 'open line' WHEN n_return > 0 AND n_ship <= 1 THEN 'returned'"
    " ELSE 'standard' END AS flow_type, (n_ship = 0 AND last_ts > TIMESTAMP '2001-06-02') AS censored FROM co c JOIN"
    " (SELECT case_id, bool_or(coalesce(linestatus = 'O', FALSE)) AS open_line FROM o GROUP BY case_id) f USING (case_id)",
    "co",
    "o",
)


def typed_o(spark, d):
    """The case table with flow types, written once."""
    return stored(spark, d, "typed", make_typed_o)


def make_typed_o(spark, d):
    events = log_o(spark, d)
    aggs = {**aggregates_o(events), "n_ship": F.count_if(F.col("activity") == "Ship item")}
    cases = C.flow_types(events, FLOW_RULES, "standard", aggs)
    cases = join_on(cases, stamps(log_o(spark, d, False)), ["case_id"], "left")
    return cases.withColumn("censored", C.right_censored(F.col("n_ship"), window_end(), CENSOR_DAYS))


def only_types(spark, d):
    """The flow types alone, not stored, so that aggregates which no rule reads are never made."""
    return make_typed_o(spark, d).select("case_id", "flow_type")


@register("C8_flow_types", "SELECT case_id, flow_type FROM ft_o", with_=["ft_o"])
def _(spark, d):
    return only_types(spark, d)


@register(
    "C8_assignment_preview",
    "SELECT t AS flow_type, count(*) AS cases, count(*) FILTER (WHERE t <> flow_type) AS changed_cases, CAST(coalesce(sum(n_events) FILTER (WHERE t <> flow_type), 0) AS BIGINT) AS changed_events FROM"
    " (SELECT *, CASE WHEN n_return > 0 AND n_ship <= 1 THEN 'returned' ELSE 'standard' END AS t FROM ft_o) GROUP BY 1",
    with_=["ft_o"],
)
def _(spark, d):
    events = log_o(spark, d)
    after = C.flow_types(events, [FLOW_RULES[2]], "standard", {"n_events": F.count(F.lit(1))})
    return C.assignment_preview(only_types(spark, d), after)


@register(
    "C9_date_difference",
    "SELECT case_id, (epoch_us(max(ts) FILTER (WHERE activity = 'purchase')) - epoch_us(min(ts) FILTER (WHERE activity = 'signup'))) / 3600000000.0 AS hours,"
    " (epoch_us(date_trunc('day', max(ts))) - epoch_us(date_trunc('day', min(ts)))) / 86400000000.0 AS days FROM w GROUP BY case_id",
    doubles="hours days",
    with_=["w"],
)
def _(spark, d):
    w = log_w(spark, d)
    cases = C.build_cases(w, {"t_buy": C.stamp(["purchase"], "last"), "t_sign": C.stamp(["signup"])})
    return cases.select(
        "case_id",
        C.date_difference(F.col("t_buy"), F.col("t_sign"), "h").alias("hours"),
        C.date_difference(F.col("last_ts"), F.col("first_ts"), "D", date_part=True).alias("days"),
    )


@register(
    "C10_period_labels",
    "SELECT case_id, strftime(first_ts, '%Y') AS y, strftime(first_ts, '%Y') || '-Q' || quarter(first_ts) AS q, strftime(t_ship, '%Y-%m') AS m FROM co",
    with_=["co"],
)
def _(spark, d):
    cases = C.build_cases(log_o(spark, d, False), {"t_ship": C.stamp(["Ship item"])})
    return cases.select(
        "case_id",
        C.period_attribute(F.col("first_ts"), "year").alias("y"),
        C.period_attribute(F.col("first_ts"), "quarter").alias("q"),
        C.period_attribute(F.col("t_ship"), "month").alias("m"),
    )


@register("C11_alias", "SELECT case_id, n_events, n_events AS touches FROM co", with_=["co"])
def _(spark, d):
    return C.alias_attribute(cases_o(spark, d), "n_events", "touches").select("case_id", "n_events", "touches")


RECIPES = {
    "n_moves": {"kind": "count", "activities": ["Ship item", "Return item"]},
    "n_items": {"kind": "count_events", "where": "(?i)^(?!place).*ITEM$"},
    "n_suppliers": {"kind": "nunique", "column": "resource", "where": "item"},
    "price_cv": {"kind": "cv", "column": "amount", "where": "item"},
    "returned_value": {"kind": "indicator_times", "activities": ["Return item"], "attribute": "exposure"},
    "per_move": {"kind": "ratio", "numerator": "exposure", "denominator": "n_moves"},
    "rework": {"kind": "eval", "expr": "n_events - n_suppliers - 1"},
    "size_scale": {"kind": "quantile_scale", "attribute": "exposure", "q": 0.95},
}


@register(
    "C12_header_count",
    "SELECT case_id, count(*) FILTER (WHERE activity IN ('Ship item', 'Return item')) AS n_moves FROM o GROUP BY case_id",
    with_=["o"],
)
def _(spark, d):
    return C.build_cases(log_o(spark, d, False), C.recipe_aggregates({"n_moves": RECIPES["n_moves"]})).select("case_id", "n_moves")


@register(
    "C13_recipes",
    "SELECT *, CASE WHEN n_moves <> 0 THEN exposure / n_moves END AS per_move, n_events - n_suppliers - 1 AS rework,"
    " least(exposure / (SELECT quantile_cont(exposure, 0.95) FROM co), 1) AS size_scale FROM (SELECT case_id, max(exposure) AS exposure, count(*) AS n_events,"
    " count(*) FILTER (WHERE activity <> 'Place order') AS n_moves, count(*) FILTER (WHERE activity <> 'Place order') AS n_items,"
    " count(DISTINCT resource) FILTER (WHERE activity <> 'Place order') AS n_suppliers,"
    " stddev_samp(amount) FILTER (WHERE activity <> 'Place order') / avg(amount) FILTER (WHERE activity <> 'Place order') AS price_cv,"
    " CASE WHEN count(*) FILTER (WHERE activity = 'Return item') > 0 THEN max(exposure) ELSE 0 END AS returned_value FROM o GROUP BY case_id)",
    doubles="exposure price_cv returned_value per_move size_scale",
    with_=["o", "co"],
)
def _(spark, d):
    cases = C.build_cases(log_o(spark, d, False), C.recipe_aggregates(RECIPES), exposure="exposure")
    out = C.recipe_columns(cases, RECIPES)
    return out.select("case_id", "exposure", "n_events", *RECIPES)


@register(
    "C14_calendar_fields",
    "SELECT case_id, strftime(first_ts, '%Y-%m') AS start_month, strftime(first_ts, '%Y') AS start_year,"
    " (epoch_us(last_ts) - epoch_us(first_ts)) / 86400000000.0 AS recorded_span_days FROM co",
    doubles="recorded_span_days",
    with_=["co"],
)
def _(spark, d):
    out = C.calendar_fields(cases_o(spark, d))
    return out.select("case_id", "start_month", "start_year", "recorded_span_days")


@register(
    "C15_attach_case_values",
    "SELECT o.case_id, o.activity, o.ts, f.flow_type, count(*) AS n FROM o JOIN ft_o f USING (case_id) GROUP BY ALL",
    with_=["o", "ft_o"],
)
def _(spark, d):
    out = C.attach(log_o(spark, d, False), only_types(spark, d), ["flow_type"])
    return out.groupBy("case_id", "activity", "ts", "flow_type").agg(F.count(F.lit(1)).alias("n"))


@register(
    "C16_scope_log",
    "SELECT activity, count(*) AS n FROM o WHERE case_id IN (SELECT case_id FROM ft_o WHERE flow_type = 'returned' AND segment = 'BUILDING') GROUP BY activity",
    with_=["o", "ft_o"],
)
def _(spark, d):
    cases = typed_o(spark, d).where((F.col("flow_type") == "returned") & (F.col("segment") == "BUILDING"))
    return C.scope_log(log_o(spark, d, False), cases).groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


@register(
    "C17_flow_type_summary",
    "SELECT flow_type, count(*) AS cases, CAST(sum(n_events) AS BIGINT) AS events, avg(CAST(censored AS INT)) AS censored_share,"
    " avg(CAST(n_events / n_stamps > 2.0 AS INT)) AS replicated_share, count(*) / (SELECT count(*) FROM ft_o) AS share,"
    " quantile_cont((epoch_us(last_ts) - epoch_us(first_ts)) / 86400000000.0, 0.5) AS median_days FROM ft_o GROUP BY flow_type",
    doubles="censored_share replicated_share share median_days",
    with_=["ft_o"],
)
def _(spark, d):
    return C.flow_type_summary(typed_o(spark, d))


@register(
    "C17_flow_type_graph",
    "SELECT flow_type, activity AS source, nxt AS target, count(*) AS n, count(DISTINCT case_id) AS cases,"
    " quantile_cont((epoch_us(nts) - epoch_us(ts)) / 3600000000.0, 0.5) AS median_hours FROM (SELECT o.case_id, f.flow_type, o.activity, o.ts,"
    " lead(o.activity) OVER x AS nxt, lead(o.ts) OVER x AS nts FROM o JOIN ft_o f USING (case_id)"
    " WINDOW x AS (PARTITION BY o.case_id ORDER BY o.ts, o.seq)) WHERE nxt IS NOT NULL GROUP BY ALL",
    doubles="median_hours",
    with_=["o", "ft_o"],
)
def _(spark, d):
    events = C.attach(log_o(spark, d, False), typed_o(spark, d), ["flow_type"])
    return flow.edges(flow.sequence(events, ["flow_type"]), ["flow_type"])


@register(
    "C18_closure_diagnostics",
    "SELECT total_cases, applicable_cases, not_applicable_cases, total_cases - applicable_cases - not_applicable_cases AS unknown_cases,"
    " closure_observed, applicable_cases - closure_observed AS closure_not_observed, undated_cases, applicable_cases - undated_cases AS measurable_cases,"
    " recent_unclosed, recent_unclosed / (applicable_cases - undated_cases) AS recent_unclosed_share FROM (SELECT count(*) AS total_cases,"
    " count(*) FILTER (WHERE status IN ('F', 'O')) AS applicable_cases, count(*) FILTER (WHERE status = 'P' AND segment = 'BUILDING') AS not_applicable_cases,"
    " count(*) FILTER (WHERE status IN ('F', 'O') AND n_ship > 0) AS closure_observed, count(*) FILTER (WHERE status IN ('F', 'O') AND last_ts IS NULL) AS undated_cases,"
    " count(*) FILTER (WHERE status IN ('F', 'O') AND n_ship = 0 AND last_ts > TIMESTAMP '2001-06-02') AS recent_unclosed FROM co)",
    doubles="recent_unclosed_share",
    with_=["co"],
)
def _(spark, d):
    cases = typed_o(spark, d)
    return C.closure_diagnostics(
        cases,
        F.col("status").isin("F", "O"),
        (F.col("status") == "P") & (F.col("segment") == "BUILDING"),
        F.col("n_ship") > 0,
        F.col("censored"),
    )


@register(
    "C19_header_replication",
    "SELECT count(*) AS header_events, avg(CAST(k > 1 AS INT)) AS replicated_share FROM o JOIN (SELECT activity, ts, count(DISTINCT case_id) AS k FROM o GROUP BY ALL) g"
    " USING (activity, ts) WHERE activity IN ('Return item')",
    doubles="replicated_share",
    with_=["o"],
)
def _(spark, d):
    return C.header_replication(log_o(spark, d, False), ["Return item"])


@register(
    "C20_absent_flow_types",
    "SELECT flow_type FROM (VALUES ('large'), ('open line'), ('returned'), ('never')) AS t(flow_type) WHERE flow_type NOT IN (SELECT flow_type FROM ft_o)",
    with_=["ft_o"],
)
def _(spark, d):
    return C.absent_flow_types(typed_o(spark, d), [r["name"] for r in FLOW_RULES])
