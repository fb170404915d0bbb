"""Linked exploratory aggregates on the case tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cases as C
from ..operators import eda
from ..session import store
from .base import case_table_o, cte, log_o, log_wd, register

# A selection with every kind of part.
REQUEST = {
    "facets": [{"field": "segment", "keys": ["v1", "v2", "v3", "v4"], "values": ["no such"]}],
    "joint_any": [
        [{"field": "nation", "keys": ["v1", "other"]}, {"field": "segment", "keys": ["v1", "v2"]}],
        [{"field": "segment", "values": ["BUILDING", "MACHINERY"]}],
        [{"field": "nation", "keys": ["v2", "v3", "v4", "v5", "v6"]}],
    ],
    "numeric": [{"field": "exposure", "ranges": [[20000, 200000], [250000, None]], "missing": True}],
    "event_ranges": [[2, 8], [9, None]],
    "span_ranges": [[10, 2000]],
    "span_missing": True,
    "time_ranges": [[None, "1998-01-01"], ["1998-03-01", None]],
}


def _domain_sql(name: str, field: str, source: str = "co") -> str:
    return (
        f"{name} AS (SELECT category, n, 'v' || row_number() OVER (ORDER BY n DESC, category) AS key FROM (SELECT {field} AS category, count(*) AS n"
        f" FROM {source} WHERE {field} IS NOT NULL AND {field} NOT IN ('', '(missing)') AND length({field}) <= 512 GROUP BY 1 ORDER BY n DESC, category LIMIT 20))"
    )


def _key_sql(alias: str, field: str) -> str:
    return f"CASE WHEN {field} IS NULL OR {field} IN ('', '(missing)') THEN 'missing' ELSE coalesce({alias}.key, 'other') END"


def marked_sql() -> str:
    """CTEs ending in ``marked``: one row per case with keys and the selected flag."""
    keyed = (
        f"keyed AS (SELECT CAST(c.case_id AS VARCHAR) AS case_id, c.n_events AS events, c.first_ts, c.last_ts, c.exposure, c.segment, c.nation,"
        " CASE WHEN c.last_ts >= c.first_ts THEN (epoch_us(c.last_ts) - epoch_us(c.first_ts)) / 86400000000.0 END AS span_days,"
        f" {_key_sql('dn', 'c.nation')} AS key_nation, {_key_sql('ds', 'c.segment')} AS key_segment"
        " FROM co c LEFT JOIN dn ON c.nation = dn.category LEFT JOIN ds ON c.segment = ds.category)"
    )
    cond = (
        "(key_segment IN ('v1', 'v2', 'v3', 'v4') OR segment IN ('no such')) AND ((key_nation IN ('v1', 'other') AND key_segment IN ('v1', 'v2'))"
        " OR segment IN ('BUILDING', 'MACHINERY') OR key_nation IN ('v2', 'v3', 'v4', 'v5', 'v6'))"
        " AND (exposure IS NULL OR (exposure >= 20000 AND exposure < 200000) OR exposure >= 250000)"
        " AND ((events >= 2 AND events < 8) OR events >= 9) AND (span_days IS NULL OR (span_days >= 10 AND span_days < 2000))"
        " AND (first_ts < TIMESTAMP '1998-01-01' OR first_ts >= TIMESTAMP '1998-03-01')"
    )
    return f"WITH {_domain_sql('dn', 'nation')}, {_domain_sql('ds', 'segment')}, {keyed}, marked AS (SELECT *, coalesce({cond}, FALSE) AS selected FROM keyed)"


def marked(spark, d):
    cases = eda.with_keys(eda.prepared(case_table_o(spark, d)), ["nation", "segment"])
    return store(eda.mark(cases, REQUEST))


def q(body: str) -> str:
    return f"SELECT * FROM ({marked_sql()} {body})"


def _ev(name: str, body: str, fn, doubles: str = "", decimals: int = 6, extra=()) -> None:
    register(name, q(body), doubles=doubles, decimals=decimals, with_=["co", *extra])(fn)


_ev(
    "D1_prepared",
    "SELECT case_id, events, first_ts, last_ts, span_days FROM marked",
    lambda s, d: eda.prepared(case_table_o(s, d)).select("case_id", "events", "first_ts", "last_ts", "span_days"),
    "span_days",
)
_ev("D2_category_domain", "SELECT category, n, key FROM dn", lambda s, d: eda.domain(case_table_o(s, d), "nation"))
_ev(
    "D2_category_keys",
    "SELECT case_id, key_nation, key_segment FROM marked",
    lambda s, d: eda.with_keys(eda.prepared(case_table_o(s, d)), ["nation", "segment"]).select(
        "case_id", F.col("key__nation").alias("key_nation"), F.col("key__segment").alias("key_segment")
    ),
)
_ev(
    "D3_totals",
    "SELECT count(*) AS cases_total, count(*) FILTER (WHERE selected) AS cases_selected, CAST(sum(events) AS BIGINT) AS events_total,"
    " CAST(sum(events) FILTER (WHERE selected) AS BIGINT) AS events_selected, count(span_days) FILTER (WHERE selected) AS known_spans,"
    " count(*) FILTER (WHERE selected AND span_days IS NULL) AS unknown_spans, count(*) FILTER (WHERE selected AND first_ts IS NULL) AS unknown_starts,"
    " min(first_ts) FILTER (WHERE selected) AS first, max(last_ts) FILTER (WHERE selected) AS last,"
    " median(span_days) FILTER (WHERE selected) AS median_span, quantile_cont(span_days, 0.9) FILTER (WHERE selected) AS p90_span FROM marked",
    lambda s, d: eda.totals(marked(s, d)),
    "median_span p90_span",
)
_ev(
    "D4_category_counts",
    "SELECT key_nation AS key, count(*) AS total, count(*) FILTER (WHERE selected) AS selected FROM marked GROUP BY 1",
    lambda s, d: eda.category_counts(marked(s, d), "nation"),
)
_ev(
    "D5_monthly_trend",
    "SELECT m.month::INTEGER AS month, coalesce(total, 0) AS total, coalesce(n.sel, 0) AS selected FROM (SELECT unnest(range(min(x), max(x) + 1)) AS month FROM"
    " (SELECT year(first_ts) * 12 + month(first_ts) - 1 AS x FROM marked)) m LEFT JOIN (SELECT year(first_ts) * 12 + month(first_ts) - 1 AS month, count(*) AS total,"
    " count(*) FILTER (WHERE selected) AS sel FROM marked GROUP BY 1) n USING (month)",
    lambda s, d: eda.trend(marked(s, d)),
)


def _sparse(spark, d):
    """The cases with every seventh start moved 40 years back, so that the calendar is too long."""
    m = marked(spark, d)
    old = F.timestamp_add("YEAR", F.lit(-40), F.col("first_ts"))
    return m.withColumn("first_ts", F.when(F.col("case_id").cast("bigint") % 7 == 0, old).otherwise(F.col("first_ts")))


_ev(
    "D5_trend_stride",
    "SELECT * FROM (WITH mm AS (SELECT (year(first_ts) - CASE WHEN CAST(case_id AS BIGINT) % 7 = 0 THEN 40 ELSE 0 END) * 12 + month(first_ts) - 1 AS month, selected FROM marked)"
    " SELECT CAST(b.m AS INTEGER) AS month, coalesce(c.total, 0) AS total, coalesce(c.sel, 0) AS selected FROM (WITH x AS (SELECT min(month) AS a, max(month) AS b FROM mm)"
    " SELECT unnest(range(a, b + 1, CAST(ceil((b - a + 1) / 120.0) AS BIGINT))) AS m FROM x) b LEFT JOIN (SELECT CAST(floor((month - a) / st) * st + a AS BIGINT) AS m,"
    " count(*) AS total, count(*) FILTER (WHERE selected) AS sel FROM mm, (SELECT min(month) AS a, CAST(ceil((max(month) - min(month) + 1) / 120.0) AS BIGINT) AS st FROM mm)"
    " GROUP BY 1) c USING (m))",
    lambda s, d: eda.trend(_sparse(s, d), eda.stride_for(_sparse(s, d), 120)),
)


def _cut_sql(col: str, cuts) -> str:
    whens = " ".join(f"WHEN {col} < {u} THEN '{i}'" for i, u in enumerate(cuts[1:]))
    return f"CASE WHEN {col} IS NULL THEN 'missing' {whens} ELSE '{len(cuts) - 1}' END"


def _hist_sql(col: str, cuts) -> str:
    return (
        f"SELECT k.key, coalesce(total, 0) AS total, coalesce(sel, 0) AS selected FROM (SELECT CAST(unnest(range({len(cuts)})) AS VARCHAR) AS key) k FULL JOIN"
        f" (SELECT {_cut_sql(col, cuts)} AS key, count(*) AS total, count(*) FILTER (WHERE selected) AS sel FROM marked GROUP BY 1) c USING (key)"
    )


_ev("D6_span_histogram", _hist_sql("span_days", eda.SPAN_CUTS), lambda s, d: eda.histogram(marked(s, d), "span_days", eda.SPAN_CUTS))
_ev("D6_event_histogram", _hist_sql("events", eda.EVENT_CUTS), lambda s, d: eda.histogram(marked(s, d), "events", eda.EVENT_CUTS))
_ev(
    "D7_joint_counts",
    "SELECT l.left_key, r.right_key, coalesce(total, 0) AS total, coalesce(sel, 0) AS selected FROM (SELECT key AS left_key FROM dn UNION ALL SELECT unnest(['other', 'missing'])) l"
    " CROSS JOIN (SELECT key AS right_key FROM ds UNION ALL SELECT unnest(['other', 'missing'])) r LEFT JOIN (SELECT key_nation AS left_key, key_segment AS right_key,"
    " count(*) AS total, count(*) FILTER (WHERE selected) AS sel FROM marked GROUP BY 1, 2) c USING (left_key, right_key)",
    lambda s, d: eda.joint_counts(marked(s, d), "nation", "segment"),
)
_ev(
    "D7_density",
    f"SELECT a.span_key, b.event_key, coalesce(total, 0) AS total, coalesce(sel, 0) AS selected FROM (SELECT CAST(unnest(range({len(eda.SPAN_CUTS)})) AS VARCHAR) AS span_key) a"
    f" CROSS JOIN (SELECT CAST(unnest(range({len(eda.EVENT_CUTS)})) AS VARCHAR) AS event_key) b LEFT JOIN (SELECT {_cut_sql('span_days', eda.SPAN_CUTS)} AS span_key,"
    f" {_cut_sql('events', eda.EVENT_CUTS)} AS event_key, count(*) AS total, count(*) FILTER (WHERE selected) AS sel FROM marked GROUP BY 1, 2) c USING (span_key, event_key)",
    lambda s, d: eda.density(marked(s, d)),
)
_ev(
    "D8_concentration",
    "SELECT key_nation AS key, count(*) AS total, count(*) FILTER (WHERE selected) AS selected, count(span_days) FILTER (WHERE selected) AS known_spans,"
    " count(*) FILTER (WHERE selected AND span_days IS NULL) AS unknown_spans, CAST(coalesce(sum(events) FILTER (WHERE selected), 0) AS BIGINT) AS events,"
    " median(span_days) FILTER (WHERE selected) AS median_span, quantile_cont(span_days, 0.9) FILTER (WHERE selected) AS p90_span FROM marked GROUP BY 1",
    lambda s, d: eda.concentration_by(marked(s, d), "nation"),
    "median_span p90_span",
)
_ev(
    "D9_comparison_choice",
    "SELECT 'segment' AS name, count(DISTINCT segment) AS \"distinct\" FROM marked",
    lambda s, d: eda.comparison_choice(case_table_o(s, d).withColumn("region_id", F.col("priority")), ["region_id", "nation", "segment", "status"], "priority"),
)
_ev(
    "D10_value_search",
    "SELECT nation AS value, count(*) AS total, count(*) FILTER (WHERE selected) AS selected FROM marked WHERE contains(lower(nation), '_1') GROUP BY 1 ORDER BY total DESC, value LIMIT 40",
    lambda s, d: eda.value_page(marked(s, d), "nation", "_1"),
)
_ev(
    "D11_hierarchy",
    "SELECT key_segment AS segment, key_nation AS nation, count(*) AS total, count(*) FILTER (WHERE selected) AS selected FROM marked GROUP BY 1, 2",
    lambda s, d: eda.hierarchy(marked(s, d), ["segment", "nation"]),
)
_ev(
    "D11_hierarchy_levels",
    "SELECT key_segment AS segment, key_nation AS nation, count(*) AS total, count(*) FILTER (WHERE selected) AS selected FROM marked GROUP BY ROLLUP (key_segment, key_nation)",
    lambda s, d: eda.hierarchy(marked(s, d), ["segment", "nation"], levels=True),
)
_ev(
    "D12_detail_page",
    "SELECT case_id, events, first_ts, last_ts, span_days FROM marked WHERE selected ORDER BY first_ts DESC NULLS LAST, case_id LIMIT 50 OFFSET 50",
    lambda s, d: eda.detail_page(marked(s, d), 2),
    "span_days",
)


# --------------------------------------------------------------------------- event evidence on the dirty log
cte(
    "mw",
    "SELECT CAST(case_id AS VARCHAR) AS case_id, count(*) >= 70 AS selected FROM wd GROUP BY case_id",
    "wd",
)


def marked_wd(spark, d):
    cases = C.build_cases(log_wd(spark, d))
    return eda.prepared(cases).withColumn("selected", F.col("events") >= 70).select("case_id", "selected")


@register(
    "D13_activity_evidence",
    "SELECT activity, coalesce(sum(n) FILTER (WHERE selected), 0)::BIGINT AS occurrences, count(*) FILTER (WHERE selected) AS cases,"
    " count(*) FILTER (WHERE selected AND n >= 2) AS repeated_cases, (SELECT count(*) FROM mw WHERE selected) - count(*) FILTER (WHERE selected) AS zero_cases,"
    " count(*) FILTER (WHERE selected) / (SELECT count(*) FROM mw WHERE selected) AS presence_rate,"
    " count(*) FILTER (WHERE selected AND n >= 2) / (SELECT count(*) FROM mw WHERE selected) AS repetition_rate"
    " FROM (SELECT activity, CAST(case_id AS VARCHAR) AS case_id, count(*) AS n FROM wd GROUP BY 1, 2) JOIN mw USING (case_id) GROUP BY activity",
    doubles="presence_rate repetition_rate",
    with_=["wd", "mw"],
)
def _(spark, d):
    return eda.activity_evidence(log_wd(spark, d), marked_wd(spark, d))


cte(
    "ep",
    "SELECT case_id, CASE WHEN na = 0 AND nb = 0 THEN 'neither' WHEN nb = 0 THEN 'startOnly' WHEN na = 0 THEN 'endOnly' WHEN na > 1 OR nb > 1 THEN 'ambiguous'"
    " WHEN ta IS NULL OR tb IS NULL THEN 'undatedEndpoint' WHEN tb < ta THEN 'reversed' ELSE 'paired' END AS status,"
    " (epoch_us(tb) - epoch_us(ta)) / 86400000000.0 AS days FROM (SELECT case_id, count(*) FILTER (WHERE activity = 'Place order') AS na,"
    " count(*) FILTER (WHERE activity = 'Return item') AS nb, min(ts) FILTER (WHERE activity = 'Place order') AS ta,"
    " min(ts) FILTER (WHERE activity = 'Return item') AS tb, max(exposure) AS exposure FROM o GROUP BY case_id) WHERE exposure >= 100000",
    "o",
)


def endpoints_o(spark, d):
    cases = eda.prepared(case_table_o(spark, d)).withColumn("selected", F.col("exposure") >= 100000)
    return eda.endpoint_pairs(log_o(spark, d, False), cases, "Place order", "Return item")


@register(
    "D14_endpoint_pairs",
    "SELECT status, count(*) AS cases, median(days) FILTER (WHERE status = 'paired') AS median_days,"
    " quantile_cont(days, 0.9) FILTER (WHERE status = 'paired') AS p90_days FROM ep GROUP BY status",
    doubles="median_days p90_days",
    with_=["ep"],
)
def _(spark, d):
    return eda.endpoint_summary(endpoints_o(spark, d))


@register(
    "D15_trace_page",
    "SELECT row_number() OVER (ORDER BY ts NULLS LAST, seq) AS position, activity, ts, ts IS NOT NULL AND count(*) OVER (PARTITION BY ts) > 1 AS tied FROM wd WHERE case_id = 7"
    " ORDER BY position LIMIT 100",
    with_=["wd"],
)
def _(spark, d):
    return eda.trace_page(log_wd(spark, d), 7)


@register(
    "D15_evidence_totals",
    "SELECT count(*) AS events, count(*) FILTER (WHERE activity IS NULL) AS missing_activity, count(*) FILTER (WHERE ts IS NULL) AS undated,"
    " (SELECT count(*) FROM mw WHERE selected) - count(DISTINCT case_id) AS cases_without_events FROM wd WHERE CAST(case_id AS VARCHAR) IN (SELECT case_id FROM mw WHERE selected)",
    with_=["wd", "mw"],
)
def _(spark, d):
    return eda.evidence_totals(log_wd(spark, d), marked_wd(spark, d))
