"""Observation window, readiness checks and caveats on the clean and dirty logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import join_on
from ..operators import backlog as K
from ..operators import cases as C
from ..operators import quality as Q
from ..operators.norm import lag_horizon_micros
from ..session import store
from .base import (
    CENSOR_DAYS,
    WINDOW_END,
    backlog_sql,
    case_table_o,
    cte,
    log_o,
    log_wd,
    norm_o,
    register,
    scored_o,
    table,
)

END_US = 996_624_000_000_000  # the window end in microseconds since 1970

# The far-out rule on the dirty log: median, median deviation and a year.
cte("us", "SELECT *, CASE WHEN ts IS NOT NULL THEN CAST(epoch_us(ts) AS DOUBLE) END AS m FROM wd", "wd")
cte("us_med", "SELECT quantile_cont(m, 0.5) AS med FROM us", "us")
cte("us_mad", "SELECT med, quantile_cont(abs(m - med), 0.5) AS mad FROM us, us_med GROUP BY med", "us", "us_med")
cte(
    "far",
    "SELECT us.*, coalesce(m < med - 3 * mad - 365 * 86400000000.0 OR m > med + 3 * mad + 365 * 86400000000.0, FALSE) AS far FROM us, us_mad",
    "us",
    "us_mad",
)


def _bounds(spark, d):
    return Q.bulk(log_wd(spark, d))


cte(
    "win",
    "SELECT CAST(floor(quantile_cont(a, 0.001)) AS BIGINT) AS s, CAST(floor(quantile_cont(b, 0.999)) AS BIGINT) AS e FROM"
    " (SELECT case_id, min(m) AS a, max(m) AS b FROM us GROUP BY case_id)",
    "us",
)
cte(
    "win2",
    "SELECT CASE WHEN s < bs - 365 * 86400000000 THEN bs ELSE s END AS start_us, CASE WHEN e > be + 365 * 86400000000 THEN be ELSE e END AS end_us FROM win,"
    " (SELECT CAST(min(m) AS BIGINT) AS bs, CAST(max(m) AS BIGINT) AS be FROM far WHERE NOT far) AS bulk",
    "win",
    "far",
)


@register("W1_observation_window", "SELECT start_us, end_us FROM win2", with_=["win2"])
def _(spark, d):
    start, end = Q.observation_window(log_wd(spark, d))
    return spark.range(1).select(F.lit(start).cast("bigint").alias("start_us"), F.lit(end).cast("bigint").alias("end_us"))


@register(
    "W2_sentinel_dates",
    "SELECT count(*) FILTER (WHERE far) AS n_far, count(*) FILTER (WHERE far) / count(*) AS share, CAST(min(m) FILTER (WHERE NOT far) AS BIGINT) AS bulk_start_us,"
    " CAST(max(m) FILTER (WHERE NOT far) AS BIGINT) AS bulk_end_us FROM far",
    doubles="share",
    with_=["far"],
)
def _(spark, d):
    return Q.sentinel_dates(log_wd(spark, d), _bounds(spark, d))


@register(
    "W2_sentinel_stamps",
    "SELECT ts, count(*) AS n_events, count(*) / (SELECT count(*) FROM wd) AS share FROM far WHERE far GROUP BY ts ORDER BY n_events DESC, ts LIMIT 10",
    doubles="share",
    with_=["far", "wd"],
)
def _(spark, d):
    return Q.sentinel_stamps(log_wd(spark, d), _bounds(spark, d))


@register(
    "W3_right_censored",
    "SELECT case_id, n_ship = 0 AND last_ts > TIMESTAMP '2001-06-02' AS censored, n_ship = 0 AND last_ts > TIMESTAMP '2001-06-02' AND n_return > 0 AS censored_opened FROM co",
    with_=["co"],
)
def _(spark, d):
    n = {k: F.count_if(F.col("activity") == a) for k, a in (("n_ship", "Ship item"), ("n_return", "Return item"))}
    cases = C.build_cases(log_o(spark, d, False), n)
    end = F.lit(WINDOW_END).cast("timestamp_ntz")
    return cases.select(
        "case_id",
        C.right_censored(F.col("n_ship"), end, CENSOR_DAYS).alias("censored"),
        C.right_censored(F.col("n_ship"), end, CENSOR_DAYS, F.col("n_return") > 0).alias("censored_opened"),
    )


@register(
    "W4_concentration",
    "SELECT ts, n_events, n_events / (SELECT count(*) FROM wd) AS share, n_events / (SELECT count(*) FROM wd) > 0.01 AND n_events >= 100 AS heavy FROM"
    " (SELECT ts, count(*) AS n_events FROM wd WHERE ts IS NOT NULL GROUP BY ts ORDER BY n_events DESC, ts LIMIT 10)",
    doubles="share",
    with_=["wd"],
)
def _(spark, d):
    return Q.concentration(log_wd(spark, d))


@register(
    "W5_duplicates",
    "SELECT kind, CAST(sum(x) AS BIGINT) AS n_events, sum(x) / (SELECT count(*) FROM wd) AS share, count(*) FILTER (WHERE x > 0) AS n_cases FROM ("
    "SELECT 'key' AS kind, case_id, sum(c - 1) AS x FROM (SELECT case_id, count(*) AS c FROM wd GROUP BY case_id, activity, ts) GROUP BY case_id UNION ALL"
    " SELECT 'exact', case_id, sum(c - 1) FROM (SELECT case_id, count(*) AS c FROM wd GROUP BY case_id, activity, ts, value, k, resource) GROUP BY case_id) GROUP BY kind",
    doubles="share",
    with_=["wd"],
)
def _(spark, d):
    return Q.duplicate_events(log_wd(spark, d))


cte(
    "prec",
    "SELECT *, CASE WHEN share_date_only >= 0.95 THEN 'day' WHEN share_date_only <= 0.05 THEN 'time' ELSE 'mixed' END AS precision FROM"
    " (SELECT coalesce(activity, '(null)') AS activity, count(*) AS n_events, avg(CAST(coalesce(ts = date_trunc('day', ts), FALSE) AS INT)) AS share_date_only FROM wd GROUP BY 1)",
    "wd",
)


@register(
    "W6_day_precision",
    "SELECT *, n_events >= 20 AND precision = 'mixed' AS mixed FROM prec",
    doubles="share_date_only",
    with_=["prec"],
)
def _(spark, d):
    return Q.day_precision(log_wd(spark, d))


@register(
    "W6_lag_precision_notes",
    "SELECT 'by_day' AS constraint_id, a AS share_a, b AS share_b FROM (SELECT avg(share_date_only) FILTER (WHERE activity = 'Day') AS a,"
    " avg(share_date_only) FILTER (WHERE activity = 'Clock') AS b FROM (SELECT activity, avg(CAST(ts = date_trunc('day', ts) AS INT)) AS share_date_only FROM ("
    "SELECT 'Day' AS activity, o_orderdate AS ts FROM orders UNION ALL SELECT 'Clock', ts FROM events) GROUP BY activity)) WHERE abs(a - b) > 0.5",
    doubles="share_a share_b",
)
def _(spark, d):
    day = table(spark, d, "orders").select(F.lit("Day").alias("activity"), F.col("o_orderdate").alias("ts"))
    clock = table(spark, d, "events").select(F.lit("Clock").alias("activity"), "ts")
    precision = Q.day_precision(day.unionByName(clock))
    return Q.lag_precision_notes(precision, {"by_day": (["Day"], ["Clock"]), "same": (["Day"], ["Day"])})


@register(
    "W7_stamp_precision",
    "SELECT *, CASE WHEN day_share >= 0.95 THEN 'day' WHEN minute_share >= 0.95 THEN 'minute' WHEN second_share >= 0.95 THEN 'second' ELSE 'sub-second' END AS precision"
    " FROM (SELECT activity, count(*) AS n_events, avg(CAST(epoch_us(ts) % 86400000000 = 0 AS INT)) AS day_share, avg(CAST(epoch_us(ts) % 60000000 = 0 AS INT)) AS minute_share,"
    " avg(CAST(epoch_us(ts) % 1000000 = 0 AS INT)) AS second_share FROM wd WHERE ts IS NOT NULL GROUP BY activity)",
    doubles="day_share minute_share second_share",
    with_=["wd"],
)
def _(spark, d):
    return Q.stamp_precision(log_wd(spark, d))


@register(
    "W8_placeholder_stamps",
    "SELECT * FROM (WITH w2 AS (SELECT ts, count(*) AS n_events FROM wd, win2 WHERE epoch_us(ts) < start_us OR epoch_us(ts) > end_us GROUP BY ts), rep AS ("
    "SELECT ts, n_events, 'repeated stamp outside the window' AS reason FROM w2 WHERE n_events >= 5 OR strftime(ts, '%Y-%m-%d') IN ('1900-01-01', '1900-12-31', '1970-01-01', '1999-12-31', '2099-12-31', '9999-12-31')"
    " ORDER BY n_events DESC, ts LIMIT 10) SELECT * FROM rep UNION ALL SELECT w2.ts, n_events, reason FROM w2 JOIN (SELECT min(ts) AS ts, 'earliest timestamp' AS reason FROM wd"
    " UNION ALL SELECT max(ts), 'latest timestamp' FROM wd) x USING (ts) WHERE ts NOT IN (SELECT ts FROM rep))",
    with_=["wd", "win2"],
)
def _(spark, d):
    start, end = Q.observation_window(log_wd(spark, d))
    return Q.placeholder_stamps(log_wd(spark, d), start, end)


# Drift needs several periods, so it runs on the orders log by quarter.
cte(
    "od",
    "SELECT case_id, CASE WHEN activity = 'Ship item' AND ts >= TIMESTAMP '2000-01-01' AND seq.supp % 2 = 0 THEN 'Ship parcel' ELSE activity END AS activity, ts, seq, amount FROM o"
    " WHERE NOT (activity = 'Return item' AND ts >= TIMESTAMP '2001-04-01')",
    "o",
)


def log_od(spark, d):
    """Log o with a label that appears in 2000 and one that stops in spring 2001."""
    o = log_o(spark, d, False)

    def since(day: str):
        return F.col("ts") >= F.lit(day).cast("timestamp_ntz")

    renamed = (F.col("activity") == "Ship item") & since("2000-01-01") & (F.col("seq.supp") % 2 == 0)
    kept = o.where(~((F.col("activity") == "Return item") & since("2001-04-01")))
    return kept.withColumn("activity", F.when(renamed, "Ship parcel").otherwise(F.col("activity"))).select("case_id", "activity", "ts", "seq", "amount")


cte("od_c", "SELECT activity, strftime(ts, '%Y') || '-Q' || quarter(ts) AS period, count(*) AS n FROM od GROUP BY 1, 2", "od")
cte(
    "od_g",
    "SELECT a.activity, p.period, coalesce(c.n, 0) AS n, p.n_events, p.n_events >= 200 AS eligible FROM (SELECT DISTINCT activity FROM od_c) a CROSS JOIN"
    " (SELECT period, sum(n) AS n_events FROM od_c GROUP BY period) p LEFT JOIN od_c c ON c.activity = a.activity AND c.period = p.period",
    "od_c",
)
cte(
    "od_r",
    "SELECT g.*, CASE WHEN EXISTS (SELECT 1 FROM od_g q WHERE q.eligible AND q.period < g.period)"
    " THEN coalesce((SELECT sum(q.n) FROM od_g q WHERE q.activity = g.activity AND q.eligible AND q.period < g.period), 0)"
    " ELSE coalesce((SELECT sum(q.n) FROM od_g q WHERE q.activity = g.activity AND q.eligible AND q.period > g.period), 0) END AS ref FROM od_g g",
    "od_g",
)
def _drift_sql(compared: str) -> str:
    return (
        "SELECT period, CAST(max(n_events) AS BIGINT) AS n_events, bool_or(eligible) AS eligible, CASE WHEN max(rt) > 0 THEN sum(0.5 * CASE WHEN n > 0 THEN n / n_events * log2((n / n_events) / ((n / n_events + ref / rt) / 2)) ELSE 0 END"
        " + 0.5 * CASE WHEN ref > 0 THEN ref / rt * log2((ref / rt) / ((n / n_events + ref / rt) / 2)) ELSE 0 END) END AS jsd,"
        " coalesce(string_agg(CASE WHEN n > 0 AND ref = 0 THEN activity END, ', ' ORDER BY activity), '') AS new_labels,"
        " sum(CASE WHEN n > 0 AND ref = 0 THEN n ELSE 0 END) / max(n_events) AS new_share,"
        " coalesce(string_agg(CASE WHEN n = 0 AND ref > 0 THEN activity END, ', ' ORDER BY activity), '') AS vanished_labels,"
        " sum(CASE WHEN n = 0 AND ref > 0 THEN ref ELSE 0 END) / max(rt) AS vanished_share FROM (SELECT *, sum(ref) OVER (PARTITION BY period) AS rt FROM " + compared + ") GROUP BY period"
    )


cte("od_d", _drift_sql("od_r"), "od_r")
REFERENCE = "1999-Q4"
EXPECTED = ["Return item", "Ship item", "Ship parcel", "No such step"]
cte("od_n", f"SELECT g.*, (SELECT q.n FROM od_g q WHERE q.activity = g.activity AND q.period = '{REFERENCE}') AS ref FROM od_g g", "od_g")


@register("W9_vocabulary_drift", "SELECT * FROM od_d", doubles="jsd new_share vanished_share", with_=["od_d"])
def _(spark, d):
    return Q.vocabulary_drift(log_od(spark, d), "quarter", 200)


@register(
    "W9_vocabulary_named",
    f"SELECT d.*, coalesce((SELECT string_agg(e, ', ' ORDER BY e) FROM (SELECT unnest({EXPECTED}) AS e) WHERE NOT EXISTS"
    " (SELECT 1 FROM od_c c WHERE c.period = d.period AND c.activity = e)), '') AS missing_labels"
    f" FROM ({_drift_sql('od_n')}) d",
    doubles="jsd new_share vanished_share",
    with_=["od_n", "od_c"],
)
def _(spark, d):
    return Q.vocabulary_drift(log_od(spark, d), "quarter", 200, reference=REFERENCE, expected=EXPECTED)


cte(
    "fd",
    "SELECT a.activity, p.period, p.n_cases, coalesce(w.n_with, 0) AS n_with, coalesce(w.n_with, 0) / p.n_cases AS share, p.n_cases >= 50 AS eligible,"
    " p.first_day + INTERVAL 3 MONTH > TIMESTAMP '2001-06-02' AS censored FROM (SELECT DISTINCT activity FROM od) a CROSS JOIN (SELECT period, count(*) AS n_cases,"
    " min(date_trunc('quarter', start)) AS first_day FROM fs GROUP BY period) p LEFT JOIN (SELECT activity, period, count(DISTINCT od.case_id) AS n_with FROM od JOIN fs USING (case_id)"
    " GROUP BY 1, 2) w ON w.activity = a.activity AND w.period = p.period",
    "od",
    "fs",
)
cte("fs", "SELECT case_id, min(ts) AS start, strftime(min(ts), '%Y') || '-Q' || quarter(min(ts)) AS period FROM od GROUP BY case_id", "od")


def drift_table(spark, d):
    return Q.frequency_drift(log_od(spark, d), "quarter", end=WINDOW_END, window_days=60, min_cases=50)


@register("W10_frequency_drift", "SELECT * FROM fd", doubles="share", with_=["fd"])
def _(spark, d):
    return drift_table(spark, d)


@register(
    "W11_frequency_steps",
    "SELECT * FROM (WITH u AS (SELECT *, sum(n_cases) OVER b AS cn, sum(n_with) OVER b AS cw, sum(n_cases) OVER (PARTITION BY activity) AS tn, sum(n_with) OVER (PARTITION BY activity) AS tw,"
    " row_number() OVER (PARTITION BY activity ORDER BY period) AS i FROM fd WHERE eligible AND NOT censored WINDOW b AS (PARTITION BY activity ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),"
    " s AS (SELECT *, cw / cn AS share_before, (tw - cw) / (tn - cn) AS share_after, abs((tw - cw) / (tn - cn) - cw / cn) AS step_size FROM u),"
    " best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY activity ORDER BY round(step_size, 9) DESC, i) AS r FROM s WHERE cn IS NOT NULL) WHERE r = 1),"
    " agg AS (SELECT activity, count(*) AS n_periods, min(share) AS share_min, max(share) AS share_max, arg_min(share, i) AS share_first, arg_max(share, i) AS share_last FROM s GROUP BY activity)"
    " SELECT c.activity, coalesce(n_periods, 0) AS n_periods, n_censored, share_min, share_max, share_first, share_last, best.period AS step_period, share_before, share_after, step_size"
    " FROM (SELECT activity, count(*) FILTER (WHERE censored) AS n_censored FROM fd GROUP BY activity) c LEFT JOIN agg USING (activity) LEFT JOIN best USING (activity))",
    doubles="share_min share_max share_first share_last share_before share_after step_size",
    with_=["fd"],
)
def _(spark, d):
    return Q.frequency_steps(drift_table(spark, d))


# Setting and releasing labels for the pair checks.
def log_pairs(spark, d):
    o = log_o(spark, d, False)
    label = (
        F.when(F.col("activity") == "Place order", "Set delivery block")
        .when(F.col("activity") == "Return item", "Release Delivery Block")
        .otherwise(F.when(F.col("seq.line") % 2 == 0, "Create shipment").otherwise("Cancel shipment"))
    )
    return o.withColumn("activity", label).where(~((F.col("activity") == "Set delivery block") & (F.col("case_id") % 3 == 0)))


cte(
    "pr",
    "SELECT * FROM (SELECT case_id, CASE WHEN activity = 'Place order' THEN 'Set delivery block' WHEN activity = 'Return item' THEN 'Release Delivery Block'"
    " WHEN seq.line % 2 = 0 THEN 'Create shipment' ELSE 'Cancel shipment' END AS activity FROM o) WHERE NOT (activity = 'Set delivery block' AND case_id % 3 = 0)",
    "o",
)
cte(
    "verbs",
    "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in Q.VERB_PAIRS) + ") AS t(s, r)",
)
cte(
    "pairs",
    "SELECT DISTINCT a.activity AS setting, b.activity AS releasing FROM (SELECT DISTINCT activity, lower(split_part(activity, ' ', 1)) AS v,"
    " lower(substr(activity, strpos(activity, ' ') + 1)) AS stem FROM pr) a JOIN verbs ON a.v = verbs.s JOIN (SELECT DISTINCT activity, lower(split_part(activity, ' ', 1)) AS v,"
    " lower(substr(activity, strpos(activity, ' ') + 1)) AS stem FROM pr) b ON b.v = verbs.r AND b.stem = a.stem",
    "pr",
    "verbs",
)


@register("W12_activity_pairs", "SELECT * FROM pairs", with_=["pairs"])
def _(spark, d):
    return Q.activity_pairs(log_pairs(spark, d).select("activity").distinct())


@register(
    "W13_logging_asymmetry",
    "SELECT setting, releasing, ns AS n_setting_events, nr AS n_releasing_events, cr AS cases_with_release, cw AS cases_release_without_set, nr / ns AS event_ratio,"
    " cw / cr AS share_release_without_set, setting = 'Set delivery block' AS setting_in_norm, FALSE AS releasing_in_norm FROM (SELECT setting, releasing,"
    " (SELECT count(*) FROM pr WHERE activity = setting) AS ns, (SELECT count(*) FROM pr WHERE activity = releasing) AS nr,"
    " (SELECT count(DISTINCT case_id) FROM pr WHERE activity = releasing) AS cr,"
    " (SELECT count(DISTINCT case_id) FROM pr WHERE activity = releasing AND case_id NOT IN (SELECT case_id FROM pr q WHERE q.activity = setting)) AS cw FROM pairs)",
    doubles="event_ratio share_release_without_set",
    with_=["pr", "pairs"],
)
def _(spark, d):
    events = log_pairs(spark, d)
    return Q.logging_asymmetry(events, Q.activity_pairs(events.select("activity").distinct()), ["Set delivery block"])


@register(
    "W14_exposure_sanity",
    "SELECT * FROM (WITH x AS (SELECT segment AS \"group\", log10(CASE WHEN case_id % 5 = 0 AND segment = 'BUILDING' THEN exposure * 1000000 ELSE exposure END) AS lg FROM co WHERE exposure > 0),"
    " g AS (SELECT \"group\", quantile_cont(lg, 0.5) AS med FROM x GROUP BY 1) SELECT x.\"group\", count(*) AS n_cases, max(med) AS median_log10, avg(CAST(abs(lg - med) > 2 AS INT)) AS far_share,"
    " max(med) - (SELECT quantile_cont(lg, 0.5) FROM x) AS decades_from_overall FROM x JOIN g ON g.\"group\" = x.\"group\" GROUP BY x.\"group\")",
    doubles="median_log10 far_share decades_from_overall",
    with_=["co"],
)
def _(spark, d):
    wrong_unit = (F.col("case_id") % 5 == 0) & (F.col("segment") == "BUILDING")
    cases = case_table_o(spark, d)
    cases = cases.withColumn("exposure", F.when(wrong_unit, F.col("exposure") * 1_000_000).otherwise(F.col("exposure")))
    return Q.exposure_sanity(cases, "segment")


def _lags():
    norm = norm_o()
    return {c: ("t_place" if c != "c_each" else "t_ship", lag_horizon_micros(norm.constraint(c))) for c in ("c_lag", "c_over", "c_each")}


def _edge_cases(spark, d):
    anchors = {"t_place": C.stamp(["Place order"]), "t_ship": C.stamp(["Ship item"])}
    return C.build_cases(log_o(spark, d), anchors, attributes=["segment"])


def _edge_sql(by: str) -> str:
    key = f"{by}, " if by else ""
    return " UNION ALL ".join(
        f"SELECT {key}'{c}' AS constraint_id, count({col}) AS n_with_activation, count(*) FILTER (WHERE epoch_us({col}) > {END_US} - {days} * 86400000000) AS n_edge,"
        f" count(*) FILTER (WHERE epoch_us({col}) > {END_US} - {days} * 86400000000) / count({col}) AS edge_share FROM co" + (f" GROUP BY {by}" if by else "")
        for c, col, days in (("c_lag", "t_place", 455), ("c_over", "t_place", 210), ("c_each", "t_ship", 395))
    )


@register("W15_window_edges", f"SELECT * FROM ({_edge_sql('')})", doubles="edge_share", with_=["co"])
def _(spark, d):
    return Q.window_edges(_edge_cases(spark, d), _lags(), END_US)


@register("W15_window_edges_by_group", f"SELECT * FROM ({_edge_sql('segment')})", doubles="edge_share", with_=["co"])
def _(spark, d):
    return Q.window_edges(_edge_cases(spark, d), _lags(), END_US, ["segment"])


@register(
    "W16_gap_retained",
    "SELECT a.nation, a.n_cases, a.stable_gap, b.stable_gap AS stable_gap_closed, b.stable_gap / a.stable_gap AS retained FROM"
    f" ({backlog_sql('nation', 'A', 20)}) a JOIN ({backlog_sql('nation', 'A', 20, where='NOT censored')}) b ON a.nation = b.nation WHERE a.stable_gap > 0 AND a.rank <= 10",
    doubles="stable_gap stable_gap_closed retained",
    with_=["so"],
)
def _(spark, d):
    rows = K.validation(scored_o(spark, d), ["nation"], "A", gamma=20)
    top = K.backlog(scored_o(spark, d), ["nation"], "A", gamma=20).where("rank <= 10 and stable_gap > 0").select("nation")
    return join_on(rows, top, ["nation"], "left_semi").select("nation", "n_cases", "stable_gap", "stable_gap_closed", "retained")


cte(
    "repl",
    "SELECT case_id, CAST(sum(n) AS BIGINT) AS n_events, count(*) AS n_stamps, sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n) AS replicated_share, sum(n) / count(*) AS replication_ratio,"
    " sum(n) / count(*) > 2.0 AS replicated FROM (SELECT case_id, ts, count(*) AS n FROM wd WHERE ts IS NOT NULL GROUP BY 1, 2) GROUP BY case_id",
    "wd",
)


@register("W17_replication", "SELECT * FROM repl", doubles="replicated_share replication_ratio", with_=["repl"])
def _(spark, d):
    return Q.replication(log_wd(spark, d))


@register(
    "W18_cross_case_replication",
    "SELECT case_id, count(*) AS n_events, avg(CAST(k > 1 AS INT)) AS cross_share FROM o JOIN (SELECT resource, activity, ts, count(DISTINCT case_id) AS k FROM o"
    " WHERE resource IS NOT NULL GROUP BY ALL) g ON g.resource = o.resource AND g.activity = o.activity AND g.ts = o.ts GROUP BY case_id",
    doubles="cross_share",
    with_=["o"],
)
def _(spark, d):
    return Q.cross_case_replication(log_o(spark, d, False), "resource")


# --------------------------------------------------------------------------- caveats and the report
cte(
    "flags",
    "SELECT case_id, k AS kgroup, dup.duplicate, dup.sentinel, coalesce(repl.replicated, FALSE) AS replicated, last_ts > TIMESTAMP '2024-01-29' AND n_buy < 12 AS censored,"
    " first_ts > TIMESTAMP '2024-01-01 12:00:00' AS window_edge FROM (SELECT case_id, max(ts) AS last_ts, min(ts) AS first_ts, count(*) FILTER (WHERE activity = 'purchase') AS n_buy,"
    " CAST(case_id % 4 AS VARCHAR) AS k FROM wd GROUP BY case_id) c LEFT JOIN (SELECT case_id, bool_or(n > 1) AS duplicate, bool_or(f) AS sentinel FROM (SELECT case_id, activity, ts, count(*) AS n,"
    " bool_or(far) AS f FROM far GROUP BY 1, 2, 3) GROUP BY case_id) dup USING (case_id) LEFT JOIN repl USING (case_id)",
    "wd",
    "far",
    "repl",
)
KINDS = ("censoring", "replication", "duplicates", "sentinel_dates", "window_edge")


def flagged(spark, d):
    events = log_wd(spark, d)
    flags = Q.case_flags(events, Q.bulk(events))
    cases = C.build_cases(events, {"n_buy": F.count_if(F.col("activity") == "purchase")})

    def after(col: str, t: str):
        return F.col(col) > F.lit(t).cast("timestamp_ntz")

    cases = cases.withColumns(
        {
            "kgroup": (F.col("case_id") % 4).cast("string"),
            "censored": after("last_ts", "2024-01-29") & (F.col("n_buy") < 12),
            "window_edge": after("first_ts", "2024-01-01 12:00:00"),
        }
    )
    return store(join_on(cases, flags, ["case_id"], "left"))


@register(
    "W19_case_flags",
    "SELECT case_id, duplicate, sentinel, replicated FROM flags",
    with_=["flags"],
)
def _(spark, d):
    return flagged(spark, d).select("case_id", "duplicate", "sentinel", "replicated")


_CAVEAT_SQL = (
    "SELECT kgroup, count(*) AS n_cases, avg(CAST(censored AS INT)) AS censoring_share, avg(CAST(replicated AS INT)) AS replication_share, avg(CAST(duplicate AS INT)) AS duplicates_share,"
    " avg(CAST(sentinel AS INT)) AS sentinel_dates_share, avg(CAST(window_edge AS INT)) AS window_edge_share FROM flags GROUP BY kgroup"
)


def _status_sql(col: str, warn: float, fail: float) -> str:
    hit = f"{col} > {warn}" if warn == 0 else f"{col} >= {warn}"
    return f"CASE WHEN {col} >= {fail} THEN 'fail' WHEN {hit} THEN 'warn' ELSE 'pass' END"


cte("cav", _CAVEAT_SQL, "flags")
cte(
    "cavl",
    " UNION ALL ".join(
        f"SELECT kgroup, n_cases, '{kind}' AS caveat, {kind}_share AS share, {_status_sql(kind + '_share', Q.THRESHOLDS[w], Q.THRESHOLDS[f])} AS status FROM cav WHERE {kind}_share > 0"
        for kind, _, w, f in Q.CAVEATS
    ),
    "cav",
)


@register("W20_caveats_by_group", "SELECT * FROM cav", doubles=" ".join(f"{k}_share" for k in KINDS), with_=["cav"])
def _(spark, d):
    return Q.caveats_by(flagged(spark, d), ["kgroup"], KINDS)


@register("W20_caveat_status", "SELECT * FROM cavl", doubles="share", with_=["cavl"])
def _(spark, d):
    groups = Q.caveats_by(flagged(spark, d), ["kgroup"], KINDS)
    return Q.caveats_long(groups, ["kgroup"], KINDS)


@register(
    "W22_caveat_summary",
    "SELECT caveat, sum(share * n_cases) / (SELECT sum(n_cases) FROM cav) AS page_share, max(share) AS max_share, count(*) AS groups,"
    " 1.5 * sum(share * n_cases) / (SELECT sum(n_cases) FROM cav) AS threshold FROM cavl GROUP BY caveat",
    doubles="page_share max_share threshold",
    with_=["cav", "cavl"],
)
def _(spark, d):
    groups = store(Q.caveats_by(flagged(spark, d), ["kgroup"], KINDS))
    return Q.caveat_summary(Q.caveats_long(groups, ["kgroup"], KINDS), groups)


NAMED = {"c1": ["Place order", "Approve order"], "c2": ["Ship item", "Return item"], "c3": ["Scrap item"]}


@register(
    "W21_norm_evidence",
    "SELECT * FROM (VALUES ('c1', 'Place order'), ('c1', 'Approve order'), ('c2', 'Ship item'), ('c2', 'Return item'), ('c3', 'Scrap item')) AS t(constraint_id, activity)"
    " WHERE activity NOT IN (SELECT activity FROM o)",
    with_=["o"],
)
def _(spark, d):
    return Q.norm_evidence(log_o(spark, d, False), NAMED)


@register(
    "W21_norm_relevance",
    "SELECT 'c1' AS constraint_id, count(*) AS events, count(DISTINCT case_id) AS cases FROM o WHERE activity = 'Place order' UNION ALL"
    " SELECT 'c2', count(*), count(DISTINCT case_id) FROM o WHERE activity IN ('Ship item', 'Return item') UNION ALL SELECT 'c3', 0, 0",
    with_=["o"],
)
def _(spark, d):
    return Q.norm_relevance(log_o(spark, d, False), NAMED)


def _report(spark, d):
    events = log_od(spark, d)
    cases = C.build_cases(
        log_o(spark, d),
        {"t_place": C.stamp(["Place order"]), "t_ship": C.stamp(["Ship item"]), "n_ship": F.count_if(F.col("activity") == "Ship item")},
        attributes=["segment"],
        exposure="exposure",
    )
    open_ = C.right_censored(F.col("n_ship"), F.lit(WINDOW_END).cast("timestamp_ntz"), CENSOR_DAYS)
    cases = store(cases.withColumn("censored", open_))
    return Q.readiness(events, cases, end=WINDOW_END, group="segment", lags=_lags(), end_us=END_US, grain="quarter")


_REPORT_SQL = (
    "SELECT 'sentinel_dates' AS check_name, 0.0 AS value, 'pass' AS status"
    " UNION ALL SELECT 'timestamp_concentration', max(n) / (SELECT count(*) FROM od), CASE WHEN bool_or(n >= 100 AND n / (SELECT count(*) FROM od) > 0.01) THEN 'warn' ELSE 'pass' END FROM (SELECT count(*) AS n FROM od GROUP BY ts)"
    f" UNION ALL SELECT 'duplicate_events', v, {_status_sql('v', 0.001, 0.05)} FROM (SELECT sum(c - 1) / sum(c) AS v FROM (SELECT count(*) AS c FROM od GROUP BY case_id, activity, ts))"
    " UNION ALL SELECT 'timestamp_precision', 0.0, 'pass'"
    " UNION ALL SELECT 'vocabulary_drift', CASE WHEN bool_or(new_labels <> '') THEN max(new_share) ELSE max(jsd) END, CASE WHEN max(new_share) >= 0.01 THEN 'fail'"
    " WHEN bool_or(new_labels <> '' OR vanished_labels <> '') OR max(jsd) >= 0.05 THEN 'warn' ELSE 'pass' END FROM od_d WHERE eligible AND jsd IS NOT NULL"
    f" UNION ALL SELECT 'activity_frequency_drift', v, {_status_sql('v', 0.1, 0.3)} FROM (SELECT max(abs((tw - cw) / (tn - cn) - cw / cn)) AS v FROM (SELECT sum(n_cases) OVER b AS cn, sum(n_with) OVER b AS cw,"
    " sum(n_cases) OVER (PARTITION BY activity) AS tn, sum(n_with) OVER (PARTITION BY activity) AS tw FROM fd WHERE eligible AND NOT censored"
    " WINDOW b AS (PARTITION BY activity ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"
    " UNION ALL SELECT 'logging_asymmetry', NULL, 'skipped'"
    f" UNION ALL SELECT 'exposure_zero', v, {_status_sql('v', 0.0, 0.2)} FROM (SELECT avg(CAST(coalesce(exposure, 0) <= 0 AS INT)) AS v FROM co)"
    f" UNION ALL SELECT 'exposure_far', v, {_status_sql('v', 0.01, 0.1)} FROM (SELECT avg(CAST(abs(log10(exposure) - m) > 2 AS INT)) AS v FROM co JOIN (SELECT segment, quantile_cont(log10(exposure), 0.5) AS m FROM co GROUP BY 1) USING (segment))"
    " UNION ALL SELECT 'exposure_units', v, CASE WHEN v >= 2 THEN 'fail' ELSE 'pass' END FROM (SELECT max(abs(m - (SELECT quantile_cont(log10(exposure), 0.5) FROM co))) AS v FROM (SELECT quantile_cont(log10(exposure), 0.5) AS m FROM co GROUP BY segment))"
    f" UNION ALL SELECT 'window_edge', v, {_status_sql('v', 0.05, 0.2)} FROM (SELECT max(edge_share) AS v FROM ({_edge_sql('')}))"
    f" UNION ALL SELECT 'right_censoring', v, {_status_sql('v', 0.02, 0.2)} FROM (SELECT avg(CAST(n_ship = 0 AND last_ts > TIMESTAMP '2001-06-02' AS INT)) AS v FROM co)"
    f" UNION ALL SELECT 'event_replication', v, {_status_sql('v', 0.02, 0.25)} FROM (SELECT avg(CAST(r > 2 AS INT)) AS v FROM (SELECT count(*) / count(DISTINCT ts) AS r FROM od GROUP BY case_id))"
)


@register("W19_readiness_report", f"SELECT * FROM ({_REPORT_SQL})", doubles="value", with_=["od", "od_d", "fd", "co"])
def _(spark, d):
    return _report(spark, d)


@register(
    "W19_overall_status",
    "SELECT CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'pass' END AS status,"
    f" count(*) FILTER (WHERE status = 'fail') AS failed, count(*) FILTER (WHERE status = 'warn') AS warned FROM ({_REPORT_SQL})",
    with_=["od", "od_d", "fd", "co"],
)
def _(spark, d):
    return Q.overall_status(_report(spark, d))


# --------------------------------------------------------------------------- readiness with a norm and scores
# Labels that form a pair of setting and releasing, and the norm's own labels.
PAIRED = {"Ship item": "Block item", "Ship parcel": "Block item", "Return item": "Release item"}


def _slices(spark, d):
    names = F.col("activity")
    events = log_od(spark, d).withColumn("activity", F.coalesce(*[F.when(names == a, F.lit(b)) for a, b in PAIRED.items()], names))
    scored = scored_o(spark, d)
    firsts = C.build_cases(log_o(spark, d, False), {"t_place": C.stamp(["Place order"]), "t_ship": C.stamp(["Ship item"])})
    scored = store(join_on(scored, firsts.select("case_id", "t_place", "t_ship"), ["case_id"]))
    labels = {"c_lag": (["Place order"], ["Block item"])}
    return Q.readiness(
        events, scored, end=WINDOW_END, group="segment", lags=_lags(), end_us=END_US, grain="quarter",
        norm_labels=["Block item"], lag_labels=labels, scored=scored, by=["segment", "priority"], view="A", gamma=20, k=12,
    )


cte(
    "odp",
    "SELECT * REPLACE (CASE WHEN activity IN ('Ship item', 'Ship parcel') THEN 'Block item' WHEN activity = 'Return item' THEN 'Release item' ELSE activity END AS activity) FROM od",
    "od",
)
cte(
    "asym_p",
    "SELECT count(*) FILTER (WHERE s = 0) / count(*) AS v FROM (SELECT case_id, count(*) FILTER (WHERE activity = 'Block item') AS s, count(*) FILTER (WHERE activity = 'Release item') AS r FROM odp GROUP BY case_id) WHERE r > 0",
    "odp",
)
cte(
    "slice_p",
    "WITH s AS (SELECT segment, priority, score_A, censored, replicated, t_place, t_ship FROM so),"
    " m AS (SELECT avg(score_A) AS mu, avg(score_A) FILTER (WHERE NOT censored) AS mc FROM s),"
    " g AS (SELECT segment, priority, count(score_A) AS n, avg(score_A) AS mean, count(score_A) FILTER (WHERE NOT censored) AS nc, avg(score_A) FILTER (WHERE NOT censored) AS cmean,"
    " avg(CAST(replicated AS INT)) AS rep, {edge} AS edge FROM s GROUP BY ALL)"
    " SELECT *, n / (n + 20.0) * greatest(mu - mean, 0) AS gap, nc / (nc + 20.0) * greatest(mc - cmean, 0) AS closed, row_number() OVER (ORDER BY n * (n / (n + 20.0)) * greatest(mu - mean, 0) DESC, n DESC, segment, priority) AS r FROM g, m".replace(
        "{edge}",
        f"avg(CAST(coalesce(CASE (SELECT id FROM worst_p) WHEN 'c_lag' THEN epoch_us(t_place) > {END_US} - 455 * 86400000000"
        f" WHEN 'c_over' THEN epoch_us(t_place) > {END_US} - 210 * 86400000000 ELSE epoch_us(t_ship) > {END_US} - 395 * 86400000000 END, FALSE) AS INT))",
    ),
    "so",
    "worst_p",
)
cte("worst_p", f"SELECT arg_max(constraint_id, edge_share) AS id FROM ({_edge_sql('')})", "co")


def _at_least(status: str, found: str, level: str) -> str:
    low = "('pass')" if level == "warn" else "('pass', 'warn')"
    return f"CASE WHEN {found} AND {status} IN {low} THEN '{level}' ELSE {status} END"


_LEAD = "(SELECT coalesce(bool_or({}), FALSE) FROM slice_p WHERE r <= 12)"
_SLICES_SQL = (
    "SELECT 'timestamp_precision' AS check_name, 0.0 AS value, 'pass' AS status"
    " UNION ALL SELECT 'logging_asymmetry', v, CASE WHEN v >= 0.5 THEN 'fail' WHEN v >= 0.1 THEN 'warn' ELSE 'pass' END FROM asym_p"
    f" UNION ALL SELECT 'duplicate_events', v, {_status_sql('v', 0.001, 0.05)} FROM (SELECT sum(c - 1) / sum(c) AS v FROM (SELECT count(*) AS c FROM odp GROUP BY case_id, activity, ts))"
    f" UNION ALL SELECT 'window_edge', v, {_at_least(_status_sql('v', 0.05, 0.2), _LEAD.format('edge >= 0.05'), 'warn')} FROM (SELECT max(edge_share) AS v FROM ({_edge_sql('')}))"
    f" UNION ALL SELECT 'right_censoring', v, {_at_least(_status_sql('v', 0.02, 0.2), _LEAD.format('gap > 0 AND closed / gap < 0.5'), 'fail')} FROM (SELECT avg(CAST(censored AS INT)) AS v FROM so)"
    f" UNION ALL SELECT 'event_replication', v, {_at_least(_status_sql('v', 0.02, 0.25), _LEAD.format('rep >= 0.5'), 'fail')} FROM (SELECT avg(CAST(r > 2 AS INT)) AS v FROM (SELECT count(*) / count(DISTINCT ts) AS r FROM odp GROUP BY case_id))"
)


@register("W19_readiness_slices", _SLICES_SQL, doubles="value", with_=["odp", "asym_p", "slice_p", "worst_p", "co", "so"])
def _(spark, d):
    shown = ["timestamp_precision", "logging_asymmetry", "duplicate_events", "window_edge", "right_censoring", "event_replication"]
    return _slices(spark, d).where(F.col("check_name").isin(shown))
