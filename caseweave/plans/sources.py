"""Sources, sinks, typing and profiles on the given tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..operators import prepare, profile
from ..session import shared_dir
from ..sources import readers, sinks
from .base import case_table_o, cases_w, log_o, log_w, log_wd, register, table, text_w


def _path(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/caseweave-{name}-{uuid.uuid4().hex}"


@register(
    "S1_csv_scan",
    'SELECT "user" AS case_user, event, time, event_id, cents, lifecycle, kind FROM (SELECT * REPLACE (nullif(cents, \'\') AS cents) FROM tw)',
    with_=["tw"],
)
def _(spark, d):
    path = _path(spark, "csv")
    padded = text_w(spark, d).withColumnsRenamed({"event": " event", "time": "time "})
    padded.write.option("header", True).csv(path)
    return readers.read_csv(spark, path).withColumnRenamed("user", "case_user")


@register(
    "S1_csv_cp1252",
    "SELECT n_name AS nation, 'Café ' || n_name AS label FROM nation",
)
def _(spark, d):
    path = _path(spark, "cp1252")
    rows = table(spark, d, "nation").select(F.col("n_name").alias("nation"), F.concat(F.lit("Café "), "n_name").alias("label"))
    rows.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return readers.read_csv(spark, path)


@register("S2_parquet_scan", "SELECT user_id, event_type, ts, value FROM events")
def _(spark, d):
    path = _path(spark, "parquet")
    rows = table(spark, d, "events").select("user_id", "event_type", "ts", "value")
    rows.withColumnsRenamed({"event_type": " event_type ", "value": "value "}).write.parquet(path)
    return readers.read_parquet(spark, path)


def _log_element(batches):
    """Wrap the traces of one output file in a log element."""
    yield pd.DataFrame({"value": ['<?xml version="1.0"?>', '<log xes.version="1.0"><string key="concept:name" value="w"/>']})
    yield from batches
    yield pd.DataFrame({"value": ["</log>"]})


@register(
    "S3_xes_scan",
    "SELECT 'case ' || case_id AS trace_name, activity, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS time, CAST(seq AS VARCHAR) AS seq,"
    " CASE WHEN seq % 2 = 0 THEN CAST(k AS VARCHAR) ELSE 'k' || k END AS kind FROM w",
    with_=["w"],
)
def _(spark, d):
    path = _path(spark, "xes")
    w = log_w(spark, d)

    def tag(kind: str, key: str, value):
        return F.concat(F.lit(f'<{kind} key="{key}" value="'), value, F.lit('"/>'))

    mixed = F.when(F.col("seq") % 2 == 0, tag("int", "kind", F.col("k").cast("string"))).otherwise(
        tag("string", "kind", F.concat(F.lit("k"), F.col("k").cast("string")))
    )
    event = F.concat(
        F.lit("<event>"),
        tag("string", "concept:name", F.col("activity")),
        tag("date", "time:timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
        tag("int", "seq", F.col("seq").cast("string")),
        mixed,
        F.lit("</event>"),
    )
    # One trace element per case and hour keeps the written lines short.
    traces = w.groupBy("case_id", F.date_trunc("hour", "ts").alias("h")).agg(F.array_join(F.collect_list(event), "").alias("e"))
    name = tag("string", "concept:name", F.concat(F.lit("case "), F.col("case_id").cast("string")))
    lines = traces.select(F.concat(F.lit("<trace>"), name, F.col("e"), F.lit("</trace>")).alias("value"))
    lines.mapInPandas(_log_element, "value string").write.text(path)
    log = readers.read_xes(spark, path)
    return log.select(
        F.col("`case:concept:name`").alias("trace_name"),
        F.col("`concept:name`").alias("activity"),
        F.col("`time:timestamp`").alias("time"),
        "seq",
        "kind",
    )


@register("S4_parquet_sink", "SELECT activity, count(*) AS n_rows, TRUE AS unchanged FROM w GROUP BY activity", with_=["w"])
def _(spark, d):
    path = _path(spark, "sink")
    w = log_w(spark, d)
    manifest = sinks.write_table(w, path, partition_by=["activity"])
    same = manifest.select("hash").scalar() == sinks.content_hash(w).select("hash").scalar()
    written = spark.read.parquet(path)
    return written.groupBy("activity").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("unchanged", same)


@register("S4_replaced_table", "SELECT activity, count(*) AS n_rows, count(DISTINCT case_id) AS cases FROM wd GROUP BY activity", with_=["wd"])
def _(spark, d):
    """A table that takes the place of an earlier one and is read back against its manifest."""
    path = _path(spark, "replaced")
    sinks.write_table(log_w(spark, d), path)
    sinks.write_table(log_wd(spark, d), path, partition_by=["k"])
    back = sinks.read_table(spark, path, content=True)
    return back.groupBy("activity").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("case_id").alias("cases"))


@register("S5_preview", "SELECT * FROM w ORDER BY seq LIMIT 50", doubles="value", with_=["w"])
def _(spark, d):
    return log_w(spark, d).orderBy("seq").limit(50)


@register(
    "S6_fingerprint",
    "SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', CAST(case_id AS VARCHAR), coalesce(activity, '\\N'),"
    " coalesce(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '\\N'), CAST(CAST(round(value * 1000000) AS BIGINT) AS VARCHAR))), 1, 15)"
    " AS HUGEINT)) AS VARCHAR) AS fingerprint FROM wd",
    with_=["wd"],
)
def _(spark, d):
    out = sinks.log_fingerprint(log_wd(spark, d), ["case_id", "activity", "ts", "value"])
    return out.withColumn("fingerprint", F.col("fingerprint").cast("string"))


@register(
    "S6_content_hash_order_independent",
    "SELECT count(*) AS n_rows, TRUE AS same_after_reorder FROM wd",
    with_=["wd"],
)
def _(spark, d):
    log = log_wd(spark, d)
    mixed = sinks.content_hash(log.repartition(7, "value")).select("hash").scalar()
    return sinks.content_hash(log).select("n_rows", (F.col("hash") == mixed).alias("same_after_reorder"))


@register(
    "S7_selection",
    "SELECT case_id, n_events, exposure FROM cw WHERE n_events >= 60",
    doubles="exposure",
    with_=["cw"],
    decimals=4,
)
def _(spark, d):
    cases = cases_w(spark, d)
    path = _path(spark, "selection")
    source = str(sinks.content_hash(cases.select("case_id", "n_events")).first()["hash"])
    sinks.save_selection(cases.where("n_events >= 60"), path, source)
    return sinks.resolve_selection(cases, path, source).select("case_id", "n_events", "exposure")


@register(
    "S8_log_profile",
    "SELECT count(*) AS n_events, count(DISTINCT case_id) AS n_cases, count(DISTINCT activity) AS n_activities,"
    " min(ts) AS first_ts, max(ts) AS last_ts FROM o",
    with_=["o"],
)
def _(spark, d):
    return profile.log_profile(log_o(spark, d, False))


def _details_sql() -> str:
    attributes = " UNION ALL ".join(f"SELECT 'attribute' AS part, '{c}' AS name, count({c}) AS n FROM tw" for c in ("event_id", "cents", "kind"))
    return (
        "(SELECT 'activity' AS part, event AS name, count(*) AS n FROM tw WHERE event IS NOT NULL GROUP BY event ORDER BY n DESC, name LIMIT 8)"
        " UNION ALL SELECT 'lifecycle', lifecycle, count(*) FROM tw WHERE lifecycle IS NOT NULL GROUP BY lifecycle"
        f" UNION ALL SELECT * FROM ({attributes}) WHERE n > 0"
    )


@register("S8_log_details", _details_sql(), with_=["tw"])
def _(spark, d):
    raw = text_w(spark, d)
    roles = profile.guess_columns(raw.columns)
    rest = [c for c in raw.columns if c not in (*roles.values(), "user", "lifecycle")]
    return profile.log_details(raw, activity=roles["activity"], lifecycle="lifecycle", attributes=rest)


@register("S9_distinct_keys", "SELECT event, lifecycle, count(*) AS n FROM tw GROUP BY event, lifecycle", with_=["tw"])
def _(spark, d):
    return profile.distinct_keys(text_w(spark, d), ["event", "lifecycle"])


def _profile_sql() -> str:
    parts = []
    for c in ("user", "event", "time", "event_id", "cents", "lifecycle", "kind"):
        parts.append(
            f"SELECT '{c}' AS name, count(*) AS n_rows, count(*) FILTER (WHERE \"{c}\" IS NULL OR \"{c}\" = '') AS n_empty,"
            f" count(*) FILTER (WHERE TRY_CAST(\"{c}\" AS DOUBLE) IS NOT NULL) AS n_numeric,"
            f" count(*) FILTER (WHERE TRY_CAST(\"{c}\" AS TIMESTAMP) IS NOT NULL) AS n_timestamp FROM tw"
        )
    body = " UNION ALL ".join(parts)
    return (
        "SELECT *, CASE WHEN n_rows > n_empty AND n_timestamp / (n_rows - n_empty) > 0.95 THEN 'timestamp'"
        f" WHEN n_rows > n_empty AND n_numeric / (n_rows - n_empty) > 0.95 THEN 'number' ELSE 'string' END AS guess FROM ({body})"
    )


@register("P1_column_profile", _profile_sql(), with_=["tw"])
def _(spark, d):
    out = profile.column_profile(text_w(spark, d))
    return out.select("name", "n_rows", "n_empty", "n_numeric", "n_timestamp", "guess")


MAPPED = prepare.Mapped(
    case_id="user",
    activity="event",
    timestamp="time",
    timestamp_format="yyyy-MM-dd HH:mm:ss.SSSSSS",
    lifecycle="lifecycle",
    event_id="event_id",
    exposure="cents",
    attributes=("kind",),
)


@register(
    "P2_typed_log",
    'SELECT "user" AS case_id, event AS activity, CAST(time AS TIMESTAMP) AS ts, event_id AS seq, abs(TRY_CAST(cents AS DOUBLE)) AS cents,'
    " lifecycle, coalesce(kind, '(missing)') AS kind FROM tw WHERE lower(lifecycle) = 'complete'",
    doubles="cents",
    with_=["tw"],
)
def _(spark, d):
    return prepare.typed_log(text_w(spark, d), MAPPED)


@register("P3_exposure", 'SELECT event_id, abs(TRY_CAST(cents AS DOUBLE)) AS cents FROM tw', doubles="cents", with_=["tw"])
def _(spark, d):
    return prepare.normalise_exposure(text_w(spark, d), "cents").select("event_id", "cents")


@register("P4_missing_label", "SELECT event_id, coalesce(kind, '(missing)') AS kind FROM tw", with_=["tw"])
def _(spark, d):
    return prepare.fill_missing(text_w(spark, d), ["kind"], "(missing)").select("event_id", "kind")


@register(
    "P5_mapping_check",
    "SELECT count(*) AS n_rows, count(TRY_CAST(time AS TIMESTAMP)) AS n_parsed, count(DISTINCT \"user\") AS n_cases, count(DISTINCT event) AS n_activities FROM tw",
    with_=["tw"],
)
def _(spark, d):
    return prepare.check_mapping(text_w(spark, d), MAPPED)


MAPPED_RULES = [
    {"name": "third kind", "rule": {"kind": "attribute", "field": "kind", "eq": "k3"}},
    {"name": "bought", "rule": {"and": [{"kind": "activity", "activity": "purchase"}, {"kind": "count", "activity": "view", "max": 8}]}},
]


@register(
    "P5_mapped_flow_types",
    "SELECT flow_type, count(*) AS cases, CAST(sum(n) AS BIGINT) AS events FROM (SELECT \"user\", count(*) AS n,"
    " CASE WHEN bool_or(coalesce(kind = 'k3', FALSE)) THEN 'third kind'"
    " WHEN count(*) FILTER (WHERE event = 'purchase') > 0 AND count(*) FILTER (WHERE event = 'view') <= 8 THEN 'bought' ELSE 'other' END AS flow_type"
    " FROM tw WHERE \"user\" IS NOT NULL AND lower(lifecycle) = 'complete' GROUP BY \"user\") GROUP BY flow_type",
    with_=["tw"],
)
def _(spark, d):
    return prepare.mapped_flow_types(text_w(spark, d), MAPPED, MAPPED_RULES, "other")


def _field_sql() -> str:
    parts = []
    for f, num in (("segment", False), ("nation", False), ("exposure", True), ("n_events", True)):
        c = f"CASE WHEN CAST({f} AS VARCHAR) IN ('', '(missing)') THEN NULL ELSE CAST({f} AS VARCHAR) END"
        stats = (
            ", ".join(f"{fn} FILTER (WHERE selected) AS {n}" for n, fn in (("min", f"min(CAST({f} AS DOUBLE))"), ("median", f"quantile_cont(CAST({f} AS DOUBLE), 0.5)"), ("p90", f"quantile_cont(CAST({f} AS DOUBLE), 0.9)"), ("max", f"max(CAST({f} AS DOUBLE))")))
            if num
            else "NULL::DOUBLE AS min, NULL::DOUBLE AS median, NULL::DOUBLE AS p90, NULL::DOUBLE AS max"
        )
        parts.append(
            f"SELECT '{f}' AS name, count(DISTINCT {c}) AS \"distinct\", count(*) FILTER (WHERE {c} IS NULL) AS missing_total,"
            f" count(*) FILTER (WHERE selected AND {c} IS NULL) AS missing_selected, {stats} FROM m"
        )
    return " UNION ALL ".join(parts)


@register(
    "P6_field_profiles",
    "SELECT * FROM (WITH m AS (SELECT * REPLACE (CASE WHEN nation IN ('FRANCE', 'NATION_03') OR case_id % 9 = 0 THEN '(missing)' ELSE nation END AS nation),"
    f" n_events >= 4 AS selected FROM co) {_field_sql()})",
    doubles="min median p90 max",
    decimals=4,
    with_=["co"],
)
def _(spark, d):
    hidden = F.col("nation").isin("FRANCE", "NATION_03") | (F.col("case_id") % 9 == 0)
    cases = case_table_o(spark, d).withColumn("nation", F.when(hidden, "(missing)").otherwise(F.col("nation")))
    marked = cases.withColumn("selected", F.col("n_events") >= 4)
    return profile.field_profiles(marked, ["segment", "nation", "exposure", "n_events"])


@register(
    "P7_attribute_inventory",
    "SELECT * FROM (SELECT 'segment' AS name, 'text' AS kind, count(DISTINCT segment) AS \"distinct\", count(*) FILTER (WHERE segment IS NULL) AS missing,"
    " NULL::DOUBLE AS min, NULL::DOUBLE AS p10, NULL::DOUBLE AS median, NULL::DOUBLE AS p90, NULL::DOUBLE AS max FROM co UNION ALL"
    " SELECT 'exposure', 'number', count(DISTINCT exposure), count(*) FILTER (WHERE exposure IS NULL), min(exposure),"
    " quantile_cont(exposure, 0.1), quantile_cont(exposure, 0.5), quantile_cont(exposure, 0.9), max(exposure) FROM co)",
    doubles="min p10 median p90 max",
    decimals=4,
    with_=["co"],
)
def _(spark, d):
    return profile.attribute_inventory(case_table_o(spark, d), ["segment", "exposure"])


@register(
    "P7_top_values",
    "SELECT name, value, n, rank, n / (SELECT count(*) FROM co) AS share FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS rank"
    " FROM (SELECT 'segment' AS name, segment AS value, count(*) AS n FROM co GROUP BY segment UNION ALL"
    " SELECT 'nation', nation, count(*) FROM co GROUP BY nation)) WHERE rank <= 5",
    doubles="share",
    with_=["co"],
)
def _(spark, d):
    return profile.top_values(case_table_o(spark, d), ["segment", "nation"], 5)


@register(
    "P8_activity_inventory",
    "SELECT coalesce(activity, '(null)') AS label, count(*) AS events, count(DISTINCT case_id) AS cases FROM wd GROUP BY activity",
    with_=["wd"],
)
def _(spark, d):
    return profile.activity_inventory(log_wd(spark, d))
