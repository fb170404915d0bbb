"""Process map, variants and timing on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import any_of, join_on
from ..operators import cases as C
from ..operators import flow as G
from ..operators import match as M
from ..session import store
from .base import CIDS, cte, log_o, log_wd, norm_o, register, scored_o, vcol

# The dirty log has ties, missing labels and missing stamps.
cte(
    "seq",
    "SELECT *, lead(activity) OVER x AS nxt, lead(ts) OVER x AS nts, row_number() OVER x - 1 AS pos, count(*) OVER (PARTITION BY case_id) AS len FROM wd"
    " WINDOW x AS (PARTITION BY case_id ORDER BY ts NULLS LAST, seq)",
    "wd",
)
HOURS = "(epoch_us(nts) - epoch_us(ts)) / 3600000000.0"
cte("nodes", "SELECT activity, count(*) AS events, count(DISTINCT case_id) AS cases FROM seq WHERE activity IS NOT NULL GROUP BY 1", "seq")
cte(
    "edges",
    f"SELECT activity AS source, nxt AS target, count(*) AS n, count(DISTINCT case_id) AS cases, quantile_cont({HOURS}, 0.5) AS median_hours FROM seq"
    " WHERE activity IS NOT NULL AND nxt IS NOT NULL GROUP BY 1, 2",
    "seq",
)
cte(
    "ends",
    "SELECT activity, count(*) AS n, 'start' AS side FROM seq WHERE pos = 0 AND activity IS NOT NULL GROUP BY 1 UNION ALL"
    " SELECT activity, count(*), 'end' FROM seq WHERE nxt IS NULL AND activity IS NOT NULL GROUP BY 1",
    "seq",
)


def seq_wd(spark, d):
    return G.sequence(log_wd(spark, d))


@register("G1_nodes", "SELECT * FROM nodes", with_=["nodes"])
def _(spark, d):
    return G.nodes(seq_wd(spark, d))


@register("G1_edges", "SELECT * FROM edges", doubles="median_hours", with_=["edges"])
def _(spark, d):
    return G.edges(seq_wd(spark, d))


@register("G1_edges_orders", f"SELECT activity AS source, nxt AS target, count(*) AS n, count(DISTINCT case_id) AS cases, quantile_cont({HOURS}, 0.5) AS median_hours FROM (SELECT *, lead(activity) OVER x AS nxt, lead(ts) OVER x AS nts FROM o WINDOW x AS (PARTITION BY case_id ORDER BY ts, seq)) WHERE nxt IS NOT NULL GROUP BY 1, 2", doubles="median_hours", with_=["o"])
def _(spark, d):
    return G.edges(G.sequence(log_o(spark, d, False)))


@register("G1_boundaries", "SELECT * FROM ends", with_=["ends"])
def _(spark, d):
    return G.boundaries(seq_wd(spark, d))


@register(
    "G1_hot_cases_cut",
    "SELECT activity AS source, nxt AS target, count(*) AS n, count(DISTINCT case_id) AS cases, CAST(sum(pos) AS BIGINT) AS positions FROM seq WHERE activity IS NOT NULL AND nxt IS NOT NULL GROUP BY 1, 2",
    with_=["seq"],
)
def _(spark, d):
    """The map when most cases exceed the size that one task may sort."""
    seq = G.sequence(log_wd(spark, d), hot_events=65)
    rows = seq.where(F.col("activity").isNotNull() & F.col("nxt_activity").isNotNull())
    return rows.groupBy(F.col("activity").alias("source"), F.col("nxt_activity").alias("target")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("case_id").alias("cases"), F.sum("pos").alias("positions")
    )


cte("bad", "SELECT case_id, " + " OR ".join(f"coalesce({vcol(c)} > 0, FALSE)" for c in ("c_noret", "c_single", "c_bal")) + " AS violated FROM so", "so")
cte(
    "seqo",
    "SELECT *, lead(activity) OVER x AS nxt, lead(ts) OVER x AS nts FROM o WINDOW x AS (PARTITION BY case_id ORDER BY ts, seq)",
    "o",
)
cte(
    "paths",
    f"SELECT direction, other, count(*) AS n, count(DISTINCT case_id) AS cases, count(DISTINCT CASE WHEN violated THEN case_id END) AS violated_cases,"
    f" count(DISTINCT CASE WHEN violated THEN case_id END) / count(DISTINCT case_id) AS violation_share, quantile_cont(h, 0.5) AS median_hours FROM (SELECT 'incoming' AS direction, activity AS other, case_id, {HOURS} AS h FROM seqo"
    f" WHERE nxt = 'Ship item' UNION ALL SELECT 'outgoing', nxt, case_id, {HOURS} FROM seqo WHERE activity = 'Ship item' AND nxt IS NOT NULL) LEFT JOIN bad USING (case_id) GROUP BY 1, 2",
    "seqo",
    "bad",
)


def focus(spark, d):
    violated = any_of(F.coalesce(F.col(f"v__{c}") > 0, F.lit(False)) for c in ("c_noret", "c_single", "c_bal"))
    flags = scored_o(spark, d).select("case_id", violated.alias("violated"))
    return G.focus_paths(G.sequence(log_o(spark, d, False)), "Ship item", flags)


@register("G2_focus_paths", "SELECT * FROM paths", doubles="violation_share median_hours", with_=["paths"])
def _(spark, d):
    return focus(spark, d)


@register(
    "G2_hidden_paths",
    "SELECT direction, count(*) AS paths, count(*) FILTER (WHERE e.source IS NULL) AS hidden, CAST(coalesce(sum(p.cases) FILTER (WHERE e.source IS NULL), 0) AS BIGINT) AS hidden_cases FROM paths p LEFT JOIN"
    " (SELECT activity AS source, nxt AS target FROM seqo WHERE nxt IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT case_id) / (SELECT count(*) FROM so) >= 0.6) e"
    " ON e.source = CASE WHEN direction = 'incoming' THEN other ELSE 'Ship item' END AND e.target = CASE WHEN direction = 'incoming' THEN 'Ship item' ELSE other END GROUP BY 1",
    with_=["paths", "seqo", "so"],
)
def _(spark, d):
    _, drawn, _ = G.abstraction(G.sequence(log_o(spark, d, False)), 0.6)
    return G.hidden_paths(focus(spark, d), "Ship item", drawn)


_SHARE = "(SELECT count(DISTINCT case_id) FROM wd)"


@register(
    "G3_abstraction",
    f"SELECT 'node' AS part, activity AS a, NULL AS b, cases FROM nodes WHERE cases / {_SHARE} >= 0.97"
    f" UNION ALL SELECT 'edge', source, target, cases FROM edges WHERE cases / {_SHARE} >= 0.97 AND source IN (SELECT activity FROM nodes WHERE cases / {_SHARE} >= 0.97)"
    f" AND target IN (SELECT activity FROM nodes WHERE cases / {_SHARE} >= 0.97) UNION ALL SELECT side, activity, NULL, n FROM ends WHERE n / {_SHARE} >= 0.97 AND activity IN (SELECT activity FROM nodes WHERE cases / {_SHARE} >= 0.97)",
    with_=["nodes", "edges", "ends", "wd"],
)
def _(spark, d):
    kept, linked, ends = G.abstraction(seq_wd(spark, d), 0.97)
    none = F.lit(None).cast("string").alias("b")
    return (
        kept.select(F.lit("node").alias("part"), F.col("activity").alias("a"), none, "cases")
        .unionByName(linked.select(F.lit("edge").alias("part"), F.col("source").alias("a"), F.col("target").alias("b"), "cases"))
        .unionByName(ends.select(F.col("side").alias("part"), F.col("activity").alias("a"), none, F.col("n").alias("cases")))
    )


cte(
    "vsh",
    " UNION ALL ".join(
        f"SELECT '{c}' AS constraint_id, count({vcol(c)}) AS evaluated, avg(CAST({vcol(c)} > 0 AS INT)) AS share_violated, avg({vcol(c)}) AS mean_violation FROM so" for c in CIDS
    ),
    "so",
)


@register("G4_violation_shares", "SELECT constraint_id, evaluated, share_violated, mean_violation FROM vsh", doubles="share_violated mean_violation", with_=["vsh"])
def _(spark, d):
    return G.violation_shares(scored_o(spark, d), norm_o()).drop("layer")


cte(
    "named",
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{c.id}', '{a}')" for c in norm_o().constraints for a in c.activities())
    + ") AS t(constraint_id, activity)",
)


@register(
    "G4_activity_violation",
    "SELECT activity, max(share_violated) AS violation_share, count(*) AS constraints FROM named JOIN vsh USING (constraint_id) GROUP BY 1",
    doubles="violation_share",
    with_=["named", "vsh"],
)
def _(spark, d):
    return G.activity_violation(G.violation_shares(scored_o(spark, d), norm_o()), norm_o())


@register(
    "G4_constraint_arcs",
    "SELECT constraint_id, source, target, evaluated, share_violated FROM (VALUES ('c_lag', 'Place order', 'Ship item'), ('c_over', 'Place order', 'Return item'), ('c_each', 'Ship item', 'Return item'),"
    " ('c_prec', 'Place order', 'Ship item')) AS t(constraint_id, source, target) JOIN vsh USING (constraint_id)",
    doubles="share_violated",
    with_=["vsh"],
)
def _(spark, d):
    return G.constraint_arcs(G.violation_shares(scored_o(spark, d), norm_o()), norm_o())


@register(
    "G5_activity_profile",
    "SELECT activity, count(*) AS events, count(DISTINCT case_id) AS cases, count(DISTINCT case_id) / (SELECT count(*) FROM co) AS share_of_cases, max(v.violation_share) AS violation_share,"
    " max(v.constraints) AS constraints, max(p.paths) AS paths FROM o JOIN (SELECT activity, max(share_violated) AS violation_share, count(*) AS constraints FROM named JOIN vsh USING (constraint_id) GROUP BY 1) v USING (activity)"
    " LEFT JOIN (SELECT activity, count(*) AS paths FROM (SELECT DISTINCT activity, nxt, 'out' AS s FROM seqo WHERE nxt IS NOT NULL UNION ALL SELECT DISTINCT nxt, activity, 'in' FROM seqo WHERE nxt IS NOT NULL) GROUP BY 1) p USING (activity) GROUP BY 1",
    doubles="share_of_cases violation_share",
    with_=["o", "co", "named", "vsh", "seqo"],
)
def _(spark, d):
    seq = G.map_counts(G.sequence(log_o(spark, d, False)), ("node", "edge", "case"))
    shares = G.activity_violation(G.violation_shares(scored_o(spark, d), norm_o()), norm_o())
    links = G.edges(seq)
    ends = links.select(F.col("source").alias("activity")).unionByName(links.select(F.col("target").alias("activity")))
    out = join_on(G.nodes(seq), shares, ["activity"])
    out = join_on(out, ends.groupBy("activity").agg(F.count(F.lit(1)).alias("paths")), ["activity"], "left")
    return out.withColumn("share_of_cases", F.col("cases") / G.n_cases(seq))


# --------------------------------------------------------------------------- variants
_STEPS = "list(activity ORDER BY ts NULLS LAST, seq)"


def _variant_sql(source: str) -> str:
    """Digest of the label list, digested twice more, as the operator defines it."""
    return (
        "SELECT variant, count(*) AS n_cases, max(len) AS n_steps, count(h) AS duration_cases, count(*) / (SELECT count(DISTINCT case_id) FROM "
        + source
        + ") AS share, quantile_cont(h, 0.5) AS median_hours, array_to_string((list(CAST(case_id AS VARCHAR) ORDER BY CAST(case_id AS VARCHAR)))[1:3], ',') AS examples, any_value(steps) AS labels FROM"
        " (SELECT case_id, len, h, array_to_string(list_transform(steps0, lambda x: coalesce(x, '∅')), '|') AS steps, sha256('[' || array_to_string(list_transform(steps0, lambda x: coalesce('\"' || x || '\"', 'null')), ',') || ']') AS variant FROM"
        f" (SELECT case_id, count(*) AS len, CASE WHEN count(ts) = count(*) THEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0 END AS h, {_STEPS} AS steps0 FROM {source} GROUP BY case_id)) GROUP BY variant"
    )


def _variants(events):
    out = G.variants(events, events.agg(F.count_distinct("case_id")).scalar())
    labels = F.array_join(F.transform("labels", lambda x: F.coalesce(x, F.lit("∅"))), "|")
    return out.withColumns({"labels": labels, "examples": F.array_join("examples", ",")})


@register("G6_variants", _variant_sql("o"), doubles="share median_hours", with_=["o"])
def _(spark, d):
    return _variants(log_o(spark, d, False))


@register("G6_variants_missing_labels", _variant_sql("wd"), doubles="share median_hours", with_=["wd"])
def _(spark, d):
    return _variants(log_wd(spark, d))


@register(
    "G6_top_variants",
    "SELECT * FROM (WITH v AS (SELECT labels, count(*) AS n_cases FROM (SELECT array_to_string(list(activity ORDER BY ts, seq), '|') AS labels, '[' || string_agg('\"' || activity || '\"', ',' ORDER BY ts, seq) || ']' AS j, case_id FROM o GROUP BY case_id) GROUP BY labels, j"
    " ORDER BY n_cases DESC, j LIMIT 10) SELECT labels, n_cases, (SELECT sum(n_cases) FROM v) / (SELECT count(DISTINCT case_id) FROM o) AS coverage, (SELECT count(DISTINCT s) FROM (SELECT string_agg(activity, '|' ORDER BY ts, seq) AS s FROM o GROUP BY case_id)) AS total_variants FROM v)",
    doubles="coverage",
    with_=["o"],
)
def _(spark, d):
    events = log_o(spark, d, False)
    table = store(G.variants(events, events.agg(F.count_distinct("case_id")).scalar()))
    out = G.top_variants(table, 10)
    return out.select(F.array_join("labels", "|").alias("labels"), "n_cases", "coverage", "total_variants")


@register(
    "G6_variant_steps",
    "SELECT sha256('[' || string_agg('\"' || activity || '\"', ',' ORDER BY ts, seq) OVER (PARTITION BY case_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) || ']') AS variant,"
    " row_number() OVER (PARTITION BY case_id ORDER BY ts, seq) - 1 AS pos, activity FROM o WHERE case_id IN (SELECT min(case_id) FROM (SELECT case_id, string_agg(activity, '|' ORDER BY ts, seq) AS s FROM o GROUP BY 1) GROUP BY s)",
    with_=["o"],
)
def _(spark, d):
    events = log_o(spark, d, False)
    example = G.case_sequences(events).groupBy("variant").agg(F.min("case_id").alias("case_id"))
    return G.variant_steps(events, example)


# --------------------------------------------------------------------------- repetition, pairs, coverage
@register(
    "G7_repetition",
    "SELECT activity, CAST(sum(n) AS BIGINT) AS events, count(*) AS cases, count(*) FILTER (WHERE n >= 2) AS repeated_cases, CAST(sum(n - 1) AS BIGINT) AS extra_events FROM"
    " (SELECT activity, case_id, count(*) AS n FROM wd WHERE activity IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
    with_=["wd"],
)
def _(spark, d):
    return G.repetition(log_wd(spark, d))


_TIMING = "clock_coverage median_hours p90_hours case_weighted_median_hours"


def _timing_sql(rows: str) -> str:
    return (
        f"SELECT * FROM (WITH p AS ({rows}) SELECT source, target, count(*) AS pairs, count(DISTINCT case_id) AS cases, count(h) AS measured_pairs, count(DISTINCT CASE WHEN h IS NOT NULL THEN case_id END) AS measured_cases,"
        " count(*) FILTER (WHERE h = 0) AS equal_stamp_pairs, count(h) / count(*) AS clock_coverage, quantile_cont(h, 0.5) AS median_hours, quantile_cont(h, 0.9) AS p90_hours, max(c.m) AS case_weighted_median_hours"
        " FROM p LEFT JOIN (SELECT source, target, quantile_cont(m, 0.5) AS m FROM (SELECT source, target, case_id, quantile_cont(h, 0.5) AS m FROM p GROUP BY 1, 2, 3) GROUP BY 1, 2) c USING (source, target) GROUP BY 1, 2)"
    )


@register(
    "G8_pair_timing",
    _timing_sql(f"SELECT case_id, activity AS source, nxt AS target, {HOURS} AS h FROM seq WHERE activity IS NOT NULL AND nxt IS NOT NULL"),
    doubles=_TIMING,
    with_=["seq"],
)
def _(spark, d):
    return G.pair_timing(G.direct_pairs(seq_wd(spark, d)))


@register(
    "G9_eventual_pairs",
    _timing_sql(
        "SELECT f.case_id, 'signup' AS source, 'purchase' AS target, (epoch_us(t.ts) - epoch_us(f.ts)) / 3600000000.0 AS h FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS r FROM seq"
        " WHERE activity = 'signup') WHERE r = 1) f JOIN (SELECT s.*, row_number() OVER (PARTITION BY s.case_id ORDER BY s.pos) AS r FROM seq s JOIN (SELECT case_id, min(pos) AS p0 FROM seq WHERE activity = 'signup' GROUP BY 1) g"
        " ON g.case_id = s.case_id AND s.pos > g.p0 WHERE s.activity = 'purchase') t ON t.case_id = f.case_id AND t.r = 1"
    ),
    doubles=_TIMING,
    with_=["seq"],
)
def _(spark, d):
    return G.pair_timing(G.eventual_pairs(seq_wd(spark, d), "signup", "purchase"))


@register(
    "G10_frequent_pairs",
    "SELECT source, target, n AS pairs FROM edges ORDER BY n DESC, source, target LIMIT 10",
    with_=["edges"],
)
def _(spark, d):
    return G.frequent_pairs(seq_wd(spark, d), 10)


@register(
    "G11_recorded_boundaries",
    "SELECT 'start' AS side, activity, count(*) AS cases FROM seq WHERE pos = 0 GROUP BY 2 UNION ALL SELECT 'end', activity, count(*) FROM seq WHERE pos = len - 1 GROUP BY 2",
    with_=["seq"],
)
def _(spark, d):
    return G.recorded_boundaries(log_wd(spark, d))


@register(
    "G12_identity_coverage",
    "SELECT activity, count(*) AS events, count(*) FILTER (WHERE trim(resource) <> '') AS known, count(DISTINCT CASE WHEN trim(resource) <> '' THEN trim(resource) END) AS identities FROM wd GROUP BY 1",
    with_=["wd"],
)
def _(spark, d):
    return G.identity_coverage(log_wd(spark, d))


@register(
    "G13_missingness",
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, count(*) FILTER (WHERE {c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') AS missing, count(*) FILTER (WHERE NOT ({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '')) AS available FROM wd"
        for c in ("activity", "ts", "resource", "k")
    ),
    with_=["wd"],
)
def _(spark, d):
    return G.missingness(log_wd(spark, d), ["activity", "ts", "resource", "k"])


@register(
    "G14_support",
    "SELECT * FROM (WITH c AS (SELECT case_id, CASE WHEN count(ts) = count(*) THEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0 END AS h, max(ts) > TIMESTAMP '2024-01-29' AS op FROM wd GROUP BY 1)"
    " SELECT count(*) AS affected_cases, count(h) AS measured_cases, count(*) - count(h) AS unmeasured_cases, count(*) FILTER (WHERE op) AS open_cases, count(*) / (SELECT count(*) FROM c) AS case_share,"
    " quantile_cont(h, 0.5) AS median_span_hours FROM c WHERE case_id IN (SELECT case_id FROM wd WHERE activity = 'view page' AND k > 90))",
    doubles="case_share median_span_hours",
    with_=["wd"],
)
def _(spark, d):
    events = log_wd(spark, d)
    cases = C.build_cases(events, G.complete_span(events))
    cases = cases.withColumn("censored", F.col("last_ts") > F.lit("2024-01-29").cast("timestamp_ntz"))
    affected = events.where((F.col("activity") == "view page") & (F.col("k") > 90))
    return G.support(cases, affected)


@register(
    "G15_stage_lanes",
    "SELECT activity, events, cases, activity_id, stage FROM nodes LEFT JOIN (VALUES ('purchase', 'buy', 'closing'), ('signup', 'register', 'opening'), ('view', 'browse', 'middle'), ('view page', 'browse', 'middle')) AS t(activity, activity_id, stage) USING (activity)",
    with_=["nodes"],
)
def _(spark, d):
    from ..functions.exprs import text_rows

    texts = text_rows(
        spark,
        [("buy", "Purchase", "name"), ("browse", "View a page", "name"), ("browse", "View", "synonym"), ("register", "Sign-up", "name"), ("register", "Signup", "synonym")],
        ["activity_id", "text", "method"],
    )
    stages = text_rows(spark, [("buy", "closing"), ("browse", "middle"), ("register", "opening")], ["activity_id", "stage"])
    counts = G.nodes(seq_wd(spark, d))
    found = M.match(counts.select(F.col("activity").alias("label")), texts, top=1, least=0.85)
    lookup = found.select(F.col("label").alias("activity"), "activity_id").join(stages, "activity_id")
    return G.stage_lanes(counts, lookup).select("activity", "events", "cases", "activity_id", "stage")
