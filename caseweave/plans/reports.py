"""Ranked groups and the reports around them (K16 to K40, K44)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import join_on, period_label
from ..operators import backlog as K
from ..operators import quality as Q
from ..operators.filters import case_clause, resolve
from ..session import store
from ..sources import sinks
from .base import (
    BACKLOG_DOUBLES,
    CIDS,
    LAYERS,
    backlog_sql,
    case_table_o,
    cte,
    log_o,
    long_sql,
    norm_o,
    register,
    scored_o,
    vcol,
)
from .cases import typed_o

GAMMA = 20
NATION = ["nation"]
TWO = ["priority", "segment"]
SLICE = "nation = 'NATION_7'"


def inside():
    return F.col("nation") == "NATION_7"


cte("long_o", long_sql("A"), "so")
cte("bl_n", backlog_sql("nation", "A", GAMMA), "so")
cte("bl_nb", backlog_sql("nation", "B", GAMMA), "so")
cte("bl_2", backlog_sql("priority, segment", "A", GAMMA), "so")


def nation_backlog(spark, d, view: str = "A", **kw):
    return K.backlog(scored_o(spark, d), NATION, view, gamma=GAMMA, **kw)


@register("K16_backlog", "SELECT * FROM bl_2", doubles=BACKLOG_DOUBLES, with_=["bl_2"])
def _(spark, d):
    return K.backlog(scored_o(spark, d), TWO, "A", gamma=GAMMA)


@register(
    "K16_backlog_exposure",
    "SELECT nation, n_cases, mean_score, volume, gap, stable_PI, rank FROM (" + backlog_sql("nation", "B", 50, volume="sum(exposure)") + ")",
    doubles="mean_score volume gap stable_PI",
    decimals=2,
    with_=["so"],
)
def _(spark, d):
    out = K.backlog(scored_o(spark, d), NATION, "B", gamma=50, volume="exposure")
    return out.select("nation", "n_cases", "mean_score", "volume", "gap", "stable_PI", "rank")


@register(
    "K17_drill_in",
    "SELECT * FROM (" + backlog_sql("segment", "A", GAMMA, where="status = 'F'", baseline="(SELECT avg(score_A) FROM so)") + ")",
    doubles=BACKLOG_DOUBLES,
    with_=["so"],
)
def _(spark, d):
    scored = scored_o(spark, d)
    run_mean = scored.agg(F.avg("score__A")).scalar()
    return K.backlog(scored.where("status = 'F'"), ["segment"], "A", gamma=GAMMA, baseline=run_mean)


@register(
    "K18_backlog_page",
    "SELECT * FROM bl_2 WHERE n_cases >= 20 AND (lower(segment) LIKE '%u%') AND priority <> 'x' ORDER BY gap DESC NULLS LAST, rank LIMIT 5 OFFSET 5",
    doubles=BACKLOG_DOUBLES,
    with_=["bl_2"],
)
def _(spark, d):
    table = K.backlog(scored_o(spark, d), TWO, "A", gamma=GAMMA)
    return K.page(table, sort="-gap", search="u", search_columns=["segment"], min_cases=20, number=2, size=5)


_GAPS = ", ".join(f"avg(contrib_A_{x}) AS mean__{x}, avg(contrib_A_{x}) - (SELECT avg(contrib_A_{x}) FROM so) AS delta__{x}" for x in LAYERS)
_BEST = "greatest(" + ", ".join(f"delta__{x}" for x in LAYERS) + ")"
cte(
    "drv",
    f"SELECT *, CASE {' '.join(f'WHEN delta__{x} = {_BEST} THEN {chr(39)}{x}{chr(39)}' for x in LAYERS)} END AS dominant_layer FROM"
    f" (SELECT nation, count(*) AS n_cases, {_GAPS} FROM so GROUP BY nation)",
    "so",
)


@register(
    "K19_layer_drivers",
    "SELECT * FROM drv",
    doubles=" ".join(f"mean__{x} delta__{x}" for x in LAYERS),
    with_=["drv"],
)
def _(spark, d):
    return K.layer_drivers(scored_o(spark, d), NATION, "A", norm_o())


cte(
    "cdrv",
    f"SELECT constraint_id, layer, avg(p) FILTER (WHERE {SLICE}) AS mean_penalty, avg(v) FILTER (WHERE {SLICE}) AS mean_violation,"
    f" count(*) FILTER (WHERE v > 0 AND {SLICE}) / count(v) FILTER (WHERE {SLICE}) AS share_violated, avg(CAST(s AS INT)) FILTER (WHERE {SLICE}) AS share_in_scope,"
    f" count(v) FILTER (WHERE {SLICE}) / count(*) FILTER (WHERE {SLICE}) AS share_evaluated, avg(p) FILTER (WHERE {SLICE}) - avg(p) AS delta_gap,"
    f" CASE WHEN avg(score) - avg(score) FILTER (WHERE {SLICE}) > 0 THEN (avg(p) FILTER (WHERE {SLICE}) - avg(p)) / (avg(score) - avg(score) FILTER (WHERE {SLICE})) END AS share_of_shortfall"
    " FROM long_o WHERE score IS NOT NULL GROUP BY 1, 2",
    "long_o",
)
_CDRV = "mean_penalty mean_violation share_violated share_in_scope share_evaluated delta_gap share_of_shortfall"


@register("K20_constraint_drivers", "SELECT * FROM cdrv", doubles=_CDRV, with_=["cdrv"])
def _(spark, d):
    return K.constraint_drivers(scored_o(spark, d), norm_o(), "A", inside())


@register(
    "K21_top_constraint",
    "SELECT nation, dominant_layer, constraint_id, share, measures_logging FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY plain DESC, share DESC, position) AS r FROM"
    " (SELECT l.nation, d.dominant_layer, constraint_id, position, count(*) FILTER (WHERE v > 0) / count(v) AS share, constraint_id <> 'c_lag' AND count(*) FILTER (WHERE v > 0) > 0 AS plain, constraint_id = 'c_lag' AS measures_logging"
    " FROM long_o l JOIN drv d ON d.nation = l.nation AND d.dominant_layer = l.layer WHERE v IS NOT NULL GROUP BY l.nation, d.dominant_layer, constraint_id, position)) WHERE r = 1",
    doubles="share",
    with_=["long_o", "drv"],
)
def _(spark, d):
    return K.top_constraint(scored_o(spark, d), NATION, "A", norm_o(), demoted=["c_lag"])


cte(
    "meas",
    "SELECT *, CASE WHEN applies_to = 0 THEN NULL WHEN violated > 0 AND violated_without_value / violated > 0.5 THEN 'missing_partner' WHEN measured < 0.5 * applies_to THEN 'partly_measured' END AS reason FROM ("
    "SELECT constraint_id, layer, count(*) FILTER (WHERE s) AS applies_to, count(v) AS evaluated, count(*) FILTER (WHERE v > 0) AS violated,"
    " count(*) FILTER (WHERE s AND has_value) AS measured, count(*) FILTER (WHERE s AND v > 0 AND NOT has_value) AS violated_without_value FROM"
    " (SELECT *, CASE WHEN constraint_id IN ('c_lag', 'c_over', 'c_each') THEN x IS NOT NULL ELSE v IS NOT NULL END AS has_value FROM long_o) GROUP BY 1, 2)",
    "long_o",
)


def measured(spark, d):
    both = {c: F.col(f"x__{c}").isNotNull() for c in ("c_lag", "c_over", "c_each")}
    return K.measurement(scored_o(spark, d), norm_o(), both)


@register("K22_measurement", "SELECT * FROM meas", with_=["meas"])
def _(spark, d):
    return measured(spark, d)


@register(
    "K23_uncalibrated",
    "SELECT constraint_id, layer, violated / evaluated AS share_violated, evaluated, applies_to, measured, violated_without_value, coalesce(reason,"
    " CASE WHEN violated / evaluated > 0.9 THEN 'almost_always_missed' WHEN violated / evaluated < 0.01 THEN 'almost_never_missed' END) AS reason FROM meas WHERE evaluated > 0"
    " AND (reason IS NOT NULL OR violated / evaluated > 0.9 OR violated / evaluated < 0.01)",
    doubles="share_violated",
    with_=["meas"],
)
def _(spark, d):
    return K.uncalibrated(measured(spark, d))


def _mass_sql(keys: str, rows: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    k = f"{keys}, " if keys else ""
    return (
        f"SELECT {k}value, n_cases, penalty_mass, mean_penalty, penalty_mass / sum(penalty_mass) OVER ({part}) AS share, sum(penalty_mass) OVER o / sum(penalty_mass) OVER ({part}) AS cum_share,"
        f" row_number() OVER ({part} ORDER BY penalty_mass DESC, n_cases DESC, value) AS rank FROM (SELECT {k}value, count(*) AS n_cases, sum(pen) AS penalty_mass, avg(pen) AS mean_penalty FROM ({rows}) GROUP BY {k}value)"
        f" WINDOW o AS ({part} ORDER BY penalty_mass DESC, n_cases DESC, value ROWS UNBOUNDED PRECEDING)"
    )


_MASS = "penalty_mass mean_penalty share cum_share"


@register(
    "K24_penalty_mass",
    _mass_sql("", "SELECT nation AS value, 1 - score_A AS pen FROM so WHERE segment = 'BUILDING' AND score_A IS NOT NULL"),
    doubles=_MASS,
    with_=["so"],
)
def _(spark, d):
    return K.penalty_mass(scored_o(spark, d), "A", "nation", F.col("segment") == "BUILDING")


_SUB = " UNION ALL ".join(
    f"SELECT '{n}' AS attribute, {e} AS value, 1 - score_A AS pen, censored FROM so WHERE {SLICE} AND score_A IS NOT NULL"
    for n, e in (("priority", "priority"), ("segment", "segment"), ("start_quarter", "strftime(first_ts, '%Y') || '-Q' || quarter(first_ts)"))
)
cte("sub0", _SUB, "so")
cte(
    "sub",
    "SELECT m.*, o.censored_share, m.attribute = 'start_quarter' AND m.value >= '2001-Q2' AS partial_period FROM ("
    + _mass_sql("attribute", "SELECT * FROM sub0")
    + ") m LEFT JOIN (SELECT attribute, value, avg(CAST(censored AS INT)) AS censored_share FROM sub0 WHERE attribute = 'start_quarter' GROUP BY 1, 2) o USING (attribute, value)",
    "sub0",
)


def subgroup_table(spark, d):
    attributes = {
        "priority": F.col("priority"),
        "segment": F.col("segment"),
        "start_quarter": period_label(F.col("first_ts"), "quarter"),
    }
    return K.subgroups(
        scored_o(spark, d), "A", attributes, inside(), period="start_quarter", censored=F.col("censored"), partial_from="2001-Q2"
    )


@register("K25_subgroups", "SELECT * FROM sub", doubles=_MASS + " censored_share", with_=["sub"])
def _(spark, d):
    return subgroup_table(spark, d)


@register(
    "K25_values_for_share",
    "SELECT attribute, count(*) AS n_values, coalesce(min(rank) FILTER (WHERE cum_share >= 0.8 - 1e-12), max(rank)) AS values_for_share, arg_min(value, rank) AS top_value,"
    " max(share) FILTER (WHERE rank = 1) AS top_share FROM sub GROUP BY attribute",
    doubles="top_share",
    with_=["sub"],
)
def _(spark, d):
    return K.values_for_share(subgroup_table(spark, d))


@register(
    "K26_worst_cases",
    "SELECT case_id, score_A AS score, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {vcol(c)} > 0 THEN '{c}' END" for c in CIDS)
    + f"], lambda x: x IS NOT NULL), ',') AS violated FROM so WHERE {SLICE} AND score_A IS NOT NULL ORDER BY score_A, case_id LIMIT 20",
    doubles="score",
    with_=["so"],
)
def _(spark, d):
    out = K.worst_cases(scored_o(spark, d), norm_o(), "A", 20, inside())
    return out.withColumn("violated", F.array_join("violated", ","))


def _kind_sql(source: str) -> str:
    return (
        "SELECT *, CASE WHEN gap_pct IS NULL THEN 'none' WHEN gap_pct - size_pct >= 1.0 / 3 THEN 'acute' WHEN size_pct - gap_pct >= 1.0 / 3 THEN 'widespread' ELSE 'systematic' END AS kind FROM ("
        "SELECT nation, n_cases, stable_gap, CASE WHEN stable_gap > 0 THEN (rank() OVER (PARTITION BY stable_gap > 0 ORDER BY stable_gap) + (count(*) OVER (PARTITION BY stable_gap) - 1) / 2.0)"
        " / count(*) OVER (PARTITION BY stable_gap > 0) END AS gap_pct, (rank() OVER (ORDER BY n_cases) + (count(*) OVER (PARTITION BY n_cases) - 1) / 2.0) / count(*) OVER () AS size_pct"
        f" FROM {source})"
    )


cte("kind_a", _kind_sql("bl_n"), "bl_n")
cte("kind_b", _kind_sql("bl_nb"), "bl_nb")


@register("K27_problem_kind", "SELECT * FROM kind_a", doubles="stable_gap gap_pct size_pct", with_=["kind_a"])
def _(spark, d):
    return K.problem_kind(nation_backlog(spark, d), NATION)


@register(
    "K28_problem_kinds",
    "SELECT nation, a.kind AS kind__A, a.stable_gap AS gap__A, b.kind AS kind__B, b.stable_gap AS gap__B, CASE WHEN a.kind <> 'none' THEN a.kind ELSE b.kind END AS kind,"
    " (a.stable_gap > 0) <> (b.stable_gap > 0) AS changes_sign FROM kind_a a JOIN kind_b b USING (nation)",
    doubles="gap__A gap__B",
    with_=["kind_a", "kind_b"],
)
def _(spark, d):
    return K.problem_kinds(scored_o(spark, d), NATION, ["A", "B"], GAMMA)


@register(
    "K29_points_below",
    "SELECT nation, (global_mean - mean_score) * 100 AS points, abs(global_mean - mean_score) * 100 / global_mean AS percent FROM bl_n",
    doubles="points percent",
    with_=["bl_n"],
)
def _(spark, d):
    points, percent = K.points_below(F.col("mean_score"), F.col("global_mean"))
    return nation_backlog(spark, d).select("nation", points.alias("points"), percent.alias("percent"))


@register(
    "K30_validation",
    "SELECT a.nation, a.n_cases, censored_share, replicated_share, a.stable_gap, b.stable_gap AS stable_gap_closed, CASE WHEN a.stable_gap > 0 THEN b.stable_gap / a.stable_gap END AS retained, a.stable_PI"
    " FROM bl_n a JOIN (SELECT nation, avg(CAST(censored AS INT)) AS censored_share, avg(CAST(replicated AS INT)) AS replicated_share FROM so GROUP BY 1) s USING (nation) JOIN ("
    + backlog_sql("nation", "A", GAMMA, where="NOT censored")
    + ") b USING (nation)",
    doubles="censored_share replicated_share stable_gap stable_gap_closed retained stable_PI",
    with_=["bl_n", "so"],
)
def _(spark, d):
    return K.validation(scored_o(spark, d), NATION, "A", GAMMA)


@register(
    "K31_concentration",
    "SELECT nation, rank, PI, sum(PI) OVER (ORDER BY rank) / sum(PI) OVER () AS cum_share_PI, sum(n_cases) OVER (ORDER BY rank) / sum(n_cases) OVER () AS cum_share_cases FROM bl_n",
    doubles="PI cum_share_PI cum_share_cases",
    with_=["bl_n"],
)
def _(spark, d):
    return K.concentration(nation_backlog(spark, d), NATION)


_RHO = "1 - 6 * sum((a.rank - b.rank) * (a.rank - b.rank)) / (CAST(count(*) AS DOUBLE) * (count(*) * count(*) - 1))"


@register(
    "K32_view_agreement",
    f"SELECT 'A' AS view_a, 'B' AS view_b, count(*) FILTER (WHERE a.rank <= 5 AND b.rank <= 5) AS common, count(*) FILTER (WHERE a.rank <= 5 AND b.rank <= 5)"
    f" / count(*) FILTER (WHERE a.rank <= 5 OR b.rank <= 5) AS jaccard, {_RHO} AS rank_correlation FROM bl_n a JOIN bl_nb b USING (nation)",
    doubles="jaccard rank_correlation",
    with_=["bl_n", "bl_nb"],
)
def _(spark, d):
    return K.view_agreement(scored_o(spark, d), NATION, ["A", "B"], k=5, gamma=GAMMA)


@register(
    "K33_top_k_overlap",
    "SELECT count(*) FILTER (WHERE a.rank <= 8 AND b.rank <= 8) AS common, count(*) FILTER (WHERE a.rank <= 8 OR b.rank <= 8) AS either,"
    " count(*) FILTER (WHERE a.rank <= 8 AND b.rank <= 8) / count(*) FILTER (WHERE a.rank <= 8 OR b.rank <= 8) AS jaccard FROM bl_n a JOIN bl_nb b USING (nation)",
    doubles="jaccard",
    with_=["bl_n", "bl_nb"],
)
def _(spark, d):
    a, b = (store(nation_backlog(spark, d, v).select("nation", "rank")) for v in "AB")
    return K.top_k_overlap(a, b, NATION, 8)


# --------------------------------------------------------------------------- flow types, board
cte("sf", "SELECT s.*, f.flow_type FROM so s JOIN (SELECT case_id, flow_type FROM ft_o) f USING (case_id)", "so", "ft_o")


def scored_flow(spark, d, *columns):
    """The named columns of the scored cases with their flow type; only these are exchanged and stored."""
    return store(join_on(scored_o(spark, d).select("case_id", *columns), typed_o(spark, d).select("case_id", "flow_type"), ["case_id"]))


@register(
    "K34_flow_comparison",
    "SELECT * FROM (WITH lf AS ("
    + " UNION ALL ".join(f"SELECT flow_type, {i} AS position, '{c}' AS constraint_id, {vcol(c)} AS v FROM sf" for i, c in enumerate(CIDS))
    + "), m AS (SELECT flow_type, constraint_id, s FROM (SELECT *, row_number() OVER (PARTITION BY flow_type ORDER BY s DESC, position) AS r FROM (SELECT flow_type, position, constraint_id,"
    " count(*) FILTER (WHERE v > 0) / count(v) AS s FROM lf WHERE v IS NOT NULL GROUP BY ALL)) WHERE r = 1)"
    " SELECT flow_type, count(*) AS cases, count(*) / (SELECT count(*) FROM sf) AS share, avg(score_A) AS mean__A, greatest((SELECT avg(score_A) FROM sf) - avg(score_A), 0) AS gap__A,"
    " avg(score_B) AS mean__B, greatest((SELECT avg(score_B) FROM sf) - avg(score_B), 0) AS gap__B, avg(CAST(censored AS INT)) AS censored_share, max(m.constraint_id) AS most_missed, max(m.s) AS missed_share"
    " FROM sf JOIN m USING (flow_type) GROUP BY flow_type)",
    doubles="share mean__A gap__A mean__B gap__B censored_share missed_share",
    with_=["sf"],
)
def _(spark, d):
    return K.flow_comparison(scored_flow(spark, d, "censored", "score__A", "score__B", *[f"v__{c}" for c in CIDS]), ["A", "B"], norm_o())


@register(
    "K34_flow_top_groups",
    "SELECT flow_type, nation, n_cases, gap, stable_PI, rank FROM (SELECT *, row_number() OVER (PARTITION BY flow_type ORDER BY stable_PI DESC, n_cases DESC, nation) AS rank FROM (SELECT *,"
    " n_cases * n_cases / (n_cases + 20.0) * gap AS stable_PI FROM (SELECT flow_type, nation, count(*) AS n_cases, greatest((SELECT avg(score_A) FROM sf) - avg(score_A), 0) AS gap FROM sf GROUP BY 1, 2))) WHERE rank <= 3",
    doubles="gap stable_PI",
    with_=["sf"],
)
def _(spark, d):
    return K.flow_top_groups(scored_flow(spark, d, *NATION, "score__A"), NATION, "A", 3, GAMMA)


def _facet_sql(value: str, source: str = "so") -> str:
    return (
        "SELECT *, n_of * gap * n_of / (n_of + 20.0) AS stable_PI FROM (SELECT *, cases AS n_of, greatest((SELECT avg(score_A) FROM so) - mean_score, 0.0) AS gap FROM ("
        f"SELECT {value} AS value, count(score_A) AS cases, count(score_A) / (SELECT count(*) FROM {source}) AS share, avg(score_A) AS mean_score, count(*) FILTER (WHERE score_A < 1) AS cases_below,"
        f" count(*) FILTER (WHERE score_A < 1) / count(score_A) AS share_below, count(*) FILTER (WHERE censored) AS open_cases, avg(CAST(censored AS INT)) AS open_share, sum(exposure) AS exposure FROM {source} GROUP BY 1))"
    )


_FACET = "share mean_score share_below gap stable_PI open_share exposure"


def _facet(name: str, value_sql: str, value, source: str = "so") -> None:
    @register(name, f"SELECT * EXCLUDE (n_of) FROM ({_facet_sql(value_sql, source)})", doubles=_FACET, decimals=4, with_=[source, "so"])
    def _(spark, d):
        scored = scored_flow(spark, d, "censored", "exposure", "score__A") if source == "sf" else scored_o(spark, d)
        return K.facets(scored, value(), "A", scored_o(spark, d).agg(F.avg("score__A")).scalar(), GAMMA)


_facet("K35_facets_attribute", "segment", lambda: F.col("segment"))
_facet("K35_facets_flow_type", "flow_type", lambda: F.col("flow_type"), "sf")
_facet("K35_facets_quarter", "strftime(first_ts, '%Y') || '-Q' || quarter(first_ts)", lambda: period_label(F.col("first_ts"), "quarter"))
_facet(
    "K35_facets_week",
    "isoyear(first_ts) || '-W' || lpad(CAST(weekofyear(first_ts) AS VARCHAR), 2, '0')",
    lambda: period_label(F.col("first_ts"), "week"),
)


@register(
    "K36_tiles",
    "SELECT count(*) AS cases, (SELECT count(*) FROM so) AS cases_total, count(score_A) AS scored, count(*) FILTER (WHERE score_A < 1) / count(score_A) AS share_below,"
    " (SELECT sum(g) FROM (SELECT count(*) * count(*) / (count(*) + 20.0) * greatest((SELECT avg(score_A) FROM so) - avg(score_A), 0) AS g FROM so WHERE status = 'F' GROUP BY nation)) AS priority_at_stake,"
    " (SELECT count(DISTINCT nation) FROM so WHERE status = 'F') AS groups, count(*) FILTER (WHERE censored) / count(*) AS open_share, avg(score_A) AS mean_score FROM so WHERE status = 'F'",
    doubles="share_below priority_at_stake open_share mean_score",
    with_=["so"],
)
def _(spark, d):
    scored = scored_o(spark, d)
    return K.tiles(scored, F.col("status") == "F", NATION, "A", scored.agg(F.avg("score__A")).scalar(), GAMMA)


# --------------------------------------------------------------------------- bands and grouping design
def _label(col: str) -> str:
    """Edge text: three digits with k or M."""
    return f"printf('%.3g', {col} / 1000) || 'k'"


cte(
    "quart",
    "SELECT quantile_cont(exposure, 0.25) AS a, quantile_cont(exposure, 0.5) AS b, quantile_cont(exposure, 0.75) AS c FROM co",
    "co",
)


@register(
    "K37_bands",
    f"SELECT case_id, CASE WHEN exposure < a THEN '< ' || {_label('a')} WHEN exposure < b THEN {_label('a')} || ' – ' || {_label('b')}"
    f" WHEN exposure < c THEN {_label('b')} || ' – ' || {_label('c')} ELSE '≥ ' || {_label('c')} END AS band FROM co, quart",
    with_=["co", "quart"],
)
def _(spark, d):
    cases = case_table_o(spark, d)
    return cases.select("case_id", K.band("exposure", K.band_edges(cases, "exposure", 4)).alias("band"))


@register(
    "K37_bands_cuts",
    "SELECT CASE WHEN n_events < 3 THEN '< 3' WHEN n_events < 6 THEN '3 – 6' ELSE '≥ 6' END AS band, count(*) AS cases FROM co GROUP BY 1",
    with_=["co"],
)
def _(spark, d):
    cases = case_table_o(spark, d).withColumn("band", K.band("n_events", [3, 6]))
    return cases.groupBy("band").agg(F.count(F.lit(1)).alias("cases"))


@register(
    "K38_slicing_preview",
    "SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS cases, count(*) FILTER (WHERE n < 25) AS below_min, min(n) AS size_min, max(n) AS size_max, quantile_cont(n, 0.5) AS size_median,"
    " quantile_cont(n, 0.9) AS size_p90 FROM (SELECT count(*) AS n FROM co GROUP BY nation, priority, segment)",
    doubles="size_median size_p90",
    with_=["co"],
)
def _(spark, d):
    return K.slicing_preview(scored_o(spark, d), ["nation", "priority", "segment"], 25)


@register(
    "K38_largest_groups",
    "SELECT nation, priority, count(*) AS n_cases FROM co GROUP BY 1, 2 ORDER BY n_cases DESC, nation, priority LIMIT 10",
    with_=["co"],
)
def _(spark, d):
    return K.largest_groups(scored_o(spark, d), ["nation", "priority"])


@register(
    "K39_grouping_options",
    "SELECT 'segment' AS name, 'categorical' AS type, count(DISTINCT segment) AS \"distinct\", count(*) FILTER (WHERE segment IS NULL) AS missing, TRUE AS suggested FROM co UNION ALL"
    " SELECT 'exposure', 'numeric', count(DISTINCT exposure), 0, TRUE FROM co UNION ALL SELECT 'customer', 'categorical', count(*), 0, FALSE FROM co UNION ALL"
    " SELECT 'n_events', 'numeric', count(DISTINCT n_events), 0, TRUE FROM co",
    with_=["co"],
)
def _(spark, d):
    cases = case_table_o(spark, d).withColumn("customer", F.concat(F.lit("c"), F.col("case_id").cast("string")))
    return K.grouping_options(cases, ["segment", "exposure", "customer", "n_events"])


_COLUMNS = ("nation", "priority", "segment", "status")


def _discovery_sql() -> str:
    from itertools import combinations

    relevance = {"segment": 0.5, "status": 0.3}
    parts = []
    for w in (1, 2, 3):
        for combo in combinations(_COLUMNS, w):
            miss = " OR ".join(f"{c} = '(missing)'" for c in combo)
            rel = min(1.0, sum(relevance.get(c, 0.0) for c in combo))
            parts.append(
                f"SELECT '{' × '.join(combo)}' AS grouping, CAST({rel} AS DOUBLE) AS relevance, count(*) AS groups, CAST(sum(n) AS BIGINT) AS cases, count(*) FILTER (WHERE n < 100) AS below_min,"
                f" CAST(coalesce(sum(n) FILTER (WHERE n >= 100), 0) AS BIGINT) AS supported, CAST(sum(CASE WHEN miss THEN 0 ELSE n END) AS BIGINT) AS support FROM (SELECT count(*) AS n, bool_or({miss}) AS miss FROM hidden GROUP BY {', '.join(combo)})"
            )
    return (
        "SELECT * FROM (WITH hidden AS (SELECT * REPLACE (CASE WHEN case_id % 4 = 0 THEN '(missing)' ELSE segment END AS segment) FROM co)"
        f" SELECT *, round(0.7 * supported / cases * support / cases + 0.3 * relevance, 6) AS score FROM ({' UNION ALL '.join(parts)}))"
    )


@register("K40_grouping_discovery", _discovery_sql(), doubles="relevance score", decimals=5, with_=["co"])
def _(spark, d):
    hidden = F.when(F.col("case_id") % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("segment"))
    cases = case_table_o(spark, d).withColumn("segment", hidden)
    return K.grouping_discovery(cases, _COLUMNS, 100, {"segment": 0.5, "status": 0.3})


# --------------------------------------------------------------------------- assessing a filtered selection
SEL = "nation = 'NATION_7' AND n_return > 0"


@register(
    "K44_selection_drivers",
    "SELECT constraint_id, avg(p) FILTER (WHERE " + SEL + ") AS mean_penalty, avg(p) FILTER (WHERE " + SEL + ") - avg(p) AS delta_gap,"
    " (SELECT avg(CAST(censored AS INT)) FROM so WHERE " + SEL + ") AS censored_share, (SELECT count(*) FROM so WHERE " + SEL + ") AS cases,"
    " (SELECT CAST(sum(CAST('0x' || substr(md5(CAST(case_id AS VARCHAR)), 1, 15) AS HUGEINT)) AS VARCHAR) FROM so WHERE " + SEL + ") AS fingerprint"
    " FROM long_o WHERE score IS NOT NULL GROUP BY constraint_id",
    doubles="mean_penalty delta_gap censored_share",
    with_=["long_o", "so"],
)
def _(spark, d):
    clause = {"kind": "activity", "op": "contains", "activity": "Return item"}
    # The clause reads no attribute of a case.  The narrow side is stored: every reader joins only its columns.
    hits = resolve(log_o(spark, d, False), [clause], {"n_events": F.count(F.lit(1))})
    hits = store(hits.select("case_id", case_clause(clause).alias("hit")))
    scored = join_on(scored_o(spark, d), hits, ["case_id"])
    where = inside() & F.col("hit")
    drivers = K.constraint_drivers(scored, norm_o(), "A", where).select("constraint_id", "mean_penalty", "delta_gap")
    picked = scored.where(where)
    share = Q.caveats_by(picked, [], ["censoring"]).select(F.struct("censoring_share", "n_cases")).scalar()
    mark = sinks.log_fingerprint(picked, ["case_id"]).select(F.col("fingerprint").cast("string")).scalar()
    return drivers.withColumns({"censored_share": share["censoring_share"], "cases": share["n_cases"], "fingerprint": mark})
