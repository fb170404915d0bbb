"""Explanations, headroom, what-if weights, bootstrap and sensitivity."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.intervals import newcombe, wilson, z_of
from ..operators import backlog as K
from ..operators import explain as X
from ..operators import uncertainty as U
from ..operators.norm import View, evaluate, gather, with_scores
from ..session import store
from .base import (
    CIDS,
    aggregates_o,
    backlog_sql,
    case_table_o,
    cte,
    log_o,
    norm_o,
    register,
    scored_o,
    scored_sql,
    vcol,
)
from .reports import GAMMA, NATION, SLICE, inside, nation_backlog

# --------------------------------------------------------------------------- X1, X2
_SIDES = {"slice": f"FILTER (WHERE {SLICE})", "all": "", "rest": f"FILTER (WHERE NOT {SLICE})"}


def _and(side: str, cond: str) -> str:
    extra = {"slice": f" AND {SLICE}", "all": "", "rest": f" AND NOT {SLICE}"}[side]
    return f"FILTER (WHERE {cond}{extra})"


cte(
    "wf0",
    "SELECT constraint_id, layer, avg(score) - avg(score) " + _SIDES["slice"] + " AS signed_gap, "
    + ", ".join(f"avg(p) {f} AS mean_penalty_{s}" for s, f in _SIDES.items())
    + ", "
    + ", ".join(
        f"count(v) {_SIDES[s]} AS n_evaluated_{s}, count(*) {_and(s, 'v > 0')} AS n_violated_{s}, avg(v) {_SIDES[s]} AS mean_violation_{s},"
        f" avg(CAST(s AS INT)) {_SIDES[s]} AS share_in_scope_{s}, count(v) {_SIDES[s]} / count(*) {_SIDES[s]} AS share_evaluated_{s}"
        for s in ("slice", "rest")
    )
    + " FROM long_o WHERE score IS NOT NULL GROUP BY 1, 2",
    "long_o",
)
Z95 = z_of(0.95)


def _wilson_sql(x: str, n: str) -> tuple[str, str]:
    p, z = f"({x} / {n})", Z95
    centre = f"({p} + {z * z} / (2 * {n}))"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4.0 * {n} * {n})))"
    scale = f"(1 + {z * z} / {n})"
    low = f"CASE WHEN {x} <= 0 THEN 0.0 ELSE greatest(0.0, ({centre} - {half}) / {scale}) END"
    high = f"CASE WHEN {x} >= {n} THEN 1.0 ELSE least(1.0, ({centre} + {half}) / {scale}) END"
    return low, high


_L1, _U1 = _wilson_sql("n_violated_slice", "n_evaluated_slice")
_L2, _U2 = _wilson_sql("n_violated_rest", "n_evaluated_rest")
cte(
    "wf",
    "SELECT *, greatest(-1.0, p1 - p2 - sqrt((p1 - l1) * (p1 - l1) + (u2 - p2) * (u2 - p2))) AS rd_low, least(1.0, p1 - p2 + sqrt((u1 - p1) * (u1 - p1) + (p2 - l2) * (p2 - l2))) AS rd_high FROM"
    f" (SELECT *, n_violated_slice / n_evaluated_slice AS p1, n_violated_rest / n_evaluated_rest AS p2, {_L1} AS l1, {_U1} AS u1, {_L2} AS l2, {_U2} AS u2 FROM wf0)",
    "wf0",
)
_WF = [
    "mean_penalty_slice",
    "mean_penalty_all",
    "mean_penalty_rest",
    "mean_violation_slice",
    "share_in_scope_slice",
    "share_evaluated_slice",
    "mean_violation_rest",
    "share_in_scope_rest",
    "share_evaluated_rest",
    "delta",
    "delta_vs_rest",
    "share_of_gap",
    "rate_slice",
    "rate_rest",
    "risk_difference",
    "rd_low",
    "rd_high",
    "relative_risk",
]


@register(
    "X1_contrast",
    "SELECT constraint_id, layer, mean_penalty_slice, mean_penalty_all, mean_penalty_rest, n_evaluated_slice, n_violated_slice, mean_violation_slice, share_in_scope_slice, share_evaluated_slice,"
    " n_evaluated_rest, n_violated_rest, mean_violation_rest, share_in_scope_rest, share_evaluated_rest, mean_penalty_slice - mean_penalty_all AS delta, mean_penalty_slice - mean_penalty_rest AS delta_vs_rest,"
    " (mean_penalty_slice - mean_penalty_all) / signed_gap AS share_of_gap, p1 AS rate_slice, p2 AS rate_rest, p1 - p2 AS risk_difference, rd_low, rd_high, CASE WHEN p2 > 0 THEN p1 / p2 END AS relative_risk FROM wf",
    doubles=" ".join(_WF),
    with_=["wf"],
)
def _(spark, d):
    return X.contrast(scored_o(spark, d), norm_o(), "A", inside())


@register(
    "X1_contrast_layers",
    "SELECT layer, sum(mean_penalty_slice) AS mean_penalty_slice, sum(mean_penalty_all) AS mean_penalty_all, sum(mean_penalty_rest) AS mean_penalty_rest,"
    " sum(mean_penalty_slice - mean_penalty_all) AS delta, sum(mean_penalty_slice - mean_penalty_rest) AS delta_vs_rest FROM wf GROUP BY layer",
    doubles="mean_penalty_slice mean_penalty_all mean_penalty_rest delta delta_vs_rest",
    with_=["wf"],
)
def _(spark, d):
    return X.contrast_layers(X.contrast(scored_o(spark, d), norm_o(), "A", inside()))


@register(
    "X1_identity",
    "SELECT round(sum(mean_penalty_slice - mean_penalty_all), 9) = round(max(signed_gap), 9) AS exact FROM wf",
    with_=["wf"],
)
def _(spark, d):
    scored = scored_o(spark, d)
    gap = scored.agg(F.avg("score__A") - F.avg(F.when(inside(), F.col("score__A")))).scalar()
    bars = X.contrast(scored, norm_o(), "A", inside()).agg(F.sum("delta").alias("s"))
    return bars.select((F.abs(F.col("s") - gap) < 1e-9).alias("exact"))


@register(
    "X2_intervals",
    "SELECT nation, l1 AS low, u1 AS high, greatest(-1.0, p1 - p2 - sqrt((p1 - l1) * (p1 - l1) + (u2 - p2) * (u2 - p2))) AS rd_low, least(1.0, p1 - p2 + sqrt((u1 - p1) * (u1 - p1) + (p2 - l2) * (p2 - l2))) AS rd_high FROM"
    f" (SELECT *, n_violated_slice / n_evaluated_slice AS p1, n_violated_rest / n_evaluated_rest AS p2, {_L1} AS l1, {_U1} AS u1, {_L2} AS l2, {_U2} AS u2 FROM"
    " (SELECT nation, count(*) FILTER (WHERE status = 'F') AS n_evaluated_slice, count(*) FILTER (WHERE status = 'F' AND n_return > 0) AS n_violated_slice,"
    " count(*) FILTER (WHERE status <> 'F') AS n_evaluated_rest, count(*) FILTER (WHERE status <> 'F' AND n_return > 0) AS n_violated_rest FROM co GROUP BY nation))",
    doubles="low high rd_low rd_high",
    with_=["co"],
)
def _(spark, d):
    cases = scored_o(spark, d).join(
        log_o(spark, d, False).where("activity = 'Return item'").select("case_id", F.lit(1).alias("r")).distinct(), "case_id", "left"
    )
    f, r = F.col("status") == "F", F.col("r").isNotNull()
    counts = cases.groupBy("nation").agg(
        F.count_if(f).alias("n1"), F.count_if(f & r).alias("x1"), F.count_if(~f).alias("n2"), F.count_if(~f & r).alias("x2")
    )
    x1, n1, x2, n2 = (F.col(c) for c in ("x1", "n1", "x2", "n2"))
    low, high = wilson(x1, n1, Z95)
    rd_low, rd_high = newcombe(x1, n1, x2, n2, Z95)
    return counts.select("nation", low.alias("low"), high.alias("high"), rd_low.alias("rd_low"), rd_high.alias("rd_high"))


# --------------------------------------------------------------------------- X3 to X6
cte("sg", f"SELECT constraint_id, x, {SLICE} AS in_slice, case_id FROM long_o WHERE x IS NOT NULL AND score IS NOT NULL", "long_o")


def signals(spark, d):
    return X.sides(scored_o(spark, d), norm_o(), "A", inside())


@register(
    "X3_cliffs_delta",
    "SELECT constraint_id, na AS n_slice, nb AS n_rest, 2 * (rs - na * (na + 1) / 2.0) / (CAST(na AS DOUBLE) * nb) - 1 AS cliffs_delta FROM (SELECT constraint_id, count(*) FILTER (WHERE in_slice) AS na,"
    " count(*) FILTER (WHERE NOT in_slice) AS nb, sum(r) FILTER (WHERE in_slice) AS rs FROM (SELECT *, rank() OVER (PARTITION BY constraint_id ORDER BY x) + (count(*) OVER (PARTITION BY constraint_id, x) - 1) / 2.0 AS r FROM sg)"
    " GROUP BY 1)",
    doubles="cliffs_delta",
    with_=["sg"],
)
def _(spark, d):
    return X.cliffs_delta(signals(spark, d))


@register(
    "X4_hodges_lehmann",
    "SELECT constraint_id, (min(d) FILTER (WHERE upto > (pairs - 1) // 2) + min(d) FILTER (WHERE upto > pairs // 2)) / 2 AS hl_shift FROM (SELECT constraint_id, d,"
    " sum(n) OVER (PARTITION BY constraint_id ORDER BY d) AS upto, sum(n) OVER (PARTITION BY constraint_id) AS pairs FROM (SELECT constraint_id, a.x - b.x AS d, sum(a.n * b.n) AS n"
    " FROM (SELECT * FROM sn WHERE in_slice) a JOIN (SELECT * FROM sn WHERE NOT in_slice) b USING (constraint_id) GROUP BY 1, 2)) GROUP BY 1",
    doubles="hl_shift",
    decimals=4,
    with_=["sn"],
)
def _(spark, d):
    return X.hodges_lehmann(signals(spark, d))


cte("sn", "SELECT constraint_id, x, in_slice, count(*) AS n FROM sg GROUP BY 1, 2, 3", "sg")


def _width(c: str) -> float:
    p = norm_o().constraint(c)
    if p.type in ("singularity", "precedence"):
        return float(p.params["K"])
    return float(p.params.get("width", 0.0)) if p.type in ("lag", "balance", "metric") else 1.0


WIDTHS = {c: _width(c) for c in CIDS}


@register(
    "X5_quantile_shifts",
    "SELECT constraint_id, q50_slice, q50_rest, q90_slice, q90_rest, q50_slice - q50_rest AS q50_shift, q90_slice - q90_rest AS q90_shift, CASE WHEN greatest(abs(q50_slice - q50_rest), abs(q90_slice - q90_rest)) <= 0.05 * w"
    " THEN 'no material shift' WHEN least(q50_slice, q50_rest, q90_slice, q90_rest) > 0 THEN CASE WHEN abs(ln(q50_slice / q50_rest)) >= 0.5 * abs(ln(q90_slice / q90_rest)) THEN 'whole distribution shifted' ELSE 'tail shifted' END"
    " WHEN abs(q50_slice - q50_rest) >= 0.5 * abs(q90_slice - q90_rest) THEN 'whole distribution shifted' ELSE 'tail shifted' END AS pattern FROM (SELECT constraint_id,"
    " quantile_cont(x, 0.5) FILTER (WHERE in_slice) AS q50_slice, quantile_cont(x, 0.5) FILTER (WHERE NOT in_slice) AS q50_rest, quantile_cont(x, 0.9) FILTER (WHERE in_slice) AS q90_slice,"
    " quantile_cont(x, 0.9) FILTER (WHERE NOT in_slice) AS q90_rest, CASE constraint_id " + " ".join(f"WHEN '{c}' THEN {w}" for c, w in WIDTHS.items()) + " END AS w FROM sg GROUP BY 1"
    " HAVING count(*) FILTER (WHERE in_slice) >= 20 AND count(*) FILTER (WHERE NOT in_slice) >= 20)",
    doubles="q50_slice q50_rest q90_slice q90_rest q50_shift q90_shift",
    decimals=5,
    with_=["sg"],
)
def _(spark, d):
    return X.quantile_shifts(signals(spark, d), WIDTHS)


@register(
    "X6_ecdf_pair",
    "SELECT * FROM (WITH h AS (SELECT constraint_id, x, count(*) FILTER (WHERE in_slice) AS a, count(*) FILTER (WHERE NOT in_slice) AS b FROM sg GROUP BY 1, 2) SELECT constraint_id, x,"
    " sum(a) OVER w / sum(a) OVER t AS f_slice, sum(b) OVER w / sum(b) OVER t AS f_rest FROM h WINDOW w AS (PARTITION BY constraint_id ORDER BY x), t AS (PARTITION BY constraint_id))",
    doubles="x f_slice f_rest",
    decimals=5,
    with_=["sg"],
)
def _(spark, d):
    return X.ecdf_pair(signals(spark, d))


# --------------------------------------------------------------------------- X8
def lens_values(spark, d, cid: str):
    return store(scored_o(spark, d).where(F.col(f"x__{cid}").isNotNull()).select(F.col(f"x__{cid}").alias("x"), F.col(f"v__{cid}").alias("v")))


def _lens(name: str, cid: str, log: bool = False) -> None:
    x = f"x_{cid[2:]}"
    threshold, saturation, _ = X.limits(norm_o().constraint(cid))
    if log:
        lo, hi = f"least(quantile_cont(log10(x), 0.005), {math.log10(threshold)})", f"greatest(quantile_cont(log10(x), 0.995), {math.log10(saturation)})"
        place, rows = "(log10(x) - lo) / (hi - lo) * 40", f"SELECT {x} AS x FROM so WHERE {x} > 0"
        sides = "log10(x) < lo - 1e-12", "log10(x) > hi + 1e-12"
    else:
        lo, hi = f"least(quantile_cont(x, 0.005), {threshold})", f"greatest(quantile_cont(x, 0.995), {saturation})"
        place, rows = "(x - lo) / (hi - lo) * 40", f"SELECT {x} AS x FROM so WHERE {x} IS NOT NULL"
        sides = "x < lo", "x > hi"
    sql = (
        f"SELECT * FROM (WITH r AS ({rows}), e AS (SELECT {lo} AS lo, {hi} AS hi FROM r) SELECT CASE WHEN {sides[0]} THEN -1 WHEN {sides[1]} THEN 40 ELSE"
        f" least(greatest(CAST(floor({place}) AS BIGINT), 0), 39) END AS bin, count(*) AS n FROM r, e GROUP BY 1)"
    )

    @register(name, sql, with_=["so"])
    def _(spark, d):
        values = lens_values(spark, d, cid)
        values = values.where(F.col("x") > 0) if log else values
        return X.lens_bins(values, X.lens_edges(values, norm_o().constraint(cid), log=log), log)


_lens("X8_lens_linear", "c_lag")
_lens("X8_lens_balance", "c_bal")
_lens("X8_lens_log", "c_metric", log=True)


@register(
    "X8_lens_counts",
    "SELECT CAST(x_single AS BIGINT) - CAST(floor((SELECT least(quantile_cont(x_single, 0.005), 2) FROM so)) AS BIGINT) AS bin, count(*) AS n FROM so"
    " WHERE x_single <= (SELECT floor(greatest(quantile_cont(x_single, 0.995), 5)) FROM so) GROUP BY 1 UNION ALL SELECT CAST(m.hi - m.lo + 1 AS BIGINT), count(*) FROM so,"
    " (SELECT floor(greatest(quantile_cont(x_single, 0.995), 5)) AS hi, floor(least(quantile_cont(x_single, 0.005), 2)) AS lo FROM so) m WHERE x_single > m.hi GROUP BY 1",
    with_=["so"],
)
def _(spark, d):
    values = lens_values(spark, d, "c_single")
    return X.lens_bins(values, X.lens_edges(values, norm_o().constraint("c_single")))


@register(
    "X8_lens_stats",
    "SELECT count(*) AS n, avg(x_lag) AS mean, min(x_lag) AS min, max(x_lag) AS max, avg(CAST(x_lag > 90 AS INT)) AS share_beyond_threshold, avg(CAST(x_lag > 455 AS INT)) AS share_beyond_saturation,"
    " avg(CAST(v_lag > 0 AS INT)) AS share_violated, avg(v_lag) AS mean_violation, quantile_cont(x_lag, 0.5) AS median, quantile_cont(x_lag, 0.9) AS p90, quantile_cont(x_lag, 0.95) AS p95 FROM so WHERE x_lag IS NOT NULL",
    doubles="mean min max share_beyond_threshold share_beyond_saturation share_violated mean_violation median p90 p95",
    with_=["so"],
)
def _(spark, d):
    return X.lens_stats(lens_values(spark, d, "c_lag"), norm_o().constraint("c_lag"))


@register(
    "X8_lens_ecdf",
    "SELECT i / 100.0 AS f, q AS x FROM (SELECT unnest(range(101)) AS i, unnest(quantile_cont(x_lag, [" + ", ".join(str(i / 100) for i in range(101)) + "])) AS q FROM so WHERE x_lag IS NOT NULL)",
    doubles="f x",
    decimals=5,
    with_=["so"],
)
def _(spark, d):
    return X.lens_ecdf(lens_values(spark, d, "c_lag"))


# --------------------------------------------------------------------------- X11, X12
_HR = "mean_penalty headroom_PI stable_PI stable_PI_after PI_reduction"


@register(
    "X11_headroom",
    "SELECT constraint_id, layer, mean_penalty, n_evaluated, share_in_scope, share_violated, mean_violation, n * mean_penalty AS headroom_PI, n * n / (n + 20.0) * greatest(base - mu, 0) AS stable_PI,"
    " n * n / (n + 20.0) * greatest(base - mu - mean_penalty, 0) AS stable_PI_after, n * n / (n + 20.0) * (greatest(base - mu, 0) - greatest(base - mu - mean_penalty, 0)) AS PI_reduction,"
    " CASE WHEN base > mu THEN (greatest(base - mu, 0) - greatest(base - mu - mean_penalty, 0)) / (base - mu) END AS share_of_PI FROM (SELECT constraint_id, layer, avg(p) AS mean_penalty, count(v) AS n_evaluated,"
    " avg(CAST(s AS INT)) AS share_in_scope, count(*) FILTER (WHERE v > 0) / count(v) AS share_violated, avg(v) AS mean_violation, count(*) AS n, avg(score) AS mu, (SELECT avg(score_A) FROM so) AS base FROM long_o"
    f" WHERE {SLICE} AND score IS NOT NULL GROUP BY 1, 2)",
    doubles=_HR + " share_in_scope share_violated mean_violation share_of_PI",
    with_=["long_o", "so"],
)
def _(spark, d):
    return X.headroom(scored_o(spark, d), norm_o(), "A", inside(), gamma=GAMMA)


@register(
    "X11_identity",
    f"SELECT round(sum(m), 9) = round(max(1 - mu), 9) AS exact FROM (SELECT avg(p) AS m, avg(score) AS mu FROM long_o WHERE {SLICE} AND score IS NOT NULL GROUP BY constraint_id)",
    with_=["long_o"],
)
def _(spark, d):
    rows = X.headroom(scored_o(spark, d), norm_o(), "A", inside())
    mu = scored_o(spark, d).where(inside()).agg(F.avg("score__A")).scalar()
    return rows.agg(F.sum("mean_penalty").alias("s")).select((F.abs(F.col("s") - (1 - mu)) < 1e-9).alias("exact"))


@register(
    "X12_headroom_by",
    "SELECT nation, constraint_id, mean_penalty, n * mean_penalty AS headroom_PI, n * n / (n + 20.0) * greatest(base - mu, 0) AS stable_PI, n * n / (n + 20.0) * greatest(base - mu - mean_penalty, 0) AS stable_PI_after,"
    " n * n / (n + 20.0) * (greatest(base - mu, 0) - greatest(base - mu - mean_penalty, 0)) AS PI_reduction FROM (SELECT nation, constraint_id, avg(p) AS mean_penalty, count(*) AS n, avg(score) AS mu,"
    " (SELECT avg(score_A) FROM so) AS base FROM long_o WHERE score IS NOT NULL GROUP BY 1, 2)",
    doubles=_HR,
    with_=["long_o", "so"],
)
def _(spark, d):
    return X.headroom_by(scored_o(spark, d), norm_o(), NATION, "A", gamma=GAMMA)


# --------------------------------------------------------------------------- X13, X14
NEW = {"c_ship": 1.0, "c_lag": 0.5, "c_over": 0.5, "c_each": 2.0, "c_prec": 1.0, "c_noret": 0.2, "c_single": 1.0, "c_bal": 3.0, "c_metric": 1.0}
cte("rw", scored_sql({"N": NEW}, source="vio_o"), "vio_o")
cte("bl_w", backlog_sql("nation", "N", GAMMA, source="rw"), "rw")


def reweighted(spark, d):
    rows = scored_o(spark, d).select("case_id", "nation", *[f"v__{c}" for c in CIDS])
    return with_scores(rows, norm_o(), [View("N", constraint_weights=NEW)])


@register("X13_reweight", "SELECT case_id, score_N AS score FROM rw", doubles="score", with_=["rw"])
def _(spark, d):
    return reweighted(spark, d).select("case_id", F.col("score__N").alias("score"))


_COMPARE = (
    "SELECT coalesce(a.nation, b.nation) AS nation, a.n_cases AS n_cases_before, a.mean_score AS mean_score_before, a.stable_PI AS stable_PI_before, a.rank AS rank_before, b.n_cases AS n_cases_after,"
    " b.mean_score AS mean_score_after, b.stable_PI AS stable_PI_after, b.rank AS rank_after, CASE WHEN a.rank IS NULL THEN 'entered' WHEN b.rank IS NULL THEN 'left' ELSE 'changed' END AS state,"
    " b.n_cases - a.n_cases AS delta_cases, round((b.mean_score - a.mean_score) * 100, 4) AS delta_mean_points, round(b.stable_PI - a.stable_PI, 6) AS delta_priority, a.rank - b.rank AS delta_rank,"
    " CASE WHEN a.rank IS NOT NULL AND b.rank IS NOT NULL THEN abs((b.mean_score - a.mean_score) * 100) < 0.05 AND abs(b.stable_PI - a.stable_PI) < 0.05 AND a.rank = b.rank END AS unchanged"
    " FROM {a} a FULL JOIN {b} b ON a.nation = b.nation"
)
_CMP = "mean_score_before stable_PI_before mean_score_after stable_PI_after delta_mean_points delta_priority"


@register("X13_reweighted_backlog", _COMPARE.format(a="bl_n", b="bl_w"), doubles=_CMP, decimals=4, with_=["bl_n", "bl_w"])
def _(spark, d):
    after = K.backlog(reweighted(spark, d), NATION, "N", gamma=GAMMA)
    return K.compare(nation_backlog(spark, d), after, NATION)


cte("bl_s", backlog_sql("nation", "A", GAMMA, where="status = 'F' AND nation <> 'NATION_3'"), "so")


def _scenario(spark, d):
    kept = scored_o(spark, d).where("status = 'F' and nation <> 'NATION_3'")
    return store(nation_backlog(spark, d)), store(K.backlog(kept, NATION, "A", gamma=GAMMA))


@register("X14_compare", _COMPARE.format(a="bl_n", b="bl_s"), doubles=_CMP, decimals=4, with_=["bl_n", "bl_s"])
def _(spark, d):
    return K.compare(*_scenario(spark, d), NATION)


@register(
    "X14_compare_summary",
    "SELECT count(rank_before) AS groups_before, count(rank_after) AS groups_after, count(*) FILTER (WHERE state = 'changed') AS groups_compared, count(*) FILTER (WHERE NOT unchanged) AS groups_changed,"
    " count(*) FILTER (WHERE state = 'entered') AS entered, count(*) FILTER (WHERE state = 'left') AS \"left\", count(*) FILTER (WHERE rank_before <= 10 AND rank_after <= 10) / 10 AS top_ten_overlap,"
    " sum(stable_PI_before) AS priority_before, sum(stable_PI_after) AS priority_after, 1 - 6 * sum((rank_before - rank_after) * (rank_before - rank_after))"
    " / (CAST(count(rank_before - rank_after) AS DOUBLE) * (count(rank_before - rank_after) * count(rank_before - rank_after) - 1)) AS rank_agreement FROM (" + _COMPARE.format(a="bl_n", b="bl_s") + ")",
    doubles="top_ten_overlap priority_before priority_after rank_agreement",
    with_=["bl_n", "bl_s"],
)
def _(spark, d):
    return K.compare_summary(*_scenario(spark, d), NATION)


# --------------------------------------------------------------------------- X15
PICK = "exposure >= 200000"


@register(
    "X15_activity_coverage",
    f"SELECT count(*) AS selected_cases, CAST(sum(n_return) AS BIGINT) AS events, 0 AS undated_events, count(*) FILTER (WHERE n_return = 0) AS without, count(*) FILTER (WHERE n_return = 1) AS single,"
    f" count(*) FILTER (WHERE n_return > 1) AS repeated FROM co WHERE {PICK}",
    with_=["co"],
)
def _(spark, d):
    return X.activity_coverage(log_o(spark, d, False), case_table_o(spark, d).where(PICK), ["Return item"])


cte(
    "ends_o",
    "SELECT CASE WHEN n_ship = 0 AND n_return = 0 THEN 'neither' WHEN n_ship = 0 THEN 'missing_start' WHEN n_return = 0 THEN 'missing_end' WHEN n_ship > 1 OR n_return > 1 THEN 'repeated'"
    " WHEN t_return < t_ship THEN 'reversed' WHEN t_return = t_ship THEN 'tied' ELSE 'ordered' END AS status, (epoch_us(t_return) - epoch_us(t_ship)) / 86400000000.0 AS days FROM co WHERE " + PICK,
    "co",
)


def _ends(spark, d):
    return X.endpoint_partition(log_o(spark, d, False), case_table_o(spark, d).where(PICK), ["Ship item"], ["Return item"])


@register("X15_endpoint_partition", "SELECT status, count(*) AS cases FROM ends_o GROUP BY 1", with_=["ends_o"])
def _(spark, d):
    return _ends(spark, d)[0]


@register(
    "X15_endpoint_days",
    "SELECT quantile_cont(days, 0.5) AS median_days, quantile_cont(days, 0.9) AS p90_days FROM ends_o WHERE status IN ('ordered', 'tied')",
    doubles="median_days p90_days",
    with_=["ends_o"],
)
def _(spark, d):
    return _ends(spark, d)[1]


@register(
    "X15_day_of_month",
    "SELECT CAST(g.day AS INTEGER) AS day, coalesce(events, 0) AS events, coalesce(cases, 0) AS cases, coalesce(months, 0) AS months FROM (SELECT unnest(range(1, 32)) AS day) g LEFT JOIN"
    f" (SELECT day(ts) AS day, count(*) AS events, count(DISTINCT case_id) AS cases, count(DISTINCT strftime(ts, '%Y-%m')) AS months FROM o WHERE activity = 'Return item' AND case_id IN (SELECT case_id FROM co WHERE {PICK})"
    " GROUP BY 1) c USING (day)",
    with_=["o", "co"],
)
def _(spark, d):
    return X.day_of_month(log_o(spark, d, False), case_table_o(spark, d).where(PICK), ["Return item"])


# --------------------------------------------------------------------------- X7, X9
B = 200


def _poisson_sql(u: str) -> str:
    out, cum = [], 0.0
    for k in range(11):
        cum += math.exp(-1.0) / math.factorial(k)
        out.append(f"WHEN {u} < {cum!r} THEN {k}")
    return f"CASE {' '.join(out)} ELSE 11 END"


def _draw_sql(keys: str, cols: str, source: str, unit: str = "case_id") -> str:
    """Every unit crossed with the replicates, with its weight; the SQL engine may form all rows."""
    h = f"md5(CAST({unit} AS VARCHAR) || ':7')"
    return (
        f"SELECT b, {keys}, {cols}, {_poisson_sql(f'(((h1 + b * h2) % {U.PRIME}) / {float(U.PRIME)!r})')} AS w FROM (SELECT *, CAST('0x' || substr({h}, 1, 7) AS BIGINT) AS h1,"
        f" CAST('0x' || substr({h}, 8, 7) AS BIGINT) AS h2 FROM {source}) CROSS JOIN (SELECT unnest(range(1, {B} + 1)) AS b)"
    )


def _boot_sql(source: str, unit: str = "case_id") -> str:
    metrics = ("gap", "stable_gap", "PI", "stable_PI", "rank")
    cols = {m: "rank_b" if m == "rank" else m for m in metrics}
    return (
        "SELECT * FROM (WITH dr AS (" + _draw_sql("nation", "score_A", source, unit) + "), s AS (SELECT b, nation, CAST(sum(w) AS DOUBLE) AS n, CASE WHEN sum(w) > 0 THEN sum(w * score_A) END AS ss FROM dr WHERE score_A IS NOT NULL GROUP BY 1, 2),"
        " m AS (SELECT *, sum(ss) OVER (PARTITION BY b) / sum(n) OVER (PARTITION BY b) AS mu FROM s), g AS (SELECT *, n * gap AS PI, n / (n + 20.0) * gap AS stable_gap, n * n / (n + 20.0) * gap AS stable_PI FROM"
        " (SELECT *, CASE WHEN n > 0 THEN greatest(mu - ss / n, 0) END AS gap FROM m)), r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY stable_PI DESC NULLS LAST, n DESC, nation) AS rank_b FROM g),"
        " st AS (SELECT nation, count(*) AS n_draws, count(gap) AS n_draws_present, "
        + ", ".join(f"quantile_cont({c}, 0.05) AS {m}_lo, quantile_cont({c}, 0.95) AS {m}_hi" for m, c in cols.items())
        + f", count(*) FILTER (WHERE rank_b <= 3 AND stable_PI > 0) / {B} AS p_top3, count(*) FILTER (WHERE rank_b <= 5 AND stable_PI > 0) / {B} AS p_top5 FROM r GROUP BY 1)"
        " SELECT p.nation, p.n_cases, p.stable_gap, p.stable_PI, p.rank, st.* EXCLUDE (nation), CASE WHEN n_cases < 10 THEN 'insufficient_support' WHEN CASE WHEN p.rank <= 5 AND p.stable_PI > 0 THEN p_top5 ELSE 1 - p_top5 END >= 0.8"
        " THEN 'stable' WHEN CASE WHEN p.rank <= 5 AND p.stable_PI > 0 THEN p_top5 ELSE 1 - p_top5 END >= 0.5 THEN 'fragile' ELSE 'insufficient_support' END AS stability FROM bl_n p LEFT JOIN st USING (nation))"
    )


_BOOT = "stable_gap stable_PI p_top3 p_top5 " + " ".join(f"{m}_{e}" for m in ("gap", "stable_gap", "PI", "stable_PI", "rank") for e in ("lo", "hi"))


@register("X9_bootstrap_cases", _boot_sql("so"), doubles=_BOOT, decimals=5, with_=["so", "bl_n"])
def _(spark, d):
    return U.bootstrap_backlog(scored_o(spark, d), NATION, "A", gamma=GAMMA, replicates=B, top=(3, 5), seed=7)


@register("X9_bootstrap_clusters", _boot_sql("so", "first_ts"), doubles=_BOOT, decimals=5, with_=["so", "bl_n"])
def _(spark, d):
    return U.bootstrap_backlog(scored_o(spark, d), NATION, "A", gamma=GAMMA, replicates=B, cluster="first_ts", top=(3, 5), seed=7)


@register(
    "X7_contrast_bootstrap",
    "SELECT * FROM (WITH dr AS (" + _draw_sql("nation", ", ".join(f"p_A_{c}" for c in CIDS), "so") + ") SELECT constraint_id, quantile_cont(d, 0.05) AS delta_lo, quantile_cont(d, 0.95) AS delta_hi, count(d) AS n_draws FROM ("
    + " UNION ALL ".join(
        f"SELECT b, '{c}' AS constraint_id, sum(w * p_A_{c}) FILTER (WHERE {SLICE}) / sum(w) FILTER (WHERE {SLICE}) - sum(w * p_A_{c}) / sum(w) AS d FROM dr GROUP BY b" for c in CIDS
    )
    + ") GROUP BY 1)",
    doubles="delta_lo delta_hi",
    with_=["so"],
)
def _(spark, d):
    return U.bootstrap_contrast(scored_o(spark, d), norm_o(), "A", inside(), replicates=B, seed=7)


# --------------------------------------------------------------------------- X10
def _envelope(spark, d):
    events = log_o(spark, d)
    norm = norm_o()
    # What the scaled norm gathers holds what the norm itself needs, so both are read off one table.
    gathered = store(gather(events, U.scaled_norm(norm), aggregates_o(events)))
    scored = with_scores(evaluate(gathered, norm, NATION), norm, [norm.view("A")])
    kept = ["case_id", *NATION, "score__A", *[f"v__{c}" for c in CIDS]]
    return U.sensitivity(gathered, store(scored.select(*kept)), norm, "A", NATION, gamma=GAMMA, k=5)


def _scaled_v(cid: str, f: float) -> str:
    """The violation of a constraint with threshold and width scaled, where it was evaluated."""
    p = norm_o().constraint(cid).params

    def cl(x: str, a: float, w: float) -> str:
        return f"least(1, greatest(0, ({x} - {a}) / {w}))"

    if cid == "c_lag":
        return f"CASE WHEN x_lag IS NULL THEN 1.0 ELSE {cl('x_lag', 90 * f, 365 * f)} END"
    if cid == "c_over":
        age = f"(epoch_us(TIMESTAMP '2001-08-01') - epoch_us(t_place)) / 86400000000.0"
        return f"CASE WHEN x_over IS NOT NULL THEN {cl('x_over', 30 * f, 180 * f)} ELSE {cl(age, 30 * f, 180 * f)} END"
    if cid == "c_each":
        return f"(SELECT e.v{str(f).replace('.', '_')} FROM each_s e WHERE e.case_id = so.case_id)"
    if cid == "c_prec":
        return cl("n_early", 0, 2 * f)
    if cid == "c_single":
        return cl("n_ship", round(2 * f), 3 * f)
    if cid == "c_bal":
        return cl("x_bal", 0.1 * f, 0.5 * f)
    return cl("exposure", p["threshold"] * f, p["width"] * f)


GRADED = ("c_lag", "c_over", "c_each", "c_prec", "c_single", "c_bal", "c_metric")
cte(
    "each_s",
    "SELECT case_id, "
    + ", ".join(
        f"avg(CASE WHEN lag IS NOT NULL THEN least(1, greatest(0, (lag - {30 * f}) / {365 * f})) END) AS v{str(f).replace('.', '_')}" for f in (0.8, 1.25)
    )
    + " FROM (SELECT s.case_id, s.seq, (epoch_us(min(r.ts)) - epoch_us(s.ts)) / 86400000000.0 AS lag FROM o s LEFT JOIN o r ON r.case_id = s.case_id AND r.activity = 'Return item' AND r.ts >= s.ts"
    " WHERE s.activity = 'Ship item' GROUP BY s.case_id, s.seq, s.ts) GROUP BY case_id",
    "o",
)


def _settings_sql() -> str:
    from ..operators.norm import weights

    norm = norm_o()
    parts = [("reference", "reference", "score_A", "20.0"), ("gamma=0", "gamma", "score_A", "0.0"), ("gamma=10", "gamma", "score_A", "10.0"), ("gamma=40", "gamma", "score_A", "40.0"), ("gamma_hat", "gamma", "score_A", "(SELECT g FROM ghat)")]
    for c in GRADED:
        for f in (0.8, 1.25):
            if c == "c_each":
                continue
            change = f"CASE WHEN {vcol(c)} IS NOT NULL THEN ({_scaled_v(c, f)} - {vcol(c)}) * w_{c} ELSE 0 END"
            parts.append((f"{c}×{f:g}", "threshold", f"score_A - ({change})", "20.0"))
    w0 = weights(norm, norm.view("A"))
    jit = U.jitter_weights(norm, norm.view("A"), 3, 0.10, 0)
    assert all(set(j) == set(w0) for j in jit)
    ctes = [
        "ghat AS (SELECT CASE WHEN between_ > 0 THEN within_ / between_ END AS g FROM (SELECT within_, (t / (k - 1) - within_) / size_ AS between_ FROM (SELECT sum((n - 1) * sd * sd) / sum(n - 1) AS within_,"
        " sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS t, count(*) AS k, (sum(n) - sum(CAST(n * n AS DOUBLE)) / sum(n)) / (count(*) - 1) AS size_ FROM"
        " (SELECT count(*) AS n, avg(score_A) AS m, stddev_samp(score_A) AS sd FROM so GROUP BY nation) WHERE n > 1)))",
        "sw AS (SELECT *, "
        + ", ".join(f"CASE WHEN {vcol(c)} IS NOT NULL AND {vcol(c)} > 0 THEN p_A_{c} / {vcol(c)} ELSE z_{c} END AS w_{c}" for c in CIDS)
        + " FROM (SELECT *, "
        + ", ".join(_weight_sql(c) for c in CIDS)
        + " FROM so))",
    ]
    body = []
    for setting, kind, score, g in parts:
        body.append(f"SELECT '{setting}' AS setting, '{kind}' AS kind, {g} AS gamma, nation, {score} AS score FROM sw AS so")
    for i, w in enumerate(jit):
        ctes.append(f"jw{i} AS ({scored_sql({'J': w})})")
        body.append(f"SELECT 'weights~{i + 1}', 'weights', 20.0, nation, score_J FROM jw{i}")
    # The each-lag variants come from their own join.
    for f in (0.8, 1.25):
        v = f"e.v{str(f).replace('.', '_')}"
        body.append(
            f"SELECT 'c_each×{f:g}', 'threshold', 20.0, nation, score_A - (CASE WHEN v_eachs IS NOT NULL THEN (coalesce({v}, v_eachs) - v_eachs) * w_c_each ELSE 0 END) FROM sw JOIN each_s e USING (case_id)"
            f" UNION ALL SELECT 'c_each×{f:g}', 'threshold', 20.0, nation, score_A FROM sw WHERE case_id NOT IN (SELECT case_id FROM each_s)"
        )
    ctes.append("va AS (" + " UNION ALL ".join(body) + ")")
    ctes.append(
        "rk AS (SELECT *, row_number() OVER (PARTITION BY setting ORDER BY spi DESC, n DESC, nation) AS rank FROM (SELECT setting, kind, nation, n, n * n / (n + gamma) * greatest(mu - m, 0) AS spi FROM"
        " (SELECT setting, kind, gamma, nation, count(*) AS n, avg(score) AS m, max(mu) AS mu FROM (SELECT *, avg(score) OVER (PARTITION BY setting) AS mu FROM va WHERE gamma IS NOT NULL AND score IS NOT NULL) GROUP BY 1, 2, 3, 4)))"
    )
    return "WITH " + ", ".join(ctes)


def _weight_sql(c: str) -> str:
    """The effective weight of a constraint, for cases whose violation is 0."""
    from .base import LAYER_OF, WEIGHTS

    w = WEIGHTS["A"]
    layer = LAYER_OF[c]
    size = sum(w[x] for x in CIDS if LAYER_OF[x] == layer)
    return f"CASE WHEN {vcol(c)} IS NOT NULL AND e_A_{layer} > 0 THEN {size} / act_A * {w[c]} / e_A_{layer} ELSE 0.0 END AS z_{c}"


@register(
    "X10_sensitivity",
    f"SELECT * FROM ({_settings_sql()} SELECT nation, max(rank) FILTER (WHERE setting = 'reference') AS rank_ref, min(rank) AS rank_min, max(rank) AS rank_max, count(*) FILTER (WHERE rank <= 5 AND spi > 0) AS topk_settings,"
    " (SELECT count(DISTINCT setting) FROM rk) AS n_settings, count(*) FILTER (WHERE rank <= 5 AND spi > 0) = (SELECT count(DISTINCT setting) FROM rk) AS always_topk FROM rk GROUP BY nation)",
    with_=["so", "each_s"],
)
def _(spark, d):
    return _envelope(spark, d)[0]


@register(
    "X10_settings",
    f"SELECT * FROM ({_settings_sql()} SELECT a.setting, a.kind, count(*) FILTER (WHERE a.rank <= 5 AND a.spi > 0) AS n_topk, count(*) FILTER (WHERE a.rank <= 5 AND r.rank <= 5) / count(*) FILTER (WHERE a.rank <= 5 OR r.rank <= 5) AS top_k_overlap"
    " FROM rk a JOIN (SELECT nation, rank FROM rk WHERE setting = 'reference') r USING (nation) GROUP BY 1, 2)",
    doubles="top_k_overlap",
    with_=["so", "each_s"],
)
def _(spark, d):
    return _envelope(spark, d)[1]
