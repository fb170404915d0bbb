"""Constraints, scores and weights on the orders log (K1 to K15, K41 to K45)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.exprs import join_on
from ..operators import cases as C
from ..operators import profile
from ..operators.norm import (
    Constraint,
    Norm,
    applies,
    count_name,
    evaluate,
    gather,
    general_view,
    in_scope,
    raw_signals,
    run_summary,
    violation,
    weights,
    with_scores,
)
from .base import (
    CIDS,
    LAYER_OF,
    LAYERS,
    WEIGHTS,
    WINDOW_END,
    aggregates_o,
    cte,
    log_o,
    norm_o,
    register,
    score_table,
    scored_o,
    scored_sql,
    vcol,
)
from .cases import typed_o

DAY = "86400000000.0"


def one(spark, d, constraint: Constraint, window_end: str | None = WINDOW_END):
    """Signal and violation of a single constraint."""
    norm = Norm((constraint.layer,), (), (constraint,), window_end=window_end)
    events = log_o(spark, d)
    rows = gather(events, norm, aggregates_o(events))
    out = evaluate(rows, norm, [])
    return out.select("case_id", F.col(f"x__{constraint.id}").alias("x"), F.col(f"v__{constraint.id}").alias("v"))


def _one(name: str, type_: str, params: dict, sql: str, with_=("co", "o"), window_end: str | None = WINDOW_END) -> None:
    @register(name, sql, doubles="x v", with_=with_)
    def _(spark, d):
        return one(spark, d, Constraint("c", "l", type_, params), window_end)


def clip(x: str, start: float, width: float) -> str:
    return f"least(1, greatest(0, ({x} - {start}) / {float(width)}))"


_one("K1_presence", "presence", {"activity": "Ship item", "m": 2}, "SELECT case_id, n_ship AS x, CASE WHEN n_ship < 2 THEN 1 ELSE 0 END AS v FROM co")
_one("K2_exclusion", "exclusion", {"activity": "Return item"}, "SELECT case_id, n_return AS x, CASE WHEN n_return > 0 THEN 1 ELSE 0 END AS v FROM co")
_one(
    "K2_exclusion_scoped",
    "exclusion",
    {"activity": "Return item", "after": "Ship item", "before": ["Place order"]},
    "SELECT c.case_id, count(o.ts) FILTER (WHERE o.activity = 'Return item' AND o.ts > c.t_ship AND o.ts < c.t_place) AS x,"
    " CASE WHEN count(o.ts) FILTER (WHERE o.activity = 'Return item' AND o.ts > c.t_ship AND o.ts < c.t_place) > 0 THEN 1 ELSE 0 END AS v"
    " FROM co c JOIN o USING (case_id) GROUP BY c.case_id",
)
_one("K3_singularity", "singularity", {"activity": ["Ship item", "Return item"], "k": 3, "K": 2}, f"SELECT case_id, n_ship + n_return AS x, {clip('n_ship + n_return', 3, 2)} AS v FROM co")
_one(
    "K3_singularity_scoped",
    "singularity",
    {"activity": "Ship item", "k": 1, "K": 2, "before": "Place order"},
    f"SELECT c.case_id, count(o.ts) FILTER (WHERE o.activity = 'Ship item' AND o.ts < c.t_place) AS x, {clip('''count(o.ts) FILTER (WHERE o.activity = 'Ship item' AND o.ts < c.t_place)''', 1, 2)} AS v"
    " FROM co c JOIN o USING (case_id) GROUP BY c.case_id",
)

AFTER = (
    "SELECT c.case_id, c.t_place AS ta, min(o.ts) FILTER (WHERE o.activity = 'Ship item' AND o.ts >= c.t_place) AS tb, min(o.ts) FILTER (WHERE o.activity = 'Ship item') AS t0,"
    " max(o.ts) FILTER (WHERE o.activity = 'Ship item') AS tl FROM co c JOIN o USING (case_id) GROUP BY c.case_id, c.t_place"
)
cte("after_o", AFTER, "co", "o")
LAG_X = f"(epoch_us(tb) - epoch_us(ta)) / {DAY}"
AGE = f"(epoch_us(TIMESTAMP '{WINDOW_END}') - epoch_us(ta)) / {DAY}"
_lag = {"a": "Place order", "b": "Ship item", "delta": 60, "width": 300}
_one("K4_lag_violate", "lag", _lag, f"SELECT case_id, {LAG_X} AS x, CASE WHEN tb IS NULL THEN 1 ELSE {clip(LAG_X, 60, 300)} END AS v FROM after_o", ("after_o",))
_one("K4_lag_skip", "lag", {**_lag, "missing_b": "skip"}, f"SELECT case_id, {LAG_X} AS x, CASE WHEN tb IS NOT NULL THEN {clip(LAG_X, 60, 300)} END AS v FROM after_o", ("after_o",))
_one(
    "K4_lag_censor",
    "lag",
    {**_lag, "missing": "censor"},
    f"SELECT case_id, {LAG_X} AS x, CASE WHEN tb IS NULL THEN {clip(AGE, 60, 300)} ELSE {clip(LAG_X, 60, 300)} END AS v FROM after_o",
    ("after_o",),
)
_one(
    "K4_lag_step_hours",
    "lag",
    {**_lag, "delta": 2400, "width": 0, "unit": "h"},
    "SELECT case_id, (epoch_us(tb) - epoch_us(ta)) / 3600000000.0 AS x, CASE WHEN tb IS NULL OR (epoch_us(tb) - epoch_us(ta)) / 3600000000.0 > 2400 THEN 1 ELSE 0 END AS v FROM after_o",
    ("after_o",),
)
_one(
    "K4_lag_first_overall",
    "lag",
    {**_lag, "response": "first_overall"},
    f"SELECT case_id, CASE WHEN t0 >= ta THEN (epoch_us(t0) - epoch_us(ta)) / {DAY} END AS x, CASE WHEN t0 IS NULL THEN 1 WHEN t0 >= ta THEN {clip(f'(epoch_us(t0) - epoch_us(ta)) / {DAY}', 60, 300)} END AS v FROM after_o",
    ("after_o",),
)
_one(
    "K4_lag_last_activation",
    "lag",
    {"a": "Ship item", "b": "Return item", "delta": 30, "width": 200, "activation": "last", "missing_a": "violate", "missing_b": "skip"},
    f"SELECT c.case_id, (epoch_us(tr) - epoch_us(tl)) / {DAY} AS x, CASE WHEN tl IS NULL THEN 1 WHEN tr IS NOT NULL THEN {clip(f'(epoch_us(tr) - epoch_us(tl)) / {DAY}', 30, 200)} END AS v"
    " FROM co c LEFT JOIN (SELECT o.case_id, l.tl, min(o.ts) FILTER (WHERE o.activity = 'Return item' AND o.ts >= l.tl) AS tr FROM o JOIN (SELECT case_id, max(ts) AS tl FROM o"
    " WHERE activity = 'Ship item' GROUP BY 1) l USING (case_id) GROUP BY 1, 2) r USING (case_id)",
)
_one(
    "K4_lag_each",
    "lag",
    {"a": "Ship item", "b": "Return item", "delta": 30, "width": 200, "activation": "each"},
    f"SELECT c.case_id, x, CASE WHEN c.n_ship > 0 THEN v END AS v FROM co c LEFT JOIN (SELECT case_id, avg(lag) AS x, avg(CASE WHEN lag IS NULL THEN 1 ELSE {clip('lag', 30, 200)} END) AS v"
    f" FROM (SELECT s.case_id, s.seq, (epoch_us(min(r.ts)) - epoch_us(s.ts)) / {DAY} AS lag FROM o s LEFT JOIN o r ON r.case_id = s.case_id AND r.activity = 'Return item' AND r.ts >= s.ts"
    " WHERE s.activity = 'Ship item' GROUP BY s.case_id, s.seq, s.ts) GROUP BY case_id) e USING (case_id)",
)
_one(
    "K5_precedence",
    "precedence",
    {"a": "Place order", "b": "Return item", "k": 0, "K": 2},
    f"SELECT c.case_id, n AS x, CASE WHEN n_return > 0 THEN {clip('n', 0, 2)} ELSE 0 END AS v FROM co c JOIN (SELECT c.case_id, count(o.ts) FILTER (WHERE o.activity = 'Return item'"
    " AND o.ts < c.t_place) AS n FROM co c JOIN o USING (case_id) GROUP BY 1) p USING (case_id)",
)
_one(
    "K6_balance",
    "balance",
    {"attr_x": "amount", "activities_x": ["Ship item"], "attr_y": "amount", "activities_y": ["Return item"], "tau": 0.2, "width": 0.6},
    f"SELECT case_id, x, {clip('x', 0.2, 0.6)} AS v FROM (SELECT case_id, abs(coalesce(a, 0) - coalesce(b, 0)) / greatest(coalesce(a, 0), coalesce(b, 0), 1e-9) AS x FROM"
    " (SELECT case_id, sum(amount) FILTER (WHERE activity = 'Ship item') AS a, sum(amount) FILTER (WHERE activity = 'Return item') AS b FROM o GROUP BY case_id))",
)
_one(
    "K6_balance_max",
    "balance",
    {"attr_x": "amount", "activities_x": ["Ship item"], "attr_y": "amount", "activities_y": ["Place order"], "tau": 0.0, "width": 0, "agg": "max"},
    "SELECT case_id, x, CASE WHEN x > 0 THEN 1 ELSE 0 END AS v FROM (SELECT case_id, abs(coalesce(a, 0) - coalesce(b, 0)) / greatest(coalesce(a, 0), coalesce(b, 0), 1e-9) AS x FROM"
    " (SELECT case_id, max(amount) FILTER (WHERE activity = 'Ship item') AS a, max(amount) FILTER (WHERE activity = 'Place order') AS b FROM o GROUP BY case_id))",
)
_one("K7_metric_high", "metric", {"attribute": "exposure", "threshold": 200000, "width": 100000}, f"SELECT case_id, exposure AS x, {clip('exposure', 200000, 100000)} AS v FROM co")
_one(
    "K7_metric_low",
    "metric",
    {"attribute": "n_events", "threshold": 4, "width": 3, "direction": "low"},
    "SELECT case_id, n_events AS x, least(1, greatest(0, (4 - n_events) / 3.0)) AS v FROM co",
)

SHORT = [c[2:] for c in CIDS]


@register("K8_applicability", "SELECT case_id, " + ", ".join(f"s_{s}" for s in SHORT) + " FROM vio_o", with_=["vio_o"])
def _(spark, d):
    norm = norm_o()
    events = log_o(spark, d)
    cases = C.build_cases(events, {**aggregates_o(events), count_name(["Ship item"]): F.count_if(F.col("activity") == "Ship item")})
    return cases.select("case_id", *[e.alias(f"s_{n[5:]}") for n, e in in_scope(norm).items()])


@register(
    "K9_raw_signals",
    "SELECT case_id, " + ", ".join(f"x_{s}" for s in SHORT) + " FROM sig_o",
    doubles=" ".join(f"x_{s}" for s in SHORT),
    with_=["sig_o"],
)
def _(spark, d):
    events = log_o(spark, d)
    out = raw_signals(gather(events, norm_o(), aggregates_o(events)), norm_o())
    return out.withColumnsRenamed({f"x__{c}": f"x_{c[2:]}" for c in CIDS})


@register(
    "K10_violations",
    "SELECT case_id, " + ", ".join(f"{vcol(c)} AS v_{c}" for c in CIDS) + " FROM vio_o",
    doubles=" ".join(f"v_{c}" for c in CIDS),
    with_=["vio_o"],
)
def _(spark, d):
    return scored_o(spark, d).select("case_id", *[F.col(f"v__{c}").alias(f"v_{c}") for c in CIDS])


@register(
    "K11_view_weights",
    "SELECT 'A' AS view, constraint_id, w AS weight, count(*) AS evaluated FROM (VALUES "
    + ", ".join(f"('{c}', {WEIGHTS['A'][c]})" for c in CIDS)
    + ") AS t(constraint_id, w) JOIN ("
    + " UNION ALL ".join(f"SELECT '{c}' AS constraint_id FROM vio_o WHERE {vcol(c)} IS NOT NULL" for c in CIDS)
    + ") USING (constraint_id) GROUP BY ALL",
    doubles="weight",
    with_=["vio_o"],
)
def _(spark, d):
    norm = norm_o()
    w = weights(norm, norm.view("A"))
    items = [
        F.struct(F.lit("A").alias("view"), F.lit(c).alias("constraint_id"), F.lit(w[c]).alias("weight"), F.col(f"n_{c}").alias("evaluated")) for c in CIDS
    ]
    return scored_o(spark, d).agg(*[F.count(f"v__{c}").alias(f"n_{c}") for c in CIDS]).select(F.inline(F.array(*items)))


GENERAL = {c: {"coverage": 1.0, "timing": 0.25, "quality": 0.5, "value": 0.5}[LAYER_OF[c]] for c in CIDS}
cte("general_o", scored_sql({"g": GENERAL}), "vio_o")


@register(
    "K12_general_view",
    "SELECT case_id, score_g AS score, " + ", ".join(f"contrib_g_{x} AS {x}" for x in LAYERS) + " FROM general_o",
    doubles="score " + " ".join(LAYERS),
    with_=["general_o"],
)
def _(spark, d):
    norm = norm_o()
    rows = scored_o(spark, d).select("case_id", *[f"v__{c}" for c in CIDS])
    out = with_scores(rows, norm, [general_view(norm, "g")])
    return out.select("case_id", F.col("score__g").alias("score"), *[F.col(f"contrib__g__{x}").alias(x) for x in LAYERS])


_SCORES = ["score_A", "score_B", *[f"contrib_{v}_{x}" for v in "AB" for x in LAYERS]]


@register("K13_score", "SELECT case_id, " + ", ".join(_SCORES) + " FROM so", doubles=" ".join(_SCORES), with_=["so"])
def _(spark, d):
    out = score_table(log_o(spark, d), norm_o())
    names = {f"score__{v}": f"score_{v}" for v in "AB"} | {f"contrib__{v}__{x}": f"contrib_{v}_{x}" for v in "AB" for x in LAYERS}
    return out.select("case_id", *[F.col(a).alias(b) for a, b in names.items()])


cte("flat_o", scored_sql(WEIGHTS, mode="flat"), "vio_o")


@register("K13_score_flat", "SELECT case_id, " + ", ".join(_SCORES) + " FROM flat_o", doubles=" ".join(_SCORES), with_=["flat_o"])
def _(spark, d):
    rows = scored_o(spark, d).select("case_id", *[f"v__{c}" for c in CIDS])
    out = with_scores(rows, replace(norm_o(), mode="flat"))
    names = {f"score__{v}": f"score_{v}" for v in "AB"} | {f"contrib__{v}__{x}": f"contrib_{v}_{x}" for v in "AB" for x in LAYERS}
    return out.select("case_id", *[F.col(a).alias(b) for a, b in names.items()])


@register(
    "K14_penalties",
    "SELECT case_id, " + ", ".join(f"p_A_{c}" for c in CIDS) + " FROM so",
    doubles=" ".join(f"p_A_{c}" for c in CIDS),
    with_=["so"],
)
def _(spark, d):
    return scored_o(spark, d).select("case_id", *[F.col(f"p__A__{c}").alias(f"p_A_{c}") for c in CIDS])


@register(
    "K15_run_summary",
    "SELECT 'density' AS measure, 'all' AS name, ("
    + " + ".join(f"count({vcol(c)})" for c in CIDS)
    + f") / (count(*) * {len(CIDS)}) AS value FROM so"
    + "".join(f" UNION ALL SELECT 'mean_score', '{v}', avg(score_{v}) FROM so" for v in "AB")
    + "".join(f" UNION ALL SELECT 'mean_contribution', '{v}/{x}', avg(contrib_{v}_{x}) FROM so" for v in "AB" for x in LAYERS),
    doubles="value",
    with_=["so"],
)
def _(spark, d):
    return run_summary(scored_o(spark, d), norm_o())


# --------------------------------------------------------------------------- editing a norm
def _counts(tag: str, v: str) -> str:
    return (
        f"SELECT '{tag}' AS version, count(*) AS applicable, count({v}) AS evaluated, count(*) FILTER (WHERE {v} > 0) AS violating, avg({v}) AS mean_penalty FROM sig_l"
    )


cte("sig_l", "SELECT *, CASE WHEN x_lag IS NULL THEN 1.0 ELSE least(1, greatest(0, (x_lag - 90) / 365.0)) END AS v0, CASE WHEN x_lag IS NULL THEN 1.0 ELSE least(1, greatest(0, (x_lag - 180) / 90.0)) END AS v1 FROM sig_o", "sig_o")


@register("K41_threshold_preview", _counts("saved", "v0") + " UNION ALL " + _counts("proposed", "v1"), doubles="mean_penalty", with_=["sig_l"])
def _(spark, d):
    norm = norm_o()
    saved = norm.constraint("c_lag")
    proposed = Constraint(saved.id, saved.layer, saved.type, {**saved.params, "delta": 180, "width": 90})
    events = log_o(spark, d)
    rows = gather(events, replace(norm, constraints=(saved,)), aggregates_o(events))
    cols = {"saved": violation(saved, norm), "proposed": violation(proposed, norm)}
    aggs, items = [F.count_if(applies(saved.applicability)).alias("n")], []
    for tag, v in cols.items():
        aggs += [F.count(v).alias(f"e_{tag}"), F.count_if(v > 0).alias(f"x_{tag}"), F.avg(v).alias(f"m_{tag}")]
        items.append(
            F.struct(
                F.lit(tag).alias("version"),
                F.col("n").alias("applicable"),
                F.col(f"e_{tag}").alias("evaluated"),
                F.col(f"x_{tag}").alias("violating"),
                F.col(f"m_{tag}").alias("mean_penalty"),
            )
        )
    return rows.agg(*aggs).select(F.inline(F.array(*items)))


@register(
    "K42_constraint_check",
    "SELECT count(*) FILTER (WHERE s_noret) AS in_scope, count(v_noret) AS evaluated, count(*) FILTER (WHERE v_noret > 0) AS missing,"
    " count(*) FILTER (WHERE v_noret > 0) / count(v_noret) AS share_missing, 1 AS unknown_labels FROM vio_o",
    doubles="share_missing",
    with_=["vio_o"],
)
def _(spark, d):
    from ..operators.quality import norm_evidence

    out = scored_o(spark, d).agg(
        F.count_if("s__c_noret").alias("in_scope"),
        F.count("v__c_noret").alias("evaluated"),
        F.count_if(F.col("v__c_noret") > 0).alias("missing"),
    )
    out = out.withColumn("share_missing", F.col("missing") / F.col("evaluated"))
    named = {"c_noret": ["Return item", "Place order", "Refund item"]}
    unknown = norm_evidence(log_o(spark, d), named).agg(F.count(F.lit(1))).scalar()
    return out.withColumn("unknown_labels", unknown)


@register(
    "K43_trace",
    "SELECT o.activity, o.ts, o.seq.line AS line, s.score_A AS score, CASE o.activity WHEN 'Place order' THEN array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {vcol(c)} > 0 THEN '{c}' END" for c in ("c_lag", "c_over", "c_prec", "c_noret", "c_bal"))
    + "], lambda x: x IS NOT NULL), ',') WHEN 'Ship item' THEN array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {vcol(c)} > 0 THEN '{c}' END" for c in ("c_ship", "c_lag", "c_each", "c_prec", "c_single", "c_bal"))
    + "], lambda x: x IS NOT NULL), ',') ELSE array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {vcol(c)} > 0 THEN '{c}' END" for c in ("c_over", "c_each", "c_noret", "c_bal"))
    + "], lambda x: x IS NOT NULL), ',') END AS violates FROM o JOIN so s USING (case_id) WHERE case_id = 42",
    doubles="score",
    with_=["o", "so"],
)
def _(spark, d):
    from ..operators.flow import ordered_trace

    norm = norm_o()
    events = ordered_trace(log_o(spark, d), 42)
    row = scored_o(spark, d).where(F.col("case_id") == 42).select("case_id", F.col("score__A").alias("score"), *[f"v__{c}" for c in CIDS])
    missed = F.array(
        *[
            F.when((F.col(f"v__{c.id}") > 0) & F.col("activity").isin(c.activities()), F.lit(c.id))
            for c in norm.constraints
        ]
    )
    out = join_on(events, row, ["case_id"])
    return out.select("activity", "ts", F.col("seq.line").alias("line"), "score", F.array_join(missed, ",").alias("violates"))


@register(
    "K45_applicability_options",
    "SELECT 'flow_type' AS name, flow_type AS value, count(*) AS n, count(*) / (SELECT count(*) FROM ft_o) AS share FROM ft_o GROUP BY 2 UNION ALL"
    " SELECT 'segment', segment, count(*), count(*) / (SELECT count(*) FROM ft_o) FROM ft_o GROUP BY 2",
    doubles="share",
    with_=["ft_o"],
)
def _(spark, d):
    return profile.top_values(typed_o(spark, d), ["flow_type", "segment"], 50).drop("rank")
