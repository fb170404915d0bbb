"""A whole norm document with derived attributes, and logs whose column names hold dots, quotes and backticks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import named
from ..operators import backlog
from ..operators.cases import build_cases, case_aggregates
from ..operators.norm import load_norm, score
from ..session import store
from .base import backlog_sql, cte, log_o, log_w, register

# --------------------------------------------------------------------------- a norm document
FLOWS = {"DF1": ("1-URGENT", "2-HIGH"), "DF2": ("3-MEDIUM",), "2-way": ("4-NOT SPECIFIED",)}
LAST_FLOW = "Consignment"
ALL = ("DF1", "DF2", "2-way", LAST_FLOW)
# A supplier number that does not start with 1 stands for a person.
HUMAN = r"(?i)^(?!(?:s1|none|nan|null|\s*$))."
LAYER_IDS = ("L1_closure", "L2_discipline", "L3_ageing", "L4_rework", "L5_exceptions", "L6_value", "L7_effort")
VIEWS = {
    "Finance": (0.24, 0.08, 0.24, 0.06, 0.08, 0.24, 0.06),
    "Logistics": (0.08, 0.24, 0.22, 0.22, 0.08, 0.04, 0.12),
    "Compliance": (0.12, 0.3, 0.1, 0.06, 0.26, 0.06, 0.1),
    "Automation": (0.06, 0.08, 0.1, 0.28, 0.06, 0.08, 0.34),
}
PLACE, SHIP, BACK = "Place order", "Ship item", "Return item"
MOVED = (SHIP, BACK)


def _days(a: str, b: str) -> str:
    return f"(epoch_us({b}) - epoch_us({a})) / 86400000000.0"


def _ramp(x: str, start: float, width: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(1.0, greatest(0.0, ({x} - {start}) / {float(width)})) END"


def _presence(activity, m=1):
    return {"type": "presence", "params": {"activity": list(activity), "m": m}}


def _exclusion(activity, after=None):
    return {"type": "exclusion", "params": {"activity": list(activity), "after": after, "before": None}}


def _singular(activity, k, width):
    return {"type": "singularity", "params": {"activity": list(activity), "k": k, "K": width, "after": None, "before": None}}


def _lag(a, b, delta, width, **more):
    return {"type": "lag", "params": {"a": list(a), "b": list(b), "delta": delta, "width": width, "unit": "D", "missing_a": "skip", "missing_b": "skip", "activation": "first", "response": "first_overall", **more}}


def _order(a, b, width, missing_b="skip"):
    return {"type": "precedence", "params": {"a": list(a), "b": list(b), "k": 0, "K": width, "missing_a": "skip", "missing_b": missing_b}}


def _metric(attribute, threshold, width):
    return {"type": "metric", "params": {"attribute": attribute, "threshold": threshold, "width": width, "direction": "high"}}


def _overall(a: str, b: str, delta: float, width: float) -> str:
    """First to first, not evaluated where one is missing or they come in the other order."""
    return f"CASE WHEN {b} >= {a} THEN {_ramp(_days(a, b), delta, width)} END"


# id, layer, weight, flows, constraint, violation in SQL (before the flow is looked at)
RULES = [
    ("c_moved", 0, 1.2, ALL[:3], _presence(MOVED), "CASE WHEN n_ship + n_back < 1 THEN 1.0 ELSE 0.0 END"),
    ("c_shipped", 0, 1.4, ALL[:3], _presence([SHIP], 2), "CASE WHEN n_ship < 2 THEN 1.0 ELSE 0.0 END"),
    ("c_placed", 0, 1.1, ALL[:2], _presence([PLACE]), "CASE WHEN n_place < 1 THEN 1.0 ELSE 0.0 END"),
    ("c_ship_after_place", 1, 1.4, ALL[:1], _order([PLACE], [SHIP], 1.0), "CASE WHEN t_place IS NOT NULL AND n_ship > 0 THEN least(1.0, early_ship) END"),
    ("c_back_after_ship", 1, 1.5, ALL[1:2], _order([SHIP], [BACK], 1.0), "CASE WHEN t_ship IS NOT NULL AND n_back > 0 THEN least(1.0, early_back) END"),
    ("c_back_after_ship_all", 1, 0.4, ALL[2:3], _order([SHIP], [BACK], 2.0, "violate"), "CASE WHEN t_ship IS NOT NULL THEN CASE WHEN n_back > 0 THEN least(1.0, early_back / 2.0) ELSE 0.0 END END"),
    ("c_no_back", 1, 1.2, ALL[2:3], _exclusion([BACK]), "CASE WHEN n_back > 0 THEN 1.0 ELSE 0.0 END"),
    ("c_no_ship", 1, 0.8, ALL[3:], _exclusion([SHIP]), "CASE WHEN n_ship > 0 THEN 1.0 ELSE 0.0 END"),
    ("c_place_to_ship", 2, 1.3, ALL[:1], _lag([PLACE], [SHIP], 10.0, 90.0), _overall("t_place", "t_ship", 10.0, 90.0)),
    ("c_place_to_back", 2, 1.5, ALL[:3], _lag([PLACE], [BACK], 30.0, 60.0), _overall("t_place", "t_back", 30.0, 60.0)),
    ("c_ship_to_back", 2, 1.2, ALL[1:2], _lag([SHIP], [BACK], 2.0, 30.0), _overall("t_ship", "t_back", 2.0, 30.0)),
    ("c_back_to_ship", 2, 1.2, ALL[1:2], _lag([BACK], [SHIP], 5.0, 20.0, missing_b="violate"), "CASE WHEN t_back IS NOT NULL AND t_ship IS NULL THEN 1.0 WHEN t_ship >= t_back THEN " + _ramp(_days("t_back", "t_ship"), 5.0, 20.0) + " END"),
    ("c_place_to_next_back", 2, 0.7, ALL, _lag([PLACE], [BACK], 20.0, 80.0, response="first_after"), "CASE WHEN t_place IS NOT NULL AND next_back IS NOT NULL THEN " + _ramp(_days("t_place", "next_back"), 20.0, 80.0) + " END"),
    ("c_many_moves", 3, 1.2, (ALL[0], ALL[1], ALL[3]), _singular(MOVED, 2, 3.0), _ramp("n_ship + n_back", 2, 3)),
    ("c_many_ships", 3, 1.2, ALL, _singular([SHIP], 0, 2.0), _ramp("n_ship", 0, 2)),
    ("c_many_backs", 3, 1.0, ALL[:3], _singular([BACK], 1, 2.0), _ramp("n_back", 1, 2)),
    ("c_placed_again", 3, 1.0, ALL, _singular([PLACE], 0, 2.0), _ramp("n_place", 0, 2)),
    ("c_never_lost", 4, 1.2, ALL[:3], _exclusion(["Lose item"]), "0.0"),
    ("c_never_back", 4, 1.0, (ALL[0], ALL[1], ALL[3]), _exclusion([BACK]), "CASE WHEN n_back > 0 THEN 1.0 ELSE 0.0 END"),
    ("c_no_back_later", 4, 1.1, ALL, _exclusion([BACK], [PLACE]), "CASE WHEN late_back > 0 THEN 1.0 ELSE 0.0 END"),
    ("c_never_open", 4, 1.3, ALL, _exclusion(["Vendor creates debit memo"]), "0.0"),
    ("c_never_closed", 4, 1.1, ALL, _exclusion(["Vendor creates credit memo"]), "0.0"),
    ("c_back_churn", 5, 1.4, ALL, _singular([BACK], 0, 2.0), _ramp("n_back", 0, 2)),
    ("c_ship_churn", 5, 1.2, ALL, _singular([SHIP], 3, 4.0), _ramp("n_ship", 3, 4)),
    ("c_costly_back", 5, 1.2, ALL, _metric("back_x_exposure", 0.0, 1.0), _ramp("back_x_exposure", 0, 1)),
    ("c_costly_ship", 5, 1.0, ALL, _metric("ship.x exposure", 0.0, 1.0), _ramp("ship_x_exposure", 0, 1)),
    ("c_volatile", 5, 1.0, ALL[:3], _metric("networth_cv", 0.5, 1.0), _ramp("networth_cv", 0.5, 1)),
    ("c_touches", 6, 1.4, ALL, _metric("manual_touch_count", 2.0, 3.0), _ramp("touches", 2, 3)),
    ("c_hands", 6, 1.1, ALL, _metric("distinct_human_resources", 1.0, 4.0), _ramp("hands", 1, 4)),
    ("c_long", 6, 1.0, ALL, _metric("total_events", 4.0, 3.0), _ramp("n_events", 4, 3)),
    ("c_manual", 6, 0.9, ALL, _metric("manual_share", 0.5, 0.5), _ramp("touches / CAST(n_events AS DOUBLE)", 0.5, 0.5)),
]
# Listed so that each recipe stands before those it reads.
DERIVED = [
    {"name": "back_x_exposure", "kind": "indicator_times", "activities": [BACK, "Vendor creates debit memo"], "attribute": "exposure_norm"},
    {"name": "ship.x exposure", "kind": "indicator_times", "activities": [SHIP], "attribute": "exposure_norm"},
    {"name": "exposure_norm", "kind": "quantile_scale", "attribute": "exposure", "q": 0.95},
    {"name": "manual_share", "kind": "ratio", "numerator": "manual_touch_count", "denominator": "total_events"},
    {"name": "total_events", "kind": "eval", "expr": "n_events"},
    {"name": "networth_cv", "kind": "cv", "column": "amount"},
    {"name": "manual_touch_count", "kind": "count_events", "where": {"column": "resource", "regex": HUMAN}},
    {"name": "distinct_human_resources", "kind": "nunique", "column": "resource", "where": {"column": "resource", "regex": HUMAN}},
]
DOCUMENT = {
    "schema_version": 2,
    "scoring_mode": "layer_balanced",
    "layers": [{"id": x, "name": x[3:], "description": ""} for x in LAYER_IDS],
    "views": [{"name": v, "description": "", "layer_weights": dict(zip(LAYER_IDS, w, strict=True))} for v, w in VIEWS.items()],
    "derived_attributes": DERIVED,
    "constraints": [{"id": i, "layer": LAYER_IDS[layer], "weight": w, "applicability": {"flow_type": list(flows)}, "description": "", **c} for i, layer, w, flows, c, _ in RULES],
}


SHOWN = ("c_back_after_ship", "c_back_to_ship", "c_place_to_next_back", "c_costly_back", "c_costly_ship", "c_volatile", "c_hands", "c_manual")


def _document_sql() -> str:
    human = r"(resource IS NOT NULL AND NOT regexp_matches(lower(resource), '^(s1|none|nan|null|\s*$)') AND length(resource) > 0)"
    flow = "CASE " + " ".join(f"WHEN priority IN ({', '.join(repr(v) for v in vs)}) THEN '{f}'" for f, vs in FLOWS.items()) + f" ELSE '{LAST_FLOW}' END"
    base = (
        "SELECT case_id, count(*) AS n_events, max(exposure) AS exposure, arg_min(priority, (ts, seq)) FILTER (WHERE priority IS NOT NULL) AS priority,"
        + "".join(f" count(*) FILTER (WHERE activity = '{a}') AS n_{n}, min(ts) FILTER (WHERE activity = '{a}') AS t_{n}," for n, a in (("place", PLACE), ("ship", SHIP), ("back", BACK)))
        + f" count(*) FILTER (WHERE {human}) AS touches, count(DISTINCT resource) FILTER (WHERE {human}) AS hands,"
        " stddev_samp(amount) / nullif(avg(amount), 0) AS networth_cv FROM o GROUP BY case_id"
    )
    later = (
        f"SELECT e.case_id, count(*) FILTER (WHERE activity = '{SHIP}' AND ts < t_place) AS early_ship, count(*) FILTER (WHERE activity = '{BACK}' AND ts < t_ship) AS early_back,"
        f" count(*) FILTER (WHERE activity = '{BACK}' AND ts > t_place) AS late_back, min(ts) FILTER (WHERE activity = '{BACK}' AND ts >= t_place) AS next_back"
        " FROM o e JOIN base USING (case_id) GROUP BY e.case_id"
    )
    scaled = "SELECT *, least(exposure / (SELECT quantile_cont(exposure, 0.95) FROM base), 1.0) AS exposure_norm FROM base JOIN later USING (case_id)"
    derived = f"SELECT *, {flow} AS flow_type, CASE WHEN n_back > 0 THEN exposure_norm ELSE 0 END AS back_x_exposure, CASE WHEN n_ship > 0 THEN exposure_norm ELSE 0 END AS ship_x_exposure FROM scaled"
    cells = "SELECT *, " + ", ".join(f"CASE WHEN flow_type IN ({', '.join(repr(f) for f in flows)}) THEN {v} END AS {i}" for i, _, _, flows, _, v in RULES) + " FROM derived"
    in_layer = {k: [(i, w) for i, layer, w, _, _, _ in RULES if layer == k] for k in range(len(LAYER_IDS))}
    # Per layer: evaluated weight and weighted violation; a view weighs the layers that have any.
    sums = ", ".join(
        f"{' + '.join(f'(CASE WHEN {i} IS NOT NULL THEN {w} ELSE 0.0 END)' for i, w in m)} AS e{k}, {' + '.join(f'{w} * coalesce({i}, 0.0)' for i, w in m)} AS p{k}" for k, m in in_layer.items()
    )
    layers = f"SELECT *, {sums} FROM cells"
    out = []
    for view, weights in VIEWS.items():
        live = " + ".join(f"(CASE WHEN e{k} > 0 THEN {w} ELSE 0.0 END)" for k, w in enumerate(weights))
        lost = " + ".join(f"(CASE WHEN e{k} > 0 THEN {w} * p{k} / e{k} ELSE 0.0 END)" for k, w in enumerate(weights))
        out.append(f"CASE WHEN {live} > 0 THEN 1 - ({lost}) / ({live}) END AS score_{view.lower()}")
    named_ = ", ".join(f"CAST({v} AS DOUBLE) AS v_{v}" for v in SHOWN)
    ctes = f"WITH base AS ({base}), later AS ({later}), scaled AS ({scaled}), derived AS ({derived}), cells AS ({cells}), layers AS ({layers})"
    return f"{ctes} SELECT case_id, flow_type, touches AS manual_touch_count, exposure_norm, {named_}, {', '.join(out)} FROM layers"


cte("doc_o", _document_sql(), "o")

SCORES = [f"score_{v.lower()}" for v in VIEWS]


def flow_column():
    """The flow type of an order: the first matching list of priorities."""
    out = F.lit(LAST_FLOW)
    for flow, values in reversed(FLOWS.items()):
        out = F.when(F.col("priority").isin(list(values)), flow).otherwise(out)
    return out


def score_document(events):
    aggs = case_aggregates(events, attributes=["priority"], exposure="exposure")
    return score(events, load_norm(DOCUMENT), aggs, ["n_events"], {"flow_type": flow_column()})


@register("K13_score_document", "SELECT * FROM doc_o", doubles=" ".join(["exposure_norm", *(f"v_{v}" for v in SHOWN), *SCORES]), with_=["doc_o"])
def _(spark, d):
    out = score_document(log_o(spark, d))
    scores = [F.col(f"score__{v}").alias(f"score_{v.lower()}") for v in VIEWS]
    return out.select("case_id", "flow_type", "manual_touch_count", "exposure_norm", *[F.col(f"v__{v}").alias(f"v_{v}") for v in SHOWN], *scores)


# --------------------------------------------------------------------------- odd names
K_NAME, VALUE_NAME = "event org.kind", "net `worth` (EUR).sum"


@register(
    "C1_odd_names",
    "SELECT case_id, n_events, first_ts, last_ts, exposure AS total, k AS kind FROM cw",
    doubles="total",
    with_=["cw"],
)
def _(spark, d):
    log = log_w(spark, d).withColumnsRenamed({"k": K_NAME, "value": VALUE_NAME})
    cases = build_cases(log, attributes=[K_NAME], exposure=VALUE_NAME, exposure_agg="sum")
    return cases.select("case_id", "n_events", "first_ts", "last_ts", F.col("exposure").alias("total"), named(K_NAME).alias("kind"))


ODD_KEYS = {"priority": "case prio.rity", "segment": "case `seg.ment`"}
ODD_NORM = {
    "layers": ["L.1", "L`2"],
    "views": [{"name": "V.1 (a)", "layer_weights": {"L.1": 0.6, "L`2": 0.4}}],
    "constraints": [
        {"id": "c.ship", "layer": "L.1", "type": "presence", "params": {"activity": SHIP}, "applicability": {"case prio.rity": ["1-URGENT", "2-HIGH", "5-LOW"]}},
        {"id": "c`back", "layer": "L`2", "type": "exclusion", "params": {"activity": BACK}},
        {"id": "c.value", "layer": "L`2", "type": "metric", "params": {"attribute": "net.worth", "threshold": 100000, "width": 300000}},
    ],
}
cte(
    "odd_o",
    "SELECT priority, segment, CASE WHEN priority IN ('1-URGENT', '2-HIGH', '5-LOW') THEN 1 - 0.6 * (CASE WHEN n_ship < 1 THEN 1.0 ELSE 0.0 END) - 0.4 * q ELSE 1 - q END AS score_A FROM"
    " (SELECT *, ((CASE WHEN n_return > 0 THEN 1.0 ELSE 0.0 END) + least(1.0, greatest(0.0, (exposure - 100000) / 300000.0))) / 2.0 AS q FROM co)",
    "co",
)


@register(
    "K16_odd_names",
    f"SELECT priority, segment, n_cases, mean_score, stable_gap, stable_PI, rank FROM ({backlog_sql('priority, segment', source='odd_o')})",
    doubles="mean_score stable_gap stable_PI",
    with_=["odd_o"],
)
def _(spark, d):
    log = log_o(spark, d).withColumnsRenamed({**ODD_KEYS, "exposure": "net.worth"})
    keys = list(ODD_KEYS.values())
    norm = load_norm(ODD_NORM)
    aggs = case_aggregates(log, attributes=keys) | {"net.worth": F.max(named("net.worth"))}
    scored = store(score(log, norm, aggs, ["n_events", *keys]))
    out = backlog.backlog(scored, keys, "V.1 (a)", gamma=20)
    return out.select(*[named(o).alias(n) for n, o in ODD_KEYS.items()], "n_cases", "mean_score", "stable_gap", "stable_PI", "rank")
