"""What-if transforms on the orders log, and scenarios scored again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backlog as K
from ..operators import transforms as T
from ..operators.norm import load_norm
from ..session import store
from .base import (
    BACKLOG_DOUBLES,
    NORM_DOC,
    backlog_sql,
    cases_o,
    cte,
    log_o,
    register,
    score_table,
    stored,
)

PICK = "segment IN ('BUILDING', 'FURNITURE')"
COLS = "case_id, activity, ts, seq.line AS line, seq.part AS part, amount"


def picked(spark, d):
    """The selected cases, stored by their ids alone."""
    return stored(spark, d, "picked", lambda s, x: cases_o(s, x).where(PICK).select("case_id"))


def shown(events):
    return events.select("case_id", "activity", "ts", F.col("seq.line").alias("line"), F.col("seq.part").alias("part"), "amount")


cte("sel", f"SELECT case_id FROM co WHERE {PICK}", "co")


def _t(name: str, sql: str, fn, with_=("o", "sel")) -> None:
    register(name, sql, doubles="amount", with_=with_)(fn)


cte(
    "late",
    "SELECT c.case_id, c.t_place + INTERVAL 100 DAY AS lim, min(o.ts) AS old FROM co c JOIN o USING (case_id) WHERE o.activity = 'Ship item' AND o.ts >= c.t_place GROUP BY 1, 2"
    " HAVING min(o.ts) > c.t_place + INTERVAL 100 DAY",
    "co",
    "o",
)
_t(
    "T1_cap_lag",
    f"SELECT * EXCLUDE (old, lim) REPLACE (CASE WHEN activity = 'Ship item' AND ts = old THEN lim ELSE ts END AS ts) FROM (SELECT {COLS}, old, lim FROM o LEFT JOIN late USING (case_id))",
    lambda s, d: shown(T.cap_lag(log_o(s, d, False), "Place order", "Ship item", 100, "D")),
    ("o", "late"),
)
_t(
    "T1_cap_lag_shift",
    f"SELECT case_id, activity, CASE WHEN activity = 'Ship item' AND ts = old THEN lim WHEN ts > old THEN ts - (old - lim) ELSE ts END AS ts, line, part, amount FROM (SELECT {COLS}, old, lim FROM o LEFT JOIN"
    " (SELECT * FROM late WHERE case_id IN (SELECT case_id FROM sel)) USING (case_id))",
    lambda s, d: shown(T.cap_lag(log_o(s, d, False), "Place order", "Ship item", 100, "D", shift_following=True, selected=picked(s, d))),
    ("o", "late", "sel"),
)
_t(
    "T2_delete_activity",
    f"SELECT {COLS} FROM o WHERE NOT (activity = 'Return item' AND case_id IN (SELECT case_id FROM sel))",
    lambda s, d: shown(T.delete_activity(log_o(s, d, False), "Return item", picked(s, d))),
)
_t(
    "T3_keep_first",
    f"SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY case_id, activity ORDER BY ts, seq) AS r FROM o) WHERE activity = 'Place order' OR r = 1",
    lambda s, d: shown(T.keep_first(log_o(s, d, False), ["Ship item", "Return item"])),
)
_t(
    "T4_move_all",
    f"SELECT * REPLACE (CASE WHEN activity = 'Return item' AND case_id IN (SELECT case_id FROM sel) THEN ts - INTERVAL 36 HOUR ELSE ts END AS ts) FROM (SELECT {COLS} FROM o)",
    lambda s, d: shown(T.move_event(log_o(s, d, False), "Return item", -36, "h", "all", picked(s, d))),
)
_t(
    "T4_move_first",
    f"SELECT case_id, activity, CASE WHEN r = 1 THEN ts + INTERVAL 2 DAY ELSE ts END AS ts, line, part, amount FROM (SELECT {COLS}, CASE WHEN activity <> 'Place order' THEN row_number() OVER"
    " (PARTITION BY case_id, activity <> 'Place order' ORDER BY ts, seq) END AS r FROM o)",
    lambda s, d: shown(T.move_event(log_o(s, d, False), ["Ship item", "Return item"], 2, "D", "first")),
)


@register(
    "T5_set_attribute",
    "SELECT case_id, activity, CASE WHEN case_id IN (SELECT case_id FROM sel) THEN 'rush' ELSE status END AS status, CASE WHEN case_id IN (SELECT case_id FROM sel) THEN 'x' END AS flag, count(*) AS n FROM o GROUP BY ALL",
    with_=["o", "sel"],
)
def _(spark, d):
    out = T.set_attribute(log_o(spark, d), "status", "rush", picked(spark, d))
    out = T.set_attribute(out, "flag", "x", picked(spark, d))
    return out.groupBy("case_id", "activity", "status", "flag").agg(F.count(F.lit(1)).alias("n"))


SPECS = [
    {"kind": "keep_first", "activity": "Ship item"},
    {"kind": "cap_lag", "a": "Place order", "b": "Ship item", "max": 100, "unit": "D"},
    {"kind": "delete_activity", "activity": "Return item"},
]
# The same three steps written out.
cte("c1", "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY case_id, activity ORDER BY ts, seq) AS r FROM o) WHERE activity <> 'Ship item' OR r = 1", "o")
cte(
    "c2l",
    "SELECT case_id, p.ta + INTERVAL 100 DAY AS lim, min(ts) AS old FROM c1 JOIN (SELECT case_id, min(ts) AS ta FROM c1 WHERE activity = 'Place order' GROUP BY 1) p USING (case_id)"
    " WHERE activity = 'Ship item' AND ts >= p.ta GROUP BY 1, 2 HAVING min(ts) > p.ta + INTERVAL 100 DAY",
    "c1",
)
cte("c2", "SELECT * EXCLUDE (lim, old) REPLACE (CASE WHEN activity = 'Ship item' AND ts = old THEN lim ELSE ts END AS ts) FROM c1 LEFT JOIN c2l USING (case_id)", "c1", "c2l")
cte("c3", "SELECT * FROM c2 WHERE activity <> 'Return item'", "c2")

_t("T6_chain", f"SELECT {COLS} FROM c3", lambda s, d: shown(T.chain(log_o(s, d, False), SPECS)[0]), ("c3",))


@register(
    "T6_chain_record",
    "SELECT 0 AS step, 'keep_first' AS kind, 0 AS events_moved, (SELECT count(*) FROM o) - (SELECT count(*) FROM c1) AS events_removed,"
    " (SELECT count(*) FROM (SELECT case_id FROM o WHERE activity = 'Ship item' GROUP BY 1 HAVING count(*) > 1)) AS cases_touched UNION ALL"
    " SELECT 1, 'cap_lag', (SELECT count(*) FROM c2l), 0, (SELECT count(*) FROM c2l) UNION ALL"
    " SELECT 2, 'delete_activity', 0, (SELECT count(*) FROM c2 WHERE activity = 'Return item'), (SELECT count(DISTINCT case_id) FROM c2 WHERE activity = 'Return item')",
    with_=["o", "c3", "c2l", "c1", "c2"],
)
def _(spark, d):
    return T.chain(log_o(spark, d, False), SPECS)[1]


# --------------------------------------------------------------------------- T7: edited norm on the transformed log
CHANGES = {
    "constraints": [{"id": "c_ship", "m": 2}, {"id": "c_metric", "applicability": None}],
    "remove": ["c_over", "c_each", "c_prec", "c_noret", "c_bal", "c_lag", "c_single"],
    "add": [{"id": "c_few", "layer": "quality", "type": "metric", "params": {"attribute": "n_events", "threshold": 2, "width": 2, "direction": "low"}}],
}


def scenario(spark, d):
    events, _ = T.chain(log_o(spark, d), SPECS)
    document, _ = T.edit_norm(NORM_DOC, CHANGES)
    document["views"] = [{"name": "A", "layer_weights": {"coverage": 1, "quality": 1, "value": 2}}]
    return store(score_table(events, load_norm(document)))


cte(
    "sc",
    "SELECT case_id, segment, (1.0 * v1 + 1.0 * v2 + 2.0 * v3) / 4.0 AS pen, 1 - (1.0 * v1 + 1.0 * v2 + 2.0 * v3) / 4.0 AS score_A FROM (SELECT case_id, max(segment) AS segment,"
    " CASE WHEN count(*) FILTER (WHERE activity = 'Ship item') < 2 THEN 1 ELSE 0 END AS v1, least(1, greatest(0, (2 - count(*)) / 2.0)) AS v2,"
    " least(1, greatest(0, (max(exposure) - 300000) / 150000.0)) AS v3 FROM c3 GROUP BY case_id)",
    "c3",
)


@register("T7_scenario_scores", "SELECT case_id, score_A AS score FROM sc", doubles="score", with_=["sc"])
def _(spark, d):
    return scenario(spark, d).select("case_id", F.col("score__A").alias("score"))


@register("T7_scenario_backlog", "SELECT * FROM (" + backlog_sql("segment", "A", 20, source="sc") + ")", doubles=BACKLOG_DOUBLES, with_=["sc"])
def _(spark, d):
    return K.backlog(scenario(spark, d), ["segment"], "A", gamma=20)
