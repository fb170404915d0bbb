"""The case filter grammar: JSON clauses compiled to a boolean per case.

Every clause becomes a condition over one row per case.  What the clauses need
from the events (counts, first and last labels, adjacent pairs, first responses)
is gathered by ``resolve`` in one aggregate, plus one join for responses and one
ordered pass for adjacency, however many clauses there are.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import all_of, elapsed, holds, join_on, label_tag, named, ntz, quoted
from ..functions.ordered import sort_key, with_next
from ..session import store

# The clause kinds with the fields each may carry, and their options.
FIELDS = {
    "time": {"kind", "field", "from", "to"},
    "attribute": {"kind", "field", "in", "eq", "min", "max"},
    "activity": {"kind", "op", "activity"},
    "follows": {"kind", "a", "b", "directly", "never"},
    "lag": {"kind", "a", "b", "unit", "min", "max"},
    "count": {"kind", "activity", "min", "max"},
    "open": {"kind", "value"},
}
START_FIELDS = ("case_start", "first_ts", "start")
END_FIELDS = ("case_end", "last_ts", "end")
ACTIVITY_OPS = ("contains", "starts_with", "ends_with", "never")
LAG_UNITS = ("D", "H", "M", "S")


class FilterError(ValueError):
    """A filter that cannot be evaluated exactly."""


def _need(ok: Any, i: int, text: str) -> None:
    if not ok:
        raise FilterError(f"clause {i}: {text}")


def _number(value: Any) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value)


def _scalar(value: Any) -> bool:
    return isinstance(value, str | int | float | bool)


def _is_labels(value: Any) -> bool:
    if isinstance(value, str):
        return bool(value)
    return isinstance(value, list) and bool(value) and all(isinstance(v, str) and v for v in value)


def check(filter_: Mapping[str, Any]) -> list[Mapping[str, Any]]:
    """The clauses of a filter; anything unknown, ambiguous or out of range is an error."""
    if not isinstance(filter_, Mapping) or set(filter_) != {"and"} or not isinstance(filter_["and"], list):
        raise FilterError('a filter is {"and": [clause, …]}')
    for i, c in enumerate(filter_["and"]):
        _need(isinstance(c, Mapping) and c.get("kind") in FIELDS, i, f"kind must be one of {tuple(FIELDS)}")
        kind = c["kind"]
        _need(not set(c) - FIELDS[kind], i, f"unknown fields {sorted(set(c) - FIELDS[kind])}")
        for flag in ("directly", "never", "value"):
            _need(flag not in c or isinstance(c[flag], bool), i, f"{flag} must be true or false")
        for name in ("activity", "a", "b"):
            _need(name not in FIELDS[kind] or _is_labels(c.get(name)), i, f"{name} needs one or more labels")
        for bound in ("min", "max"):
            _need(c.get(bound) is None or _number(c[bound]), i, f"{bound} must be a finite number")
        if c.get("min") is not None and c.get("max") is not None:
            _need(c["min"] <= c["max"], i, "min is above max")
        bounded = c.get("min") is not None or c.get("max") is not None
        if kind == "time":
            _need(c.get("field", "case_start") in START_FIELDS + END_FIELDS, i, "unknown time field")
            stamps = [_iso(c[k], i) for k in ("from", "to") if k in c]
            _need(stamps, i, "a time clause needs from or to")
            if len(stamps) == 2:
                _need((stamps[0].tzinfo is None) == (stamps[1].tzinfo is None), i, "give both bounds a zone or neither")
                _need(stamps[0] <= stamps[1], i, "from is after to")
        elif kind == "attribute":
            _need(isinstance(c.get("field"), str) and c["field"], i, "attribute needs a field")
            _need(("in" in c) + ("eq" in c) + ("min" in c or "max" in c) == 1, i, "give exactly one of in, eq, bounds")
            if "in" in c:
                _need(isinstance(c["in"], list) and c["in"] and all(map(_scalar, c["in"])), i, "in needs values")
            _need("eq" not in c or _scalar(c["eq"]), i, "eq needs one value")
        elif kind == "activity":
            _need(c.get("op", "contains") in ACTIVITY_OPS, i, f"op must be one of {ACTIVITY_OPS}")
        elif kind in ("lag", "count"):
            _need(bounded, i, f"{kind} needs min or max")
            _need(kind != "lag" or c.get("unit", "D") in LAG_UNITS, i, f"unit must be one of {LAG_UNITS}")
            if kind == "count":
                values = [c[k] for k in ("min", "max") if c.get(k) is not None]
                _need(all(v >= 0 and int(v) == v for v in values), i, "counts are whole and not negative")
    return list(filter_["and"])


def _iso(text: Any, i: int) -> datetime:
    _need(isinstance(text, str) and text.strip(), i, "time bounds are ISO text")
    try:
        return datetime.fromisoformat(text)
    except ValueError as exc:
        raise FilterError(f"clause {i}: {text!r} is no ISO time") from exc


def _stamp(text: str) -> Column:
    """A time bound on the log's clock; a bound with a zone is taken in UTC."""
    t = datetime.fromisoformat(text)
    return ntz((t.astimezone(UTC).replace(tzinfo=None) if t.tzinfo else t).isoformat(sep=" "))


def parse(text: str) -> dict[str, Any]:
    """A filter from its JSON text: a conjunction or a single clause."""
    try:
        obj = json.loads(text)
    except ValueError as exc:
        raise FilterError(f"not valid JSON: {exc}") from exc
    if isinstance(obj, dict) and "and" not in obj:
        obj = {"and": [obj] if obj else []}
    check(obj)
    return obj


def _labels(value: Any) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def _count(c: Mapping[str, Any]) -> str:
    return f"__n:{label_tag(c['activity'])}"


def _pair(c: Mapping[str, Any], what: str) -> str:
    return f"__{what}:{label_tag(c['a'], c['b'])}"


def needs(clauses: Sequence[Mapping[str, Any]]) -> dict[str, Mapping[str, Any]]:
    """Helper columns the clauses read, by name."""
    out: dict[str, Mapping[str, Any]] = {}
    for c in clauses:
        if c["kind"] == "count" or (c["kind"] == "activity" and c.get("op", "contains") in ("contains", "never")):
            out[_count(c)] = c
        elif c["kind"] == "activity":
            out["__first_label" if c["op"] == "starts_with" else "__last_label"] = c
        elif c["kind"] == "follows" and c.get("directly"):
            out[_pair(c, "direct")] = c
        elif c["kind"] in ("follows", "lag"):
            out[_pair(c, "from")] = c
            out[_pair(c, "to")] = c
    return out


def resolve(events: DataFrame, clauses: Sequence[Mapping[str, Any]], aggregates: Mapping[str, Column]) -> DataFrame:
    """One row per case: the given aggregates and every helper column of the clauses."""
    act, ts, key = F.col("activity"), F.col("ts"), sort_key(events)
    wanted = needs(clauses)
    aggs = dict(aggregates)
    for name, c in wanted.items():
        if name.startswith("__n:"):
            aggs[name] = F.count_if(act.isin(_labels(c["activity"])))
        elif name == "__first_label":
            aggs[name] = F.min_by(act, F.when(act.isNotNull(), key))
        elif name == "__last_label":
            aggs[name] = F.max_by(act, F.when(act.isNotNull(), key))
        elif name.startswith("__from:"):
            aggs[name] = F.min(F.when(act.isin(_labels(c["a"])), ts))
    aggs = aggs or {"__rows": F.count(F.lit(1))}
    cases = events.groupBy("case_id").agg(*[e.alias(n) for n, e in aggs.items()])
    responses = {n: c for n, c in wanted.items() if n.startswith("__to:")}
    if responses:
        # Read twice: as anchors for the responses and as the result.
        cases = store(cases)
        b = sorted({x for c in responses.values() for x in _labels(c["b"])})
        starts = [_pair(c, "from") for c in responses.values()]
        rows = events.where(act.isin(b) & ts.isNotNull()).select("case_id", "activity", "ts")
        rows = join_on(rows, cases.select("case_id", *starts), ["case_id"])
        first = [
            F.min(F.when(act.isin(_labels(c["b"])) & (ts >= named(_pair(c, 'from'))), ts)).alias(n)
            for n, c in responses.items()
        ]
        cases = join_on(cases, rows.groupBy("case_id").agg(*first), ["case_id"], "left")
    direct = {n: c for n, c in wanted.items() if n.startswith("__direct:")}
    if direct:
        rows = with_next(events.select("case_id", "activity", "ts", *[x for x in ("ord",) if x in events.columns], "seq"), ("activity",))
        hits = [
            F.bool_or(holds(act.isin(_labels(c["a"])) & F.col("nxt_activity").isin(_labels(c["b"])))).alias(n)
            for n, c in direct.items()
        ]
        cases = join_on(cases, rows.groupBy("case_id").agg(*hits), ["case_id"], "left")
    return cases


def case_clause(c: Mapping[str, Any]) -> Column:
    """One clause as a condition on a resolved case row; never NULL."""
    kind = c["kind"]
    if kind == "time":
        col = F.col("first_ts" if c.get("field", "case_start") in START_FIELDS else "last_ts")
        conds = [col >= _stamp(c["from"])] if "from" in c else []
        conds += [col <= _stamp(c["to"])] if "to" in c else []
        return holds(all_of(conds))
    if kind == "attribute":
        col = named(c['field'])
        # Booleans are spelled True and False in filters.
        text = F.when(F.typeof(col) == "boolean", F.initcap(col.cast("string"))).otherwise(col.cast("string"))
        if "in" in c:
            wanted = [str(v) for v in c["in"]]
            hit = holds(text.isin(wanted))
            return hit | col.isNull() if {"(missing)", ""} & set(wanted) else hit
        if "eq" in c:
            return holds(text == F.lit(str(c["eq"])))
        return _between(F.expr(f"try_cast({quoted(c['field'])} as double)"), c)
    if kind == "activity":
        op = c.get("op", "contains")
        if op in ("contains", "never"):
            n = named(_count(c))
            return n > 0 if op == "contains" else n == 0
        return holds(F.col("__first_label" if op == "starts_with" else "__last_label").isin(_labels(c["activity"])))
    if kind == "follows":
        seen = holds(named(_pair(c, 'direct'))) if c.get("directly") else named(_pair(c, 'to')).isNotNull()
        return ~seen if c.get("never") else seen
    if kind == "lag":
        unit = c.get("unit", "D")
        return _between(elapsed(named(_pair(c, 'from')), named(_pair(c, 'to')), unit), c)
    if kind == "count":
        return _between(named(_count(c)), c)
    return holds(F.col("censored")) if c.get("value", True) else ~holds(F.col("censored"))


def _between(x: Column, c: Mapping[str, Any]) -> Column:
    conds = [x.isNotNull()]
    if c.get("min") is not None:
        conds.append(x >= F.lit(c["min"]))
    if c.get("max") is not None:
        conds.append(x <= F.lit(c["max"]))
    return holds(all_of(conds))


def select_cases(events: DataFrame, filter_: Mapping[str, Any], aggregates: Mapping[str, Column]) -> DataFrame:
    """The resolved cases with ``selected`` = all clauses hold."""
    clauses = check(filter_)
    cases = resolve(events, clauses, aggregates)
    return cases.withColumn("selected", all_of(case_clause(c) for c in clauses))


def preview(cases: DataFrame, clauses: Sequence[Mapping[str, Any]], scopes: Mapping[str, Column]) -> DataFrame:
    """Counts of a filter: cases in and out, per clause kept alone and removed on its own margin, scope per constraint."""
    masks = [case_clause(c) for c in clauses]
    every = all_of(masks)
    items = {("cases_in", ""): every, ("cases_out", ""): ~every}
    for i, m in enumerate(masks):
        others = all_of(q for j, q in enumerate(masks) if j != i)
        items[("kept_alone", str(i))] = m
        items[("removed_marginally", str(i))] = others & ~m
    for cid, s in scopes.items():
        items[("in_scope", cid)] = every & s
    aggs = [F.count_if(m).alias(f"m{i}") for i, m in enumerate(items.values())]
    rows = [
        F.struct(F.lit(a).alias("measure"), F.lit(b).alias("item"), named(f"m{i}").alias("cases"))
        for i, (a, b) in enumerate(items)
    ]
    return cases.agg(*aggs).select(F.inline(F.array(*rows)))


def slice_mask(where: Mapping[str, Any]) -> Column:
    """AND of equalities or value lists over attributes; NULL equals NULL."""
    conds = []
    for name, value in where.items():
        values = value if isinstance(value, list | tuple) else [value]
        hit = F.lit(False)
        for v in values:
            hit = hit | named(name).eqNullSafe(F.lit(v))
        conds.append(hit)
    return all_of(conds)
