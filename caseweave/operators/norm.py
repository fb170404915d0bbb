"""Norms: weighted graded expectations, compiled to Column expressions.

Scoring reads the events twice at most: one aggregate per case gathers counts,
totals and anchor times of all constraints, one join back to the events counts
what lies before, after or between the anchors.  Violations, weights and scores
are Column arithmetic on the resulting one-row-per-case table.

Definitions of our own, where a choice had to be made:
  presence   1 when fewer than ``m`` events, else 0
  exclusion  1 when any (scoped) event, else 0
  scopes     ``after``: strictly later than the first such event (none: count 0);
             ``before``: strictly earlier than the first such event (none: no limit)
  missing    ``skip`` not evaluated, ``violate`` 1, ``censor`` graded on the age
             of the activation at the window end; defaults skip for a missing
             ``a`` and violate for a missing ``b``
  balanced   a layer's weight is renormalised over layers with an evaluated
             constraint and split inside the layer by constraint weight
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import MICROS, all_named, all_of, any_of, clip01, elapsed, holds, join_on, label_tag, named, total
from ..functions.ordered import next_times
from ..session import store
from .derived import distinct_counts, recipe_aggregates, recipe_columns

# The closed catalogue of constraint types.
TYPES = ("presence", "exclusion", "singularity", "lag", "precedence", "balance", "metric")
MISSING = ("skip", "violate", "censor")


@dataclass(frozen=True)
class Constraint:
    id: str
    layer: str
    type: str
    params: Mapping[str, Any]
    weight: float = 1.0
    applicability: Mapping[str, Any] | None = None

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise ValueError(f"constraint {self.id}: unknown type {self.type!r}")

    def labels(self, name: str) -> list[str]:
        value = self.params.get(name) or []
        return [value] if isinstance(value, str) else list(value)

    def activities(self) -> list[str]:
        names = ("activity", "a", "b", "after", "before", "activities_x", "activities_y")
        return list(dict.fromkeys(label for n in names for label in self.labels(n)))

    def missing(self, end: str) -> str:
        default = {"missing_a": "skip", "missing_b": "violate"}[end]
        policy = self.params.get(end, self.params.get("missing", default))
        if policy not in MISSING:
            raise ValueError(f"constraint {self.id}: unknown missing policy {policy!r}")
        return policy


@dataclass(frozen=True)
class View:
    name: str
    layer_weights: Mapping[str, float] | None = None
    constraint_weights: Mapping[str, float] | None = None


@dataclass(frozen=True)
class Norm:
    layers: Sequence[str]
    views: Sequence[View]
    constraints: Sequence[Constraint]
    mode: str = "layer_balanced"
    window_end: str | None = None
    derived: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)

    def view(self, name: str) -> View:
        return next(v for v in self.views if v.name == name)

    def constraint(self, cid: str) -> Constraint:
        return next(c for c in self.constraints if c.id == cid)

    def ids(self) -> list[str]:
        return [c.id for c in self.constraints]


def load_norm(doc: Mapping[str, Any]) -> Norm:
    """A norm from its JSON document.

    Layers are ids or objects with an ``id``; derived attributes are a mapping by name or a list of
    recipes with a ``name``.
    """
    layers = [x if isinstance(x, str) else x["id"] for x in doc["layers"]]
    derived = doc.get("derived_attributes") or {}
    if not isinstance(derived, Mapping):
        derived = {r["name"]: {k: v for k, v in r.items() if k != "name"} for r in derived}
    views = [View(v["name"], v.get("layer_weights"), v.get("constraint_weights")) for v in doc.get("views", [])]
    constraints = [
        Constraint(c["id"], c["layer"], c["type"], c.get("params", {}), c.get("weight", 1.0), c.get("applicability"))
        for c in doc["constraints"]
    ]
    return Norm(
        tuple(layers),
        tuple(views),
        tuple(constraints),
        doc.get("scoring_mode", "layer_balanced"),
        doc.get("window_end"),
        derived,
    )


# --------------------------------------------------------------------------- weights
def weights(norm: Norm, view: View) -> dict[str, float]:
    """Constraint weights of a view; a layer weight is split inside the layer by constraint weight."""
    if view.constraint_weights is not None:
        return {c.id: float(view.constraint_weights.get(c.id, 0.0)) for c in norm.constraints}
    in_layer = {layer: sum(c.weight for c in norm.constraints if c.layer == layer) for layer in norm.layers}
    return {
        c.id: float((view.layer_weights or {}).get(c.layer, 0.0)) * c.weight / in_layer[c.layer]
        if in_layer[c.layer]
        else 0.0
        for c in norm.constraints
    }


def general_view(norm: Norm, name: str = "general") -> View:
    """Every layer that any view weighs totals 1, split equally over its constraints."""
    used = set()
    for view in norm.views:
        w = weights(norm, view)
        used |= {c.layer for c in norm.constraints if w[c.id] > 0}
    sizes = {layer: sum(c.layer == layer for c in norm.constraints) for layer in used}
    return View(name, constraint_weights={c.id: 1.0 / sizes[c.layer] for c in norm.constraints if c.layer in used})


def with_weights(df: DataFrame, norm: Norm, view: View, prefix: str) -> DataFrame:
    """Per-case weights over the evaluated constraints, summing to 1 or all 0.

    Added in steps, so that a weight refers to a layer total instead of repeating it.
    """
    w = weights(norm, view)
    members = {layer: [c.id for c in norm.constraints if c.layer == layer] for layer in norm.layers}
    members = {layer: ids for layer, ids in members.items() if ids}
    live = {i: F.when(named(f"v__{i}").isNotNull(), F.lit(w[i])).otherwise(F.lit(0.0)) for i in norm.ids()}
    out = df.withColumns({f"{prefix}e_{layer}": total([live[i] for i in ids]) for layer, ids in members.items()})
    e = {layer: named(f"{prefix}e_{layer}") for layer in members}
    if norm.mode == "flat":
        out = out.withColumn(f"{prefix}act", total(list(e.values())))
    else:
        size = {layer: float(sum(w[i] for i in ids)) for layer, ids in members.items()}
        active = [F.when(e[layer] > 0, F.lit(size[layer])).otherwise(F.lit(0.0)) for layer in members]
        out = out.withColumn(f"{prefix}act", total(active))
        factor = {
            layer: F.when(e[layer] > 0, F.lit(size[layer]) / named(f"{prefix}act") / e[layer]).otherwise(F.lit(0.0))
            for layer in members
        }
        out = out.withColumns({f"{prefix}f_{layer}": c for layer, c in factor.items()})
    cols = {}
    for layer, ids in members.items():
        for i in ids:
            if norm.mode == "flat":
                cols[f"{prefix}w_{i}"] = F.when(named(f"{prefix}act") > 0, live[i] / named(f"{prefix}act")).otherwise(0.0)
            else:
                cols[f"{prefix}w_{i}"] = live[i] * named(f"{prefix}f_{layer}")
    return out.withColumns(cols).drop(*[f"{prefix}{k}_{layer}" for layer in members for k in ("e", "f")])


# --------------------------------------------------------------------------- applicability
def applies(rule: Mapping[str, Any] | None, norm_labels: Sequence[str] = ()) -> Column:
    """Compile the applicability grammar to a boolean; NULL comparisons are false."""
    if not rule:
        return F.lit(True)
    parts: list[Column] = []
    if "attr" in rule:
        col = named(rule["attr"])
        ops = {
            "in": lambda v: col.cast("string").isin([str(x) for x in v]),
            "not_in": lambda v: ~holds(col.cast("string").isin([str(x) for x in v])),
            "eq": lambda v: col == F.lit(v),
            "ne": lambda v: ~holds(col == F.lit(v)),
            "gt": lambda v: col > F.lit(v),
            "gte": lambda v: col >= F.lit(v),
            "lt": lambda v: col < F.lit(v),
            "lte": lambda v: col <= F.lit(v),
            "isna": lambda v: col.isNull() if v else col.isNotNull(),
            "notna": lambda v: col.isNotNull() if v else col.isNull(),
        }
        used = [op for op in ops if op in rule]
        if not used or set(rule) - set(ops) - {"attr"}:
            raise ValueError(f"applicability rule not understood: {dict(rule)}")
        parts += [holds(ops[op](rule[op])) for op in used]
    else:
        for key, value in rule.items():
            if key == "all":
                parts.append(all_of(applies(r) for r in value))
            elif key == "any":
                parts.append(any_of(applies(r) for r in value))
            elif key == "not":
                parts.append(~applies(value))
            elif key == "has":
                parts.append(F.col(count_name([value] if isinstance(value, str) else value)) > 0)
            elif key == "lacks":
                parts.append(F.col(count_name([value] if isinstance(value, str) else value)) == 0)
            else:
                wanted = value if isinstance(value, list | tuple) else [value]
                parts.append(holds(named(key).cast("string").isin([str(x) for x in wanted])))
    return all_of(parts)


def rule_labels(rule: Mapping[str, Any] | None) -> list[tuple[str, ...]]:
    """The label sets named by ``has`` and ``lacks`` anywhere in a rule."""
    out: list[tuple[str, ...]] = []
    for key, value in (rule or {}).items():
        if key in ("has", "lacks"):
            out.append((value,) if isinstance(value, str) else tuple(value))
        elif key in ("all", "any"):
            for r in value:
                out += rule_labels(r)
        elif key == "not":
            out += rule_labels(value)
    return out


def count_name(labels: Sequence[str]) -> str:
    return f"n__{label_tag(labels)}"


def _first_name(labels: Sequence[str]) -> str:
    return f"t__{label_tag(labels)}"


def _last_name(labels: Sequence[str]) -> str:
    return f"u__{label_tag(labels)}"


# --------------------------------------------------------------------------- first and second pass
def first_pass(norm: Norm) -> dict[str, Column]:
    """Aggregates over a case's events that need no anchor; all have a map-side part."""
    act, ts = F.col("activity"), F.col("ts")
    out: dict[str, Column] = {}

    def need_count(labels: Sequence[str]) -> None:
        out[count_name(labels)] = F.count_if(act.isin(list(labels)))

    def need_first(labels: Sequence[str]) -> None:
        out[_first_name(labels)] = F.min(F.when(act.isin(list(labels)), ts))

    for c in norm.constraints:
        for labels in rule_labels(c.applicability):
            need_count(labels)
        if c.type in ("presence", "exclusion", "singularity"):
            need_count(c.labels("activity"))
            for scope in ("after", "before"):
                if c.labels(scope):
                    need_first(c.labels(scope))
        elif c.type == "lag":
            need_first(c.labels("a"))
            need_first(c.labels("b"))
            if c.params.get("activation", "first") == "last":
                out[_last_name(c.labels("a"))] = F.max(F.when(act.isin(c.labels("a")), ts))
        elif c.type == "precedence":
            need_first(c.labels("a"))
            need_count(c.labels("a"))
            need_count(c.labels("b"))
        elif c.type == "balance":
            agg = {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg}[c.params.get("agg", "sum")]
            for side in ("x", "y"):
                value = named(c.params[f"attr_{side}"]).cast("double")
                labels = c.labels(f"activities_{side}")
                out[f"bal_{side}__{c.id}"] = agg(F.when(act.isin(labels), value) if labels else value)
    return out


def second_pass(norm: Norm) -> dict[str, Column]:
    """Aggregates relative to the anchors found by the first pass."""
    act, ts = F.col("activity"), F.col("ts")
    out: dict[str, Column] = {}
    for c in norm.constraints:
        if c.type == "lag" and c.params.get("activation", "first") != "each" and (
            c.params.get("response", "first_after") == "first_after"
        ):
            out[f"resp__{c.id}"] = F.min(F.when(act.isin(c.labels("b")) & (ts >= _activation(c)), ts))
        elif c.type == "precedence":
            out[f"early__{c.id}"] = F.count_if(act.isin(c.labels("b")) & (ts < F.col(_first_name(c.labels("a")))))
        elif c.type in ("exclusion", "singularity") and (c.labels("after") or c.labels("before")):
            cond = act.isin(c.labels("activity"))
            if c.labels("after"):
                cond = cond & (ts > F.col(_first_name(c.labels("after"))))
            if c.labels("before"):
                first = F.col(_first_name(c.labels("before")))
                cond = cond & (first.isNull() | (ts < first))
            out[f"scoped__{c.id}"] = F.count_if(holds(cond))
    return out


def _activation(c: Constraint) -> Column:
    name = _last_name if c.params.get("activation", "first") == "last" else _first_name
    return F.col(name(c.labels("a")))


def _second_labels(norm: Norm) -> list[str]:
    names = {"lag": ("b",), "precedence": ("b",), "exclusion": ("activity",), "singularity": ("activity",)}
    return sorted({x for c in norm.constraints for n in names.get(c.type, ()) for x in c.labels(n)})


def gather(
    events: DataFrame, norm: Norm, case_aggregates: Mapping[str, Column], case_columns: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per case with the case columns, the derived attributes and every quantity the constraints need.

    ``case_columns`` are expressions on the aggregated row, such as a flow type; derived attributes may read them.
    """
    several = {n: r for n, r in norm.derived.items() if r["kind"] != "nunique"}
    first = {**case_aggregates, **recipe_aggregates(several), **first_pass(norm)}
    cases = events.groupBy("case_id").agg(*[c.alias(n) for n, c in first.items()])
    distinct = distinct_counts(events, norm.derived)
    if distinct is not None:
        cases = join_on(cases, distinct, ["case_id"], "left").fillna(0, [n for n in norm.derived if n not in several])
    cases = cases.withColumns(dict(case_columns)) if case_columns else cases
    later = second_pass(norm)
    if later:
        # Read twice below: as anchors for the events and as the result.
        cases = store(cases)
        anchors = [c for c in cases.columns if c.startswith(("t__", "u__"))]
        rows = events.where(F.col("activity").isin(_second_labels(norm)) & F.col("ts").isNotNull())
        rows = join_on(rows.select("case_id", "activity", "ts"), cases.select("case_id", *anchors), ["case_id"])
        found = rows.groupBy("case_id").agg(*[c.alias(n) for n, c in later.items()])
        cases = join_on(cases, found, ["case_id"], "left")
        counts = [n for n in later if n.startswith(("early__", "scoped__"))]
        cases = cases.withColumns({n: F.coalesce(named(n), F.lit(0)) for n in counts})
    each = [c for c in norm.constraints if c.type == "lag" and c.params.get("activation") == "each"]
    if each:
        sizes = cases.select("case_id", "n_events") if later and "n_events" in cases.columns else None
        cases = join_on(cases, _each_lags(events, each, norm, sizes), ["case_id"], "left")
    return recipe_columns(cases, norm.derived) if norm.derived else cases


def _each_lags(events: DataFrame, each: Sequence[Constraint], norm: Norm, sizes: DataFrame | None = None) -> DataFrame:
    """Mean lag and mean violation over every activation, for all ``each`` lags in one pass over the events.

    Constraints that wait for the same labels share the search for the next one.
    """
    act = F.col("activity")
    waits = {_next_name(c): act.isin(c.labels("b")) for c in each}
    labels = sorted({x for c in each for n in ("a", "b") for x in c.labels(n)})
    rows = events.where(act.isin(labels) & F.col("ts").isNotNull())
    rows = next_times(rows.select("case_id", "activity", "ts", "seq"), waits, sizes=sizes)
    aggs = []
    for c in each:
        hit, tb = act.isin(c.labels("a")), F.col(_next_name(c))
        lag = elapsed(F.col("ts"), tb, c.params.get("unit", "D"))
        late = _missing_b(c, F.col("ts"), norm)
        nu = F.when(tb.isNotNull(), _grade(lag, c.params["delta"], c.params.get("width", 0.0))).otherwise(late)
        aggs += [F.avg(F.when(hit, lag)).alias(f"each__{c.id}"), F.avg(F.when(hit, nu)).alias(f"eachv__{c.id}")]
    return rows.groupBy("case_id").agg(*aggs)


def _next_name(c: Constraint) -> str:
    return f"next__{label_tag(c.labels('b'))}"


# --------------------------------------------------------------------------- signals and violations
def _grade(x: Column, start: float, width: float) -> Column:
    if not width:
        return F.when(x.isNotNull(), F.when(x > start, F.lit(1.0)).otherwise(F.lit(0.0)))
    return F.when(x.isNotNull(), clip01((x - F.lit(float(start))) / F.lit(float(width))))


def _missing_b(c: Constraint, activation: Column, norm: Norm) -> Column:
    policy = c.missing("missing_b")
    if policy == "skip":
        return F.lit(None).cast("double")
    if policy == "violate":
        return F.lit(1.0)
    if norm.window_end is None:
        raise ValueError(f"constraint {c.id}: the censor policy needs a window end")
    age = elapsed(activation, F.lit(norm.window_end).cast("timestamp_ntz"), c.params.get("unit", "D"))
    return _grade(age, c.params["delta"], c.params.get("width", 0.0))


def signal(c: Constraint) -> Column:
    """The raw signal of a constraint in its own unit, from a gathered case row."""
    if c.type == "presence":
        return F.col(count_name(c.labels("activity"))).cast("double")
    if c.type in ("exclusion", "singularity"):
        scoped = c.labels("after") or c.labels("before")
        return named(f"scoped__{c.id}" if scoped else count_name(c.labels("activity"))).cast("double")
    if c.type == "lag":
        if c.params.get("activation") == "each":
            return named(f"each__{c.id}")
        unit = c.params.get("unit", "D")
        if c.params.get("response", "first_after") == "first_overall":
            raw = elapsed(_activation(c), F.col(_first_name(c.labels("b"))), unit)
            return F.when(raw >= 0, raw)
        return elapsed(_activation(c), named(f"resp__{c.id}"), unit)
    if c.type == "precedence":
        return F.when(F.col(_first_name(c.labels("a"))).isNotNull(), named(f"early__{c.id}").cast("double")).otherwise(
            F.lit(0.0)
        )
    if c.type == "balance":
        x, y = (F.coalesce(named(f"bal_{s}__{c.id}"), F.lit(0.0)) for s in ("x", "y"))
        return F.abs(x - y) / F.greatest(x, y, F.lit(float(c.params.get("eps", 1e-9))))
    return named(c.params["attribute"]).cast("double")


def violation(c: Constraint, norm: Norm, x: Column | None = None) -> Column:
    """The graded violation in [0, 1]; NULL where the constraint cannot be evaluated.

    ``x`` may name a column that already holds the signal.
    """
    x, p = signal(c) if x is None else x, c.params
    if c.type == "presence":
        return F.when(x < p.get("m", 1), 1.0).otherwise(0.0)
    if c.type == "exclusion":
        return F.when(x > 0, 1.0).otherwise(0.0)
    if c.type == "singularity":
        return _grade(x, p.get("k", 1), p.get("K", 1))
    if c.type == "balance":
        return _grade(x, p.get("tau", 0.0), p.get("width", 0.0))
    if c.type == "metric":
        down = p.get("direction", "high") == "low"
        return _grade(-x if down else x, -p["threshold"] if down else p["threshold"], p.get("width", 0.0))
    none_a = {"skip": F.lit(None).cast("double"), "violate": F.lit(1.0), "censor": F.lit(None).cast("double")}[
        c.missing("missing_a")
    ]
    has_a = F.col(_first_name(c.labels("a"))).isNotNull()
    if c.type == "precedence":
        has_b = F.col(count_name(c.labels("b"))) > 0
        none_b = F.lit(None).cast("double") if c.missing("missing_b") == "skip" else F.lit(0.0)
        graded = _grade(x, p.get("k", 0), p.get("K", 1))
        return F.when(~has_a, none_a).when(~has_b, none_b).otherwise(graded)
    if p.get("activation") == "each":
        return F.when(has_a, named(f"eachv__{c.id}")).otherwise(none_a)
    graded = _grade(x, p["delta"], p.get("width", 0.0))
    if p.get("response", "first_after") == "first_overall":
        negative = F.col(_first_name(c.labels("b"))) < _activation(c)
        none_b = F.when(holds(negative), F.lit(None).cast("double")).otherwise(_missing_b(c, _activation(c), norm))
    else:
        none_b = _missing_b(c, _activation(c), norm)
    return F.when(~has_a, none_a).otherwise(F.coalesce(graded, none_b))


def in_scope(norm: Norm) -> dict[str, Column]:
    return {f"s__{c.id}": applies(c.applicability) for c in norm.constraints}


def raw_signals(gathered: DataFrame, norm: Norm) -> DataFrame:
    """Cases x constraints in native units, not masked by applicability."""
    return gathered.select("case_id", *[signal(c).alias(f"x__{c.id}") for c in norm.constraints])


def evaluate(gathered: DataFrame, norm: Norm, keep: Sequence[str]) -> DataFrame:
    """Scope, signal and violation columns next to the kept case columns."""
    out = gathered.withColumns({f"x__{c.id}": signal(c) for c in norm.constraints})
    out = out.withColumns({f"s__{c.id}": applies(c.applicability) for c in norm.constraints})
    cols = []
    for c in norm.constraints:
        v = violation(c, norm, named(f"x__{c.id}"))
        cols += [named(f"s__{c.id}"), named(f"x__{c.id}"), F.when(named(f"s__{c.id}"), v).alias(f"v__{c.id}")]
    return out.select("case_id", *all_named(keep), *all_named(cols))


def with_scores(evaluated: DataFrame, norm: Norm, views: Sequence[View] | None = None) -> DataFrame:
    """Per view: ``score__``, ``contrib__<view>__<layer>`` and ``p__<view>__<constraint>`` (penalties)."""
    out = evaluated
    for view in views if views is not None else norm.views:
        pre = f"__{view.name}_"
        out = with_weights(out, norm, view, pre)
        pen = {
            f"p__{view.name}__{i}": F.coalesce(named(f"v__{i}"), F.lit(0.0)) * named(f"{pre}w_{i}") for i in norm.ids()
        }
        out = out.withColumns(pen)
        scored = named(f"{pre}act") > 0
        cols = {f"score__{view.name}": F.when(scored, 1 - total([named(p) for p in pen]))}
        for layer in norm.layers:
            members = [named(f"p__{view.name}__{c.id}") for c in norm.constraints if c.layer == layer]
            cols[f"contrib__{view.name}__{layer}"] = F.when(scored, total(members) if members else F.lit(0.0))
        out = out.withColumns(cols).drop(f"{pre}act", *[f"{pre}w_{i}" for i in norm.ids()])
    return out


def score(
    events: DataFrame,
    norm: Norm,
    case_aggregates: Mapping[str, Column],
    keep: Sequence[str],
    case_columns: Mapping[str, Column] | None = None,
) -> DataFrame:
    """The scored case table: attributes, derived attributes, scope, signals, violations, penalties and scores."""
    kept = list(dict.fromkeys([*keep, *(case_columns or {}), *norm.derived]))
    return with_scores(evaluate(gather(events, norm, case_aggregates, case_columns), norm, kept), norm)


def long_form(scored: DataFrame, norm: Norm, view: str, keep: Sequence[str]) -> DataFrame:
    """One row per case and constraint: ``constraint_id, layer, v, s, x, p`` and the kept columns."""
    items = [
        F.struct(
            F.lit(c.id).alias("constraint_id"),
            F.lit(c.layer).alias("layer"),
            named(f"v__{c.id}").alias("v"),
            named(f"s__{c.id}").alias("s"),
            named(f"x__{c.id}").alias("x"),
            named(f"p__{view}__{c.id}").alias("p"),
        )
        for c in norm.constraints
    ]
    return scored.select(*all_named(keep), F.inline(F.array(*items)))


def run_summary(scored: DataFrame, norm: Norm) -> DataFrame:
    """Mean score per view, mean contribution per layer and the share of evaluated cells."""
    n = len(norm.constraints)
    evaluated = total([F.count(named(f"v__{c.id}")) for c in norm.constraints]) / (F.count(F.lit(1)) * n)
    rows = [F.struct(F.lit("density").alias("measure"), F.lit("all").alias("name"), F.col("density").alias("value"))]
    aggs = [evaluated.alias("density")]
    for view in norm.views:
        aggs.append(F.avg(named(f"score__{view.name}")).alias(f"m_{view.name}"))
        rows.append(F.struct(F.lit("mean_score").alias("measure"), F.lit(view.name).alias("name"), named(f"m_{view.name}").alias("value")))
        for layer in norm.layers:
            aggs.append(F.avg(named(f"contrib__{view.name}__{layer}")).alias(f"c_{view.name}_{layer}"))
            rows.append(
                F.struct(
                    F.lit("mean_contribution").alias("measure"),
                    F.lit(f"{view.name}/{layer}").alias("name"),
                    named(f"c_{view.name}_{layer}").alias("value"),
                )
            )
    return scored.agg(*aggs).select(F.inline(F.array(*rows)))


def scale(c: Constraint, factor: float) -> Constraint | None:
    """A copy of a graded constraint with threshold and width scaled, or ``None``."""
    p = dict(c.params)
    if c.type == "lag":
        p.update(delta=p["delta"] * factor, width=p.get("width", 0.0) * factor)
    elif c.type == "balance":
        p.update(tau=min(1.0, p.get("tau", 0.0) * factor), width=p.get("width", 0.0) * factor)
    elif c.type in ("singularity", "precedence"):
        p.update(k=max(0, round(p.get("k", 0) * factor)), K=p.get("K", 1) * factor)
    elif c.type == "metric":
        p.update(threshold=p["threshold"] * factor, width=p.get("width", 0.0) * factor)
    else:
        return None
    return Constraint(c.id, c.layer, c.type, p, c.weight, c.applicability)


def lag_horizon_micros(c: Constraint) -> int:
    return int((c.params["delta"] + c.params.get("width", 0.0)) * MICROS[c.params.get("unit", "D")])
