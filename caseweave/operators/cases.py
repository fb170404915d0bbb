"""The case table and everything derived per case; recipes of derived attributes are in ``derived``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import MICROS, all_named, elapsed, holds, join_on, named, period_label, quoted, text_rows
from ..functions.ordered import quantiles, sort_key
from .derived import arithmetic, recipe_aggregates, recipe_columns
from .filters import case_clause, needs, resolve
from .norm import applies, rule_labels

# How the exposure of a case is taken from its events.
EXPOSURE = ("max", "sum", "first", "last", "min", "mean")


def case_aggregates(
    events: DataFrame,
    attributes: Sequence[str] = (),
    exposure: str | None = None,
    exposure_agg: str = "max",
) -> dict[str, Column]:
    """The aggregates of a case table; an attribute is the first non-null value in event order."""
    key = sort_key(events)
    out = {
        "n_events": F.count(F.lit(1)),
        "first_ts": F.min("ts"),
        "last_ts": F.max("ts"),
    }
    if exposure:
        if exposure_agg not in EXPOSURE:
            raise ValueError(f"exposure aggregate must be one of {EXPOSURE}")
        x = named(exposure)
        known = F.when(x.isNotNull(), key)
        out["exposure"] = {
            "max": F.max(x),
            "sum": F.sum(x),
            "min": F.min(x),
            "mean": F.avg(x),
            "first": F.min_by(x, known),
            "last": F.max_by(x, known),
        }[exposure_agg]
    for a in attributes:
        out[a] = F.min_by(named(a), F.when(named(a).isNotNull(), key))
    return out


def build_cases(events: DataFrame, extra: Mapping[str, Column] | None = None, **spec: Any) -> DataFrame:
    aggs = {**case_aggregates(events, **spec), **(extra or {})}
    return events.groupBy("case_id").agg(*[c.alias(n) for n, c in aggs.items()])


# --------------------------------------------------------------------------- derived attributes
def stamp(labels: Sequence[str], which: str = "first") -> Column:
    """Aggregate: first or last timestamp of an activity in the case."""
    hit = F.when(F.col("activity").isin(list(labels)), F.col("ts"))
    return F.max(hit) if which == "last" else F.min(hit)


def date_difference(minuend: Column, subtrahend: Column, unit: str = "D", *, date_part: bool = False) -> Column:
    if date_part:
        minuend, subtrahend = (F.date_trunc("day", c).cast("timestamp_ntz") for c in (minuend, subtrahend))
    return elapsed(subtrahend, minuend, unit)


def period_attribute(ts: Column, grain: str = "month") -> Column:
    return period_label(ts, grain)


def alias_attribute(df: DataFrame, source: str, name: str) -> DataFrame:
    """A second name for a column; an existing column of that name wins."""
    return df if name in df.columns or source not in df.columns else df.withColumn(name, named(source))


def calendar_fields(cases: DataFrame, native: Sequence[str] = ()) -> DataFrame:
    """``start_month``, ``start_year`` and ``recorded_span_days``; native columns are kept."""
    span = elapsed(F.col("first_ts"), F.col("last_ts"), "D")
    fields = {
        "start_month": F.date_format("first_ts", "yyyy-MM"),
        "start_year": F.date_format("first_ts", "yyyy"),
        "recorded_span_days": F.when(span >= 0, span),
    }
    return cases.withColumns({n: c for n, c in fields.items() if n not in native})


# --------------------------------------------------------------------------- flow typing
def any_event(rules: Sequence[Mapping[str, Any]], event_columns: Sequence[str]) -> dict[str, Column]:
    """Aggregates behind attribute rules, which look at every event of the case."""
    out: dict[str, Column] = {}
    for i, item in enumerate(rules):
        rule = item["rule"]
        if rule.get("kind") == "attribute" and rule.get("field") in event_columns and ("in" in rule or "eq" in rule):
            wanted = [str(v).strip() for v in (rule["in"] if "in" in rule else [rule["eq"]])]
            hit = F.trim(named(rule["field"]).cast("string")).isin(wanted)
            out[f"__any{i}"] = F.bool_or(holds(hit))
    return out


def flow_types(
    events: DataFrame, rules: Sequence[Mapping[str, Any]], default: str, aggregates: Mapping[str, Column]
) -> DataFrame:
    """The case table with ``flow_type``: the first matching rule wins, else the default.

    A rule is ``{"name": …, "rule": …}``; the rule is a filter clause, a filter
    conjunction or an applicability rule.
    """
    extra = any_event(rules, events.columns)
    clauses = [c for r in rules for c in _clauses(r["rule"])]
    labels = [x for r in rules if "kind" not in r["rule"] and "and" not in r["rule"] for x in rule_labels(r["rule"])]
    from .norm import count_name

    extra.update({count_name(x): F.count_if(F.col("activity").isin(list(x))) for x in labels})
    cases = resolve(events, clauses, {**aggregates, **extra})
    flow = F.lit(default)
    for i, item in reversed(list(enumerate(rules))):
        rule = item["rule"]
        if f"__any{i}" in extra:
            hit = named(f"__any{i}")
        elif _clauses(rule):
            hit = F.lit(True)
            for c in _clauses(rule):
                hit = hit & case_clause(c)
        else:
            hit = applies(rule)
        flow = F.when(holds(hit), F.lit(item["name"])).otherwise(flow)
    helpers = [*extra, *needs(clauses)]
    return cases.withColumn("flow_type", flow).drop(*[h for h in helpers if h not in aggregates])


def _clauses(rule: Mapping[str, Any]) -> list[Mapping[str, Any]]:
    if "and" in rule:
        return list(rule["and"])
    return [rule] if "kind" in rule else []


def assignment_preview(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per newly assigned flow type: its cases, and the cases and events whose type would change."""
    old = before.select("case_id", F.col("flow_type").alias("__old"))
    rows = join_on(after.select("case_id", "flow_type", "n_events"), old, ["case_id"], "left")
    changed = ~F.col("flow_type").eqNullSafe(F.col("__old"))
    return rows.groupBy("flow_type").agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(changed).alias("changed_cases"),
        F.coalesce(F.sum(F.when(changed, F.col("n_events"))), F.lit(0)).alias("changed_events"),
    )


def absent_flow_types(cases: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rule names that no case carries."""
    listed = text_rows(cases.sparkSession, [(n,) for n in names], ["flow_type"])
    return join_on(listed, cases.select("flow_type").distinct(), ["flow_type"], "left_anti")


def attach(events: DataFrame, cases: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Case values copied onto every event of the case."""
    return join_on(events, cases.select("case_id", *all_named(columns)), ["case_id"], "left")


def scope_log(events: DataFrame, cases: DataFrame) -> DataFrame:
    """Events of the given cases; an empty scope is an error."""
    scoped = join_on(events, cases.select("case_id"), ["case_id"], "left_semi")
    if cases.isEmpty():
        raise ValueError("no case is in this scope")
    return scoped


def exclude_cases(events: DataFrame, dropped: DataFrame) -> DataFrame:
    """Events without the dropped cases; dropping every case is an error."""
    kept = join_on(events, dropped.select("case_id"), ["case_id"], "left_anti")
    if kept.isEmpty():
        raise ValueError("the decisions exclude every case")
    return kept


def header_replication(events: DataFrame, header_events: Sequence[str]) -> DataFrame:
    """Share of dated header events whose activity and stamp occur in more than one case."""
    rows = events.where(F.col("activity").isin(list(header_events)) & F.col("ts").isNotNull())
    per_case = rows.groupBy("activity", "ts", "case_id").agg(F.count(F.lit(1)).alias("n"))
    keys = per_case.groupBy("activity", "ts").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    n = F.sum("n")
    return keys.agg(
        F.coalesce(n, F.lit(0)).alias("header_events"),
        F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("n")).otherwise(0)) / n, F.lit(0.0)).alias("replicated_share"),
    )


def flow_type_summary(cases: DataFrame) -> DataFrame:
    """Per flow type: cases, share, events, median span in days, open and replicated shares.

    ``cases`` carries ``flow_type, n_events, first_ts, last_ts, censored, n_stamps``.
    """
    base = cases.withColumn("__days", elapsed(F.col("first_ts"), F.col("last_ts"), "D"))
    total = cases.agg(F.count(F.lit(1))).scalar()
    ratio = F.col("n_events") / F.col("n_stamps")
    out = base.groupBy("flow_type").agg(
        F.count(F.lit(1)).alias("cases"),
        F.sum("n_events").alias("events"),
        F.avg(F.col("censored").cast("double")).alias("censored_share"),
        F.avg(holds(ratio > 2.0).cast("double")).alias("replicated_share"),
    )
    out = out.withColumn("share", F.col("cases") / total)
    return join_on(out, quantiles(base, ["flow_type"], "__days", {"median_days": 0.5}), ["flow_type"], "left")


def closure_diagnostics(
    cases: DataFrame, applicable: Column, not_applicable: Column, closed: Column, recent: Column
) -> DataFrame:
    """Applicable / not applicable / unknown cases and the recent-unclosed share of measurable ones."""
    a, dated = holds(applicable), F.col("last_ts").isNotNull()
    na = holds(not_applicable) & ~a
    measurable = F.count_if(a & dated)
    flagged = F.count_if(a & dated & holds(recent))
    return cases.agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(a).alias("applicable_cases"),
        F.count_if(na).alias("not_applicable_cases"),
        F.count_if(~a & ~na).alias("unknown_cases"),
        F.count_if(a & holds(closed)).alias("closure_observed"),
        F.count_if(a & ~holds(closed)).alias("closure_not_observed"),
        F.count_if(a & ~dated).alias("undated_cases"),
        measurable.alias("measurable_cases"),
        flagged.alias("recent_unclosed"),
        F.when(measurable > 0, flagged / measurable).alias("recent_unclosed_share"),
    )


def right_censored(closure_count: Column, end: Column, window_days: float = 60.0, opened: Column | None = None) -> Column:
    """No closure activity, and last event inside the window before ``end`` or after it."""
    from_ = F.timestamp_add("MICROSECOND", F.lit(-int(window_days * MICROS["D"])), end)
    late = holds(F.col("last_ts") > from_)
    out = (closure_count == 0) & late
    return out & opened if opened is not None else out
