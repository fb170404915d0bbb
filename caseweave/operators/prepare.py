"""Mapping a raw table to a typed event log, and event-level cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import all_named, holds, named, quoted
from ..functions.ordered import sort_key
from .cases import flow_types

# Placeholder dates that systems write for "no date".
PLACEHOLDER_DATES = ("1900-01-01", "1900-12-31", "1970-01-01", "1999-12-31", "2099-12-31", "9999-12-31")


@dataclass(frozen=True)
class Mapped:
    """Which raw column plays which role."""

    case_id: str
    activity: str
    timestamp: str
    timestamp_format: str | None = None
    lifecycle: str | None = None
    keep_transitions: Sequence[str] = ("complete",)
    order: str | None = None
    event_id: str | None = None
    exposure: str | None = None
    exposure_abs: bool = True
    attributes: Sequence[str] = field(default_factory=tuple)
    missing_label: str | None = "(missing)"
    day_first: bool = False


def check_mapping(raw: DataFrame, mapping: Mapped) -> DataFrame:
    """Fail on missing columns; report rows, parsed timestamps, cases and activities of the whole log."""
    roles = [mapping.case_id, mapping.activity, mapping.timestamp, mapping.lifecycle, mapping.order]
    wanted = [c for c in [*roles, mapping.exposure, *mapping.attributes] if c]
    absent = sorted(set(wanted) - set(raw.columns))
    if absent:
        raise ValueError(f"columns not in the log: {absent}")
    parsed = parse_timestamp(F.col(mapping.timestamp), raw, mapping)
    return raw.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(named(parsed)).alias("n_parsed"),
        F.count_distinct(mapping.case_id).alias("n_cases"),
        F.count_distinct(mapping.activity).alias("n_activities"),
    )


def mapped_flow_types(raw: DataFrame, mapping: Mapped, rules: Sequence[Mapping[str, Any]], default: str) -> DataFrame:
    """``flow_type, cases, events`` of the log as mapped; types without a case are not listed.

    Fails on missing columns, and if a log with rows has no timestamp that parses.  That check ends at the first
    stamp it finds.
    """
    check_mapping(raw, mapping)
    stamps = raw.select(parse_timestamp(F.col(mapping.timestamp), raw, mapping).alias("ts"))
    if stamps.where(F.col("ts").isNotNull()).isEmpty() and not raw.isEmpty():
        raise ValueError(f"no timestamp of {mapping.timestamp!r} parses with format {mapping.timestamp_format!r}")
    cases = flow_types(typed_log(raw, mapping), rules, default, {"n_events": F.count(F.lit(1))})
    return cases.groupBy("flow_type").agg(F.count(F.lit(1)).alias("cases"), F.sum("n_events").alias("events"))


def parse_timestamp(col: Column, raw: DataFrame, mapping: Mapped) -> Column:
    """Wall-clock time of a column; texts that do not parse are NULL."""
    if dict(raw.dtypes)[mapping.timestamp].startswith("timestamp"):
        return col
    if mapping.timestamp_format:
        return F.try_to_timestamp(col, F.lit(mapping.timestamp_format)).cast("timestamp_ntz")
    if mapping.day_first:
        col = F.regexp_replace(col, r"^\s*(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})(.*)$", "$3-$2-$1$4")
    # A text with a zone becomes UTC; one without keeps its wall clock.
    zoned = col.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})\s*$") & col.rlike(r":")
    utc = F.convert_timezone(None, F.lit("UTC"), col.try_cast("timestamp").cast("timestamp_ntz"))
    return F.when(zoned, utc).otherwise(col.try_cast("timestamp_ntz"))


def fill_missing(df: DataFrame, attributes: Sequence[str], label: str) -> DataFrame:
    """NULL text attributes become the label so that groupings keep a key."""
    text = {n for n, t in df.dtypes if t == "string"}
    return df.withColumns({a: F.coalesce(named(a), F.lit(label)) for a in attributes if a in text})


def normalise_exposure(df: DataFrame, column: str) -> DataFrame:
    """Absolute number; text that is no number becomes NULL."""
    return df.withColumn(column, F.abs(F.expr(f"try_cast({quoted(column)} as double)")))


def typed_log(raw: DataFrame, mapping: Mapped) -> DataFrame:
    """The canonical log of a raw table: roles renamed, timestamps parsed, transitions filtered.

    Rows without a case id belong to no case and are left out.
    """
    df = raw.where(F.col(mapping.case_id).isNotNull())
    if mapping.lifecycle:
        kept = [t.lower() for t in mapping.keep_transitions]
        df = df.where(holds(F.lower(F.col(mapping.lifecycle)).isin(kept)))
    if mapping.exposure and mapping.exposure_abs:
        df = normalise_exposure(df, mapping.exposure)
    if mapping.missing_label:
        df = fill_missing(df, mapping.attributes, mapping.missing_label)
    roles = {mapping.case_id: "case_id", mapping.activity: "activity"}
    cols = [named(c).alias(n) for c, n in roles.items()]
    cols.append(parse_timestamp(F.col(mapping.timestamp), raw, mapping).alias("ts"))
    if mapping.order:
        cols.append(F.col(mapping.order).alias("ord"))
    cols.append(F.col(mapping.event_id or "seq").alias("seq"))
    taken = {*roles, mapping.timestamp, mapping.order, mapping.event_id, "seq"}
    cols += [named(c) for c in df.columns if c not in taken]
    return df.select(*all_named(cols))


# --------------------------------------------------------------------------- cleaning
def drop_exact_duplicates(events: DataFrame, keep: str = "seq") -> DataFrame:
    """One row per set of events equal in every column but ``seq``; the earliest ``seq`` stays.

    A grouped minimum, so that a row copied very often is reduced before the shuffle.
    """
    cols = [c for c in events.columns if c != keep]
    return events.groupBy(*all_named(cols)).agg(F.min(named(keep)).alias(keep)).select(*all_named(events.columns))


def drop_key_duplicates(events: DataFrame) -> DataFrame:
    """One event per case, activity and timestamp: the first in event order."""
    key = ["case_id", "activity", "ts"]
    rest = [c for c in events.columns if c not in key]
    first = F.min_by(F.struct(*rest), sort_key(events)).alias("__first")
    return events.groupBy(*key).agg(first).select(*key, "__first.*").select(*all_named(events.columns))


def outside_window(start: Column, end: Column) -> Column:
    """Events before ``start`` or after ``end``; undated events are never outside."""
    return holds(F.col("ts") < start) | holds(F.col("ts") > end)


def drop_outside_window(events: DataFrame, start: Column, end: Column) -> DataFrame:
    return events.where(~outside_window(start, end))


def placeholder(stamps: Sequence[str], activities: Sequence[str] = ()) -> Column:
    """Events that carry one of the listed stamps (of the listed activities only, when given)."""
    hit = F.col("ts").isin([F.lit(s).cast("timestamp_ntz") for s in stamps])
    return holds(hit & F.col("activity").isin(list(activities)) if activities else hit)


def placeholder_as_missing(events: DataFrame, stamps: Sequence[str], activities: Sequence[str] = ()) -> DataFrame:
    return events.withColumn("ts", F.when(~placeholder(stamps, activities), F.col("ts")))


def exact_duplicate_counts(events: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per distinct row: how many copies beyond the first (``extra``)."""
    return events.groupBy(*all_named(columns)).agg((F.count(F.lit(1)) - 1).alias("extra"))


def decision_preview(
    events: DataFrame,
    cases: DataFrame,
    masks: Mapping[str, Column],
    case_masks: Mapping[str, Column],
) -> DataFrame:
    """Cases and events each decision would touch, and cases that would lose every event.

    ``masks`` are event conditions, ``case_masks`` conditions on the case table
    (which must carry ``n_events``).  All event decisions share one pass.
    """
    hits = [F.count_if(m).alias(f"h{i}") for i, m in enumerate(masks.values())]
    per_case = events.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), *hits)
    aggs, rows = [], []
    for i, kind in enumerate(masks):
        aggs += [
            F.count_if(named(f"h{i}") > 0).alias(f"c{i}"),
            F.sum(named(f"h{i}")).alias(f"e{i}"),
            F.count_if((named(f"h{i}") > 0) & (named(f"h{i}") == F.col("n"))).alias(f"d{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(kind).alias("decision"),
                named(f"c{i}").alias("cases"),
                named(f"e{i}").alias("events"),
                named(f"d{i}").alias("cases_emptied"),
            )
        )
    out = per_case.agg(*aggs).select(F.inline(F.array(*rows)))
    if case_masks:
        aggs, rows = [], []
        for i, (kind, m) in enumerate(case_masks.items()):
            aggs += [
                F.count_if(holds(m)).alias(f"c{i}"),
                F.coalesce(F.sum(F.when(holds(m), F.col("n_events"))), F.lit(0)).alias(f"e{i}"),
            ]
            rows.append(
                F.struct(
                    F.lit(kind).alias("decision"),
                    named(f"c{i}").alias("cases"),
                    named(f"e{i}").alias("events"),
                    named(f"c{i}").alias("cases_emptied"),
                )
            )
        out = out.unionByName(cases.agg(*aggs).select(F.inline(F.array(*rows))))
    return out


def duplicate_preview(events: DataFrame) -> DataFrame:
    """Repeated rows over every column but ``seq``: cases and events touched, and key collisions."""
    cols = [c for c in events.columns if c != "seq"]
    copies = events.groupBy(*all_named(cols)).agg((F.count(F.lit(1)) - 1).alias("x"))
    exact = copies.groupBy("case_id").agg(F.sum("x").alias("x"))
    keys = events.groupBy("case_id", "activity", "ts").agg((F.count(F.lit(1)) - 1).alias("x"))
    return exact.agg(
        F.lit("collapse_duplicates").alias("decision"),
        F.count_if(F.col("x") > 0).alias("cases"),
        F.sum("x").alias("events"),
    ).withColumn("key_collisions", keys.agg(F.sum("x")).scalar())
