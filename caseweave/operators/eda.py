"""Linked exploratory aggregates over the case table; no norm needed.

Everything is computed from one ``marked`` table: all cases with a ``selected``
flag, so totals never move when the selection does.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import all_named, all_of, any_of, elapsed, holds, join_on, named, ntz
from ..functions.ordered import log_order, quantiles
from .profile import category, is_numeric

# The category limit and the cuts of the two histograms.
TOP_CATEGORIES = 20
SPAN_CUTS = (0.0, 1.0, 3.0, 7.0, 14.0, 30.0, 60.0, 90.0, 180.0, 365.0)
# Words that mark a field as an identifier.
IDENTIFIER_WORDS = ("id", "uuid", "guid", "identifier", "case")
EVENT_CUTS = (0, 1, 2, 3, 5, 10, 20, 50, 100, 200, 500)
PAGE = 40


def prepared(cases: DataFrame) -> DataFrame:
    """Case id as text, events, first and last stamp, span in days (NULL when unknown or negative)."""
    span = elapsed(F.col("first_ts"), F.col("last_ts"), "D")
    return cases.withColumns(
        {
            "case_id": F.col("case_id").cast("string"),
            "events": F.col("n_events").cast("bigint"),
            "span_days": F.when(F.col("last_ts") >= F.col("first_ts"), span),
        }
    )


def field_category(df: DataFrame, field: str, missing_label: str = "(missing)") -> Column:
    return category(named(field), dict(df.dtypes)[field], missing_label)


def domain(cases: DataFrame, field: str, missing_label: str = "(missing)") -> DataFrame:
    """The most frequent categories of a field over the whole table, keyed ``v1``, ``v2``, …"""
    value = field_category(cases, field, missing_label)
    rows = cases.select(value.alias("category")).where(F.col("category").isNotNull())
    counts = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), F.asc("category")).limit(TOP_CATEGORIES)
    place = F.row_number().over(Window.orderBy(F.desc("n"), F.asc("category")))
    return top.withColumn("key", F.concat(F.lit("v"), place.cast("string")))


def with_keys(cases: DataFrame, fields: Sequence[str], missing_label: str = "(missing)") -> DataFrame:
    """Add ``key__<field>``: the domain key, ``other`` or ``missing``."""
    out = cases
    for f in fields:
        keys = domain(cases, f, missing_label).select(F.col("category").alias(f"__c_{f}"), F.col("key").alias(f"__k_{f}"))
        out = out.withColumn(f"__v_{f}", field_category(cases, f, missing_label))
        out = out.join(keys, named(f"__v_{f}") == named(f"__c_{f}"), "left")
        key = F.when(named(f"__v_{f}").isNull(), "missing").otherwise(F.coalesce(named(f"__k_{f}"), F.lit("other")))
        out = out.withColumn(f"key__{f}", key).drop(f"__v_{f}", f"__c_{f}", f"__k_{f}")
    return out


def domain_keys(cases: DataFrame, field: str) -> Column:
    """All keys of a field as one small array: at most 22 entries."""
    keys = domain(cases, field).agg(F.collect_list("key"))
    return F.concat(keys.scalar(), F.array(F.lit("other"), F.lit("missing")))


# --------------------------------------------------------------------------- predicates
def _in_range(x: Column, low: Any, high: Any) -> Column:
    """Half-open interval with optional bounds."""
    conds = [x >= low] if low is not None else []
    conds += [x < high] if high is not None else []
    return all_of(conds)


def _bound(value: Any, dtype: str) -> Column | None:
    """A numeric bound compared exactly with decimals and integers; beyond 38 digits it is an error."""
    if value is None:
        return None
    if dtype in ("double", "float"):
        return F.lit(float(value))
    try:
        d = Decimal(str(value))
    except InvalidOperation as exc:
        raise ValueError(f"{value!r} is no number") from exc
    scale = max(0, -int(d.as_tuple().exponent))
    own = re.match(r"decimal\((\d+),(\d+)\)", dtype)
    digits, places = (int(own[1]) - int(own[2]), int(own[2])) if own else (19, 0)
    if max(digits, d.adjusted() + 1) + max(places, scale) > 38:
        raise ValueError("the bound exceeds exact comparison precision")
    return F.lit(d)


def selection(df: DataFrame, request: Mapping[str, Any], missing_label: str = "(missing)") -> Column:
    """Compile an exploratory selection to a boolean that is never NULL.

    Parts (all optional, combined with AND): ``facets`` and ``joint_any`` over
    domain keys or values, ``numeric`` half-open ranges with ``missing``,
    ``event_ranges``, ``span_ranges``, ``time_ranges``, and the flags
    ``span_missing``, ``time_missing``, ``event_missing``.
    """
    types = dict(df.dtypes)

    def facet(f: Mapping[str, Any]) -> Column:
        hits = []
        if f.get("keys"):
            hits.append(named(f"key__{f['field']}").isin(list(f["keys"])))
        if f.get("values"):
            hits.append(holds(category(named(f["field"]), types[f["field"]], missing_label).isin(list(f["values"]))))
        return any_of(hits)

    parts: list[Column] = [facet(f) for f in request.get("facets", [])]
    if request.get("joint_any"):
        parts.append(any_of(all_of(facet(f) for f in branch) for branch in request["joint_any"]))
    for n in request.get("numeric", []):
        col, dtype = named(n["field"]), types[n["field"]]
        if not is_numeric(dtype):
            raise ValueError(f"{n['field']!r} is not numeric")
        known = col.isNotNull()
        if dtype in ("double", "float"):
            known = known & ~F.isnan(col) & (F.abs(col) < float("inf"))
        hits = [~known] if n.get("missing") else []
        hits += [known & _in_range(col, _bound(lo, dtype), _bound(hi, dtype)) for lo, hi in n.get("ranges", [])]
        parts.append(any_of(hits))
    for name, col, low in (("event", F.col("events"), F.lit), ("span", F.col("span_days"), F.lit), ("time", F.col("first_ts"), ntz)):
        hits = [col.isNull()] if request.get(f"{name}_missing") else []
        for lo, hi in request.get(f"{name}_ranges", []):
            hits.append(_in_range(col, None if lo is None else low(lo), None if hi is None else low(hi)))
        if hits:
            parts.append(any_of(hits))
    return holds(all_of(parts))


def mark(df: DataFrame, request: Mapping[str, Any]) -> DataFrame:
    return df.withColumn("selected", selection(df, request))


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("total"), F.count_if("selected").alias("selected")]


# --------------------------------------------------------------------------- charts
def totals(marked: DataFrame) -> DataFrame:
    """Cases and events of all and selected; known spans, median, p90 and the time range of the selection."""
    pick = F.col("selected")
    out = marked.agg(
        F.count(F.lit(1)).alias("cases_total"),
        F.count_if(pick).alias("cases_selected"),
        F.coalesce(F.sum("events"), F.lit(0)).alias("events_total"),
        F.coalesce(F.sum(F.when(pick, F.col("events"))), F.lit(0)).alias("events_selected"),
        F.count(F.when(pick, F.col("span_days"))).alias("known_spans"),
        F.count_if(pick & F.col("span_days").isNull()).alias("unknown_spans"),
        F.count_if(pick & F.col("first_ts").isNull()).alias("unknown_starts"),
        F.min(F.when(pick, F.col("first_ts"))).alias("first"),
        F.max(F.when(pick, F.col("last_ts"))).alias("last"),
    )
    q = quantiles(marked.where(pick), [], "span_days", {"m": 0.5, "p": 0.9}).select(F.struct("m", "p")).scalar()
    return out.withColumns({"median_span": q["m"], "p90_span": q["p"]})


def category_counts(marked: DataFrame, field: str) -> DataFrame:
    return marked.groupBy(named(f"key__{field}").alias("key")).agg(*_counts())


def _month(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts) - 1


def trend(marked: DataFrame, stride: int = 1) -> DataFrame:
    """Cases per start period of ``stride`` months over the whole calendar; unknown starts as their own row."""
    months = marked.where(F.col("first_ts").isNotNull()).groupBy(_month(F.col("first_ts")).alias("month")).agg(*_counts())
    unknown = marked.where(F.col("first_ts").isNull()).agg(*_counts()).where(F.col("total") > 0)
    unknown = unknown.select(F.lit(None).cast("int").alias("month"), "total", "selected")
    ends = months.agg(F.min("month").alias("a"), F.max("month").alias("b")).first()
    if ends["a"] is None:
        return unknown
    first, last = ends["a"], ends["b"]
    start = (F.floor((F.col("month") - first) / stride) * stride + first).cast("int")
    binned = months.groupBy(start.alias("month")).agg(F.sum("total").alias("total"), F.sum("selected").alias("selected"))
    every = marked.sparkSession.range(first, last + 1, stride).select(F.col("id").cast("int").alias("month"))
    return every.join(binned, "month", "left").fillna(0, ["total", "selected"]).unionByName(unknown)


def stride_for(marked: DataFrame, periods: int) -> int:
    """Months per period for at most ``periods`` periods over the calendar of all cases."""
    ends = marked.agg(F.min(_month(F.col("first_ts"))).alias("a"), F.max(_month(F.col("first_ts"))).alias("b")).first()
    return 1 if ends["a"] is None else math.ceil((ends["b"] - ends["a"] + 1) / periods)


def cut_key(col: Column, cuts: Sequence[float]) -> Column:
    """Number of the cut interval as text, ``missing`` for NULL."""
    out = F.lit(str(len(cuts) - 1))
    for i, upper in reversed(list(enumerate(cuts[1:]))):
        out = F.when(col < upper, F.lit(str(i))).otherwise(out)
    return F.when(col.isNull(), F.lit("missing")).otherwise(out)


def histogram(marked: DataFrame, column: str, cuts: Sequence[float]) -> DataFrame:
    """Counts over fixed cuts, zero bins kept; unknown values as ``missing`` when there are any."""
    counts = marked.groupBy(cut_key(named(column), cuts).alias("key")).agg(*_counts())
    every = marked.sparkSession.range(len(cuts)).select(F.col("id").cast("string").alias("key"))
    return every.join(counts, "key", "full_outer").fillna(0, ["total", "selected"])


def _grid(df: DataFrame, left: Column, right: Column, names: tuple[str, str]) -> DataFrame:
    """All pairs of two small key arrays, from a single row."""
    one = df.sparkSession.range(1)
    return one.select(F.explode(left).alias(names[0])).withColumn(names[1], F.explode(right))


def joint_counts(marked: DataFrame, left: str, right: str) -> DataFrame:
    """Cross-tab of two fields with every pair of their keys."""
    counts = marked.groupBy(named(f"key__{left}").alias("left_key"), named(f"key__{right}").alias("right_key")).agg(*_counts())
    grid = _grid(marked, domain_keys(marked, left), domain_keys(marked, right), ("left_key", "right_key"))
    return grid.join(counts, ["left_key", "right_key"], "left").fillna(0, ["total", "selected"])


def density(marked: DataFrame) -> DataFrame:
    """Span by event-count grid, zero cells kept."""
    keys = [cut_key(F.col("span_days"), SPAN_CUTS).alias("span_key"), cut_key(F.col("events"), EVENT_CUTS).alias("event_key")]
    counts = marked.groupBy(*all_named(keys)).agg(*_counts())
    sides = [F.array(*[F.lit(str(i)) for i in range(len(c))]) for c in (SPAN_CUTS, EVENT_CUTS)]
    grid = _grid(marked, *sides, ("span_key", "event_key"))
    return grid.join(counts, ["span_key", "event_key"], "full_outer").fillna(0, ["total", "selected"])


def concentration_by(marked: DataFrame, field: str) -> DataFrame:
    """Per category: cases, known and unknown spans, median and p90 span, events of the selection."""
    pick = F.col("selected")
    rows = marked.withColumn("key", named(f"key__{field}"))
    out = rows.groupBy("key").agg(
        *_counts(),
        F.count(F.when(pick, F.col("span_days"))).alias("known_spans"),
        F.count_if(pick & F.col("span_days").isNull()).alias("unknown_spans"),
        F.coalesce(F.sum(F.when(pick, F.col("events"))), F.lit(0)).alias("events"),
    )
    q = quantiles(rows.where(pick), ["key"], "span_days", {"median_span": 0.5, "p90_span": 0.9})
    return join_on(out, q, ["key"], "left")


def _names_an_identifier(name: Column) -> Column:
    """Whether a word of the name says identifier; words end at signs, digits and a change of case."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z]+", " ")
    return F.arrays_overlap(F.split(F.lower(spaced), " "), F.lit(list(IDENTIFIER_WORDS)))


def comparison_choice(cases: DataFrame, fields: Sequence[str], primary: str | None) -> DataFrame:
    """The attribute offered for comparison: the first with 2 to 20 values, identifiers last."""
    names = [f for f in fields if f != primary]
    items = [F.struct(F.lit(i).alias("i"), F.lit(f).alias("name"), field_category(cases, f).alias("v")) for i, f in enumerate(names)]
    counts = cases.select(F.inline(F.array(*items))).groupBy("i", "name").agg(F.count_distinct("v").alias("distinct"))
    identifier = _names_an_identifier(F.col("name"))
    useful = F.col("distinct").between(2, 20)
    order = [F.desc(useful & ~identifier), F.desc(named(useful)), F.asc("i")]
    return counts.orderBy(*order).limit(1).select("name", "distinct")


def value_page(marked: DataFrame, field: str, text: str, page: int = 1) -> DataFrame:
    """Distinct values that contain ``text``, most frequent first, 40 a page."""
    v = field_category(marked, field)
    rows = marked.withColumn("value", v).where(holds(F.contains(F.lower("value"), F.lit(text.lower()))))
    counts = rows.groupBy("value").agg(*_counts())
    return counts.orderBy(F.desc("total"), F.asc("value")).offset((page - 1) * PAGE).limit(PAGE)


def hierarchy(marked: DataFrame, fields: Sequence[str], *, levels: bool = False) -> DataFrame:
    """Counts per combination of the chosen fields; with ``levels`` also for every prefix of them."""
    keys = [named(f"key__{f}").alias(f) for f in fields]
    rows = marked.select("selected", *all_named(keys))
    return (rows.rollup(*all_named(fields)) if levels else rows.groupBy(*all_named(fields))).agg(*_counts())


def detail_page(marked: DataFrame, page: int = 1, size: int = 50) -> DataFrame:
    """Selected cases, newest first."""
    rows = marked.where("selected").orderBy(F.desc_nulls_last("first_ts"), F.asc("case_id"))
    return rows.offset((page - 1) * size).limit(size).select("case_id", "events", "first_ts", "last_ts", "span_days")


# --------------------------------------------------------------------------- event evidence
def activity_evidence(events: DataFrame, marked: DataFrame) -> DataFrame:
    """Per activity of all cases: occurrences, cases and rates within the selection; NULL is an activity too."""
    flags = marked.select("case_id", "selected")
    per_case = events.withColumn("case_id", F.col("case_id").cast("string")).groupBy("activity", "case_id").agg(F.count(F.lit(1)).alias("n"))
    rows = join_on(per_case, flags, ["case_id"])
    eligible = marked.agg(F.count_if("selected")).scalar()
    pick = F.col("selected")
    out = rows.groupBy("activity").agg(
        F.coalesce(F.sum(F.when(pick, F.col("n"))), F.lit(0)).alias("occurrences"),
        F.count_if(pick).alias("cases"),
        F.count_if(pick & (F.col("n") >= 2)).alias("repeated_cases"),
    )
    return out.withColumns(
        {
            "zero_cases": eligible - F.col("cases"),
            "presence_rate": F.when(eligible > 0, F.col("cases") / eligible),
            "repetition_rate": F.when(eligible > 0, F.col("repeated_cases") / eligible),
        }
    )


def endpoint_pairs(events: DataFrame, marked: DataFrame, start: str, end: str) -> DataFrame:
    """Per selected case: one of seven endpoint classes and, for pairs, the days between."""
    per_case = events.withColumn("case_id", F.col("case_id").cast("string")).where(F.col("activity").isin(start, end))
    a, b = F.col("activity") == start, F.col("activity") == end
    per_case = per_case.groupBy("case_id").agg(
        F.count_if(a).alias("na"), F.count_if(b).alias("nb"), F.min(F.when(a, F.col("ts"))).alias("ta"), F.min(F.when(b, F.col("ts"))).alias("tb")
    )
    rows = join_on(marked.where("selected").select("case_id"), per_case, ["case_id"], "left").fillna(0, ["na", "nb"])
    na, nb, ta, tb = (named(c) for c in ("na", "nb", "ta", "tb"))
    state = (
        F.when((na == 0) & (nb == 0), "neither")
        .when(nb == 0, "startOnly")
        .when(na == 0, "endOnly")
        .when((na > 1) | (nb > 1), "ambiguous")
        .when(ta.isNull() | tb.isNull(), "undatedEndpoint")
        .when(tb < ta, "reversed")
        .otherwise("paired")
    )
    return rows.select("case_id", state.alias("status"), F.when(state == "paired", elapsed(ta, tb, "D")).alias("days"))


def endpoint_summary(pairs: DataFrame) -> DataFrame:
    """Cases per class; median and p90 days on the ``paired`` row."""
    counts = pairs.groupBy("status").agg(F.count(F.lit(1)).alias("cases"))
    return join_on(counts, quantiles(pairs, ["status"], "days", {"median_days": 0.5, "p90_days": 0.9}), ["status"], "left")


def trace_page(events: DataFrame, case_id: Any, page: int = 1, size: int = 100) -> DataFrame:
    """Events of one case with position and tied stamps.

    The position counts the earlier pages, so only a page's rows are numbered.
    """
    rows = events.where(F.col("case_id") == F.lit(case_id))
    ties = rows.where(F.col("ts").isNotNull()).groupBy("ts").agg((F.count(F.lit(1)) > 1).alias("tied"))
    shown = rows.orderBy(*log_order(events)).offset((page - 1) * size).limit(size)
    place = F.row_number().over(Window.orderBy(*log_order(events))) + F.lit((page - 1) * size)
    shown = shown.withColumn("position", place)
    out = join_on(shown, ties, ["ts"], "left")
    return out.select("position", "activity", "ts", F.coalesce("tied", F.lit(False)).alias("tied"))


def evidence_totals(events: DataFrame, marked: DataFrame) -> DataFrame:
    """Recorded, unlabelled and undated events of the selected cases, and cases without events."""
    pick = marked.where("selected").select("case_id")
    rows = join_on(events.withColumn("case_id", F.col("case_id").cast("string")), pick, ["case_id"], "left_semi")
    eligible = marked.agg(F.count_if("selected")).scalar()
    return rows.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("activity").isNull()).alias("missing_activity"),
        F.count_if(F.col("ts").isNull()).alias("undated"),
        F.count_distinct("case_id").alias("with_events"),
    ).select("events", "missing_activity", "undated", (eligible - F.col("with_events")).alias("cases_without_events"))
