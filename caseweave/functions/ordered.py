"""Exact order statistics that never pass one whole group through one task.

A quantile, a rank or a running sum needs the sorted order of a group, and a
group may hold most of the data.  Rows are counted first; up to ``SORTED_AT_ONCE``
one sort does.  Beyond it they are dealt by ranges of the full order, which Spark
cuts by sampling the rows themselves, so ranges are even whatever the values are.
Each range is summed on its own, and one row per range carries the earlier sums on.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import store
from .exprs import all_named, join_on, named

# Rows that a single task may sort; also the size that ranges are cut to.
SORTED_AT_ONCE = 1_000_000
PART = "__part"


def ranged(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> tuple[DataFrame, bool]:
    """Add the number of the range of ``(keys, order)`` that a row lies in; the second result tells whether there are several.

    ``rows`` must be stored, since they are counted first.  Rows that are equal in all of ``order`` stay together.
    """
    n = rows.count()
    if n <= SORTED_AT_ONCE:
        return rows.withColumn(PART, F.lit(0)), False
    dealt = rows.repartitionByRange(-(-n // SORTED_AT_ONCE), *[c.asc_nulls_first() for c in all_named(keys)], *order)
    return store(dealt.withColumn(PART, F.spark_partition_id())), True


def _candidates(df: DataFrame, keys: list[str], value: str, probs: Sequence[float], times: bool, weight: str | None = None) -> DataFrame:
    """The few distinct values that can hold a wanted rank, with the ranks ``[__from, __to)`` they cover.

    Equal values are counted map-side.  The totals of the ranges then tell which range holds each
    wanted rank, and only the rows of those ranges are sorted.
    """
    v = named(value)
    clean = df.where(v.isNotNull()) if times else df.where(v.isNotNull() & ~F.isnan(v.cast("double")))
    hist = store(clean.groupBy(*all_named(keys), v.alias("__v")).agg((F.sum(named(weight)) if weight else F.count(F.lit(1))).alias("__n")))
    rows, cut = ranged(hist, keys, [F.col("__v").asc()])
    in_key = Window.partitionBy(*all_named(keys))
    if not cut:
        upto = in_key.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({"__to": F.sum("__n").over(upto), "__total": F.sum("__n").over(in_key)})
        return rows.withColumn("__from", F.col("__to") - F.col("__n"))
    totals = rows.groupBy(*all_named(keys), PART).agg(F.sum("__n").alias("__bn"))
    before = F.sum("__bn").over(in_key.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.withColumn("__before", F.coalesce(before, F.lit(0))).withColumn("__total", F.sum("__bn").over(in_key))
    low, end = F.col("__before"), F.col("__before") + F.col("__bn")
    holds_rank = F.exists(
        F.array(*[F.lit(float(p)) for p in probs]),
        lambda p: ((low <= _rank(p, False)) & (_rank(p, False) < end)) | ((low <= _rank(p, True)) & (_rank(p, True) < end)),
    )
    needed = totals.where(holds_rank).select(*all_named(keys), PART, "__before", "__total")
    rows = join_on(rows, needed, [*keys, PART])
    run = Window.partitionBy(*all_named(keys), PART).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__to", F.col("__before") + F.sum("__n").over(run))
    return rows.withColumn("__from", F.col("__to") - F.col("__n"))


def _rank(p: Column, up: bool) -> Column:
    pos = p * (F.col("__total") - 1)
    return (F.ceil(pos) if up else F.floor(pos)).cast("bigint")


def _covers(p: Column, up: bool) -> Column:
    r = _rank(p, up)
    return (F.col("__from") <= r) & (r < F.col("__to"))


def _between(lo: Column, hi: Column, p: Column) -> Column:
    """Linear interpolation between the two values around the wanted position."""
    pos = p * (F.col("__total") - 1)
    step = (hi.cast("double") - lo.cast("double")) * (pos - F.floor(pos))
    return F.when(lo == hi, lo.cast("double")).when(pos == F.floor(pos), lo.cast("double")).otherwise(lo.cast("double") + step)


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], *, times: bool = False, weight: str | None = None
) -> DataFrame:
    """Exact linearly interpolated quantiles per key: one column per entry of ``probs``.

    NULL and NaN values are left out; groups without values have no row.  ``weight`` names a column
    that tells how often a value of counted rows occurs.
    """
    keys = list(keys)
    rows = _candidates(df, keys, value, list(probs.values()), times, weight)
    aggs = []
    for i, p in enumerate(probs.values()):
        for up in (False, True):
            aggs.append(F.max(F.when(_covers(F.lit(p), up), F.col("__v"))).alias(f"__{i}{int(up)}"))
    picked = rows.groupBy(*all_named(keys)).agg(F.max("__total").alias("__total"), *aggs)
    out = [_between(named(f"__{i}0"), named(f"__{i}1"), F.lit(p)).alias(n) for i, (n, p) in enumerate(probs.items())]
    return picked.select(*all_named(keys), *out)


def quantile_rows(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """The same for many probabilities, as rows ``f, x``."""
    keys = list(keys)
    rows = _candidates(df, keys, value, probs, False)
    hit = F.filter(F.array(*[F.lit(float(p)) for p in probs]), lambda p: _covers(p, False) | _covers(p, True))
    rows = rows.withColumn("f", F.explode(hit))
    found = rows.groupBy(*all_named(keys), "f").agg(
        F.max("__total").alias("__total"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")
    )
    return found.select(*all_named(keys), "f", _between(F.col("__lo"), F.col("__hi"), F.col("f")).alias("x"))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, Column], *, rank: str | None = None) -> DataFrame:
    """Running sums (and a row number) in ``order`` within ``keys``; ``df`` must be stored.

    ``order`` should tell all rows of a key apart, so that any number of ties can be cut into ranges.
    """
    keys, cols = list(keys), dict(sums)
    if rank:
        cols[rank] = F.lit(1)
    rows, cut = ranged(df, keys, order)
    within = Window.partitionBy(*all_named(keys), PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({n: F.sum(c).over(within) for n, c in cols.items()})
    if cut:
        totals = rows.groupBy(*all_named(keys), PART).agg(*[F.sum(c).alias(f"__s_{n}") for n, c in cols.items()])
        earlier = Window.partitionBy(*all_named(keys)).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(*all_named(keys), PART, *[F.coalesce(F.sum(named(f"__s_{n}")).over(earlier), F.lit(0)).alias(f"__o_{n}") for n in cols])
        out = join_on(out, offsets, [*keys, PART])
        out = out.withColumns({n: named(n) + named(f"__o_{n}") for n in cols}).drop(*[f"__o_{n}" for n in cols])
    return out.drop(PART)


def rank_rows(
    df: DataFrame, order: Sequence[Column], *, name: str = "rank", sums: dict[str, Column] | None = None, keys: Sequence[str] = (), stored: bool = False
) -> DataFrame:
    """Global 1-based rank of a grouped table in ``order``; the table is stored first because it is read twice."""
    return running(df if stored else store(df), keys, order, sums or {}, rank=name)


# --------------------------------------------------------------------------- event order
def log_order(df: DataFrame, *, descending: bool = False) -> list[Column]:
    """The one event order: timestamp (missing last), mapped order column, ``seq``."""
    cols = ["ts"] + (["ord"] if "ord" in df.columns else []) + ["seq"]
    if descending:
        return [F.desc_nulls_first(named(c)) if c == "ts" else F.desc_nulls_last(named(c)) for c in cols]
    return [F.asc_nulls_last(named(c)) if c == "ts" else F.asc_nulls_first(named(c)) for c in cols]


def sort_key(df: DataFrame) -> Column:
    """The event order as one comparable value, for ``min_by`` and ``max_by``."""
    parts = [F.col("ts").isNull().alias("u"), F.col("ts").alias("t")]
    if "ord" in df.columns:
        parts.append(F.col("ord").alias("o"))
    return F.struct(*parts, F.col("seq").alias("s"))


CHUNK = "__chunk"
# Rows of long cases that a range holds at least, however short the pieces it is cut into.
ROWS_PER_RANGE = 200_000


def chunked(
    events: DataFrame, hot_events: int = 1_000_000, sizes: DataFrame | None = None
) -> tuple[DataFrame, bool]:
    """Add a chunk number so that no (case, chunk) holds more than ``hot_events`` rows.

    Ordinary cases keep chunk 0.  Cases above the limit are range-partitioned on
    the full event order, which Spark balances by sampling, and sorted; every
    ``hot_events`` rows of a range are a chunk.  The number of ranges follows the rows, not
    the limit.  That part is stored, so the numbers cannot change on a retry.
    The second result tells whether any case was cut.  ``sizes`` may bring the known
    ``case_id, n_events`` of a case table, which saves counting.
    """
    if sizes is None:
        if events.count() <= hot_events:
            return events.withColumn(CHUNK, F.lit(0).cast("bigint")), False
        sizes = events.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_events"))
    hot = sizes.select("case_id", F.col("n_events").alias("__n")).where(F.col("__n") > hot_events)
    found = hot.agg(F.count(F.lit(1)).alias("k"), F.sum("__n").alias("n")).first()
    if not found["k"]:
        return events.withColumn(CHUNK, F.lit(0).cast("bigint")), False
    hot = store(hot.select("case_id"))
    cold = join_on(events, hot, ["case_id"], "left_anti").withColumn(CHUNK, F.lit(0).cast("bigint"))
    rows = join_on(events, hot, ["case_id"], "left_semi")
    parts = max(2, -(-int(found["n"]) // max(hot_events, ROWS_PER_RANGE)))
    order = [F.col("case_id").asc_nulls_first(), *log_order(events)]
    # The id counts the sorted rows of a range in its lower 33 bits and names the range above them.
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(CHUNK, F.monotonically_increasing_id())
    first = F.shiftleft(F.shiftright(F.col(CHUNK), 33), 33)
    piece = (first + F.floor((F.col(CHUNK) - first) / F.lit(hot_events))).cast("bigint")
    return cold.unionByName(store(placed.withColumn(CHUNK, piece))), True


def with_next(
    events: DataFrame, columns: Sequence[str] = ("activity", "ts"), *, hot_events: int = 1_000_000
) -> DataFrame:
    """Add ``pos`` (0-based), ``nxt_<column>``, ``has_next`` and ``is_first`` in event order per case."""
    data, cut = chunked(events, hot_events)
    w = Window.partitionBy("case_id", *([CHUNK] if cut else [])).orderBy(*log_order(events))
    data = data.withColumn("pos", (F.row_number().over(w) - 1).cast("bigint")).withColumn(
        "__nxt", F.lead(F.struct(*all_named(columns))).over(w)
    )
    if cut:
        firsts = data.groupBy("case_id", CHUNK).agg(
            F.count(F.lit(1)).alias("__c"), F.min_by(F.struct(*all_named(columns)), F.col("pos")).alias("__first")
        )
        per_case = Window.partitionBy("case_id").orderBy(CHUNK)
        earlier = F.sum("__c").over(per_case.rowsBetween(Window.unboundedPreceding, -1))
        firsts = firsts.select(
            "case_id",
            CHUNK,
            F.coalesce(earlier, F.lit(0)).alias("__off"),
            F.lead("__first").over(per_case).alias("__carry"),
        )
        data = join_on(data, firsts, ["case_id", CHUNK])
        data = data.withColumn("pos", F.col("pos") + F.col("__off"))
        data = data.withColumn("__nxt", F.coalesce("__nxt", "__carry")).drop("__off", "__carry")
    out = {f"nxt_{c}": F.col("__nxt").getField(c) for c in columns}
    out["has_next"] = F.col("__nxt").isNotNull()
    out["is_first"] = F.col("pos") == 0
    return data.withColumns(out).drop("__nxt", CHUNK)


def next_times(
    events: DataFrame, wanted: Mapping[str, Column], *, hot_events: int = 1_000_000, sizes: DataFrame | None = None
) -> DataFrame:
    """For each entry of ``wanted``, add the timestamp of the first such event of the case at or after each event's own.

    All entries are answered by one pass over the sorted events of a case.
    """
    data, cut = chunked(events, hot_events, sizes)
    names = list(wanted)
    data = data.withColumns({f"__t{i}": F.when(wanted[n], F.col("ts")) for i, n in enumerate(names)})
    later = (
        Window.partitionBy("case_id", *([CHUNK] if cut else []))
        .orderBy(F.col("ts").asc_nulls_last())
        .rangeBetween(Window.currentRow, Window.unboundedFollowing)
    )
    data = data.withColumns({n: F.min(f"__t{i}").over(later) for i, n in enumerate(names)})
    if cut:
        ends = [c for i in range(len(names)) for c in (F.min(f"__t{i}").alias(f"__lo{i}"), F.max(f"__t{i}").alias(f"__hi{i}"))]
        per_case = Window.partitionBy("case_id").orderBy(CHUNK)
        after, before = per_case.rowsBetween(1, Window.unboundedFollowing), per_case.rowsBetween(Window.unboundedPreceding, -1)
        sides = data.groupBy("case_id", CHUNK).agg(*ends)
        sides = sides.select(
            "case_id",
            CHUNK,
            *[F.min(f"__lo{i}").over(after).alias(f"__after{i}") for i in range(len(names))],
            *[F.max(f"__hi{i}").over(before).alias(f"__before{i}") for i in range(len(names))],
        )
        data = join_on(data, sides, ["case_id", CHUNK])
        for i, n in enumerate(names):
            tied = F.when(F.col(f"__before{i}") == F.col("ts"), F.col("ts"))
            data = data.withColumn(n, F.least(named(n), F.col(f"__after{i}"), tied)).drop(f"__after{i}", f"__before{i}")
    dated = {n: F.when(F.col("ts").isNotNull(), named(n)) for n in names}
    return data.withColumns(dated).drop(CHUNK, *[f"__t{i}" for i in range(len(names))])


def next_time(
    events: DataFrame, wanted: Column, name: str, *, hot_events: int = 1_000_000, sizes: DataFrame | None = None
) -> DataFrame:
    """Add the timestamp of the first ``wanted`` event of the case at or after each event's own timestamp."""
    return next_times(events, {name: wanted}, hot_events=hot_events, sizes=sizes)
