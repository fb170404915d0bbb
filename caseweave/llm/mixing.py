"""Mixing sources to target weights by entropy balancing, in DataFrame expressions only.

A document is taken at a rate between 0 and ``most``.  Of all rates that give each source its
target of words, the ones closest to 1 in relative entropy are ``min(most, exp(l * z))``, where
``z`` is the document's size by the mean of its source and ``l`` is the source's multiplier: the
solution of a convex dual, found by Newton steps inside a bracket.  A rate depends on source and
size only, so the steps run over counted sizes and never read the documents again.

Rates become copies by systematic rounding: along the sizes of a source, a document gets a copy
for each whole number that the running sum of rates passes.  The sums that steer the steps and the
rounding are integers or decimals, so the order in which rows arrive cannot change the result.
What whole copies leave open (less than a few large documents) is taken as part of a copy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import part_offsets, store

WORD = r"[^\x20\x09-\x0D]+"
# Rates are multiples of 2 ** -UNIT_BITS.
UNIT_BITS = 24
STEPS = 60
# Documents with the same source and size are numbered in this many groups.
GROUPS = 256
# Documents of a source that may take part of a copy.
PARTLY = 64


def sizes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size, h``: words of each text (NULL: 0) and a hash of the row that orders equal sizes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col).cast("long"), text).alias("h"),
    )


def numbered(sources: DataFrame) -> DataFrame:
    """Add ``number``: the place of the source by code points from 0 on, the missing one last.

    Sources are dealt by ranges and numbered in them; the sizes of the ranges give the offsets.
    """
    order = F.col("source").asc_nulls_last()
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = store(sources.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return ranged.withColumn("place", place).join(part_offsets(ranged, F.lit(1)), "part").withColumn("number", F.col("part_start") + F.col("place")).drop("part", "part_start", "place")


def with_targets(sources: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """Add ``target``: ``share`` of all words dealt by weight, none above ``most`` times its source's words.

    What a source cannot take is dealt again among the others, until none is above.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    rows = store(sources.withColumn("weight", F.element_at(cycle, (F.col("number") % len(weights)).cast("int") + 1)))
    room, level, full = F.col("source_size") * most, None, -1
    while True:
        above = F.lit(False) if level is None else room < F.col("weight") * level
        sums = rows.agg(F.sum("source_size").alias("words"), F.sum(F.when(~above, F.col("weight"))).alias("weight"), F.sum(F.when(above, room)).alias("dealt"), F.count_if(above).alias("full")).first()
        if not sums["words"] or not sums["weight"] or sums["full"] == full:
            break
        level, full = (share * sums["words"] - (sums["dealt"] or 0)) / sums["weight"], sums["full"]
    dealt = F.lit(0.0) if level is None else F.least(room.cast("double"), F.col("weight") * F.lit(float(level)))
    return rows.withColumn("target", dealt)


def _rate(most: int) -> Column:
    """The rate in units; no exponent is larger than the cap needs."""
    exponent = F.greatest(F.least(F.col("multiplier") * F.col("z"), F.lit(float(most))), F.lit(-700.0))
    tilted = F.least(F.exp(exponent), F.lit(float(most)))
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("target") >= F.col("source_size") * most, float(most)).otherwise(tilted)
    return F.round(rate * (1 << UNIT_BITS)).cast("long")


def balanced(counted: DataFrame, sources: DataFrame, most: int, *, steps: int = STEPS) -> DataFrame:
    """``counted`` (``number, size, n``) with ``rate`` in units, by Newton steps on all sources at once.

    A step that leaves the bracket is replaced by halving it, or by doubling where one side is still open.
    """
    ratio = F.greatest(F.least(F.col("target") / F.col("source_size"), F.lit(float(most))), F.lit(1e-9))
    start = F.when(F.col("source_size") > 0, F.log(ratio)).otherwise(0.0)
    ends = F.lit(None).cast("double")
    state = sources.select("number", "source_size", "target", (F.col("source_size") / F.col("filled")).alias("mean"), start.alias("multiplier"), ends.alias("low"), ends.alias("high"), F.lit(False).alias("done"))
    state = store(state)
    for _ in range(steps):
        rows = counted.join(state, "number").withColumn("z", F.coalesce(F.col("size") / F.col("mean"), F.lit(0.0)))
        rows = rows.withColumn("rate", _rate(most))
        words = (F.col("n") * F.col("size")).cast("decimal(20,0)")
        slope = F.when(F.col("rate") < most << UNIT_BITS, F.col("n") * F.col("size") * F.col("z") * F.col("rate") / (1 << UNIT_BITS)).otherwise(0.0)
        sums = rows.groupBy("number").agg(F.sum(words * F.col("rate").cast("decimal(10,0)")).cast("double").alias("units"), F.sum(slope.cast("decimal(38,6)")).cast("double").alias("slope"))
        gap = F.col("units") / (1 << UNIT_BITS) - F.col("target")
        low = F.when(F.col("gap") < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(F.col("gap") > 0, F.col("multiplier")).otherwise(F.col("high"))
        newton = F.when(F.col("slope") > 0, F.col("multiplier") - F.col("gap") / F.col("slope"))
        inside = newton.isNotNull() & (F.col("lo").isNull() | (newton > F.col("lo"))) & (F.col("hi").isNull() | (newton < F.col("hi")))
        wide = F.when(F.col("lo").isNull(), 2 * F.col("multiplier") - 1).when(F.col("hi").isNull(), 2 * F.abs("multiplier") + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        after = F.when(inside, newton).otherwise(wide)
        fixed = (F.col("target") <= 0) | (F.col("target") >= F.col("source_size") * most)
        met = state.join(sums, "number").withColumn("gap", gap).withColumn("lo", low).withColumn("hi", high)
        end = F.col("done") | fixed | (F.abs("gap") <= F.greatest(F.lit(0.25), F.col("target") * 1e-9)) | (F.col("hi") - F.col("lo") < 1e-12)
        met = met.withColumn("end", F.coalesce(end, F.lit(False)))
        state = store(met.select("number", "source_size", "target", "mean", F.when(F.col("end"), F.col("multiplier")).otherwise(after).alias("multiplier"), F.col("lo").alias("low"), F.col("hi").alias("high"), F.col("end").alias("done")))
        if state.where(~F.col("done")).isEmpty():
            break
    final = counted.join(state, "number").withColumn("z", F.coalesce(F.col("size") / F.col("mean"), F.lit(0.0)))
    return final.select("number", "size", "n", _rate(most).alias("rate"))


def mix(
    docs: DataFrame, *, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies``: one row per row of ``docs``.

    ``taken`` is ``copies`` times the size and, for a few documents of a source, part of a copy more
    or less; it is never above ``most`` times the size.  A missing source is a source of its own, the
    last one; a missing text has no words; repeated rows are documents of their own, and which of two
    equal rows is taken more often makes no difference.  A table without words takes none.
    """
    light = store(sizes(docs, id_col=id_col, text_col=text_col, source_col=source_col).withColumn("g", F.pmod("h", F.lit(GROUPS)).cast("int")))
    groups = store(light.groupBy("source", "size", "g").agg(F.count(F.lit(1)).alias("in_g")))
    counted = groups.groupBy("source", "size").agg(F.sum("in_g").alias("n"))
    filled = F.coalesce(F.sum(F.when(F.col("size") > 0, F.col("n"))), F.lit(0))
    sources = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), filled.alias("filled"))
    sources = sources.withColumn("filled", F.nullif("filled", F.lit(0)))
    sources = store(with_targets(numbered(sources), weights, share, most))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    by_number = store(counted.join(sources, same(counted, sources)).select("number", "size", "n"))
    rated = balanced(by_number, sources, most)

    # The running sum of rates up to each size, and the documents of a size up to each of its groups.
    earlier = Window.partitionBy("number").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rated = rated.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(earlier), F.lit(0)))
    rated = rated.join(sources.select("number", F.col("source").alias("of"), "source_size", "target"), "number").withColumnRenamed("size", "of_size")
    up_to = Window.partitionBy("source", "size").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("skip", F.coalesce(F.sum("in_g").over(up_to), F.lit(0)))
    placed = placed.join(rated, placed["source"].eqNullSafe(rated["of"]) & (placed["size"] == rated["of_size"]))
    placed = placed.select(F.col("source").alias("of"), F.col("size").alias("of_size"), F.col("g").alias("of_g"), "number", "source_size", "target", "rate", (F.col("before") + F.col("skip") * F.col("rate")).alias("before"))
    in_group = Window.partitionBy("source", "size", "g").orderBy("h", F.col("doc_id").asc_nulls_first())
    rows = light.withColumn("k", F.row_number().over(in_group))
    rows = rows.join(placed, rows["source"].eqNullSafe(placed["of"]) & (rows["size"] == placed["of_size"]) & (rows["g"] == placed["of_g"]))
    passed = lambda k: F.shiftright(F.col("before") + k * F.col("rate") + (1 << (UNIT_BITS - 1)), UNIT_BITS)
    copies = (passed(F.col("k")) - passed(F.col("k") - 1)).cast("int")
    return _completed(store(rows.select("doc_id", "size", "source_size", "target", copies.alias("copies"), "number", "g", "k")), most)


def _completed(rows: DataFrame, most: int) -> DataFrame:
    """Take the words that whole copies leave open from, or give them to, a few documents of the source."""
    whole = F.col("copies") * F.col("size")
    gaps = rows.groupBy("number").agg((F.round(F.max("target")).cast("long") - F.sum(whole)).alias("gap"))
    # The few largest of either side are found in one pass, before it is known which side is needed.
    side = lambda sign, room: F.struct(F.lit(sign).alias("sign"), room.alias("room"))
    sides = rows.select("number", "size", "g", "k", F.inline(F.array(side(1, F.col("size") * most - whole), side(-1, whole)))).where("room > 0")
    largest = Window.partitionBy("number", "sign").orderBy(F.desc("room"), F.desc("size"), "g", "k")
    few = sides.withColumn("place", F.row_number().over(largest)).where(F.col("place") <= PARTLY).join(gaps, "number").where(F.col("sign") * F.col("gap") > 0)
    before = Window.partitionBy("number", "sign").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.abs("gap") - F.coalesce(F.sum("room").over(before), F.lit(0))
    parts = store(few.select("number", "size", "g", "k", (F.least("room", left) * F.col("sign")).alias("part"), left.alias("left")).where("left > 0").drop("left"))
    taken = whole + F.coalesce(F.col("part"), F.lit(0))
    return rows.join(parts, ["number", "size", "g", "k"], "left").select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "copies")
