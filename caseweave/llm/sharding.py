"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame expressions only.

The ring has ``cells`` equal cells.  Every shard owns ``vnodes`` points on it; a document lies in
the cell of its hashed id and belongs to the next point clockwise.  Shards have a capacity: a
document that finds its shard full goes on clockwise to the next shard with room.  Within an arc
the documents with the smallest hashes stay first, and all home documents are placed before any
overflow.

Law ``rows``: the capacities sum to the number of documents, so counts differ by at most one
(shards with the smaller numbers hold one more).  Which document is moved depends only on how many
lie on each arc, so the allocation works on ``shards * vnodes`` totals; documents meet it by cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import plain, store

VNODES = 64
CELL_BITS = 14


def _cell(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits).cast("int")


def ring(spark, shards: int, vnodes: int, bits: int) -> DataFrame:
    """``arc, shard, nexts, cells``: the points in ring order, the shards clockwise from each, the cells before it.

    One row per virtual node, whatever the data.
    """
    points = spark.range(shards * vnodes, numPartitions=1).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("copy"))
    # A point depends on its shard and copy only, so more shards add points and move none.
    points = points.withColumn("h", F.xxhash64("shard", "copy", F.lit("virtual node")))
    placed = F.sort_array(F.collect_list(F.struct(_cell(F.col("h"), bits).alias("cell"), "h", "shard")))
    listed = points.agg(placed.alias("ring")).select("ring", F.posexplode("ring").alias("arc", "point"))
    turned = F.concat(F.slice("ring", F.col("arc") + 1, F.lit(shards * vnodes)), F.slice("ring", F.lit(1), F.col("arc")))
    last, here = F.element_at("ring", -1)["cell"], F.col("point.cell")
    before = F.when(F.col("arc") > 0, F.element_at("ring", F.greatest("arc", F.lit(1)))["cell"])
    from_zero = F.sequence(F.lit(0), here)
    around = F.when(last < (1 << bits) - 1, F.sequence(last + 1, F.lit((1 << bits) - 1))).otherwise(F.array().cast("array<int>"))
    between = F.when(before < here, F.sequence(before + 1, here)).otherwise(F.array().cast("array<int>"))
    return listed.select(
        "arc",
        F.col("point.shard").alias("shard"),
        F.array_distinct(F.transform(turned, lambda p: p["shard"])).alias("nexts"),
        F.when(F.col("arc") == 0, F.concat(around, from_zero)).otherwise(between).alias("cells"),
    )


def _overflow(arcs: Column, room: Column) -> Column:
    """Deal what each arc has left to the next shards with room: ``arc, shard, n`` in the order of dealing."""
    dealt = "array<struct<arc:int,shard:int,n:bigint>>"

    def per_arc(acc: Column, arc: Column) -> Column:
        def per_shard(a: Column, s: Column) -> Column:
            take = F.least(a["left"], F.element_at(a["room"], s + 1))
            after = F.transform(a["room"], lambda v, i: F.when(i == s, v - take).otherwise(v))
            more = F.concat(a["dealt"], F.array(F.struct(arc["arc"].alias("arc"), s.alias("shard"), take.alias("n"))))
            changed = F.struct(after.alias("room"), more.alias("dealt"), (a["left"] - take).alias("left"))
            return F.when(take > 0, changed.cast(inner)).otherwise(a)

        inner = f"struct<room:array<bigint>,dealt:{dealt},left:bigint>"
        start = F.struct(acc["room"].alias("room"), acc["dealt"].alias("dealt"), arc["left"].alias("left")).cast(inner)
        done = F.aggregate(arc["nexts"], start, per_shard)
        moved = F.struct(done["room"].alias("room"), done["dealt"].alias("dealt")).cast(outer)
        return F.when(arc["left"] > 0, moved).otherwise(acc)

    outer = f"struct<room:array<bigint>,dealt:{dealt}>"
    first = F.struct(room.alias("room"), F.array().cast(dealt).alias("dealt")).cast(outer)
    return F.aggregate(arcs, first, per_arc)["dealt"]


def assign(docs: DataFrame, shards: int = 16, *, vnodes: int = VNODES, bits: int = CELL_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, home_shard``: one row per row of ``docs``.

    ``home_shard`` is the owner on the ring without capacities.  A missing id is hashed by its
    text; repeated rows are placed one by one; an empty table gives no rows.
    """
    spark = docs.sparkSession
    data = F.col("text").cast("binary")
    # The ring takes no text; what it needs of the documents is written once.
    light = store(
        plain(docs, id_col, text_col).select(
            "doc_id",
            (F.octet_length("text") + 1).cast("long").alias("size"),
            F.crc32(data).cast("long").alias("text_crc32"),
            F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.xxhash64("text")).alias("h"),
        )
    ).withColumn("cell", _cell(F.col("h"), bits))

    points = ring(spark, shards, vnodes, bits)
    counts = light.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    cells = points.select("arc", F.posexplode("cells").alias("at", "cell")).join(counts, "cell")
    in_arc = Window.partitionBy("arc").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    cells = store(cells.withColumn("cell_start", F.coalesce(F.sum("n").over(in_arc), F.lit(0))))

    totals = points.drop("cells").join(cells.groupBy("arc").agg(F.sum("n").alias("n")), "arc", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    all_rows = F.sum("n").over(Window.partitionBy())
    cap = F.floor(all_rows / shards).cast("long") + F.when(F.col("shard") < all_rows % shards, 1).otherwise(0)
    totals = totals.withColumn("cap", cap)
    earlier = Window.partitionBy("shard").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    room = F.greatest(F.col("cap") - F.coalesce(F.sum("n").over(earlier), F.lit(0)), F.lit(0))
    home = store(totals.withColumn("home", F.least("n", room)))

    listed = F.sort_array(F.collect_list(F.struct("arc", (F.col("n") - F.col("home")).alias("left"), "nexts", "shard", "cap", "home")))
    placed_home = lambda s: F.aggregate(F.filter("arcs", lambda x: x["shard"] == s), F.lit(0).cast("long"), lambda t, x: t + x["home"])
    full = lambda s: F.coalesce(F.filter("arcs", lambda x: x["shard"] == s)[0]["cap"], F.lit(0))
    left = home.agg(listed.alias("arcs")).withColumn("rooms", F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: full(s) - placed_home(s)))
    dealt = left.select(F.posexplode(_overflow(F.col("arcs"), F.col("rooms"))).alias("turn", "x"))
    segments = home.where("home > 0").select("arc", F.lit(-1).alias("turn"), "shard", F.col("home").alias("n")).unionByName(dealt.select("x.arc", "turn", "x.shard", "x.n"))
    before_in = lambda key: F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("turn", "arc").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    segments = segments.select("arc", "shard", "n", before_in("arc").alias("lo"), before_in("shard").alias("base"))
    per_arc = segments.groupBy("arc").agg(F.collect_list(F.struct("lo", (F.col("lo") + F.col("n")).alias("hi"), "shard", "base")).alias("segments"))
    owners = home.select("arc", F.col("shard").alias("home_shard")).join(per_arc, "arc")
    places = store(cells.select("cell", "arc", "cell_start").join(owners, "arc"))

    in_cell = Window.partitionBy("cell").orderBy("h", "doc_id", "size", "text_crc32")
    ranked = light.withColumn("rank", F.row_number().over(in_cell) - 1).join(places, "cell").withColumn("rank", F.col("rank") + F.col("cell_start"))
    mine = F.filter("segments", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"]))[0]
    return ranked.withColumn("mine", mine).select(
        "doc_id", "size", "text_crc32", F.col("mine.shard").alias("shard"), (F.col("mine.base") + F.col("rank") - F.col("mine.lo")).cast("long").alias("slot"), "home_shard"
    )
