"""What the operators share: reading, batch sizes, global order and Arrow columns."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, store, tune

__all__ = ["documents", "in_order", "int_lists", "map_batches", "part_offsets", "parts_of", "plain", "prepared", "remainder", "shared_dir", "store", "table"]

# Whole texts travel to Python in batches of this many rows; Spark also cuts batches by bytes.
BATCH_ROWS = 256
# The sizes that the operators on texts were measured with; their blocks follow the pieces of the files.
SIZES = {
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.codegen.hugeMethodLimit": "65535",
}


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings of this package; Python workers find it where the driver does."""
    tune(spark)
    for key, value in SIZES.items():
        spark.conf.set(key, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def plain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text`` (NULL: empty), so that no other column can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (a missing id counts as the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def int_lists(rows: list[np.ndarray], kind: str = "int32") -> pa.ListArray:
    """An Arrow list column from one integer array per row."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    values = np.concatenate(rows).astype(kind, copy=False) if rows else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def parts_of(rows: DataFrame, parts: int) -> DataFrame:
    """Add ``part``: the number of the row's range in the order of ``(doc_id, tie)``.

    The ranges come from quantiles of the ids (one bounded list), so the number depends on the
    row alone.  An id that fills several ranges is cut further by its tie, in the same order.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    if parts < 2:
        return rows.withColumn("part", F.lit(0))
    found = rows.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 20 * parts).alias("q")).first()["q"] or []
    splits = F.lit([int(x) for x in found]) if found else F.array().cast("array<long>")
    below = F.size(F.filter(splits, lambda x: x < key))
    equal = F.size(F.filter(splits, lambda x: x == key))
    share = F.col("tie").cast("double") / 2.0**64 + 0.5
    return rows.withColumn("part", below + F.least(F.floor(share * (equal + 1)).cast("int"), equal))


def in_order(docs: DataFrame, *, guests: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows of ``doc_id, text`` with ``tie, part``, dealt by ranges of ``(doc_id, tie)`` and sorted in them.

    ``tie`` is a hash of the text; missing ids come first.  Each range is one task.  ``guests`` may
    add rows of other ranges, which then follow the range's own rows (column ``guest``).
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = parts_of(docs.withColumn("tie", F.xxhash64("text")), parts)
    order: list[Column] = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    if guests is not None:
        rows = rows.withColumn("guest", F.lit(False)).unionByName(guests(rows).withColumn("guest", F.lit(True)))
        order.insert(0, F.col("guest").asc())
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions(*order)


def part_offsets(rows: DataFrame, amount: Column) -> DataFrame:
    """``part, part_start``: the sum of ``amount`` over all earlier parts; one row per part.

    The first pass sums each part, the second sums the part totals.  There are as many rows as
    shuffle partitions, so the result may be broadcast: its size does not depend on the data.
    """
    from pyspark.sql import Window

    totals = rows.groupBy("part").agg(F.sum(amount).cast("long").alias("part_total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select("part", F.coalesce(F.sum("part_total").over(before), F.lit(0)).cast("long").alias("part_start")))
