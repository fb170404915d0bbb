"""Token ids as ORC files in document order, and back.

Ids are integer lists, which ORC writes in stripes with run-length encoding; a row index and a
Bloom filter on ``doc_id`` let a reader skip stripes and row groups, and readers take one stripe
each.  A row knows its place within its part (one range of documents), so the global place needs
only the totals of the parts.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, part_offsets, shared_dir
from .word_bpe import ordered_ids

OPTIONS = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str, **columns: str) -> None:
    """Encode all documents and write ``doc_id, part, start_in_part, n, ids`` in ascending order.

    A NULL or empty text has the end id only; NULL ids come first; equal ids follow a hash of their
    text, and repeated rows are rows of their own; an empty table gives files without rows.
    """
    ordered_ids(docs, tokenizer, end_id, **columns).write.options(**OPTIONS).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files with ``start``: the ids of all documents before.

    The totals of the parts are read from the numbers alone, not from the ids.
    """
    rows = spark.read.schema("doc_id long, part int, start_in_part long, n long, ids array<int>").orc(path)
    placed = rows.join(part_offsets(rows.select("part", "n"), F.col("n")), "part")
    return placed.select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "ids")


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The rows of a few documents; stripes and row groups without them are skipped."""
    return read(spark, path).where(F.col("doc_id").isin(ids))


def checked(rows: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of read rows."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(values[i:j].tobytes()) for i, j in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(np.diff(bounds), pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(rows, crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}.orc"
