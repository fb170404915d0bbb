"""Concatenate and cut: documents laid end to end and cut into sequences of equal length.

The first pass sums the tokens of each part (a range of documents), the second the totals of the
parts; both together give every document its global offset.  Sequence ``i`` holds the tokens from
``i * length`` on, so a document is cut exactly at the multiples of ``length`` and only the very
last sequence is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import int_lists, map_batches, part_offsets, store
from .word_bpe import ordered_ids

LENGTH = 4096
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, opens boolean, closes boolean"


def pack(docs: DataFrame, tokenizer: str, end_id: int, *, length: int = LENGTH, with_ids: bool = False, **columns: str) -> DataFrame:
    """One row per piece: which tokens of which document lie where.

    ``opens`` and ``closes`` are the boundary records: whether the piece holds the document's first
    and last token.  ``with_ids`` adds the ids themselves.  An empty or NULL text still has its end id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = b.column("ids").to_pylist()
            sizes, at = b.column("n").to_numpy(), b.column("start").to_numpy()
            first = at // length
            n = (at + sizes - 1) // length - first + 1
            doc = np.repeat(np.arange(len(n)), n)
            sequence = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            lo = np.maximum(at[doc], sequence * length)
            hi = np.minimum((at + sizes)[doc], (sequence + 1) * length)
            start = lo - at[doc]
            parts = [packed[d][4 * i : 4 * j] for d, i, j in zip(doc, start, start + hi - lo, strict=True)]
            numbers = [start, hi - lo, [zlib.crc32(p) for p in parts], sizes[doc], sequence, lo - sequence * length]
            out = [b.column("doc_id").take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in numbers), pa.array(start == 0), pa.array(hi == (at + sizes)[doc])]
            names = PIECE.replace(" long", "").replace(" boolean", "").split(", ")
            if with_ids:
                out, names = [*out, int_lists([np.frombuffer(p, "<u4") for p in parts])], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    rows = store(ordered_ids(docs, tokenizer, end_id, packed=True, **columns))
    placed = rows.join(part_offsets(rows, F.col("n")), "part").select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n", "ids")
    return map_batches(placed, cut, PIECE + ", ids array<int>" * with_ids)


def sequences(pieces: DataFrame, *, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """``sequence_id, ids, documents``: padded sequences with the documents and offsets in them, from pieces with ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "opens", "closes", "ids")))
    whole = pieces.groupBy("sequence_id").agg(parts.alias("parts")).withColumn("flat", F.flatten(F.transform("parts", lambda p: p["ids"])))
    padding = F.array_repeat(F.lit(pad_id), F.lit(length) - F.size("flat"))
    return whole.select(
        "sequence_id",
        F.concat("flat", padding).alias("ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["offset"].alias("offset"), p["opens"].alias("opens"), p["closes"].alias("closes"))).alias("documents"),
    )
