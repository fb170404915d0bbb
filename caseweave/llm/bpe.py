"""Byte-level BPE encoding and decoding of whole texts, long ones in overlapping chunks.

A text up to ``chunk`` characters is encoded at once.  A longer one is cut into chunks that
overlap on both sides; every chunk is pre-tokenised by itself, in parallel.  A chunk that starts
inside a match finds wrong boundaries at first, but from the first boundary that it shares with
the chunk before it both agree, because a match depends only on the text from its start on.  The
pieces between these shared boundaries are encoded in parallel and joined.  A piece never ends in
white space, since how a run of white space is matched depends on whether text follows it.  A text
in which some overlap holds no such boundary (one match longer than the overlap, or white space
only) is encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import int_lists, map_batches, plain, store

CHUNK = 16_384
OVERLAP = 512
# Text past the overlap, so that a boundary inside it never depends on where the chunk was cut.
SLACK = 64


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


@lru_cache(maxsize=2)
def _matcher(pattern: str):
    import regex

    return regex.compile(pattern)


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, ids``: one row per row of ``docs``, repeated rows and ids included.

    A NULL or empty text has no ids.  ``docs`` must be a stored table (or as stable as one),
    since its rows are numbered where they are read.
    """
    if chunk <= 2 * overlap + SLACK:
        raise ValueError("a chunk must be longer than its overlaps")
    rows = plain(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    short, long_ = rows.where(F.length("text") <= chunk), rows.where(F.length("text") > chunk)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, pattern)
        for b in batches:
            ids = [np.asarray(enc.encode_ordinary(t), np.int32) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), int_lists(ids)], ["doc_id", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, doc_id, text in zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                n = -(-len(text) // chunk)
                for first in range(0, n, 64):
                    idx = list(range(first, min(n, first + 64)))
                    base = [max(0, i * chunk - overlap) for i in idx]
                    texts = [text[at : (i + 1) * chunk + overlap + SLACK] for i, at in zip(idx, base, strict=True)]
                    columns = [[row] * len(idx), [doc_id] * len(idx), idx, [n] * len(idx), base, texts]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, CHUNK_TYPES, strict=True)], CHUNK_NAMES)

    def boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _matcher(pattern).finditer
        for b in batches:
            left, right = [], []
            for idx, n, base, text in zip(*(b.column(c).to_pylist() for c in ("idx", "n", "base", "text")), strict=True):
                starts = base + np.fromiter((m.start() for m in find(text)), np.int64)
                near = lambda at: starts[(starts >= at - overlap) & (starts <= at + overlap)]
                left.append(near(idx * chunk) if idx else np.empty(0, np.int64))
                ends = near((idx + 1) * chunk) if idx + 1 < n else ()
                right.append(np.array([s for s in ends if not text[s - base - 1].isspace()], np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, int_lists(left, "int64"), int_lists(right, "int64")], [*CHUNK_NAMES, "lefts", "rights"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, pattern)
        for b in batches:
            parts = zip(*(b.column(c).to_pylist() for c in ("text", "base", "start", "end")), strict=True)
            ids = [np.asarray(enc.encode_ordinary(t[s - base : None if e is None else e - base]), np.int32) for t, base, s, e in parts]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("idx"), int_lists(ids)], ["row", "doc_id", "idx", "ids"])

    chunks = map_batches(long_, cut, CHUNK_SCHEMA).repartition("row", "idx")
    marked = store(map_batches(chunks, boundaries, CHUNK_SCHEMA + ", lefts array<long>, rights array<long>"))
    per_text = Window.partitionBy("row").orderBy("idx")
    both = F.array_intersect("lefts", F.lag("rights").over(per_text))
    small = marked.select("row", "idx", "n", F.when(F.col("idx") == 0, F.lit(0)).otherwise(F.array_min(both)).cast("long").alias("start"))
    stitched = small.withColumn("end", F.lead("start").over(per_text)).withColumn("whole", F.max(F.col("start").isNull()).over(Window.partitionBy("row")))
    apart = marked.join(stitched.where(~F.col("whole")).select("row", "idx", "start", "end"), ["row", "idx"])
    encoded = map_batches(apart.select("row", "doc_id", "idx", "text", "base", "start", "end"), pieces, "row long, doc_id long, idx long, ids array<int>")
    gathered = encoded.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "ids"))).alias("parts"))
    joined = gathered.select("doc_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
    unbroken = long_.join(stitched.where(F.col("whole")).select("row").distinct(), "row", "left_semi")
    at_once = short.select("doc_id", "text").unionByName(unbroken.select("doc_id", "text"))
    return map_batches(at_once, whole, "doc_id long, ids array<int>").unionByName(joined)


CHUNK_SCHEMA = "row long, doc_id long, idx long, n long, base long, text string"
CHUNK_NAMES = ["row", "doc_id", "idx", "n", "base", "text"]
CHUNK_TYPES = [pa.int64()] * 5 + [pa.string()]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded``: the bytes of the ids, one after the other (NULL ids: no bytes)."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _token_bytes(path).__getitem__
        for b in batches:
            raw = [b"".join(map(token, ids or ())) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], [*b.schema.names, "decoded"])

    return map_batches(encoded.select("doc_id", "ids"), joined, "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    """The digest row of each document."""
    ids = F.coalesce(F.col("ids"), F.array().cast("array<int>"))
    return decoded.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.coalesce(F.col("decoded"), F.lit(b"")), 256).alias("decoded_sha256"),
    )
