"""Content-defined chunking: fingerprints that survive shifts.

A gear hash runs over the bytes of a text; where some of its bits are zero a chunk ends.  Cutting
is normalised: before the normal size more bits must be zero than after it, so that lengths stay
close together.  The hash looks back 32 bytes, so an edit moves only the cuts near it.  A
fingerprint is the set of the chunks' digests, each with its length; the containment of one in
another is the share of its length whose chunks the other has, too.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_order, map_batches, plain

LEAST, NORMAL, MOST = 8, 32, 128
# Bits that must be zero before and after the normal size; the first set holds the second.
HARD, EASY = np.uint32(0x7F << 22), np.uint32(0x7 << 22)


def _gear() -> np.ndarray:
    """256 numbers by a fixed rule: the mixed squares of a Weyl sequence."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def cuts(data: bytes, first: int = 0) -> list[int]:
    """Ends of the chunks of ``data`` from the cut at ``first`` on; the last end is its length."""
    n = len(data)
    h = GEAR[np.frombuffer(data, np.uint8)]
    for s in (1, 2, 4, 8, 16):
        if s < n:
            h[s:] = h[s:] + (h[:-s] << np.uint32(s))
    ends = np.flatnonzero((h & EASY) == 0)
    hard = (ends[(h[ends] & HARD) == 0] + 1).tolist()
    easy = (ends + 1).tolist()
    out, at, i, j, n_hard, n_easy = [], first, 0, 0, len(hard), len(easy)
    while n - at > LEAST:
        i = bisect_left(hard, at + LEAST, i)
        end = min(at + MOST, n)
        if i < n_hard and hard[i] < at + NORMAL:
            end = min(hard[i], n)
        else:
            j = bisect_left(easy, at + NORMAL, j)
            if j < n_easy and easy[j] < end:
                end = easy[j]
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def chunk_keys(data: bytes, ends: list[int], start: int = 0) -> list[int]:
    """Digest and length of each chunk as one number."""
    out, at, digest = [], start, xxhash.xxh32_intdigest
    for end in ends:
        out.append(digest(data[at:end]) << 8 | (end - at))
        at = end
    return out


def written(keys: set[int]) -> str:
    """Ten hexadecimal digits for each chunk: eight of the digest, two of the length."""
    raw = np.fromiter(keys, np.uint64, len(keys))
    raw.sort()
    return raw.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()


def containment(a: set[int], b: set[int]) -> float:
    """Share of the length of ``a`` in chunks that ``b`` holds; 1 if ``a`` is empty and ``b`` is, too."""
    total = sum(k & 0xFF for k in a)
    if not total:
        return 1.0 if not b else 0.0
    return sum(k & 0xFF for k in a & b) / total


class Text:
    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.data = text.encode()
        self.ends = cuts(self.data)
        self.keys = chunk_keys(self.data, self.ends)
        self.chunks = set(self.keys)

    def edited(self, other: Text) -> tuple[bytes, set[int]]:
        """The text with its last quarter replaced by the start of ``other``, and its chunks.

        Cuts depend on what stands before them only, so the chunks of the kept part stay.
        """
        q = len(self.text) // 4
        kept = self.text[: len(self.text) - q].encode()
        data = kept + other.text[:q].encode()
        same = bisect_left(self.ends, len(kept))
        at = self.ends[same - 1] if same else 0
        back = max(0, at - 31)
        ends = [back + e for e in cuts(data[back:], at - back)]
        return data, set(self.keys[:same]) | set(chunk_keys(data, ends, at))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint``; a NULL or empty text has the empty fingerprint."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            prints = [written(set(chunk_keys(d, cuts(d)))) for d in (t.encode() for t in texts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(prints)], ["doc_id", "n_chars", "fingerprint"])

    return map_batches(plain(docs, id_col, text_col), each, "doc_id long, n_chars long, fingerprint string")


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(a: Text, b: Text) -> tuple:
    data, chunks = a.edited(b)
    near = containment(a.chunks, chunks), containment(a.chunks, b.chunks)
    return (a.doc_id, len(a.text), hashlib.sha256(data).hexdigest(), written(a.chunks), written(chunks), *near)


def _first_of_next(rows: DataFrame) -> DataFrame:
    """The first row of each range, as a guest of the range before it (of the last one: the very first row).

    There are as many first rows as shuffle partitions; their keys are sent to the texts.
    """
    firsts = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("first"))
    by_part = Window.orderBy("part")
    before = F.coalesce(F.lag("part").over(by_part), F.last("part").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = firsts.select(F.col("part").alias("own"), "first", before.alias("part"))
    same = rows.withColumnRenamed("part", "own").join(F.broadcast(firsts), "own").where(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie")))
    return same.select("doc_id", "text", "tie", "part").dropDuplicates(["part"])


def edited_and_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, compared; columns as in ``COMPARED``.

    The next document is the one with the next larger id (ties: by a hash of the text; after the
    last: the first).  The texts are dealt by ranges of ids once; each range also gets the first
    text of the next one, so every pair of neighbours meets in a task that streams through its range.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Text | None = None
        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                now = Text(doc_id, text)
                if held is not None:
                    out.append(_compared(held, now))
                held = now
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, COMPARED_TYPES, strict=True)], COMPARED_NAMES)

    ordered = in_order(plain(docs, id_col, text_col), guests=_first_of_next)
    return map_batches(ordered.select("doc_id", "text"), stream, COMPARED)


COMPARED_NAMES = [c.split()[0] for c in COMPARED.split(", ")]
COMPARED_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
