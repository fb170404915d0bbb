"""Alignment of two tokenizations of a text by diagonal run skipping.

Both tokenizers cut the same bytes.  The ends of the tokens are two ascending arrays; where an end
of one equals an end of the other, a group of tokens ends on both sides.  Most groups are one to
one, so the ends are compared along a diagonal, at the current shift between the two positions, in
steps that double while they agree and halve after the first difference: a stretch of one-to-one
groups is passed in a logarithm of its length.  The irregular group behind it is walked token by
token, which also gives the new shift.

How many documents hold a linked pair of ids is counted in two steps.  Each task numbers the
distinct pairs of a block of documents, so a document only lists small numbers, and the counts of
all blocks are added up.  Then every block gets the totals of its own pairs back.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import int_lists, map_batches, plain, store
from .word_bpe import BYTE_LETTERS

# A block ends with the document that brings it to this many pairs of a document.
BLOCK_PAIRS = 1_000_000
# Rows that carry the pairs of a block hold this many each.
SLICE = 65_536
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The rank encoder gives up on white space runs of some 100,000 characters; far below, the other library takes over.
BLANK_RUN = re.compile(r"\s{10000}")


def links(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int]]:
    """Positions of the tokens of all overlapping pairs, in order of the text.

    Both lists ascend and end with the same number.  A link closes a group where both ends are equal.
    """
    left: list[int] = []
    right: list[int] = []
    i = shift = 0
    n = len(a_ends)
    while i < n:
        start, step = i, 1
        while i < n and a_ends[i : i + step] == b_ends[i + shift : i + shift + step]:
            i += step
            step += step
        while step > 1 and i < n:
            step >>= 1
            if a_ends[i : i + step] == b_ends[i + shift : i + shift + step]:
                i += step
        i = min(i, n)
        if i > start:
            left.extend(range(start, i))
            right.extend(range(start + shift, i + shift))
        if i < n:
            j = i + shift
            x, y = a_ends[i], b_ends[j]
            left.append(i)
            right.append(j)
            while x != y:
                if x < y:
                    i += 1
                    x = a_ends[i]
                else:
                    j += 1
                    y = b_ends[j]
                left.append(i)
                right.append(j)
            i += 1
            shift = j + 1 - i
    return left, right


class Pair:
    """The two tokenizers with the bytes of their tokens; one per worker."""

    def __init__(self, byte_bpe: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(byte_bpe, encoding="utf-8") as f:
            file = json.load(f)
        special = {t["content"] for t in file.get("added_tokens", []) if t.get("special")}
        byte_of = {letter: b for b, letter in BYTE_LETTERS.items()}
        ranks = {bytes(byte_of[c] for c in entry): i for entry, i in file["model"]["vocab"].items() if entry not in special}
        # Merges are listed in the order of the ids, so ids are ranks.
        self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.library = Tokenizer.from_file(byte_bpe)
        self.library.encode_special_tokens = True
        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [self._piece(i) for i in range(self.model.get_piece_size())]
        self.a_sizes = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(t) for t in self.b_bytes], np.int64)
        # An id as text with the sign behind it: `,` inside a side, `|` between the sides, `;` after the group.
        kinds = [(len(self.a_bytes), b","), (len(self.a_bytes), b"|"), (len(self.b_bytes), b","), (len(self.b_bytes), b";")]
        self.written = [b"%d" % i + sign for size, sign in kinds for i in range(size)]
        self.first = np.cumsum([0, *(size for size, _ in kinds)])[:4]

    def _piece(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def a_ids(self, text: str) -> list[int]:
        if len(text) > 10_000 and BLANK_RUN.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(text)

    def align(self, text: str | None, b_ids: list[int]) -> tuple[np.ndarray, ...] | None:
        """Ids of both sides and the positions of all links; ``None`` where the bytes of a side are not the text's."""
        if not text:
            return None
        spaced = " " + text
        if b"".join(map(self.b_bytes.__getitem__, b_ids)) != spaced.encode():
            return None
        a, b = np.array(self.a_ids(spaced), np.int64), np.array(b_ids, np.int64)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        if a_ends[-1] != b_ends[-1]:
            return None
        left, right = (np.array(x, np.int64) for x in links(a_ends.tolist(), b_ends.tolist()))
        return a, b, left, right, a_ends[left] == b_ends[right]

    def text_of(self, a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, closes: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of the groups."""
        a_last, b_last = left[closes], right[closes]
        a_ends, b_ends = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_ends[a_last] = 1
        b_ends[b_last] = 1
        out = np.empty(len(a) + len(b), np.int64)
        # A token of the first side stands behind all tokens of earlier groups of the second, and so on.
        b_before = np.r_[0, b_last + 1]
        a_upto = np.r_[a_last + 1, len(a)]
        out[np.arange(len(a)) + b_before[np.cumsum(a_ends) - a_ends]] = a + self.first[a_ends]
        out[np.arange(len(b)) + a_upto[np.cumsum(b_ends) - b_ends]] = b + self.first[2 + b_ends]
        return b"".join(map(self.written.__getitem__, out.tolist()))[:-1]


@lru_cache(maxsize=1)
def pair(byte_bpe: str, pieces: str) -> Pair:
    return Pair(byte_bpe, pieces)


def aligned(docs: DataFrame, byte_bpe: str, pieces: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, a_ids, b_ids, a_ends, b_ends``: ids of both sides and, per group, how many tokens of each lie up to its end.

    A text that is NULL, empty or not given back by the pieces has empty lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, none = pair(byte_bpe, pieces), np.empty(0, np.int64)
        for b in batches:
            texts = b.column("text").to_pylist()
            found = [both.align(t, ids) or (none, none, none, none, none.astype(bool)) for t, ids in zip(texts, both.model.encode(texts, num_threads=1), strict=True)]
            lists = [[f[0] for f in found], [f[1] for f in found], [f[2][f[4]] + 1 for f in found], [f[3][f[4]] + 1 for f in found]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(int_lists, lists)], ["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])

    return map_batches(plain(docs, id_col, text_col), run, "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


ROW = "block long, at long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, items binary, times binary, pairs array<long>, docs array<int>"
NAMES = [c.split()[0] for c in ROW.replace(", ", ",").split(",")]


class _Block:
    """Documents of a task until they hold ``BLOCK_PAIRS`` pairs, then their rows and those of the block's pairs."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.size = 0

    def add(self, row: tuple, codes: np.ndarray) -> None:
        distinct, times = np.unique(codes, return_counts=True)
        self.rows.append(row)
        self.pairs.append(distinct)
        self.times.append(times)
        self.size += len(distinct) + 16

    def batches(self, number: int) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(self.pairs)
        known, place, docs = np.unique(every, return_inverse=True, return_counts=True)
        del every
        bounds = np.cumsum([0, *(len(p) for p in self.pairs)])
        for first in range(0, len(known), SLICE):
            part = slice(first, first + SLICE)
            yield _batch([number], at=[first], pairs=int_lists([known[part]], "int64"), docs=int_lists([docs[part]]))
        for first in range(0, len(self.rows), 1024):
            rows = range(first, min(first + 1024, len(self.rows)))
            # Numbers ascend within a document: steps between them are small.
            items = [np.diff(place[bounds[i] : bounds[i + 1]], prepend=0).astype("<u4").tobytes() for i in rows]
            times = [self.times[i].astype("<u4").tobytes() for i in rows]
            columns = dict(zip(NAMES[2:8], zip(*(self.rows[i] for i in rows), strict=True), strict=True))
            yield _batch([number] * len(rows), items=items, times=times, **columns)


def _batch(block: list[int], **columns) -> pa.RecordBatch:
    types = {"groups_sha256": pa.string(), "items": pa.binary(), "times": pa.binary(), "pairs": pa.list_(pa.int64()), "docs": pa.list_(pa.int32())}
    got = {"block": block} | columns
    arrays = []
    for name in NAMES:
        kind, value = types.get(name, pa.int64()), got.get(name)
        arrays.append(value if isinstance(value, pa.Array) else pa.nulls(len(block), kind) if value is None else pa.array(value, kind))
    return pa.RecordBatch.from_arrays(arrays, NAMES)


def _linked(docs: DataFrame, byte_bpe: str, pieces: str, block_pairs: int) -> DataFrame:
    """Rows of ``ROW``: a row per document, and rows with the distinct pairs of each block and how many of its documents hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(byte_bpe, pieces)
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for b in batches:
            texts = b.column("text").to_pylist()
            for doc_id, text, ids in zip(b.column("doc_id").to_pylist(), texts, both.model.encode(texts, num_threads=1), strict=True):
                found = both.align(text, ids)
                if found is None:
                    block.add((doc_id, 0, 0, 0, 0, ""), np.empty(0, np.int64))
                else:
                    a, b_, left, right, closes = found
                    digest = hashlib.sha256(both.text_of(*found)).hexdigest()
                    block.add((doc_id, len(a), len(b_), int(closes.sum()), len(left), digest), a[left] << 32 | b_[right])
                if block.size >= block_pairs:
                    yield from block.batches(number)
                    number, block = number + 1, _Block()
        if block.rows:
            yield from block.batches(number)

    return map_batches(plain(docs), run, ROW)


def linked_pairs(rows: DataFrame) -> DataFrame:
    """``pair, count, best``: documents that hold the pair linked, and whether no pair of its first id is in more."""
    each = rows.where("pairs is not null").select(F.inline(F.arrays_zip("pairs", "docs")))
    counted = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("count")).withColumn("a", F.shiftright("pair", 32))
    most = counted.groupBy("a").agg(F.max("count").alias("most"))
    return counted.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, byte_bpe: str, pieces: str, *, id_col: str = "doc_id", text_col: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``n_best`` links are among the most frequent of their first id, ``count_sum`` adds the counts of
    all links.  Repeated rows and ids are rows and documents of their own.  A text that is NULL, empty
    or not given back by the pieces has zeros and the empty digest; an empty table gives no rows.
    """
    plain_docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = store(_linked(plain_docs, byte_bpe, pieces, block_pairs))
    slices = rows.where("pairs is not null").select("block", "at", F.explode("pairs").alias("pair"))
    totals = slices.join(store(linked_pairs(rows)), "pair")
    sent = F.transform(F.sort_array(F.collect_list(F.struct("pair", "count", "best"))), _packed).alias("pairs")
    answers = totals.groupBy("block", "at").agg(sent)
    documents = rows.where("pairs is null").drop("docs", "pairs", "at").withColumn("at", F.lit(None).cast("long"))
    both = documents.unionByName(answers, allowMissingColumns=True)
    asked = both.repartition("block").sortWithinPartitions("block", F.col("at").asc_nulls_last())
    return map_batches(asked, _summed, RESULT)


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _packed(x: Column) -> Column:
    """A count with its mark in the lowest bit."""
    return x["count"] * 2 + x["best"].cast("long")


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The totals of a block come first, then its documents."""
    block, parts, counts = None, [], np.empty(0, np.int64)
    for batch in batches:
        out: dict[str, list] = {c.split()[0]: [] for c in RESULT.split(", ")}
        numbers, at = batch.column("block").to_pylist(), batch.column("at").to_pylist()
        columns = {c: batch.column(c).to_pylist() for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "items", "times")}
        totals = batch.column("pairs")
        for i, (number, first) in enumerate(zip(numbers, at, strict=True)):
            if number != block:
                block, parts, counts = number, [], np.empty(0, np.int64)
            if first is not None:
                parts.append(totals[i].values.to_numpy())
                continue
            if parts:
                counts, parts = np.concatenate(parts), []
            found = counts[np.cumsum(np.frombuffer(columns["items"][i], "<u4"), dtype=np.int64)]
            times = np.frombuffer(columns["times"][i], "<u4").astype(np.int64)
            out["n_best"].append(int((times * (found & 1)).sum()))
            out["count_sum"].append(int((times * (found >> 1)).sum()))
            for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"):
                out[c].append(columns[c][i])
        arrays = [pa.array(v, pa.string() if c == "groups_sha256" else pa.int64()) for c, v in out.items()]
        yield pa.RecordBatch.from_arrays(arrays, list(out))
