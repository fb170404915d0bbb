"""Near-duplicate documents by DartMinHash.

A document is a weighted set of word runs (five words).  Every run throws darts: in each unit cell
of its weight and of the rank axis a number of darts that follows a Poisson law with mean one falls
at places given by hashes of the run and the cell, each on one of ``k`` coordinates.  A document
keeps the darts below its weights and, for each coordinate, the one of lowest rank.  Two documents
keep the same dart on a coordinate with a probability equal to their weighted Jaccard similarity.
Only ranks below ``t / weight`` are looked at, where about ``t = k ln k + 2k`` darts of a document
fall; if a coordinate stays empty, the limit doubles.

Equal texts are one class.  Classes that share a band of coordinates are candidates.  In each band
bucket the class with the most company leads; its links to the others are verified exactly and
linked classes merge.  Members of a bucket that are still apart are verified with each other: in
small buckets pair by pair, in large ones in blocks, whose tasks compare all their texts and return
a spanning forest instead of pairs.  So no link between different components of a bucket is left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, plain, store
from .components import Forest, components

RUN = 5
SIMILAR = 0.8
BANDS, ROWS = 30, 5
# Share of equal sketch bytes below which a candidate cannot be similar: six deviations under the limit of 0.8.
HOPEFUL = 0.6
# Buckets with more members that are still apart are compared in blocks of this many texts.
SMALL_BUCKET, BLOCK = 24, 256
# Columns of a block's table of texts and runs at a time.
COLUMNS = 16_384
WORD = re.compile(r"\w+")
U64 = np.uint64


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def runs(text: str, run: int = RUN) -> np.ndarray:
    """Hashes of the word runs, repeated ones included; a shorter text is one run, an empty one has none."""
    found = words(text)
    if not found:
        return np.empty(0, U64)
    h = np.fromiter(map(_HASHES.__getitem__, found), U64, len(found))
    n = max(1, len(h) - run + 1)
    out = np.full(n, min(len(h), run), U64)
    for i in range(min(run, len(h))):
        out = _mixed(out * U64(0x9E3779B97F4A7C15) + h[i : i + n])
    return out


def weighted(text: str, run: int = RUN, counted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs and their weights: 1, or how often they occur."""
    elements, n = np.unique(runs(text, run), return_counts=True)
    return elements, n.astype(float) if counted else np.ones(len(n))


@lru_cache(maxsize=1)
def _poisson() -> np.ndarray:
    """Upper ends, on a 64-bit scale, of the values of a Poisson variable with mean one."""
    ends = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])
    return (ends * 2.0**64).clip(0, 2.0**64 - 2048).astype(U64)


def darts(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts of elements below their weight and below the rank ``limit`` of their owner: owner, coordinate, rank with the dart's identity in its low bits."""
    cells = np.ceil(limit[owner]).astype(np.int64)
    levels = np.ceil(weights).astype(np.int64)
    per = cells * levels
    which = np.repeat(np.arange(len(elements)), per)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(per) - per, per)
    cell, level = nth % cells[which], nth // cells[which]
    seed = _mixed(elements[which] ^ _mixed(cell.astype(U64) * U64(0x9E3779B97F4A7C15) + level.astype(U64) * U64(0xD1B54A32D192ED03) + U64(1)))
    thrown = np.searchsorted(_poisson(), seed, side="right")
    at = np.repeat(np.arange(len(seed)), thrown)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(thrown) - thrown, thrown)
    h = _mixed(seed[at] + (nth.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
    high = _mixed(h ^ U64(0xA0761D6478BD642F))
    below = level[at] + (high >> U64(11)).astype(float) / 2.0**53 < weights[which[at]]
    rank = cell[at].astype(float) + (h >> U64(32)).astype(float) / 2.0**32
    kept = below & (rank < limit[owner[which[at]]])
    at, h = at[kept], h[kept]
    key = (cell[at].astype(U64) << U64(40)) | ((h >> U64(32)) << U64(8)) | (high[kept] & U64(0xFF))
    return owner[which[at]], (_mixed(h) % U64(k)).astype(np.int64), key


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """One row of ``k`` dart keys for each non-empty weighted set."""
    out = np.full((len(sets), k), np.iinfo(U64).max, U64)
    todo = np.arange(len(sets))
    limit = np.array([(k * math.log(k) + 2 * k) / max(w.sum(), 1e-9) for _, w in sets])
    while len(todo):
        owner = np.repeat(todo, [len(sets[i][0]) for i in todo])
        doc, coordinate, key = darts(np.concatenate([sets[i][0] for i in todo]), np.concatenate([sets[i][1] for i in todo]), owner, limit, k)
        np.minimum.at(out, (doc, coordinate), key)
        todo = todo[(out[todo] == np.iinfo(U64).max).any(1)]
        limit[todo] *= 2
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), (len(signature), bands)).copy()
    for i in range(rows):
        out = _mixed(out * U64(0xD1B54A32D192ED03) + signature[:, i : bands * rows : rows])
    return out.view(np.int64)


def classes(docs: DataFrame, *, bands: int, rows: int, run: int, counted: bool) -> DataFrame:
    """``row, doc_id, digest, keys, sketch``: a digest of the text and, unless it has no words, its band keys and one byte of each coordinate."""
    names = ["row", "doc_id", "digest", "keys", "sketch"]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = b.column("digest").to_pylist()
            # A text that occurs again in the batch is signed once.
            sets = {d: weighted(t, run, counted) for d, t in dict(zip(digests, b.column("text").to_pylist(), strict=True)).items()}
            filled = [d for d, s in sets.items() if len(s[0])]
            keys, sketch = {}, {}
            # Bounded work at a time, whatever the lengths of the texts.
            at, size = 0, 0
            for i, d in enumerate(filled):
                size += len(sets[d][0]) + 1000
                if size > 400_000 or i + 1 == len(filled):
                    part = filled[at : i + 1]
                    found = signatures([sets[x] for x in part], bands * rows)
                    keys |= dict(zip(part, band_keys(found, bands, rows).tolist(), strict=True))
                    sketch |= dict(zip(part, (x.tobytes() for x in _mixed(found).astype(np.uint8)), strict=True))
                    at, size = i + 1, 0
            own = [pa.array([keys.get(d) for d in digests], pa.list_(pa.int64())), pa.array([sketch.get(d) for d in digests], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("digest"), *own], names)

    return map_batches(docs.withColumn("digest", F.md5(F.col("text").cast("binary"))), signed, "row long, doc_id long, digest string, keys array<long>, sketch binary")


def _hopeful(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that share enough bytes of their sketches."""
    left = pairs.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("s")), "a")
    both = left.join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("t")), "b")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s, t = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("s", "t"))
                yield b.select(["a", "b"]).filter(pa.array((s == t).mean(1) >= HOPEFUL))

    return map_batches(both.select("a", "b", "s", "t"), close, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, *, run: int, counted: bool, similar: float) -> DataFrame:
    """The pairs ``a, b`` whose texts are at least ``similar``, with ``similarity``."""
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y, s, t in zip(*(b.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                (e, v), (f, w) = weighted(s, run, counted), weighted(t, run, counted)
                _, i, j = np.intersect1d(e, f, assume_unique=True, return_indices=True)
                shared = np.minimum(v[i], w[j]).sum()
                share = shared / max(v.sum() + w.sum() - shared, 1e-9)
                if share >= similar:
                    out.append((x, y, share))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "similarity"])

    return map_batches(both.select("a", "b", "text_a", "text_b"), compare, "a long, b long, similarity double")


def members(text: str, run: int, counted: bool) -> np.ndarray:
    """The runs as a plain set: with ``counted`` each repetition is a member of its own."""
    elements, n = weighted(text, run, counted)
    nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n.astype(int))
    return np.sort(np.repeat(elements, n.astype(int)) + _mixed(nth.astype(U64)) * (nth > 0).astype(U64))


def _linked(sets: list[np.ndarray], similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of sets that are similar enough, exactly."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[column] > 1
    owner, column = owner[common], np.unique(column[common], return_inverse=True)[1]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        table = np.zeros((len(sets), COLUMNS), np.float32)
        table[owner[lo:hi], column[lo:hi] - at] = 1
        shared += table @ table.T
    sizes = np.array([len(s) for s in sets], float)
    share = shared / np.maximum(sizes[:, None] + sizes - shared, 1e-9)
    return np.nonzero(np.triu(share >= similar, 1))


def _in_blocks(large: DataFrame, texts: DataFrame, *, run: int, counted: bool, similar: float) -> DataFrame:
    """Links ``a, b`` among the ids that share a bucket, as a spanning forest of each pair of blocks.

    Ids joined by shared buckets are one family; its texts are dealt to blocks of bounded size, and
    each pair of blocks is one row, compared as a whole.
    """
    family = components(large.select(F.col("bucket").alias("a"), F.col("id").alias("b"))).withColumnsRenamed({"node": "id", "component": "family"})
    family = family.join(large.select("id").distinct(), "id")
    sizes = family.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = family.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        sets = [members(t, run, counted) for t in group.column("text").to_pylist()]
        packed = [np.array([len(s) for s in sets], np.int64), group.column("id").to_numpy(), np.concatenate(sets)]
        columns = [group.column("family")[:1], group.column("block")[:1], *(pa.array([x.tobytes()], pa.binary()) for x in packed)]
        return pa.table(dict(zip(["family", "block", "sizes", "ids", "runs"], columns, strict=True)))

    blocks = store(dealt.select("family", "block", "id").join(texts, "id").groupBy("family", "block").applyInArrow(pack, "family long, block int, sizes binary, ids binary, runs binary"))
    right = blocks.select("family", *[F.col(c).alias(f"{c}_b") for c in ("block", "sizes", "ids", "runs")])
    both = blocks.join(right, "family").where("block <= block_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, sets = [], []
                for side in ("", "_b") if row["block"] != row["block_b"] else ("",):
                    ends = np.cumsum(np.frombuffer(row[f"sizes{side}"], np.int64))
                    ids.append(np.frombuffer(row[f"ids{side}"], np.int64))
                    sets += np.split(np.frombuffer(row[f"runs{side}"], U64), ends[:-1])
                forest = Forest(len(sets))
                forest.add(*_linked(sets, similar))
                child, names = np.flatnonzero(forest.root != np.arange(len(sets))), np.concatenate(ids)
                yield pa.RecordBatch.from_arrays([pa.array(names[child]), pa.array(names[forest.root[child]])], ["a", "b"])

    return map_batches(both, compare, "a long, b long")


NO_ID = 2**63 - 1


def _groups(rows: DataFrame, *, bands: int, rows_per_band: int, run: int, similar: float, counted: bool) -> DataFrame:
    """``row, doc_id, class_id, component_id, kept`` from ``row, doc_id, text``."""
    check = {"run": run, "counted": counted, "similar": similar}
    signed = store(classes(rows, bands=bands, rows=rows_per_band, run=run, counted=counted))
    place = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("row").alias("row"))
    # A class stands for one text; it is named by a hash of the digest and shown by its smallest document.
    grouped = signed.groupBy("digest").agg(F.min(place).alias("first"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    grouped = store(grouped.select(F.xxhash64("digest").alias("id"), "digest", "first", "keys", "sketch"))

    buckets = grouped.where(F.col("keys").isNotNull()).select("id", F.explode("keys").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = store(buckets.join(sizes, "bucket").select("bucket", "id", "size"))
    company = shared.groupBy("id").agg(F.sum("size").alias("company"))
    leaders = shared.select("bucket", "id").join(company, "id").groupBy("bucket").agg(F.max(F.struct("company", "id"))["id"].alias("leader"))
    stars = shared.select("bucket", "id").join(leaders, "bucket").where("id <> leader")
    led = stars.groupBy(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    led = store(led.select("a", "b"))

    sketches = grouped.select("id", "sketch")
    wanted = grouped.join(shared.select("id").distinct(), "id").select("id", "first.row")
    texts = store(rows.select("row", "text").join(wanted, "row").select("id", "text"))
    links = store(verified(_hopeful(led, sketches), texts, **check))

    # Members of a bucket that are still in different components meet.
    found = components(links).withColumnRenamed("node", "id")
    member = store(shared.select("bucket", "id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id")))
    split = member.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo <> hi")
    apart = store(member.join(split.select("bucket", "members"), "bucket"))
    small, large = apart.where(F.col("members") <= SMALL_BUCKET), apart.where(F.col("members") > SMALL_BUCKET)
    other = small.select("bucket", F.col("id").alias("other"), F.col("component").alias("there"))
    crossing = small.join(other, "bucket").where("component < there").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    crossing = crossing.join(led, ["a", "b"], "left_anti")
    paired = verified(_hopeful(crossing, sketches), texts, **check).select("a", "b")
    links = store(links.select("a", "b").unionByName(paired).unionByName(_in_blocks(large.select("bucket", "id"), texts, **check)))

    joined = components(links).withColumnsRenamed({"node": "id", "component": "root"})
    table = grouped.select("id", "digest", "first").join(joined, "id", "left").withColumn("root", F.coalesce("root", "id"))
    heads = table.groupBy("root").agg(F.min("first").alias("head"))
    table = table.join(heads, "root").select("digest", "first", "head")
    shown = lambda c, name: F.when(F.col(f"{c}.doc_id") != NO_ID, F.col(f"{c}.doc_id")).alias(name)
    return signed.select("row", "doc_id", "digest").join(table, "digest").select("row", "doc_id", shown("first", "class_id"), shown("head", "component_id"), (F.col("row") == F.col("head.row")).alias("kept"))


def near_duplicates(docs: DataFrame, *, bands: int = BANDS, rows: int = ROWS, run: int = RUN, similar: float = SIMILAR, counted: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, component_id, kept``: one row per row of ``docs``.

    ``class_id`` is the smallest id with the same text, ``component_id`` the smallest id of the
    group: the texts that a chain of links at least ``similar`` joins.  One row of each group is kept:
    one with the smallest id.  NULL texts equal empty ones; texts without words are similar
    only to equal texts; a text shorter than a run is one run.  Missing ids come after all others.
    ``counted`` weighs runs by how often they occur.  ``docs`` must be a stored table (or as stable
    as one), since its rows are numbered where they are read.
    """
    numbered = plain(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    return _groups(numbered, bands=bands, rows_per_band=rows, run=run, similar=similar, counted=counted).drop("row")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    number = "row"
    while number in docs.columns:
        number += "_"
    numbered = docs.withColumn(number, F.monotonically_increasing_id())
    named = numbered.select(F.col(number).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    defaults = {"bands": BANDS, "rows_per_band": ROWS, "run": RUN, "similar": SIMILAR, "counted": False}
    kept = store(_groups(named, **(defaults | options)).where("kept").select(F.col("row").alias(number)))
    return numbered.join(kept, number, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
