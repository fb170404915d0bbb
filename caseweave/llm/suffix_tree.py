"""A probabilistic suffix tree over word tokens.

The root is the distribution of single tokens over all training texts.  A context (the last one or
more tokens) is a candidate if it occurs at least ``MIN_COUNT`` times in them, and stays in the
tree only if its next-token distribution diverges from that of the longest shorter context in the
tree by more than chance explains.  Next tokens that follow the context at least ``MIN_COUNT``
times are kept with it, smoothed towards the shorter context; all others share what is left in
proportion to the shorter context.  A text is scored from the longest context that the tree holds
at each place.

The count is fixed, so the tree grows with the corpus.  Words, contexts and next tokens are stored
tables and never leave the executors.  Texts are read in blocks, whose distinct words are counted
and coded part by part.  Each window of a token and those before it is then sent once, packed, to the
bucket of its last context token, where all lengths are tested and scored together, and the sums of
the gains go back to the texts.  A context with too many windows for one task is counted as rows, and
its windows are parted by the token before it.

``learn`` gives the whole tree of a few texts, length by length from stored tables.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, plain, store

# A context, and a next token kept with it, occurs so often in the training texts.
MIN_COUNT = 5
# Longest context.  A length without any diverging context does not end the tree: longer ones may diverge again.
DEPTH = 4
# Pseudo-count of the shorter context's distribution.
SMOOTH = 5.0
# A block is closed when it holds this many tokens (one text is never cut).
BLOCK_TOKENS = 1_500_000
END = b""


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered, and the end token."""
    found = text.encode().lower().split()
    found.append(END)
    return found


class _Numbers(dict):
    """Numbers words in the order of their first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


BLOCKS = "block long, doc_id long, held_out boolean, n long, ids binary, word binary, local long, trained long"
BLOCK_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]
BLOCK_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]


def _rows(**columns: list) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), t) for c, t in zip(BLOCK_NAMES, BLOCK_TYPES, strict=True)], BLOCK_NAMES)


def blocks(docs: DataFrame, held_out: Column, *, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Texts as numbers of their block's words (rows with ``ids``), and the words of each block (rows with ``word``)."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        pack = zstandard.ZstdCompressor(level=1).compress
        local, trained, held = _Numbers(), [], 0

        def close() -> Iterator[pa.RecordBatch]:
            counts = np.zeros(len(local), np.int64)
            for ids in trained:
                counts += np.bincount(ids, minlength=len(local))
            names = list(local)
            for i in range(0, len(names), 50_000):
                part = names[i : i + 50_000]
                yield _rows(block=[block] * len(part), word=part, local=list(range(i, i + len(part))), trained=counts[i : i + 50_000])

        for b in batches:
            ids_of, ns = [], []
            for text, out in zip(b.column("text").to_pylist(), b.column("held_out").to_pylist(), strict=True):
                ids = np.fromiter(map(local.__getitem__, tokens(text)), np.uint32)
                if not out:
                    trained.append(ids)
                ids_of.append(pack(ids.tobytes()))
                ns.append(len(ids))
            held += sum(ns)
            yield _rows(block=[block] * len(ns), doc_id=b.column("doc_id").to_pylist(), held_out=b.column("held_out").to_pylist(), n=ns, ids=ids_of)
            if held >= block_tokens:
                yield from close()
                block, local, trained, held = block + 1, _Numbers(), [], 0
        if local:
            yield from close()

    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return map_batches(rows, number, BLOCKS)


@dataclass
class Level:
    """Next tokens of the contexts of one length; each is also a context one longer."""

    # Sorted: number of the context times ``base``, plus the next token.
    keys: np.ndarray
    ids: np.ndarray
    # Log10 probability over the root's; NaN if the context is not in the tree.
    logs: np.ndarray
    # As a context: log10 of the share left to all other next tokens, over what the shorter context
    # gives them; NaN if it is not in the tree.
    rest: np.ndarray


@dataclass
class Tree:
    """A tree, or the part that a block asks for.  Tokens and contexts are numbered from 1; 0 is any other."""

    codes: np.ndarray
    rest: np.ndarray
    levels: list[Level] = field(default_factory=list)
    words: dict[bytes, int] = field(default_factory=dict)

    @property
    def base(self) -> int:
        return len(self.codes) + 1

    def number(self, codes: np.ndarray) -> np.ndarray:
        return _place(self.codes, codes) + 1

    def add(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, logs: np.ndarray, rest: np.ndarray) -> None:
        """A level of next tokens ``b`` of the contexts ``a``."""
        earlier = self.levels[-1].ids if self.levels else self.codes
        order = np.argsort(earlier)
        keys = (order[np.searchsorted(earlier, a, sorter=order)] + 1) * self.base + self.number(b) if len(a) else np.empty(0, np.int64)
        by_key = np.argsort(keys)
        self.levels.append(Level(keys[by_key], ids[by_key], logs[by_key], rest[by_key]))

    def walk(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the longest kind of context before each token, and the gain of each token."""
        gain, ends, rest = np.zeros(len(codes)), codes, self.rest
        for level in [*self.levels, None]:
            state = np.concatenate([[0], ends[:-1]])
            state[starts] = 0
            if level is None:
                return state, gain
            left = np.concatenate([[np.nan], rest])[state]
            at = _place(level.keys, np.where((state > 0) & (codes > 0), state * self.base + codes, -1))
            kept = np.concatenate([level.logs, [np.nan]])[at]
            gain = np.where(np.isnan(left), gain, np.where(at >= 0, kept, gain + left))
            ends, rest = at + 1, level.rest

    def gains(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log10 probability of each token over what the root gives it."""
        return self.walk(codes, starts)[1]


def _place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in sorted keys, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


# What a block is answered: its words (level 0: local number, count, code) and its kept pairs of
# context and next token.
ANSWERS = "of long, level int, a long, b long, id long, log double, rest double"
PAIRS = "block long, a long, b long, n long"


def _answers(rows: DataFrame, level: int) -> DataFrame:
    """Answers with all columns; a missing one is NULL."""
    columns = [F.lit(level).cast(t).alias(c) if c == "level" else (F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in map(str.split, ANSWERS.split(", "))]
    return rows.select(*columns)


def _numpy(rows: pa.Table, level: int) -> list[np.ndarray]:
    part = rows.filter(pa.compute.equal(rows.column("level"), level))
    return [part.column(c).to_numpy() for c in ("a", "b", "id", "log", "rest")]


def _part(rows: pa.Table, depth: int) -> tuple[Tree, np.ndarray, np.ndarray]:
    """The part of the tree that a block was answered, and the number and count of each of its words."""
    local, c, code, _, rest = _numpy(rows, 0)
    count, number = np.zeros(len(local)), np.zeros(len(local), np.int64)
    known = np.flatnonzero(code)
    known = known[np.argsort(code[known])]
    tree = Tree(code[known], rest[known].astype(float))
    count[local] = c
    number[local] = np.where(code > 0, tree.number(code), 0)
    for level in range(1, depth + 1):
        a, b, ids, log, rest = _numpy(rows, level)
        tree.add(a, b, ids, log.astype(float), rest.astype(float))
    return tree, number, count


def _texts(texts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The local word numbers of all texts of a block, one after the other, and where each text starts."""
    unpack, ns = zstandard.ZstdDecompressor().decompress, texts.column("n").to_pylist()
    ids = [np.frombuffer(unpack(x, max_output_size=4 * n), np.uint32) for n, x in zip(ns, texts.column("ids").to_pylist(), strict=True)]
    return np.concatenate(ids), np.cumsum([0, *ns])[:-1]


def pairs(texts: DataFrame, answers: DataFrame, depth: int) -> DataFrame:
    """Each block's distinct pairs of a context of ``depth`` tokens and its next token; ``n`` counts the training texts."""

    def count(key: tuple, rows: pa.Table, answered: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in PAIRS.split(", ")]
        if not rows.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        tree, number, _ = _part(answered, depth - 1)
        ids, starts = _texts(rows)
        codes = number[ids]
        state, _ = tree.walk(codes, starts)
        both = (state > 0) & (codes > 0)
        trained = np.repeat(~rows.column("held_out").to_numpy().astype(bool), rows.column("n").to_numpy())
        found, place = np.unique(state[both] * tree.base + codes[both], return_inverse=True)
        contexts = tree.levels[-1].ids if tree.levels else tree.codes
        a, b = contexts[found // tree.base - 1], tree.codes[found % tree.base - 1]
        n = np.bincount(place, trained[both], len(found)).astype(np.int64)
        return pa.table(dict(zip(names, [pa.array(np.full(len(found), key[0].as_py()), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n)], strict=True)))

    return texts.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(count, PAIRS)


def tested(rows: DataFrame) -> DataFrame:
    """Add ``p`` and ``log`` (NULL if the context ``a`` is not in the tree) and ``rest`` of the context.

    ``rows`` has the next tokens: ``a, total`` (count of the context), ``n, shorter, root`` (probabilities).
    """
    n, total, shorter = F.col("n"), F.col("total"), F.col("shorter")
    p = (n + SMOOTH * shorter) / (total + SMOOTH)
    sums = rows.groupBy("a").agg(
        F.first("total").alias("t"),
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("followed"),
        F.sum("shorter").alias("given"),
        F.sum(p).alias("kept"),
        F.sum(n / total * F.log(n / total / shorter)).alias("gain"),
    )
    left, left_shorter = F.greatest(F.col("t") - F.col("followed"), F.lit(0)), F.greatest(1 - F.col("given"), F.lit(1e-12))
    divergence = F.col("gain") + F.when(left > 0, left / F.col("t") * F.log(left / F.col("t") / left_shorter)).otherwise(0.0)
    inside = F.col("t") * divergence > (F.col("k") + 1) * F.log(F.col("t"))
    rest = F.when(inside, F.log10(F.greatest(1 - F.col("kept"), F.lit(1e-12)) / left_shorter))
    out = rows.join(sums.select("a", rest.alias("rest")), "a")
    out = out.withColumn("p", F.when(F.col("rest").isNotNull(), p).otherwise(shorter))
    return out.withColumn("log", F.when(F.col("rest").isNotNull(), F.log10(F.col("p") / F.col("root"))))


def coded(counts: DataFrame) -> DataFrame:
    """``word, c, id`` as a stored table."""
    return store(counts.select("word", "c", (F.monotonically_increasing_id() + 1).alias("id")))


def grow(numbered: DataFrame, counts: DataFrame, total: int, vocabulary: int, *, p_min: float, depth: int) -> list[DataFrame]:
    """The answers to the blocks, by length of context from 0 (the words); ``counts`` as of ``coded``."""
    least = max(MIN_COUNT, math.ceil(p_min * total))
    words = numbered.where(F.col("word").isNotNull()).select(F.col("block").alias("of"), "local", "word")
    texts = numbered.where(F.col("ids").isNotNull()).select("block", "held_out", "n", "ids")
    known = counts.withColumn("id", F.when(F.col("c") >= least, F.col("id")).otherwise(0))
    asked = words.join(known, "word", "left").select("of", F.col("local").alias("a"), F.coalesce("c", F.lit(0)).alias("b"), F.coalesce("id", F.lit(0)).alias("id"))
    levels, prior = [store(asked)], None
    root = (F.col("c") + 0.5) / (total + 0.5 * (vocabulary + 1))
    for length in range(1, depth + 1):
        answers = _answers(levels[0], 0)
        for i, x in enumerate(levels[1:], 1):
            answers = answers.unionByName(_answers(x, i))
        met = store(pairs(texts, answers, length))
        n = met.where("n > 0").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        kept = store(n.withColumn("id", F.monotonically_increasing_id() + 1))
        if length == 1:
            single = known.where("id > 0")
            of_context = single.select(F.col("id").alias("a"), F.col("c").alias("total"))
            of_next = single.select(F.col("id").alias("b"), root.alias("root"))
            # The context without its oldest token, one longer, ends in the next token alone.
            rows = kept.join(of_context, "a").join(of_next, "b").withColumns({"shorter": F.col("root"), "suffix": F.col("b")})
        else:
            of_context = prior.select(F.col("id").alias("a"), F.col("n").alias("total"), F.col("suffix").alias("short"))
            twin = prior.select(F.col("a").alias("short"), "b", F.col("p").alias("shorter"), "root", F.col("id").alias("suffix"))
            rows = kept.join(of_context, "a").join(twin, ["short", "b"]).drop("short")
        prior = store(tested(rows))
        if prior.isEmpty():
            break
        rests = prior.where("rest IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.first("rest").alias("rest"))
        levels[-1] = levels[-1].join(rests, "id", "left")
        levels.append(store(met.select(F.col("block").alias("of"), "a", "b").join(prior.select("a", "b", "id", "log"), ["a", "b"])))
    return levels


def learn(trained: DataFrame, counts: DataFrame, total: int, vocabulary: int, *, p_min: float = 0.0, depth: int = DEPTH) -> Tree:
    """The whole tree of a few training texts in memory; ``counts`` has ``word, c`` of all their tokens."""
    counts = coded(counts)
    levels = grow(store(blocks(trained, F.lit(False))), counts, total, vocabulary, p_min=p_min, depth=depth)
    first, *longer = [_answers(x, i).drop("of").distinct().toArrow() for i, x in enumerate(levels)]
    rest = dict(zip(first.column("id").to_pylist(), first.column("rest").to_numpy().astype(float), strict=True))
    codes = np.array(sorted(x for x in rest if x), np.int64)
    tree = Tree(codes, np.array([rest[x] for x in codes]))
    for i, x in enumerate(longer, 1):
        a, b, ids, log, left = _numpy(x, i)
        tree.add(a, b, ids, log.astype(float), left.astype(float))
    number = {int(x): i for i, x in enumerate(codes, 1)}
    tree.words = {bytes(r["word"]): number[r["id"]] for r in counts.collect() if r["id"] in number}
    return tree


# ------------------------------------------------------------------ scoring
# A word, by its hash, is counted in one of these parts.
PARTS = 64
# A task takes about so many windows (a token and the tokens before it) at a time; a context with
# more of them is heavy: its next tokens are counted as rows, and longer contexts part its windows.
BUCKET_WINDOWS = 1_000_000
# Sums of gains are exchanged in steps of this, so that their order does not matter.
GRAIN = 2.0**-40

NUMBERED = "block long, docs array<long>, held array<boolean>, ns array<long>, trained long, ids binary, part int, words binary, counts binary, all_counts binary"
CODED = "block long, part int, counts binary, codes binary, distinct long, heavy array<long>, sizes array<long>, firsts array<long>, steps array<long>"
MET = "block long, kind int, a long, b long, n long, c long"
SENT = "bucket long, block long, n_trained long, n_docs long, fields array<binary>, docs array<long>, held array<boolean>, ns array<long>"
GAINS = "block long, bucket long, at binary, gain binary, known binary, base binary, docs array<long>, held array<boolean>, ns array<long>"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
_ARROW |= {f"array<{k}>": pa.list_(v) for k, v in _ARROW.items()}


def _table(schema: str, **columns: list) -> pa.Table:
    """A table of ``schema``; a missing column is NULL."""
    rows = len(next(iter(columns.values()))) if columns else 0
    fields = [c.split() for c in schema.split(", ")]
    return pa.table({c: pa.array(columns.get(c, [None] * rows), _ARROW[t]) for c, t in fields})


def _pack(values: np.ndarray) -> bytes:
    """Numbers byte by byte of their places, so that small ones take little."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _by_rank(sizes: np.ndarray) -> np.ndarray:
    """Places of words sorted by part and rank, in the order of their numbers; ``sizes`` of the parts."""
    rank = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.argsort(rank, kind="stable")


def numbered_blocks(docs: DataFrame, held_out: Column, *, block_tokens: int) -> DataFrame:
    """One row per block of texts, as numbers of its words, and one per part of a block's words.

    In its part a word's rank follows its frequency in the block, then its bytes; words are numbered by
    rank, then part, so that frequent ones have small numbers.  Training texts come first.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        local, texts, size = _Numbers(), [], 0

        def close() -> Iterator[pa.RecordBatch]:
            names = list(local)
            part = np.fromiter((zlib.crc32(w) % PARTS for w in names), np.int64, len(names))
            texts.sort(key=lambda t: bool(t[1]))
            ns = [len(t[2]) for t in texts]
            ids = np.concatenate([t[2] for t in texts])
            trained = sum(n for n, t in zip(ns, texts, strict=True) if not t[1])
            counts, all_counts = np.bincount(ids[:trained], minlength=len(names)), np.bincount(ids, minlength=len(names))
            often = np.floor(np.log2(all_counts)).astype(np.int64)
            keys = list(zip(part.tolist(), (-often).tolist(), names, strict=True))
            order = np.array(sorted(range(len(names)), key=keys.__getitem__), np.int64)
            del keys
            ends = np.searchsorted(part[order], np.arange(PARTS + 1))
            number_of = np.empty(len(order), np.uint32)
            number_of[order[_by_rank(np.diff(ends))]] = np.arange(len(order))
            ids, counts, all_counts = number_of[ids], counts[order], all_counts[order]
            yield from _table(NUMBERED, block=[block], docs=[[t[0] for t in texts]], held=[[t[1] for t in texts]], ns=[ns], trained=[trained], ids=[_pack(ids)]).to_batches()
            cuts = [(p, a, b) for p, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if a < b]
            pack = zstandard.ZstdCompressor(level=3).compress
            yield from _table(
                NUMBERED,
                block=[block] * len(cuts),
                part=[p for p, _, _ in cuts],
                words=[pack(b" ".join([names[i] for i in order[a:b]])) for _, a, b in cuts],
                counts=[_pack(counts[a:b]) for _, a, b in cuts],
                all_counts=[_pack(all_counts[a:b]) for _, a, b in cuts],
            ).to_batches()

        for b in batches:
            for doc_id, out, text in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), b.column("text").to_pylist(), strict=True):
                texts.append((doc_id, out, np.fromiter(map(local.__getitem__, tokens(text)), np.uint32)))
                size += len(texts[-1][2])
            if size >= block_tokens:
                yield from close()
                block, local, texts, size = block + 1, _Numbers(), [], 0
        if texts:
            yield from close()

    return map_batches(docs.select("doc_id", held_out.alias("held_out"), "text"), number, NUMBERED)


@dataclass
class Counts:
    """What codes say of their words: in a part, ranks follow the counts, so a few steps hold them all."""

    # Sorted: part times 2**32, plus the first rank of a step.
    keys: np.ndarray
    values: np.ndarray

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The counts of codes, 0 of code 0."""
        if not len(self.keys):
            return np.zeros(len(codes), np.int64)
        part, rank = (codes.astype(np.int64) - 1) % PARTS, (codes.astype(np.int64) - 1) // PARTS
        found = self.values[np.maximum(np.searchsorted(self.keys, (part << 32) + rank, "right") - 1, 0)]
        return np.where(codes > 0, found, 0)


def coded_words(numbered: DataFrame, least: int, heavy: int) -> DataFrame:
    """The codes of each block's words; words in fewer than ``least`` training tokens have code 0, and ``counts`` has theirs.

    One row of each part names its number of words in training texts, its words of more than ``heavy``
    tokens with their ``sizes``, and the ``firsts`` ranks of its ``steps`` in the counts of coded words.
    """

    def code(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        unpack = zstandard.ZstdDecompressor().decompress
        words = [unpack(x).split(b" ") for x in rows.column("words").to_pylist()]
        found = pa.chunked_array([pa.array(x, pa.large_binary()) for x in words]).combine_chunks().dictionary_encode()
        place, size = found.indices.to_numpy(), len(found.dictionary)
        count, everywhere = (np.bincount(place, np.concatenate([_unpack(x, np.int64) for x in rows.column(c).to_pylist()]), size).astype(np.int64) for c in ("counts", "all_counts"))
        # The order of the blocks' words does not matter to the codes, that of their bytes breaks ties.
        often = np.flatnonzero(count >= least)
        often = often[np.lexsort((pa.compute.array_sort_indices(found.dictionary).to_numpy().argsort()[often], -count[often]))]
        codes = np.zeros(size, np.uint32)
        codes[often] = np.arange(len(often)) * PARTS + key[0].as_py() + 1
        large = np.flatnonzero((everywhere > heavy) & (codes > 0))
        firsts = np.flatnonzero(np.diff(count[often], prepend=-1))
        steps, more = count[often][firsts], [[]] * (len(words) - 1)
        distinct = int((count > 0).sum())
        count[often] = 0
        cuts = np.cumsum([0, *map(len, words)])
        places = [place[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return _table(
            CODED,
            block=rows.column("block").to_pylist(),
            part=rows.column("part").to_pylist(),
            counts=[_pack(count[x]) for x in places],
            codes=[_pack(codes[x]) for x in places],
            distinct=[distinct, *[0] * (len(places) - 1)],
            **{c: [[int(x) for x in v], *more] for c, v in (("heavy", codes[large]), ("sizes", everywhere[large]), ("firsts", firsts), ("steps", steps))},
        )

    return numbered.where("words IS NOT NULL").select("part", "block", "words", "counts", "all_counts").groupBy("part").applyInArrow(code, CODED)


@dataclass
class Heavy:
    """The heavy contexts of one length: sorted, the number of the shorter one times 2**32, plus the code of the oldest token."""

    keys: np.ndarray
    # Its windows.
    sizes: np.ndarray
    # As in ``Level``; NaN if it is not in the tree.
    rest: np.ndarray


def _in_heavy(back: list[np.ndarray], heavy: list[Heavy]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Length by length: the windows in a heavy context, and its number."""
    where, a = np.arange(len(back[0])), np.zeros(len(back[0]), np.int64)
    for level, c in zip(heavy, back, strict=False):
        a = _place(level.keys, (a << 32) + c[where])
        where, a = where[a >= 0], a[a >= 0]
        yield where, a


class _Block:
    """The windows of a block of texts that have a known token before the next one."""

    def __init__(self, texts: pa.Table, answers: pa.Table, counts: Counts, depth: int) -> None:
        row = texts.to_pylist()[0]
        self.docs, self.held, self.ns = row["docs"], row["held"], row["ns"]
        words = answers.sort_by("part")
        rare = [_unpack(x, np.int64) for x in words.column("counts").to_pylist()]
        order = _by_rank(np.array([len(x) for x in rare]))
        code = np.concatenate([_unpack(x, np.uint32) for x in words.column("codes").to_pylist()])[order]
        self.count = np.concatenate(rare)[order] + counts.of(code)
        self.ids = _unpack(row["ids"], np.uint32)
        self.starts = np.cumsum([0, *self.ns])[:-1]
        codes = code[self.ids]
        place = np.arange(len(codes), dtype=np.int32) - np.repeat(self.starts.astype(np.int32), self.ns)
        before = np.concatenate([[0], codes[:-1]])
        self.at = np.flatnonzero((place > 0) & (before > 0))
        place, self.back = place[self.at], []
        for k in range(1, depth + 1):
            c = codes[np.maximum(self.at - k, 0)]
            c[place < k] = 0
            if self.back:
                c[self.back[-1] == 0] = 0
            self.back.append(c)
        self.next, self.c = codes[self.at], self.count[self.ids[self.at]]
        self.doc = np.repeat(np.arange(len(self.ns), dtype=np.uint32), self.ns)[self.at]
        self.n_trained = sum(not x for x in self.held)
        self.trained = self.doc < self.n_trained


def met_by(numbered: DataFrame, answers: DataFrame, counts: Counts, heavy: list[Heavy], share: float, depth: int) -> DataFrame:
    """Each block's counts of what surrounds the longest heavy contexts.

    ``kind`` 0: next token, in training texts, with its count as a word in ``c``; 1: the token before, in all texts,
    if the block has more than ``share`` of it (fewer in every block are not too many in all).
    """

    def count(key: tuple, texts: pa.Table, answered: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _table(MET)
        block = _Block(texts, answered, counts, depth)
        *_, (where, a) = _in_heavy(block.back, heavy)
        found, first, place = np.unique((a << 32) + block.next[where], return_index=True, return_inverse=True)
        n = np.bincount(place, block.trained[where], len(found)).astype(np.int64)
        parts = [(0, found, n, block.c[where][first])]
        if len(heavy) < depth:
            older = block.back[len(heavy)][where]
            found, n = np.unique((a << 32)[older > 0] + older[older > 0], return_counts=True)
            parts.append((1, found[n > share], n[n > share], n[n > share]))
        kind, found, n, c = (np.concatenate(x) for x in zip(*((np.full(len(f), k), f, n, c) for k, f, n, c in parts), strict=True))
        return _table(MET, block=np.full(len(found), key[0].as_py()), kind=kind, a=found >> 32, b=found & 0xFFFFFFFF, n=n, c=c)

    texts = numbered.where("ids IS NOT NULL").select("block", "docs", "held", "ns", "ids")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(count, MET)


def _heavy(numbered: DataFrame, answers: DataFrame, counts: Counts, codes: dict[int, int], root: Column, least: int, limit: int, depth: int) -> tuple[list[Heavy], list[DataFrame]]:
    """The heavy contexts, length by length, and their next tokens that occur at least ``least`` times."""
    heavy, told = [], []
    keys, n_blocks = np.array(sorted(codes), np.int64), numbered.where("ids IS NOT NULL").count()
    while len(keys) and len(heavy) < depth:
        heavy.append(Heavy(keys, np.array([codes[x] for x in keys]), np.full(len(keys), np.nan)))
        met = store(met_by(numbered, answers, counts, heavy, limit / n_blocks, depth))
        follow = met.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("c").alias("c"))
        totals = follow.groupBy("a").agg(F.sum("n").alias("total"))
        rows = follow.where("b > 0").where(F.col("n") >= least).withColumn("root", root).join(totals, "a")
        if not told:
            rows = rows.withColumn("shorter", F.col("root"))
        else:
            # As many rows as there are heavy contexts.
            parents = numbered.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(keys >> 32)], "a long, parent long")
            rows = rows.join(F.broadcast(parents), "a").join(told[-1].select(F.col("a").alias("parent"), "b", F.col("p").alias("shorter")), ["parent", "b"])
        told.append(store(tested(rows).select("a", "b", "p", "log", "rest")))
        for r in told[-1].where("rest IS NOT NULL").groupBy("a").agg(F.first("rest").alias("rest")).collect():
            heavy[-1].rest[r["a"]] = r["rest"]
        older = met.where("kind = 1").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
        codes = {(r["a"] << 32) + r["b"]: r["n"] for r in older.collect()}
        keys = np.array(sorted(codes), np.int64)
    return heavy, told


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    mixed = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        mixed = (mixed ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _spread(level: Heavy, k: int, limit: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The first bucket of each heavy context of a length, and how many it has."""
    first = _mixed([level.keys, np.full(len(level.keys), k)]) % np.uint64(buckets)
    return first.astype(np.int64), np.minimum(1 + 2 * level.sizes // limit, buckets)


def _told(spark: SparkSession, heavy: list[Heavy], told: list[DataFrame], limit: int, buckets: int) -> DataFrame:
    """Next tokens of heavy contexts, in all buckets that have windows of theirs or of a longer one."""
    rows, longer = [], {}
    for k in reversed(range(len(heavy))):
        first, size = _spread(heavy[k], k, limit, buckets)
        for a, (x, n) in enumerate(zip(first.tolist(), size.tolist(), strict=True)):
            own = {(x + i) % buckets for i in range(n)} | longer.get((k, a), set())
            rows += [(k, a, bucket) for bucket in sorted(own)]
            if k:
                longer.setdefault((k - 1, int(heavy[k].keys[a] >> 32)), set()).update(own)
    out = spark.createDataFrame([], "bucket long, level int, a long, b long, p double, log double")
    for k, x in enumerate(told):
        places = spark.createDataFrame([r for r in rows if r[0] == k], "level int, a long, bucket long")
        out = out.unionByName(x.select("a", "b", "p", "log").join(F.broadcast(places), "a"))
    return out


def sent(numbered: DataFrame, answers: DataFrame, counts: Counts, heavy: list[Heavy], over: float, limit: int, buckets: int, depth: int) -> DataFrame:
    """Windows by bucket: all windows of a context that is not heavy meet in one.

    One more row per block, in a bucket of its own, has its texts and their base scores.
    """

    def send(key: tuple, texts: pa.Table, answered: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _table(SENT)
        block = _Block(texts, answered, counts, depth)
        bucket = (_mixed(block.back[:1]) % np.uint64(buckets)).astype(np.int64)
        for k, (where, a) in enumerate(_in_heavy(block.back, heavy)):
            first, size = _spread(heavy[k], k, limit, buckets)
            # Windows without a longer context may be anywhere.
            by = np.where(block.back[k + 1][where] > 0, block.back[k + 1][where], block.doc[where]) if k + 1 < depth else block.doc[where]
            bucket[where] = (first[a] + (_mixed([by]) % size[a].astype(np.uint64)).astype(np.int64)) % buckets
        base = np.add.reduceat(np.log10(block.count + 0.5)[block.ids] - over, block.starts)
        n_known = np.add.reduceat((block.count[block.ids] > 0).astype(np.int64), block.starts)
        whole = _table(SENT, bucket=[-1 - key[0].as_py()], block=key, fields=[[_pack(n_known), _pack(base)]], docs=[block.docs], held=[block.held], ns=[block.ns])
        pairs = [(x.astype(np.uint64) << np.uint64(32)) + y for x, y in itertools.batched([*block.back, *[np.uint32(0)] * (depth % 2)], 2)]
        order = np.lexsort(pairs[::-1])
        order = order[np.argsort(bucket[order].astype(np.uint16 if buckets < 65536 else np.int64), kind="stable")]
        names, cuts = np.unique(bucket[order], return_index=True)
        fields = []
        for x in np.split(order, cuts[1:]) if len(order) else []:
            last, *back = (c[x] for c in block.back)
            fields.append([_pack(v) for v in (np.diff(last, prepend=np.uint32(0)), *back, block.next[x], block.doc[x])])
        n = len(fields)
        return pa.concat_tables([whole, _table(SENT, bucket=names, block=[key[0].as_py()] * n, n_trained=[block.n_trained] * n, n_docs=[len(block.ns)] * n, fields=fields)])

    texts = numbered.where("ids IS NOT NULL").select("block", "docs", "held", "ns", "ids")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(send, SENT)


def _gains(columns: list[np.ndarray], least: int) -> np.ndarray:
    """The gain of each window; the tests are those of ``tested``.

    ``columns``, which are used up: the tokens before the next one, last first; the next token, whether
    it is in a training text, the length ``h`` of its heavy context, its probability by the root, and
    by that context, with the gain there.
    """
    order = np.lexsort(columns[-7::-1])
    for i in range(len(columns)):
        columns[i] = columns[i][order]
    *back, token, trained, h, root, p, gain = columns
    changed, alive = np.zeros(len(token), bool), np.arange(len(token), dtype=np.int32)
    changed[:1] = True
    for length, c in enumerate(back, 1):
        changed[1:] |= c[1:] != c[:-1]
        group = np.cumsum(changed, dtype=np.int32) - 1
        alive = alive[c[alive] > 0]
        here = alive[h[alive] < length]
        t = np.bincount(group[here], trained[here], group[-1] + 1 if len(group) else 0)
        often = t >= least
        alive = alive[often[group[alive]] | (h[alive] >= length)]
        here = here[often[group[here]]]
        if not len(here):
            continue
        context = np.cumsum(np.diff(group[here], prepend=group[here[0]]) > 0)
        t = np.bincount(context, trained[here])
        known = token[here] > 0
        _, first, pair = np.unique((context[known] << 32) + token[here][known], return_index=True, return_inverse=True)
        n = np.bincount(pair, trained[here][known], len(first))
        kept, shorter, of = n >= least, p[here][known][first], context[known][first]
        total = t[of]
        own = (n + SMOOTH * shorter) / (total + SMOOTH)

        def add(x: np.ndarray) -> np.ndarray:
            return np.bincount(of[kept], x[kept], len(t))  # noqa: B023

        with np.errstate(divide="ignore", invalid="ignore"):
            k, followed, given, used = add(np.ones(len(n))), add(n), add(shorter), add(own)
            left, left_shorter = np.maximum(t - followed, 0), np.maximum(1 - given, 1e-12)
            divergence = add(n / total * np.log(n / total / shorter)) + np.where(left > 0, left / t * np.log(left / t / left_shorter), 0.0)
            inside = (k > 0) & (t * divergence > (k + 1) * np.log(t))
            rest = np.log10(np.maximum(1 - used, 1e-12) / left_shorter)
        at = np.full(len(here), -1)
        at[known] = np.where(kept, np.arange(len(n)), -1)[pair]
        is_kept, is_inside = at >= 0, inside[context]
        p[here] = np.where(is_kept & is_inside, np.append(own, 0)[at], p[here])
        gain[here] = np.where(is_inside, np.where(is_kept, np.log10(p[here] / root[here]), gain[here] + rest[context]), gain[here])
    out = np.empty(len(order))
    out[order] = gain
    return out


def gained(windows: DataFrame, told: DataFrame, counts: Counts, heavy: list[Heavy], least: int, share: float, depth: int) -> DataFrame:
    """The sums of the gains by text, from each bucket to each block."""

    def solve(key: tuple, rows: pa.Table, answered: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table(GAINS)
        rows = rows.sort_by("block").to_pylist()
        if key[0].as_py() < 0:
            n_known, base = zip(*(r["fields"] for r in rows), strict=True)
            return _table(GAINS, block=[r["block"] for r in rows], known=list(n_known), base=list(base), **{c: [r[c] for r in rows] for c in ("docs", "held", "ns")})
        parts = []
        for r in rows:
            step, *back, token, doc = (_unpack(x, np.uint32) for x in r.pop("fields"))
            parts.append([doc, doc < r["n_trained"], token, *back[::-1], np.cumsum(step, dtype=np.uint32)])
        cuts = np.cumsum([len(x[0]) for x in parts])[:-1]
        # Each column leaves the parts as it is joined.
        columns = [np.concatenate([x.pop() for x in parts]) for _ in range(len(parts[0]))]
        *back, token, trained, doc = columns
        root = (counts.of(token) + 0.5) / share
        p, gain, h = root.copy(), np.zeros(len(token)), np.zeros(len(token), np.uint8)
        for k, (where, a) in enumerate(_in_heavy(back, heavy)):
            known = answered.filter(pa.compute.equal(answered.column("level"), k)).sort_by([("a", "ascending"), ("b", "ascending")])
            at = _place((known.column("a").to_numpy() << 32) + known.column("b").to_numpy(), (a << 32) + token[where])
            kept, log, rest = at >= 0, np.append(known.column("log").to_numpy().astype(float), np.nan)[at], heavy[k].rest[a]
            gain[where] = np.where(np.isnan(rest), gain[where], np.where(kept, log, gain[where] + rest))
            p[where[kept]] = known.column("p").to_numpy().astype(float)[at[kept]]
            h[where] = k + 1
        columns = [*back, token, trained, h, root, p, gain]
        del back, token, trained, h, root, p, gain
        ats, sums = [], []
        for r, d, g in zip(rows, np.split(doc, cuts), np.split(_gains(columns, least), cuts), strict=True):
            s = np.rint(np.bincount(d, g, r["n_docs"]) / GRAIN).astype(np.int64)
            at = np.flatnonzero(s)
            ats.append(_pack(np.diff(at, prepend=0).astype(np.uint32)))
            sums.append(_pack((s[at] << 1) ^ (s[at] >> 63)))
        return _table(GAINS, block=[r["block"] for r in rows], bucket=[key[0].as_py()] * len(rows), at=ats, gain=sums)

    return windows.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(solve, GAINS)


def score(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", p_min: float = 0.0, depth: int = DEPTH, block_tokens: int = BLOCK_TOKENS, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """Learn from the rows that are not held out and score all rows; columns as in ``SCORED``.

    ``held_out`` is a condition on ``doc_id``.  A NULL or empty text is its end token alone.
    Repeated rows are counted and scored each.  ``p_min`` asks for contexts and next tokens of
    at least this share of all training tokens besides their least count.
    """
    rows = plain(docs, id_col, text_col)
    numbered = store(numbered_blocks(rows, held_out, block_tokens=block_tokens))
    seen = numbered.agg(F.coalesce(F.sum("trained"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.aggregate("ns", F.lit(0).cast("long"), lambda x, y: x + y)), F.lit(0)).alias("n_all")).first()
    total, buckets = int(seen["n"]), 1 + int(seen["n_all"]) // bucket_windows
    least = max(MIN_COUNT, math.ceil(p_min * total))
    # Fewer, for a heavy context comes on top of what else falls into its bucket.
    limit = max(1, bucket_windows * 7 // 8)
    coded = store(coded_words(numbered, least, limit))
    distinct = int(coded.agg(F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()["v"])
    codes, steps = {}, {}
    for r in coded.where(F.size("steps") > 0).select("part", "heavy", "sizes", "firsts", "steps").collect():
        codes |= zip(r["heavy"], r["sizes"], strict=True)
        steps |= zip(((r["part"] << 32) + x for x in r["firsts"]), r["steps"], strict=True)
    counts = Counts(np.array(sorted(steps), np.int64), np.array([steps[x] for x in sorted(steps)], np.int64))
    answers, share = coded.select("block", "part", "counts", "codes"), total + 0.5 * (distinct + 1)
    heavy, told = _heavy(numbered, answers, counts, codes, (F.col("c") + 0.5) / share, least, limit, depth)
    windows = sent(numbered, answers, counts, heavy, math.log10(share), limit, buckets, depth)
    gains = gained(windows, _told(docs.sparkSession, heavy, told, limit, buckets), counts, heavy, least, share, depth)

    def scored(key: tuple, rows: pa.Table) -> pa.Table:
        whole, *rows = sorted(rows.to_pylist(), key=lambda r: -1 if r["bucket"] is None else r["bucket"])
        n_known, base = _unpack(whole["known"], np.int64), _unpack(whole["base"], float)
        sums = np.zeros(len(base), np.int64)
        for r in rows:
            s = _unpack(r["gain"], np.int64)
            sums[np.cumsum(_unpack(r["at"], np.uint32))] += (s >> 1) ^ -(s & 1)
        return _table(SCORED, doc_id=whole["docs"], held_out=whole["held"], n_tokens=whole["ns"], n_known=n_known, train_tokens=[total] * len(base), base_score=base, score=base + sums * GRAIN)

    return gains.groupBy("block").applyInArrow(scored, SCORED)
