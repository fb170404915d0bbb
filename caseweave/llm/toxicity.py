"""Toxicity by compression distance.

The library trains two zstandard dictionaries: one on windows of eight words of ordinary texts, one
on the words of toxic texts that hold a character run which sets these texts apart.  Given whole
windows of toxic texts, the trainer mostly picks the language that both classes share.  Every window
of a text is compressed with the ordinary dictionary, and with the toxic one laid before it, so that
the shared language costs the same in both; the bytes saved are the window's gain.  A calibrated
threshold tells which gains count, and a logistic curve fitted on texts that no dictionary has seen
turns a text's gains into a score.

The model is fitted on a bounded sample (``SAMPLE`` labelled texts of each class, none longer than
``SAMPLE_CHARS``), scoring reads every window of every text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, plain, remainder

SAMPLE = 1_500
SAMPLE_CHARS = 50_000
WORDS = 8
# Longer runs without white space are cut, so that a window stays a window.
WORD_CHARS = 64
# A lazy search with short matches: faster ones index a dictionary sparsely.  Stated in full, since a
# level means other settings for a dictionary of another size, and both sides must be searched alike.
SEARCH = {"chain_log": 18, "hash_log": 17, "search_log": 6, "min_match": 4, "target_length": 32, "strategy": zstandard.STRATEGY_BTLAZY2}
ORDINARY_BYTES = 13_800
# Characters in a row that the toxic dictionary's samples are chosen by.
RUN = 5
# Words that toxic texts hold so often are samples of the toxic dictionary, which has room for each so many times.
TOXIC_COUNT, TOXIC_ROOM = 3, 2
# The trainer's units for the toxic dictionary: a short word counts whole, and a segment takes a few words.
TOXIC_UNITS = {"d": 6, "k": 64}
REJECT = 0.3
MARKS = ".,;:!?\"'()[]{}«»¿¡-"


def words(text: str) -> list[str]:
    found = text.lower().split()
    if any(len(w) > WORD_CHARS for w in found):
        found = [w[i : i + WORD_CHARS] for w in found for i in range(0, len(w), WORD_CHARS)]
    return found


def windows(text: str) -> list[bytes]:
    w = words(text)
    return [f" {' '.join(w[i : i + WORDS])} ".encode() for i in range(0, len(w), WORDS)]


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    threshold: int
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]

    def gains(self):
        """A function from a text to the gains of its windows."""

        window = max(18, (len(self.toxic) + len(self.ordinary)).bit_length() + 1)
        search = zstandard.ZstdCompressionParameters(window_log=window, write_content_size=False, write_dict_id=False, **SEARCH)

        def packer(content: bytes):
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(dict_data=data, compression_params=search).compress

        if not self.toxic:
            return lambda text: np.zeros(len(windows(text)))
        plain_size, toxic_size = packer(self.ordinary), packer(self.toxic + self.ordinary)
        return lambda text: np.array([len(plain_size(w)) - len(toxic_size(w)) for w in windows(text)], float)

    def score(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.centre) / self.scale @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(gains: np.ndarray, threshold: int) -> list[float]:
    if not len(gains):
        return [0.0] * 4
    hits = float((gains >= threshold).sum())
    return [float(np.clip(gains.max(), 0, 16)), math.log1p(hits), hits / len(gains), float(gains.max() >= threshold)]


def _apart(texts: Sequence[str]) -> list[str]:
    """Without near copies: at least half of a text's five-word runs must be new."""
    seen: set[int] = set()
    out = []
    for t in texts:
        w = words(t)
        runs = {hash(tuple(w[i : i + 5])) for i in range(max(1, len(w) - 4))}
        if len(runs & seen) * 2 <= len(runs):
            out.append(t)
        seen |= runs
    return out


def _trained(size: int, samples: list[bytes], **units: int) -> bytes:
    """Content of a trained dictionary; small samples serve as they are."""
    try:
        return zstandard.train_dictionary(size + 256, samples, **units).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def _runs(word: str) -> list[str]:
    w = f" {word.strip(MARKS)} "
    return [w[i : i + RUN] for i in range(max(1, len(w) - RUN + 1))]


def _contrast(toxic: Sequence[str], ordinary: Sequence[str]) -> set[str]:
    """Character runs in words that are far more common among toxic texts than chance explains."""

    def texts_with(texts: Sequence[str]) -> Counter:
        found: Counter = Counter()
        for t in texts:
            found.update({r for w in set(words(t)) for r in _runs(w)})
        return found

    a, b, n_a, n_b = texts_with(toxic), texts_with(ordinary), len(toxic), len(ordinary)
    z = {}
    for r, c in a.items():
        if c > 1 and c / n_a > 4 * (b[r] + 1) / n_b:
            p = (c + b[r]) / (n_a + n_b)
            z[r] = (c / n_a - b[r] / n_b) / math.sqrt(p * (1 - p) * (1 / n_a + 1 / n_b) + 1e-12)
    # About one run would pass by chance.
    least = NormalDist().inv_cdf(1 - 1 / max(2, len(a)))
    return {r for r, x in z.items() if x >= least}


def _telling(toxic: Sequence[str], runs: set[str]) -> list[bytes]:
    """The words of toxic texts that hold one of the runs, as often as they occur, but for rare ones."""
    found = [f" {word.strip(MARKS)} ".encode() for t in toxic for word in words(t) if not runs.isdisjoint(_runs(word))]
    counts = Counter(found)
    return [w for w in found if counts[w] >= TOXIC_COUNT]


def _spread(samples: list[bytes], n: int) -> list[bytes]:
    return samples[:: max(1, len(samples) // n)][:n]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps for a ridge-regularised logistic curve; the first weight is the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [0.1] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge @ w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, grad)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _dictionaries(toxic: Sequence[str], ordinary: Sequence[str]) -> tuple[bytes, bytes]:
    base = _trained(ORDINARY_BYTES, _spread([w for t in ordinary for w in windows(t)], 40_000))
    runs = _contrast(toxic, ordinary) if toxic and ordinary else set()
    samples = _telling(toxic, runs)
    return base, _trained(TOXIC_ROOM * sum(map(len, set(samples))), samples, **TOXIC_UNITS) if samples else b""


def fit(rows: Sequence[tuple[str, int]], share: float | None = None) -> Model:
    """A model from labelled texts; ``share`` is the share of toxic ones among all labelled texts.

    Calibration sees each text through dictionaries trained without it (three folds); the
    dictionaries of the model are trained on all of them.  Without a toxic text every text scores
    below ``REJECT``, so that none is dropped.
    """
    rows = list(dict.fromkeys(rows))
    sides = {y: _apart([t for t, label in rows if label == y]) for y in (0, 1)}
    gains, y = [], []
    for fold in range(3):
        learn = {k: [t for i, t in enumerate(s) if i % 3 != fold] for k, s in sides.items()}
        gains_of = Model(*_dictionaries(learn[1], learn[0]), 1, (), (), ()).gains()
        hold = [(t, k) for k, s in sides.items() for i, t in enumerate(s) if i % 3 == fold]
        gains += [gains_of(t) for t, _ in hold]
        y += [k for _, k in hold]
    y, both = np.array(y, float), _dictionaries(sides[1], sides[0])
    if y.sum() in (0, len(y)):
        rate = (y.sum() + 0.5) / (len(y) + 1)
        if not y.sum():
            rate = min(rate, REJECT / 2)
        return Model(*both, 4, (math.log(rate / (1 - rate)), 0.0, 0.0, 0.0, 0.0), (0.0,) * 4, (1.0,) * 4)
    best = np.array([g.max(initial=0) for g in gains])
    parts = [(best[y == 1] >= t).mean() - (best[y == 0] >= t).mean() for t in range(1, 13)]
    threshold = int(np.argmax(parts)) + 1
    x = np.array([features(g, threshold) for g in gains])
    centre, scale = x.mean(0), x.std(0) + 1e-6
    weights = _logistic((x - centre) / scale, y)
    if share is not None and 0 < share < 1:
        # The sample holds more toxic texts than the corpus.
        weights[0] += math.log(share / (1 - share)) - math.log(y.mean() / (1 - y.mean()))
    return Model(*both, threshold, tuple(weights), tuple(centre), tuple(scale))


def sample(docs: DataFrame, labels: DataFrame, *, each: int = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[list[tuple[str, int]], float | None]:
    """At most ``each`` labelled texts of either class, and the share of toxic ones among all labelled rows.

    Held-out ids are left out; ids are chosen by a hash and their texts bounded in length.  A
    document with several labels counts as toxic if one says so; an id with several texts gives the
    smallest.  All texts are read once for both classes.
    """
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y"))
    marked = marked.where(remainder(F.col("id"), 4) != 2).groupBy("id").agg(F.max("y").alias("y"))
    ordinary, toxic = (marked.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(each) for y in (0, 1))
    named = plain(docs).where(F.length("text") <= chars).select(F.col("doc_id").alias("id"), "text")
    found = named.join(ordinary.unionByName(toxic), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    return [(r["text"], r["y"]) for r in found.orderBy("y", F.xxhash64("id"), "id").collect()], marked.agg(F.avg("y")).first()[0]


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, windows, hits``: one row per row of ``docs``; empty and NULL texts have no window and a low score."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains_of = model.gains()
        for b in batches:
            gains = [gains_of(t) for t in b.column("text").to_pylist()]
            x = np.array([features(g, model.threshold) for g in gains]).reshape(-1, 4)
            counts = [pa.array([len(g) for g in gains], pa.int64()), pa.array([int((g >= model.threshold).sum()) for g in gains], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x), pa.float64()), *counts], ["doc_id", "score", "windows", "hits"])

    return map_batches(plain(docs, id_col, text_col), each, "doc_id long, score double, windows long, hits long")


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled rows whose id is not held out."""
    return fit(*sample(docs, labels))


def accepted(docs: DataFrame, model: Model, *, reject: float = REJECT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below ``reject``, with all their columns."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains_of = model.gains()
        for b in batches:
            x = np.array([features(gains_of(t or ""), model.threshold) for t in b.column(text_at).to_pylist()]).reshape(-1, 4)
            yield b.filter(pa.array(model.score(x) < reject))

    # Batches are handed over under plain names, since a column may have any.
    text_at = docs.columns.index(text_col)
    renamed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return renamed.mapInArrow(kept, renamed.schema).toDF(*docs.columns)
