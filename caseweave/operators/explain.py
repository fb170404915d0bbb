"""Explaining a group: exact gap decomposition, effect sizes, distributions, headroom."""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.exprs import all_named, elapsed, holds, join_on, named
from ..functions.intervals import newcombe, z_of
from ..functions.ordered import SORTED_AT_ONCE, quantile_rows, quantiles, running
from ..session import store
from .backlog import constraint_rows, group_scores, label_keys, overall
from .norm import Constraint, Norm, long_form

# Differences tried per constraint and pass.
TRIALS = 16
# The blocks that the values are cut into: values in one at least, and how many there are at most.
VALUES_PER_BLOCK = 2_000
BLOCKS = 4_000


# --------------------------------------------------------------------------- waterfall
def contrast(scored: DataFrame, norm: Norm, view: str, where: Column, level: float = 0.95) -> DataFrame:
    """Per constraint: mean penalties of slice, all and rest, and the rates with their risk difference.

    ``delta`` sums exactly to the signed gap of the slice.
    """
    inside = holds(where)

    def part(c: Column, side: str) -> Column:
        return c if side == "all" else F.when(inside if side == "slice" else ~inside, c)

    fields = {}
    for side in ("slice", "all", "rest"):
        fields[f"mean_penalty_{side}"] = lambda c, s=side: F.avg(part(named(f"p__{view}__{c.id}"), s))
    for side in ("slice", "rest"):
        fields[f"n_evaluated_{side}"] = lambda c, s=side: F.count(part(named(f"v__{c.id}"), s))
        fields[f"n_violated_{side}"] = lambda c, s=side: F.count(part(F.when(named(f"v__{c.id}") > 0, 1), s))
        fields[f"mean_violation_{side}"] = lambda c, s=side: F.avg(part(named(f"v__{c.id}"), s))
        fields[f"share_in_scope_{side}"] = lambda c, s=side: F.avg(part(named(f"s__{c.id}").cast("double"), s))
        fields[f"share_evaluated_{side}"] = lambda c, s=side: F.avg(part(named(f"v__{c.id}").isNotNull().cast("double"), s))
    score = named(f"score__{view}")
    gap = (F.avg(named(score)) - F.avg(F.when(inside, score))).alias("signed_gap")
    out = constraint_rows(scored.where(score.isNotNull()), norm, fields, extra=[gap])
    x1, n1 = F.col("n_violated_slice"), F.col("n_evaluated_slice")
    x2, n2 = F.col("n_violated_rest"), F.col("n_evaluated_rest")
    low, high = newcombe(x1, n1, x2, n2, z_of(level))
    rate1, rate2 = F.when(n1 > 0, x1 / n1), F.when(n2 > 0, x2 / n2)
    return out.withColumns(
        {
            "delta": F.col("mean_penalty_slice") - F.col("mean_penalty_all"),
            "delta_vs_rest": F.col("mean_penalty_slice") - F.col("mean_penalty_rest"),
            "share_of_gap": F.when(
                F.col("signed_gap") != 0, (F.col("mean_penalty_slice") - F.col("mean_penalty_all")) / F.col("signed_gap")
            ),
            "rate_slice": rate1,
            "rate_rest": rate2,
            "risk_difference": rate1 - rate2,
            "rd_low": low,
            "rd_high": high,
            "relative_risk": F.when(rate2 > 0, rate1 / rate2),
        }
    ).drop("position", "signed_gap")


def contrast_layers(waterfall: DataFrame) -> DataFrame:
    cols = ("mean_penalty_slice", "mean_penalty_all", "mean_penalty_rest", "delta", "delta_vs_rest")
    return waterfall.groupBy("layer").agg(*[F.sum(named(c)).alias(c) for c in cols])


# --------------------------------------------------------------------------- effect sizes on raw signals
def sides(scored: DataFrame, norm: Norm, view: str, where: Column) -> DataFrame:
    """Defined raw signals of scored cases: ``constraint_id, x, in_slice, case_id``."""
    rows = scored.where(named(f"score__{view}").isNotNull()).withColumn("in_slice", holds(where))
    return long_form(rows, norm, view, ["case_id", "in_slice"]).where(F.col("x").isNotNull()).select(
        "constraint_id", "x", "in_slice", "case_id"
    )


def _histogram(signals: DataFrame) -> DataFrame:
    return signals.groupBy("constraint_id", "x").agg(
        F.count_if("in_slice").alias("a"), F.count_if(~F.col("in_slice")).alias("b")
    )


def _totals(hist: DataFrame) -> DataFrame:
    return hist.groupBy("constraint_id").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))


def cliffs_delta(signals: DataFrame) -> DataFrame:
    """P(slice > rest) - P(slice < rest) per constraint, exact with ties, from value counts."""
    hist = store(_histogram(signals))
    run = running(hist, ["constraint_id"], [F.asc("x")], {"__b": F.col("b")})
    rows = join_on(run, _totals(hist), ["constraint_id"])
    below = F.col("__b") - F.col("b")
    above = F.col("n_b") - F.col("__b")
    wins = F.sum((F.col("a") * (below - above)).cast("double"))
    out = rows.groupBy("constraint_id").agg(F.max("n_a").alias("n_slice"), F.max("n_b").alias("n_rest"), wins.alias("w"))
    pairs = F.col("n_slice").cast("double") * F.col("n_rest")
    return out.select("constraint_id", "n_slice", "n_rest", F.when(pairs > 0, F.col("w") / pairs).alias("cliffs_delta"))


def hodges_lehmann(signals: DataFrame) -> DataFrame:
    """Median of the pairwise differences slice - rest per constraint, over all pairs.

    Works on counted values and never forms pairs: each pass counts, for a few trial differences
    per constraint, the pairs above them, and narrows the bracket around the median rank.  The
    bracket ends at an actual difference, or at 1e-12 of the range.  Non-finite signals are left
    out; a constraint with an empty side has a NULL shift.

    The values are cut into blocks in their order.  The ends and counts of the blocks, a bounded
    number of rows, settle most pairs of blocks; only the two or so blocks of the rest that a
    difference cuts through are compared value by value with each block of the slice.
    """
    x = F.col("x").cast("double")
    blocks = _blocks(store(_histogram(signals.withColumn("x", x).where(F.abs("x") < float("inf")))))
    ends = blocks.select("constraint_id", "block", *[F.try_element_at(f"{c}_x", F.lit(i)).alias(f"{n}_{c}") for c in "ab" for n, i in (("min", 1), ("max", -1))], "n_a", "n_b")
    found: dict[str, list[Row]] = {}
    for r in ends.collect():
        found.setdefault(r["constraint_id"], []).append(r)
    sides = {c: _Ends.of(rows) for c, rows in found.items()}
    sides = {c: s for c, s in sides.items() if s.n_a and s.n_b}
    brackets = {c: s.bracket() for c, s in sides.items()}
    trials = {c: sides[c].trials(b) for c, b in brackets.items() if not b.done}
    while trials:
        counted = _cut_pairs(blocks, sides, trials)
        for c, ds in trials.items():
            rows = []
            for d in ds:
                (above, after), (more, nearer) = sides[c].surely(d), counted.get((c, d), (0, None))
                rows.append((d, above + more, min((v for v in (after, nearer) if v is not None), default=None)))
            brackets[c].narrow(rows)
        trials = {c: b.trials() for c, b in brackets.items() if not b.done}
    shift = F.lit(None).cast("double")
    for c, b in brackets.items():
        shift = F.when(F.col("constraint_id") == c, F.lit(b.median)).otherwise(shift)
    return signals.select("constraint_id").distinct().withColumn("hl_shift", shift)


def _blocks(hist: DataFrame) -> DataFrame:
    """The counted values in blocks of their order: per side the sorted values, their counts and the sum of these.

    There are at most about ``BLOCKS`` blocks, so their ends fit the driver whatever the input.
    """
    n = hist.count()
    size = max(VALUES_PER_BLOCK, -(-n // BLOCKS))
    order = [F.col("constraint_id").asc_nulls_first(), F.col("x").asc()]
    dealt = hist.repartitionByRange(max(1, -(-n // SORTED_AT_ONCE)), *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    first = F.shiftleft(F.shiftright(F.col("id"), 33), 33)
    dealt = store(dealt.withColumn("block", (first + F.floor((F.col("id") - first) / F.lit(size))).cast("bigint")).drop("id"))
    lists = [F.array_sort(F.collect_list(F.when(named(c) > 0, F.struct(F.col("x"), named(c).alias("n"))))).alias(c) for c in "ab"]
    packed = dealt.groupBy("constraint_id", "block").agg(*lists, F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    sides = [F.col(c).getField(f).alias(f"{c}_{f}") for c in "ab" for f in ("x", "n")]
    return store(packed.select("constraint_id", "block", *sides, "n_a", "n_b"))


@dataclass
class _Ends:
    """Number, smallest and largest value of each block that holds values of a side, in their order."""

    a: np.ndarray
    b: np.ndarray
    # The blocks' counts, and the running counts of side b from 0.
    count_a: np.ndarray
    upto_b: np.ndarray
    id_a: np.ndarray
    id_b: np.ndarray

    @classmethod
    def of(cls, rows: Sequence[Row]) -> _Ends:
        rows = sorted(rows, key=lambda r: r["block"])
        a, b = ([r for r in rows if r[f"n_{c}"]] for c in "ab")
        ends = [np.array([(r[f"min_{c}"], r[f"max_{c}"]) for r in side], dtype=float).reshape(-1, 2) for c, side in (("a", a), ("b", b))]
        counts = [np.array([r[f"n_{c}"] for r in side], dtype=object) for c, side in (("a", a), ("b", b))]
        ids = [np.array([r["block"] for r in side], dtype=np.int64) for side in (a, b)]
        return cls(*ends, counts[0], np.array([0, *np.cumsum(counts[1])], dtype=object), *ids)

    @property
    def n_a(self) -> int:
        return int(sum(self.count_a))

    @property
    def n_b(self) -> int:
        return int(self.upto_b[-1])

    def bracket(self) -> _Bracket:
        lo, hi = float(self.a[0, 0] - self.b[-1, 1]), float(self.a[-1, 1] - self.b[0, 0])
        width = 1e-12 * max(abs(lo), abs(hi), hi - lo)
        return _Bracket(self.n_a * self.n_b, lo - width, hi + width, width, after_lo=lo, done=lo == hi)

    def cut(self, d: float) -> tuple[np.ndarray, np.ndarray]:
        """Per block of a: how many blocks of b lie wholly, and how many at least partly, more than ``d`` below it."""
        return np.searchsorted(self.b[:, 1], self.a[:, 0] - d, side="left"), np.searchsorted(self.b[:, 0], self.a[:, 1] - d, side="left")

    def surely(self, d: float) -> tuple[int, float | None]:
        """Pairs in blocks that lie wholly more than ``d`` apart, and the smallest difference of these."""
        whole, _ = self.cut(d)
        near = (self.a[:, 0] - self.b[np.maximum(whole - 1, 0), 1])[whole > 0]
        return int((self.count_a * self.upto_b[whole]).sum()), float(near.min()) if len(near) else None

    def trials(self, bracket: _Bracket) -> list[float]:
        """Differences around the median as the ends of the blocks bound it, for the first pass."""
        half, lo, hi = (bracket.pairs - 1) // 2, [bracket.lo, bracket.hi], [bracket.lo, bracket.hi]
        for _ in range(60):
            d, e = (lo[0] + lo[1]) / 2, (hi[0] + hi[1]) / 2
            lo = [d, lo[1]] if bracket.pairs - self.surely(d)[0] <= half else [lo[0], d]
            most = int((self.count_a * self.upto_b[self.cut(e)[1]]).sum())
            hi = [hi[0], e] if bracket.pairs - most > half else [e, hi[1]]
        first, last = lo[0] - bracket.width, hi[1] + bracket.width
        points = {first + (last - first) / TRIALS * i for i in range(TRIALS + 1)}
        return sorted(p for p in points if bracket.lo < p < bracket.hi) or bracket.trials()


def _cut_pairs(blocks: DataFrame, sides: Mapping[str, _Ends], trials: Mapping[str, list[float]]) -> dict[tuple[str, float], tuple[int, float | None]]:
    """Per constraint and difference: the pairs above it, and the smallest such difference, in the pairs of blocks it cuts through."""
    cut: dict[tuple[str, int, int], list[float]] = {}
    for c, ds in trials.items():
        s = sides[c]
        for d in ds:
            whole, partly = s.cut(d)
            for i, (first, last) in enumerate(zip(whole, partly, strict=True)):
                for j in range(first, last):
                    cut.setdefault((c, int(s.id_a[i]), int(s.id_b[j])), []).append(d)
    if not cut:
        return {}
    spark = blocks.sparkSession
    table = pa.table({"constraint_id": [k[0] for k in cut], "a": [k[1] for k in cut], "b": [k[2] for k in cut], "ds": pa.array(list(cut.values()), pa.list_(pa.float64()))})
    links = spark.createDataFrame(table)
    a = blocks.select("constraint_id", F.col("block").alias("a"), "a_x", "a_n")
    b = blocks.select("constraint_id", F.col("block").alias("b"), "b_x", "b_n")
    rows = links.join(a, ["constraint_id", "a"]).join(b, ["constraint_id", "b"]).select("constraint_id", "ds", "a_x", "a_n", "b_x", "b_n")
    counted = rows.mapInArrow(_count_cut, "constraint_id string, d double, above decimal(38,0), next_d double")
    total = counted.groupBy("constraint_id", "d").agg(F.sum("above").alias("above"), F.min("next_d").alias("next_d"))
    return {(r["constraint_id"], r["d"]): (int(r["above"]), r["next_d"]) for r in total.collect()}


def _count_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of two sorted blocks that differ by more than each of a few differences."""
    for batch in batches:
        out: dict[str, list] = {"constraint_id": [], "d": [], "above": [], "next_d": []}
        for i in range(batch.num_rows):
            x, n, y, m = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in ("a_x", "a_n", "b_x", "b_n"))
            upto = np.concatenate(([0], np.cumsum(m)))
            for d in batch.column("ds")[i].as_py():
                below = np.searchsorted(y, x - d, side="left")
                near = (x - y[np.maximum(below - 1, 0)])[below > 0]
                out["constraint_id"].append(batch.column("constraint_id")[i].as_py())
                out["d"].append(d)
                out["above"].append(decimal.Decimal(int(np.dot(n, upto[below]))))
                out["next_d"].append(float(near.min()) if len(near) else None)
        types = {"constraint_id": pa.string(), "d": pa.float64(), "above": pa.decimal128(38, 0), "next_d": pa.float64()}
        yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in types.items()], list(types))


@dataclass
class _Bracket:
    """Where the middle ranks of the sorted differences lie: at most half are ``<= lo``, more than half ``<= hi``."""

    pairs: int
    lo: float
    hi: float
    width: float
    # Pairs above ``hi``, and the smallest differences above ``lo`` and ``hi``.
    above_hi: int = 0
    after_lo: float | None = None
    after_hi: float | None = None
    done: bool = False

    def trials(self) -> list[float]:
        """Evenly spaced differences, and one just above the smallest that the bracket holds."""
        step = (self.hi - self.lo) / TRIALS
        points = {self.lo + step * i for i in range(1, TRIALS)} | {self.after_lo + self.width}
        return sorted(p for p in points if self.lo < p < self.hi) or [self.hi]

    def narrow(self, rows: list[tuple[float, int, float | None]]) -> None:
        before = self.lo, self.hi
        for d, above, after in sorted(rows, reverse=True):
            if self.pairs - above > (self.pairs - 1) // 2:
                self.hi, self.above_hi, self.after_hi = d, above, after
            else:
                self.lo, self.after_lo = d, after
                break
        self.done = self.hi <= self.after_lo + 2 * self.width or (self.lo, self.hi) == before

    @property
    def median(self) -> float:
        both = self.pairs - self.above_hi > self.pairs // 2 or self.after_hi is None
        return self.after_lo if both else (self.after_lo + self.after_hi) / 2


def quantile_shifts(signals: DataFrame, widths: Mapping[str, float], min_evaluated: int = 20) -> DataFrame:
    """Median and Q90 shift per constraint, and whether the whole distribution or its tail moved.

    The tolerance is 5 % of the constraint's width, or of the pooled interquartile range.
    """
    signals = store(signals.select("constraint_id", "x", "in_slice"))
    probs = {"q50": 0.5, "q90": 0.9}
    q = quantiles(signals, ["constraint_id", "in_slice"], "x", probs)
    n = signals.groupBy("constraint_id", "in_slice").agg(F.count(F.lit(1)).alias("n"))
    q = join_on(q, n, ["constraint_id", "in_slice"])

    def side(flag: bool, tag: str) -> DataFrame:
        return q.where(F.col("in_slice") == flag).select("constraint_id", *[named(c).alias(f"{c}_{tag}") for c in ("q50", "q90", "n")])

    pooled = quantiles(signals, ["constraint_id"], "x", {"q25": 0.25, "q75": 0.75})
    out = side(True, "slice").join(side(False, "rest"), "constraint_id").join(pooled, "constraint_id")
    out = out.where((F.col("n_slice") >= min_evaluated) & (F.col("n_rest") >= min_evaluated))
    width = F.lit(0.0)
    for cid, w in widths.items():
        width = F.when(F.col("constraint_id") == cid, F.lit(float(w))).otherwise(width)
    iqr = F.col("q75") - F.col("q25")
    tol = 0.05 * F.when(width > 0, width).when(iqr > 0, iqr).otherwise(1.0)
    d50, d90 = F.col("q50_slice") - F.col("q50_rest"), F.col("q90_slice") - F.col("q90_rest")
    positive = F.least("q50_slice", "q50_rest", "q90_slice", "q90_rest") > 0
    s50 = F.when(positive, F.ln(F.col("q50_slice") / F.col("q50_rest"))).otherwise(d50)
    s90 = F.when(positive, F.ln(F.col("q90_slice") / F.col("q90_rest"))).otherwise(d90)
    pattern = (
        F.when(F.greatest(F.abs(d50), F.abs(d90)) <= tol, "no material shift")
        .when(F.abs(s50) >= 0.5 * F.abs(s90), "whole distribution shifted")
        .otherwise("tail shifted")
    )
    return out.select(
        "constraint_id", "q50_slice", "q50_rest", "q90_slice", "q90_rest", d50.alias("q50_shift"), d90.alias("q90_shift"), pattern.alias("pattern")
    )


def ecdf_pair(signals: DataFrame, max_points: int | None = None) -> DataFrame:
    """Both distribution functions of a constraint on the union of its values.

    ``max_points`` thins a longer curve to that many quantiles of the distinct values; the default keeps all.
    """
    hist = store(_histogram(signals))
    totals = hist.groupBy("constraint_id").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.count(F.lit(1)).alias("d"))
    run = running(
        hist,
        ["constraint_id"],
        [F.asc("x")],
        {"__a": F.col("a"), "__b": F.col("b")},
        rank="r",
    )
    shares = (F.when(F.col("n_a") > 0, F.col("__a") / F.col("n_a")).alias("f_slice"), F.when(F.col("n_b") > 0, F.col("__b") / F.col("n_b")).alias("f_rest"))
    if max_points is None:
        return join_on(run, totals, ["constraint_id"]).select("constraint_id", "x", *shares)
    rows = store(join_on(run, totals, ["constraint_id"]))
    after = rows.select("constraint_id", (F.col("r") - 1).alias("r"), F.col("x").alias("x_next"))
    rows = rows.join(after, ["constraint_id", "r"], "left")
    step = (F.col("d") - 1) / F.lit(float(max_points - 1))
    point = F.ceil((F.col("r") - 1) / step - F.lit(1e-9))
    offset = point * step - (F.col("r") - 1)
    thin = F.col("d") > max_points
    x = F.when(thin & (offset > 1e-9), F.col("x") + (F.col("x_next") - F.col("x")) * offset).otherwise(F.col("x"))
    return rows.where(~thin | (offset < 1 - 1e-9)).select("constraint_id", x.alias("x"), *shares)


# --------------------------------------------------------------------------- distribution lens
def limits(c: Constraint) -> tuple[float | None, float | None, str]:
    """Threshold, saturation point and direction of a constraint's signal."""
    p = c.params
    if c.type == "lag":
        return p["delta"], p["delta"] + p.get("width", 0.0), "high"
    if c.type == "balance":
        return p.get("tau", 0.0), p.get("tau", 0.0) + p.get("width", 0.0), "high"
    if c.type in ("singularity", "precedence"):
        base = p.get("k", 1 if c.type == "singularity" else 0)
        return base, base + p.get("K", 1), "high"
    if c.type == "metric":
        down = p.get("direction", "high") == "low"
        w = p.get("width", 0.0)
        return p["threshold"], p["threshold"] - w if down else p["threshold"] + w, "low" if down else "high"
    return None, None, "high"


def lens_edges(values: DataFrame, c: Constraint, bins: int = 40, log: bool = False) -> list[float]:
    """Bin edges over the 0.5-99.5 % range widened to threshold and saturation; scalars only are collected."""
    x = F.log10("x") if log else F.col("x")
    rows = values.where(F.col("x") > 0) if log else values
    rows = rows.select(x.alias("x"))
    q = quantiles(rows, [], "x", {"lo": 0.005, "hi": 0.995}).first()
    if q is None:
        return []
    marks = [m for m in limits(c)[:2] if m is not None and (not log or m > 0)]
    marks = [math.log10(m) for m in marks] if log else marks
    lo, hi = min([q["lo"], *marks]), max([q["hi"], *marks])
    hi = lo + 1.0 if hi <= lo else hi
    if not log and hi - lo <= bins and values.where(F.col("x") % 1 != 0).isEmpty():
        return [math.floor(lo) + i - 0.5 for i in range(int(math.floor(hi) - math.floor(lo)) + 2)]
    edges = [lo + (hi - lo) * i / bins for i in range(bins + 1)]
    return [10.0**e for e in edges] if log else edges


def lens_bins(values: DataFrame, edges: Sequence[float], log: bool = False) -> DataFrame:
    """Counts per bin, with ``-1`` below the first edge and ``bins`` beyond the last."""
    n = len(edges) - 1
    lo, hi = edges[0], edges[-1]
    x = F.col("x")
    if log:
        place = (F.log10(x) - F.lit(math.log10(lo))) / F.lit(math.log10(hi) - math.log10(lo)) * n
    else:
        place = (x - F.lit(lo)) / F.lit(hi - lo) * n
    inside = F.least(F.greatest(F.floor(place), F.lit(0)), F.lit(n - 1))
    index = F.when(x < F.lit(lo), F.lit(-1)).when(x > F.lit(hi), F.lit(n)).otherwise(inside)
    return values.groupBy(index.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def lens_stats(values: DataFrame, c: Constraint) -> DataFrame:
    """Summary of a signal: mean, quantiles, and shares beyond threshold and saturation."""
    threshold, saturation, direction = limits(c)
    x = F.col("x")

    def beyond(m: float | None) -> Column:
        if m is None:
            return F.lit(None).cast("double")
        return F.avg(((x < m) if direction == "low" else (x > m)).cast("double"))

    out = values.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("mean"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        beyond(threshold).alias("share_beyond_threshold"),
        beyond(saturation).alias("share_beyond_saturation"),
        F.avg((F.col("v") > 0).cast("double")).alias("share_violated"),
        F.avg("v").alias("mean_violation"),
    )
    q = quantiles(values, [], "x", {"median": 0.5, "p90": 0.9, "p95": 0.95}).select(F.struct("median", "p90", "p95")).scalar()
    return out.withColumns({k: q[k] for k in ("median", "p90", "p95")})


def lens_ecdf(values: DataFrame, points: int = 101) -> DataFrame:
    """The value at ``points`` equally spaced probabilities."""
    return quantile_rows(values, [], "x", [i / (points - 1) for i in range(points)])


# --------------------------------------------------------------------------- headroom
def headroom(
    scored: DataFrame, norm: Norm, view: str, where: Column, *, gamma: float = 0.0, baseline: Column | None = None
) -> DataFrame:
    """Per constraint: the exact rise of the slice mean and fall of its priority without its violations."""
    score = named(f"score__{view}")
    rows = scored.where(score.isNotNull())
    base = baseline if baseline is not None else rows.agg(F.avg(named(score))).scalar()
    fields = {
        "mean_penalty": lambda c: F.avg(named(f"p__{view}__{c.id}")),
        "n_evaluated": lambda c: F.count(named(f"v__{c.id}")),
        "share_in_scope": lambda c: F.avg(named(f"s__{c.id}").cast("double")),
        "share_violated": lambda c: F.avg((named(f"v__{c.id}") > 0).cast("double")),
        "mean_violation": lambda c: F.avg(named(f"v__{c.id}")),
    }
    slice_facts = [F.count(F.lit(1)).alias("__n"), F.avg(named(score)).alias("__mu")]
    out = constraint_rows(rows.where(holds(where)), norm, fields, extra=slice_facts).withColumn("__base", base)
    return _headroom_columns(out, F.col("__n").cast("double"), F.col("__n"), gamma).drop("__n", "__mu", "__base", "position")


def _headroom_columns(df: DataFrame, volume: Column, n: Column, gamma: float) -> DataFrame:
    shrink = n / (n + F.lit(float(gamma))) if gamma > 0 else F.lit(1.0)
    mu, base, pen = F.col("__mu"), F.col("__base"), F.col("mean_penalty")
    now = volume * shrink * F.greatest(base - mu, F.lit(0.0))
    then = volume * shrink * F.greatest(base - (mu + pen), F.lit(0.0))
    return df.withColumns(
        {
            "headroom_PI": volume * pen,
            "stable_PI": now,
            "stable_PI_after": then,
            "PI_reduction": now - then,
            "share_of_PI": F.when(now > 0, (now - then) / now),
        }
    )


def headroom_by(scored: DataFrame, norm: Norm, keys: Sequence[str], view: str, *, gamma: float = 0.0) -> DataFrame:
    """Headroom of every constraint in every group: one aggregate for all constraints."""
    groups = store(group_scores(scored, keys, view))
    rows = label_keys(scored.where(named(f"score__{view}").isNotNull()), keys)
    long = constraint_rows(rows, norm, {"mean_penalty": lambda c: F.avg(named(f"p__{view}__{c.id}"))}, keys=keys)
    base = groups.withColumn("__base", overall(groups)).withColumnRenamed("mean_score", "__mu")
    out = join_on(long, base.select(*all_named(keys), "n_cases", "volume", "__mu", "__base"), keys)
    out = _headroom_columns(out, F.col("volume"), F.col("n_cases"), gamma)
    return out.select(*all_named(keys), "constraint_id", "mean_penalty", "headroom_PI", "stable_PI", "stable_PI_after", "PI_reduction")


# --------------------------------------------------------------------------- temporal evidence of a driver
def activity_coverage(events: DataFrame, cases: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Over the selected cases: none, one or several occurrences of the labels."""
    n = events.where(F.col("activity").isin(list(labels))).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ts").isNull()).alias("undated")
    )
    rows = join_on(cases.select("case_id"), n, ["case_id"], "left").fillna(0)
    return rows.agg(
        F.count(F.lit(1)).alias("selected_cases"),
        F.sum("n").alias("events"),
        F.sum("undated").alias("undated_events"),
        F.count_if(F.col("n") == 0).alias("without"),
        F.count_if(F.col("n") == 1).alias("single"),
        F.count_if(F.col("n") > 1).alias("repeated"),
    )


def endpoint_partition(events: DataFrame, cases: DataFrame, a: Sequence[str], b: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Eight endpoint classes of the selected cases, and median / p90 days of the unique ordered ones."""
    aggs = []
    for tag, labels in (("a", a), ("b", b)):
        hit = F.col("activity").isin(list(labels))
        aggs += [F.count_if(hit).alias(f"n{tag}"), F.min(F.when(hit, F.col("ts"))).alias(f"t{tag}")]
    per_case = events.where(F.col("activity").isin([*a, *b])).groupBy("case_id").agg(*aggs)
    rows = join_on(cases.select("case_id"), per_case, ["case_id"], "left").fillna(0, ["na", "nb"])
    na, nb, ta, tb = (named(c) for c in ("na", "nb", "ta", "tb"))
    state = (
        F.when((na == 0) & (nb == 0), "neither")
        .when(na == 0, "missing_start")
        .when(nb == 0, "missing_end")
        .when((na > 1) | (nb > 1), "repeated")
        .when(ta.isNull() | tb.isNull(), "undated")
        .when(tb < ta, "reversed")
        .when(tb == ta, "tied")
        .otherwise("ordered")
    )
    rows = store(rows.select(state.alias("status"), elapsed(ta, tb, "D").alias("days")))
    counts = rows.groupBy("status").agg(F.count(F.lit(1)).alias("cases"))
    paired = rows.where(F.col("status").isin("ordered", "tied"))
    q = quantiles(paired, [], "days", {"median_days": 0.5, "p90_days": 0.9})
    return counts, q


def day_of_month(events: DataFrame, cases: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Events, cases and months present per day of the month, all 31 days."""
    rows = join_on(events.where(F.col("activity").isin(list(labels)) & F.col("ts").isNotNull()), cases.select("case_id"), ["case_id"], "left_semi")
    days = rows.groupBy(F.dayofmonth("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_distinct("case_id").alias("cases"),
        F.count_distinct(F.date_format("ts", "yyyy-MM")).alias("months"),
    )
    every = events.sparkSession.range(1, 32).select(F.col("id").cast("int").alias("day"))
    return every.join(days, "day", "left").fillna(0)
