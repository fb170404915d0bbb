"""How stable a ranking is: bootstrap intervals and a grid of settings.

The bootstrap draws independent Poisson(1) weights per case (or cluster) and
replicate instead of multinomial counts, because those need no knowledge of the
other cases.  A weight is a function of the unit's MD5, the replicate number and
the seed, so a lost task is recomputed with the same draws.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import all_named, holds, join_on, named
from ..functions.ordered import rank_rows
from ..session import store
from .backlog import GAMMA, group_scores, label_keys, overall, ranked, shortfall
from .norm import Constraint, Norm, View, scale, violation, weights, with_weights

# Fixed value: the largest prime below 2**28, the modulus of the replicate hash.
PRIME = 268_435_399


def unit_hash(unit: Column, seed: int) -> tuple[Column, Column]:
    """Two independent 28-bit integers of a resampling unit."""
    digest = F.md5(F.concat(unit.cast("string"), F.lit(f":{seed}")))
    return tuple(F.conv(F.substring(digest, start, 7), 16, 10).cast("bigint") for start in (1, 8))


def poisson_weight(h1: Column, h2: Column, replicate: Column) -> Column:
    """A Poisson(1) draw: uniform from a pairwise independent hash family, inverted on the distribution."""
    u = F.pmod(h1 + replicate * h2, F.lit(PRIME)) / F.lit(float(PRIME))
    out, cum = F.lit(11), 0.0
    steps = []
    for k in range(11):
        cum += math.exp(-1.0) / math.factorial(k)
        steps.append((k, cum))
    for k, edge in reversed(steps):
        out = F.when(u < F.lit(edge), F.lit(k)).otherwise(out)
    return out.cast("bigint")


def _poisson_edges() -> list[float]:
    edges, cum = [], 0.0
    for k in range(11):
        cum += math.exp(-1.0) / math.factorial(k)
        edges.append(cum)
    return edges


# Weights are drawn for at most this many pairs of row and replicate at once, and a task keeps this many sums.
DRAWN_AT_ONCE = 2_000_000
SUMS_KEPT = 8_000_000


def replicate_sums(
    rows: DataFrame, keys: Sequence[str], unit: str, sums: Mapping[str, Column], replicates: int, seed: int
) -> DataFrame:
    """Weighted sums for every group and every replicate, also those in which no row of the group is drawn.

    A task holds one vector of replicate sums per group and adds each row's weights to it, so rows are
    never multiplied by replicates.  Vectors of the same group are then added element by element.
    Rows of one unit share its hash and so its weight; they need not be brought together.
    """
    names, edges, prime = list(sums), _poisson_edges(), PRIME
    h1, h2 = unit_hash(named(unit), seed)
    group = F.to_json(F.array(*[named(k).cast("string") for k in keys]), {"ignoreNullFields": "false"})
    light = rows.select(group.alias("g"), h1.alias("h1"), h2.alias("h2"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in sums.items()])
    drawn_at_once, sums_kept = DRAWN_AT_ONCE, SUMS_KEPT

    def out(found: dict):
        import pyarrow as pa

        values = list(found.values())
        columns = [pa.array(list(found), pa.string()), *(pa.array([v[i] for v in values], pa.list_(pa.float64())) for i in range(len(names)))]
        return pa.RecordBatch.from_arrays(columns, ["g", *names])

    def drawn(batches):
        import numpy as np

        replicate = np.arange(1, replicates + 1, dtype=np.int64)
        limits = np.array(edges)
        step = max(1, drawn_at_once // replicates)
        found: dict = {}
        for batch in batches:
            dictionary = batch.column("g").dictionary_encode()
            labels, codes = dictionary.dictionary.to_pylist(), dictionary.indices.to_numpy()
            hashes = [batch.column(c).to_numpy() for c in ("h1", "h2")]
            x = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
            order = np.argsort(codes, kind="stable")
            for first in range(0, len(order), step):
                at = order[first : first + step]
                u = (hashes[0][at, None] + replicate[None, :] * hashes[1][at, None]) % prime / float(prime)
                w = np.searchsorted(limits, u.ravel(), side="right").reshape(u.shape).astype(float)
                starts = np.flatnonzero(np.r_[True, codes[at][1:] != codes[at][:-1]])
                for i in range(len(starts)):
                    part = slice(starts[i], starts[i + 1] if i + 1 < len(starts) else None)
                    label = labels[codes[at[starts[i]]]]
                    added = x[:, at[part]] @ w[part]
                    found[label] = found[label] + added if label in found else added
            if len(found) * replicates * len(names) > sums_kept:
                yield out(found)
                found = {}
        if found:
            yield out(found)

    def added(batches):
        import numpy as np

        now, held = None, None
        for batch in batches:
            done: dict = {}
            vectors = [np.stack([v.values.to_numpy() for v in batch.column(n)]) for n in names] if batch.num_rows else []
            for i, label in enumerate(batch.column("g").to_pylist()):
                vector = np.stack([v[i] for v in vectors])
                if label == now:
                    held = held + vector
                    continue
                if now is not None:
                    done[now] = held
                now, held = label, vector
            if done:
                yield out(done)
        if now is not None:
            yield out({now: held})

    schema = ", ".join(["g string", *(f"{n} array<double>" for n in names)])
    parts = light.mapInArrow(drawn, schema).repartition("g").sortWithinPartitions("g").mapInArrow(added, schema)
    label = F.from_json("g", "array<string>")
    whole = parts.select(*[label[i].alias(f"__k{i}") for i in range(len(keys))], F.posexplode(F.arrays_zip(*names)).alias("b", "x"))
    return whole.select((F.col("b") + 1).alias("b"), *[named(f"__k{i}").alias(k) for i, k in enumerate(keys)], *[F.col("x").getField(n).alias(n) for n in names])


def bootstrap_backlog(
    scored: DataFrame,
    keys: Sequence[str],
    view: str,
    *,
    gamma: float = GAMMA,
    replicates: int = 200,
    cluster: str = "case_id",
    top: Sequence[int] = (5, 10),
    seed: int = 0,
    level: float = 0.90,
    min_support: int = 10,
    baseline: float | None = None,
    volume: str | None = None,
) -> DataFrame:
    """Intervals of gap, priority and rank per group, chance to be in the top, and a stability badge.

    A replicate in which no case of a group is drawn has no gap for it, and its rank comes after all
    groups that have one: ranks are taken over all ``n_draws`` replicates, gaps over ``n_draws_present``.
    """
    s = named(f"score__{view}")
    rows = label_keys(scored.where(s.isNotNull()), keys)
    size = F.coalesce(named(volume).cast("double"), F.lit(0.0)) if volume else F.lit(1).cast("double")
    sums = {"n": F.lit(1).cast("double"), "ssum": s, "vol": size}
    draws = store(replicate_sums(rows, keys, cluster, sums, replicates, seed))
    per_b = draws.groupBy("b").agg(F.try_divide(F.sum("ssum"), F.sum("n")).alias("mu_bar"))
    mean = F.lit(baseline) if baseline is not None else F.col("mu_bar")
    n = F.col("n")
    shrink = n / (n + F.lit(float(gamma))) if gamma > 0 else F.lit(1.0)
    d = draws.join(per_b, "b")
    d = d.withColumn("gap", F.when(n > 0, F.greatest(mean - F.col("ssum") / F.nullif(n, F.lit(0.0)), F.lit(0.0))))
    vol = F.col("vol")
    d = d.withColumns({"PI": vol * F.col("gap"), "stable_gap": shrink * F.col("gap"), "stable_PI": vol * shrink * F.col("gap")})
    order = [F.desc_nulls_last("stable_PI"), F.desc("n"), *[F.asc(named(k)) for k in keys]]
    d = rank_rows(d.drop("mu_bar", "ssum", "vol"), order, keys=["b"], name="rank_b")
    tail = (1.0 - level) / 2.0
    metrics = {"gap": "gap", "stable_gap": "stable_gap", "PI": "PI", "stable_PI": "stable_PI", "rank": "rank_b"}
    aggs = []
    for name, col in metrics.items():
        # B values per group at most: the built-in exact percentile is bounded here.
        aggs += [F.percentile(col, tail).alias(f"{name}_lo"), F.percentile(col, 1 - tail).alias(f"{name}_hi")]
    for k in top:
        aggs.append((F.count_if((F.col("rank_b") <= k) & (F.col("stable_PI") > 0)) / replicates).alias(f"p_top{k}"))
    stats = d.groupBy(*all_named(keys)).agg(F.count(F.lit(1)).alias("n_draws"), F.count("gap").alias("n_draws_present"), *aggs)
    groups = store(group_scores(scored, keys, view, volume))
    point = ranked(shortfall(groups, F.lit(baseline) if baseline is not None else overall(groups), gamma), keys)
    out = join_on(point.select(*all_named(keys), "n_cases", "stable_gap", "stable_PI", "rank"), stats, keys, "left")
    k = max(top)
    in_top = (F.col("rank") <= k) & (F.col("stable_PI") > 0)
    stays = F.when(in_top, named(f"p_top{k}")).otherwise(1 - named(f"p_top{k}"))
    badge = (
        F.when(F.col("n_cases") < min_support, "insufficient_support")
        .when(stays >= 0.8, "stable")
        .when(stays >= 0.5, "fragile")
        .otherwise("insufficient_support")
    )
    return out.withColumn("stability", badge)


def bootstrap_contrast(
    scored: DataFrame, norm: Norm, view: str, where: Column, *, replicates: int = 200, seed: int = 0, level: float = 0.90
) -> DataFrame:
    """Interval of each waterfall bar: mean penalty in the slice minus mean penalty of all cases."""
    rows = scored.where(named(f"score__{view}").isNotNull()).withColumn("__in", holds(where))
    ids = norm.ids()
    sums = {"n": F.lit(1).cast("double"), **{f"s_{i}": named(f"p__{view}__{c}") for i, c in enumerate(ids)}}
    draws = replicate_sums(rows, ["__in"], "case_id", sums, replicates, seed)
    inside = F.col("__in") == "true"
    total_n, slice_n = F.sum("n"), F.sum(F.when(inside, F.col("n")))
    bars = [
        (F.try_divide(F.sum(F.when(inside, named(f"s_{i}"))), slice_n) - F.try_divide(F.sum(named(f"s_{i}")), total_n)).alias(f"d_{i}")
        for i in range(len(ids))
    ]
    per_b = draws.groupBy("b").agg(*bars)
    items = [F.struct(F.lit(c).alias("constraint_id"), named(f"d_{i}").alias("d")) for i, c in enumerate(ids)]
    long = per_b.select(F.inline(F.array(*items)))
    tail = (1.0 - level) / 2.0
    return long.groupBy("constraint_id").agg(
        F.percentile("d", tail).alias("delta_lo"), F.percentile("d", 1 - tail).alias("delta_hi"), F.count("d").alias("n_draws")
    )


# --------------------------------------------------------------------------- sensitivity
def estimate_gamma(groups: DataFrame) -> Column:
    """Shrinkage by moments: within-group variance over the variance between group means."""
    n, sd, mean = F.col("n_cases"), F.coalesce(F.col("sd_score"), F.lit(0.0)), F.col("mean_score")
    within = F.try_divide(F.sum((n - 1) * sd * sd), F.sum(n - 1))
    total = F.sum(n * mean * mean) - F.try_divide(F.sum(n * mean) * F.sum(n * mean), F.sum(named(n)))
    # A single group has no variance between groups: the result is then NULL.
    others = F.count(F.lit(1)) - 1
    size = F.try_divide(F.sum(named(n)) - F.try_divide(F.sum((n * n).cast("double")), F.sum(named(n))), others)
    between = F.try_divide(F.try_divide(total, others) - within, size)
    return groups.where(n > 1).agg(F.when(between > 0, within / between)).scalar()


def jitter_weights(norm: Norm, view: View, draws: int, spread: float, seed: int) -> list[dict[str, float]]:
    """Weight sets multiplied by 1 + U(-spread, spread), reproducible by seed."""
    import numpy as np

    rng = np.random.default_rng(seed)
    base = weights(norm, view)
    out = []
    for _ in range(draws):
        factor = 1.0 + rng.uniform(-spread, spread, size=len(base))
        out.append({cid: float(max(0.0, w * f)) for (cid, w), f in zip(base.items(), factor, strict=True)})
    return out


def scaled_constraints(norm: Norm, factors: Sequence[float]) -> list[tuple[Constraint, str, float]]:
    """Every graded constraint with threshold and width scaled, under an id of its own."""
    out = []
    for c in norm.constraints:
        for i, f in enumerate(factors):
            scaled = scale(c, f)
            if scaled is not None:
                out.append((replace(scaled, id=f"{c.id}_f{i}"), c.id, f))
    return out


def scaled_norm(norm: Norm, factors: Sequence[float] = (0.8, 1.25)) -> Norm:
    """The norm extended by its scaled constraints, for gathering what their violations need."""
    extra = [c for c, _, _ in scaled_constraints(norm, factors)]
    return replace(norm, constraints=(*norm.constraints, *extra))


def sensitivity(
    gathered: DataFrame,
    scored: DataFrame,
    norm: Norm,
    view: str,
    keys: Sequence[str],
    *,
    gamma: float = GAMMA,
    factors: Sequence[float] = (0.8, 1.25),
    draws: int = 3,
    spread: float = 0.10,
    k: int = 10,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Rank range of every group over shrinkage, threshold and weight settings, and the settings themselves.

    All score variants are columns of one table and one grouped aggregate serves all
    settings.  ``gathered`` holds the per-case quantities of ``scaled_norm``.
    """
    v = norm.view(view)
    with_w = with_weights(scored.select("case_id", *all_named(keys), named(f"score__{view}"), *all_named(f"v__{c}" for c in norm.ids())), norm, v, "__j_")
    alternatives: dict[str, Column] = {}
    variants = scaled_constraints(norm, factors)
    helper = {f"__v_{c.id}": violation(c, norm) for c, _, _ in variants}
    probe = gathered.select("case_id", *[e.alias(n) for n, e in helper.items()])
    rows = join_on(with_w, probe, ["case_id"])
    s = named(f"score__{view}")
    settings: list[tuple[str, str, str, float]] = [("reference", "reference", "reference", gamma)]
    alternatives["reference"] = s
    for scaled, cid, f in variants:
        old = named(f"v__{cid}")
        new = F.when(old.isNotNull(), F.coalesce(named(f"__v_{scaled.id}"), old))
        change = F.coalesce((new - old) * named(f"__j_w_{cid}"), F.lit(0.0))
        alternatives[f"{cid}×{f:g}"] = s - change
        settings.append((f"{cid}×{f:g}", "threshold", f"{cid}×{f:g}", gamma))
    out = rows
    for i, w in enumerate(jitter_weights(norm, v, draws, spread, seed)):
        out = with_weights(out, norm, View(f"j{i}", constraint_weights=w), f"__k{i}_")
        pen = [F.coalesce(named(f"v__{c}"), F.lit(0.0)) * named(f"__k{i}_w_{c}") for c in norm.ids()]
        total = pen[0]
        for p in pen[1:]:
            total = total + p
        alternatives[f"weights~{i + 1}"] = F.when(named(f"__k{i}_act") > 0, 1 - total)
        settings.append((f"weights~{i + 1}", "weights", f"weights~{i + 1}", gamma))
    for g in dict.fromkeys(round(x, 6) for x in (0.0, gamma / 2.0, 2.0 * gamma)):
        if g != round(gamma, 6):
            settings.append((f"gamma={g:g}", "gamma", "reference", g))
    names = list(alternatives)
    aggs = []
    for i, n in enumerate(names):
        aggs += [F.count(alternatives[n]).alias(f"n{i}"), F.sum(alternatives[n]).alias(f"s{i}")]
    groups = store(label_keys(out.where(s.isNotNull()), keys).groupBy(*all_named(keys)).agg(*aggs))
    items = [
        F.struct(
            F.lit(setting).alias("setting"),
            F.lit(kind).alias("kind"),
            F.lit(float(g)).alias("gamma"),
            named(f"n{names.index(source)}").alias("n_cases"),
            named(f"s{names.index(source)}").alias("sum_score"),
        )
        for setting, kind, source, g in settings
    ]
    long = groups.select(*all_named(keys), F.inline(F.array(*items))).where(F.col("n_cases") > 0)
    point = store(group_scores(scored, keys, view))
    g_hat = point.select(*all_named(keys), F.lit("gamma_hat").alias("setting"), F.lit("gamma").alias("kind"), estimate_gamma(point).alias("gamma"), "n_cases", "sum_score")
    long = store(long.unionByName(g_hat.where(F.col("gamma").isNotNull())))
    base = long.groupBy("setting").agg((F.sum("sum_score") / F.sum("n_cases")).alias("mu"))
    d = long.join(base, "setting")
    n = F.col("n_cases")
    gap = F.greatest(F.col("mu") - F.col("sum_score") / n, F.lit(0.0))
    d = d.withColumn("stable_PI", n * n / (n + F.col("gamma")) * gap).drop("mu", "sum_score")
    order = [F.desc("stable_PI"), F.desc("n_cases"), *[F.asc(named(c)) for c in keys]]
    d = store(rank_rows(d, order, keys=["setting"]))
    in_top = (F.col("rank") <= k) & (F.col("stable_PI") > 0)
    n_settings = d.agg(F.count_distinct("setting")).scalar()
    per_group = d.groupBy(*all_named(keys)).agg(
        F.max(F.when(F.col("setting") == "reference", F.col("rank"))).alias("rank_ref"),
        F.min("rank").alias("rank_min"),
        F.max("rank").alias("rank_max"),
        F.count_if(in_top).alias("topk_settings"),
    )
    per_group = per_group.withColumn("n_settings", n_settings)
    per_group = per_group.withColumn("always_topk", F.col("topk_settings") == F.col("n_settings"))
    ref = d.where((F.col("setting") == "reference") & (F.col("rank") <= k)).select(*all_named(keys), F.lit(True).alias("__ref"))
    marked = d.join(ref, list(keys), "left").withColumn("__ref", F.coalesce("__ref", F.lit(False)))
    mine = F.col("rank") <= k
    per_setting = marked.groupBy("setting", "kind").agg(
        F.count_if(in_top).alias("n_topk"),
        (F.count_if(mine & F.col("__ref")) / F.count_if(mine | F.col("__ref"))).alias("top_k_overlap"),
    )
    return per_group, per_setting
