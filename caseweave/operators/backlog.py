"""Ranking groups of cases by size and shortfall, and the reports around it.

Input is a scored case table (see ``norm.with_scores``), best read from storage:
the reports below only read the columns they need.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import all_named, holds, join_on, named, quoted, total
from ..functions.ordered import quantiles, rank_rows, running
from ..session import store
from .norm import Constraint, Norm
from .profile import average_rank, top_per_key

# Shrinkage, smallest group, normal quantile of the lower bound, kind margin.
GAMMA = 50.0
MIN_CASES = 20
Z_LOWER = 1.96
KIND_MARGIN = 1.0 / 3.0
MISSING = "(missing)"


def label_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """NULL keys become a labelled group; keys are text from here on."""
    return df.withColumns({k: F.coalesce(named(k).cast("string"), F.lit(MISSING)) for k in keys})


def group_scores(
    scored: DataFrame, keys: Sequence[str], view: str, volume: str | None = None, extra: Sequence[Column] = ()
) -> DataFrame:
    """Counts, score sums and volume per group, over scored cases."""
    s = named(f"score__{view}")
    vol = F.sum(F.coalesce(F.col(volume).cast("double"), F.lit(0.0))) if volume else F.count(F.lit(1)).cast("double")
    rows = label_keys(scored.where(s.isNotNull()), keys)
    return rows.groupBy(*all_named(keys)).agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.sum(named(s)).alias("sum_score"),
        F.avg(named(s)).alias("mean_score"),
        F.stddev_samp(named(s)).alias("sd_score"),
        vol.alias("volume"),
        *extra,
    )


def shortfall(groups: DataFrame, baseline: Column, gamma: float = GAMMA, z: float = Z_LOWER) -> DataFrame:
    """Gap, priority and their shrunk forms per group against a baseline score."""
    n = F.col("n_cases")
    shrink = n / (n + F.lit(float(gamma))) if gamma > 0 else F.lit(1.0)
    error = F.lit(z) * F.coalesce(F.col("sd_score"), F.lit(0.0)) / F.sqrt(n)
    out = groups.withColumn("global_mean", baseline)
    out = out.withColumn("gap", F.greatest(F.col("global_mean") - F.col("mean_score"), F.lit(0.0)))
    return out.withColumns(
        {
            "PI": F.col("volume") * F.col("gap"),
            "stable_mean": F.col("global_mean") - shrink * (F.col("global_mean") - F.col("mean_score")),
            "stable_gap": shrink * F.col("gap"),
            "stable_PI": F.col("volume") * shrink * F.col("gap"),
            "PI_lower": F.col("volume") * F.greatest(F.col("gap") - error, F.lit(0.0)),
        }
    )


def overall(groups: DataFrame) -> Column:
    """The mean score over all scored cases, from group sums."""
    return groups.agg(F.sum("sum_score") / F.sum("n_cases")).scalar()


def ranked(groups: DataFrame, keys: Sequence[str], min_cases: int = 1, within: Sequence[str] = ()) -> DataFrame:
    """Rank by stabilised priority, then size, then key."""
    kept = groups.where(F.col("n_cases") >= min_cases)
    order = [F.desc("stable_PI"), F.desc("n_cases"), *[F.asc(named(k)) for k in keys]]
    return rank_rows(kept, order, keys=within)


def backlog(
    scored: DataFrame,
    keys: Sequence[str],
    view: str,
    *,
    gamma: float = GAMMA,
    volume: str | None = None,
    baseline: Column | None = None,
    min_cases: int = 1,
) -> DataFrame:
    """One ranked row per group.  Without a given baseline the mean of all scored cases is used."""
    groups = store(group_scores(scored, keys, view, volume))
    out = shortfall(groups, baseline if baseline is not None else overall(groups), gamma)
    return ranked(out, keys, min_cases).drop("sum_score", "sd_score")


def page(
    table: DataFrame,
    *,
    sort: str = "-stable_PI",
    filters: Mapping[str, Any] | None = None,
    search: str | None = None,
    search_columns: Sequence[str] = (),
    min_cases: int | None = None,
    number: int = 1,
    size: int = 50,
) -> DataFrame:
    """One page of a ranked table: equality filters, search, sort with NULLs last and rank as tie-break."""
    name, down = sort.lstrip("-"), sort.startswith("-")
    if name not in table.columns:
        raise ValueError(f"cannot sort by {name!r}")
    out = table
    for column, value in (filters or {}).items():
        out = out.where(named(column) == F.lit(value))
    if min_cases is not None:
        out = out.where(F.col("n_cases") >= min_cases)
    if search:
        hit = F.lit(False)
        for c in search_columns:
            hit = hit | F.contains(F.lower(named(c).cast("string")), F.lit(search.lower()))
        out = out.where(hit)
    order = [F.desc_nulls_last(named(name)) if down else F.asc_nulls_last(named(name))]
    if name != "rank" and "rank" in out.columns:
        order.append(F.asc("rank"))
    return out.orderBy(*order).offset((number - 1) * size).limit(size)


# --------------------------------------------------------------------------- drivers
def layer_drivers(scored: DataFrame, keys: Sequence[str], view: str, norm: Norm) -> DataFrame:
    """Mean contribution per layer and group, its difference to all cases, and the layer that leads.

    The earlier layer of the norm leads on ties.
    """
    layers = list(norm.layers)
    sums = [F.sum(named(f"contrib__{view}__{layer}")).alias(f"__{layer}") for layer in layers]
    groups = store(group_scores(scored, keys, view, extra=sums))
    whole = groups.agg(*[(F.sum(named(f"__{layer}")) / F.sum("n_cases")).alias(layer) for layer in layers])
    whole = whole.select(F.struct(*all_named(layers))).scalar()
    means = {f"mean__{layer}": named(f"__{layer}") / F.col("n_cases") for layer in layers}
    out = groups.withColumns(means)
    out = out.withColumns({f"delta__{layer}": named(f"mean__{layer}") - whole[layer] for layer in layers})
    best = F.greatest(*[named(f"delta__{layer}") for layer in layers]) if len(layers) > 1 else named(f"delta__{layers[0]}")
    lead = F.lit(None).cast("string")
    for layer in reversed(layers):
        lead = F.when(named(f"delta__{layer}") == best, F.lit(layer)).otherwise(lead)
    out = out.withColumn("dominant_layer", lead)
    return out.select(*all_named(keys), "n_cases", *all_named(means), *all_named(f"delta__{layer}" for layer in layers), "dominant_layer")


# Aggregates in one pass are kept below the size where generated code stops compiling well.
AGGREGATES_PER_PASS = 60


def constraint_rows(
    df: DataFrame,
    norm: Norm,
    fields: Mapping[str, Callable[[Constraint], Column]],
    *,
    keys: Sequence[str] = (),
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Aggregates of every constraint as rows ``position, constraint_id, layer, <fields>`` (per group).

    Constraints are aggregated side by side, so cases are never multiplied by
    constraints.  A long norm takes several passes, each reading its own columns.
    """
    size = max(1, AGGREGATES_PER_PASS // len(fields))
    numbered = list(enumerate(norm.constraints))
    out: DataFrame | None = None
    for start in range(0, len(numbered), size):
        aggs, rows = [], []
        for i, c in numbered[start : start + size]:
            items = [F.lit(i).alias("position"), F.lit(c.id).alias("constraint_id"), F.lit(c.layer).alias("layer")]
            for name, make in fields.items():
                aggs.append(make(c).alias(f"__{name}_{i}"))
                items.append(named(f"__{name}_{i}").alias(name))
            rows.append(F.struct(*items))
        part = df.groupBy(*all_named(keys)).agg(*extra, *aggs)
        kept = [c for c in part.columns if not re.match(r"__.*_\d+$", c)]
        part = part.select(*all_named(kept), F.inline(F.array(*rows)))
        out = part if out is None else out.unionByName(part)
    return out


def constraint_drivers(scored: DataFrame, norm: Norm, view: str, where: Column) -> DataFrame:
    """Per constraint inside a slice: penalty, violation, shares, and the part of the gap it explains."""
    inside = holds(where)

    def only(c: Column) -> Column:
        return F.when(inside, c)

    fields = {
        "mean_penalty": lambda c: F.avg(only(named(f"p__{view}__{c.id}"))),
        "mean_penalty_all": lambda c: F.avg(named(f"p__{view}__{c.id}")),
        "mean_violation": lambda c: F.avg(only(named(f"v__{c.id}"))),
        "share_violated": lambda c: F.avg(only((named(f"v__{c.id}") > 0).cast("double"))),
        "share_in_scope": lambda c: F.avg(only(named(f"s__{c.id}").cast("double"))),
        "share_evaluated": lambda c: F.avg(only(named(f"v__{c.id}").isNotNull().cast("double"))),
    }
    score = named(f"score__{view}")
    gap = F.greatest(F.avg(named(score)) - F.avg(F.when(inside, score)), F.lit(0.0)).alias("gap")
    out = constraint_rows(scored.where(score.isNotNull()), norm, fields, extra=[gap])
    delta = F.col("mean_penalty") - F.col("mean_penalty_all")
    return out.withColumn("delta_gap", delta).withColumn(
        "share_of_shortfall", F.when(F.col("gap") > 0, F.col("delta_gap") / F.col("gap"))
    ).drop("position", "gap", "mean_penalty_all")


def top_constraint(
    scored: DataFrame, keys: Sequence[str], view: str, norm: Norm, demoted: Sequence[str] = ()
) -> DataFrame:
    """Per group: the constraint of its leading layer that the largest share of evaluated cases misses.

    A demoted constraint leads only where no other one of the layer is missed.
    """
    lead = layer_drivers(scored, keys, view, norm).select(*all_named(keys), "dominant_layer")
    fields = {
        "hit": lambda c: F.count_if(named(f"v__{c.id}") > 0),
        "seen": lambda c: F.count(named(f"v__{c.id}")),
    }
    rows = label_keys(scored.where(named(f"score__{view}").isNotNull()), keys)
    long = constraint_rows(rows, norm, fields, keys=keys)
    long = long.where(F.col("seen") > 0).withColumn("share", F.col("hit") / F.col("seen"))
    long = join_on(long, lead, keys).where(F.col("layer") == F.col("dominant_layer"))
    plain = ~F.col("constraint_id").isin(list(demoted)) if demoted else F.lit(True)
    long = long.withColumn("plain", plain & (F.col("share") > 0))
    best = top_per_key(long, keys, [F.desc("plain"), F.desc("share"), F.asc("position")], 1)
    flagged = ~F.col("plain") & F.col("constraint_id").isin(list(demoted)) if demoted else F.lit(False)
    return best.select(*all_named(keys), "dominant_layer", "constraint_id", "share", flagged.alias("measures_logging"))


def measurement(scored: DataFrame, norm: Norm, has_value: Mapping[str, Column]) -> DataFrame:
    """Per constraint: applies, evaluated, violated, measured, violated without a value, and the reason flag.

    ``has_value`` holds, per lag constraint, the condition that both of its events exist.
    """

    def value(c) -> Column:
        return holds(has_value[c.id]) if c.id in has_value else named(f"v__{c.id}").isNotNull()

    fields = {
        "applies_to": lambda c: F.count_if(named(f"s__{c.id}")),
        "evaluated": lambda c: F.count(named(f"v__{c.id}")),
        "violated": lambda c: F.count_if(named(f"v__{c.id}") > 0),
        "measured": lambda c: F.count_if(named(f"s__{c.id}") & value(c)),
        "violated_without_value": lambda c: F.count_if(named(f"s__{c.id}") & (named(f"v__{c.id}") > 0) & ~value(c)),
    }
    out = constraint_rows(scored, norm, fields).drop("position")
    reason = (
        F.when(F.col("applies_to") == 0, F.lit(None).cast("string"))
        .when((F.col("violated") > 0) & (F.col("violated_without_value") / F.col("violated") > 0.5), "missing_partner")
        .when(F.col("measured") < 0.5 * F.col("applies_to"), "partly_measured")
    )
    return out.withColumn("reason", reason)


def uncalibrated(measured: DataFrame) -> DataFrame:
    """Constraints whose number says more about the norm or the log than about the groups."""
    rows = measured.where(F.col("evaluated") > 0)
    share = F.col("violated") / F.col("evaluated")
    reason = F.coalesce(
        F.col("reason"), F.when(share > 0.90, "almost_always_missed").when(share < 0.01, "almost_never_missed")
    )
    out = rows.withColumns({"share_violated": share, "reason": reason})
    return out.where(F.col("reason").isNotNull()).select(
        "constraint_id", "layer", "share_violated", "evaluated", "applies_to", "measured", "violated_without_value", "reason"
    )


# --------------------------------------------------------------------------- penalty mass
def mass_table(rows: DataFrame, keys: Sequence[str], penalty: Column) -> DataFrame:
    """Penalty mass per ``value`` (within ``keys``) with shares, cumulative shares and ranks."""
    groups = rows.groupBy(*all_named(keys), "value").agg(
        F.count(F.lit(1)).alias("n_cases"), F.sum(named(penalty)).alias("penalty_mass"), F.avg(named(penalty)).alias("mean_penalty")
    )
    groups = store(groups)
    whole = groups.groupBy(*all_named(keys)).agg(F.sum("penalty_mass").alias("__all"))
    order = [F.desc("penalty_mass"), F.desc("n_cases"), F.asc("value")]
    out = rank_rows(groups, order, keys=keys, sums={"__cum": F.col("penalty_mass")}, stored=True)
    if keys:
        out = join_on(out, whole, keys)
    else:
        out = out.withColumn("__all", whole.scalar())
    ratio = {
        "share": F.when(F.col("__all") > 0, F.col("penalty_mass") / F.col("__all")).otherwise(0.0),
        "cum_share": F.when(F.col("__all") > 0, F.col("__cum") / F.col("__all")).otherwise(0.0),
    }
    return out.withColumns(ratio).drop("__all", "__cum")


def penalty_mass(scored: DataFrame, view: str, by: str, where: Column | None = None) -> DataFrame:
    s = named(f"score__{view}")
    rows = scored.where(s.isNotNull() if where is None else s.isNotNull() & holds(where))
    rows = rows.withColumn("value", F.coalesce(named(by).cast("string"), F.lit(MISSING)))
    return mass_table(rows, [], 1 - s)


def subgroups(
    scored: DataFrame,
    view: str,
    attributes: Mapping[str, Column],
    where: Column,
    *,
    period: str | None = None,
    censored: Column | None = None,
    partial_from: str | None = None,
) -> DataFrame:
    """Penalty mass for many attributes of a slice in one pass.

    For the attribute named by ``period`` the open share and whether the period
    reaches ``partial_from`` (a period label) are added.
    """
    s = named(f"score__{view}")
    inside = scored.where(s.isNotNull() & holds(where))
    pairs = [
        F.struct(F.lit(n).alias("attribute"), F.coalesce(c.cast("string"), F.lit(MISSING)).alias("value"))
        for n, c in attributes.items()
    ]
    flag = holds(censored) if censored is not None else F.lit(False)
    rows = inside.select((1 - s).alias("__pen"), flag.alias("__open"), F.inline(F.array(*pairs)))
    out = mass_table(rows, ["attribute"], F.col("__pen"))
    if period is None:
        return out
    opened = rows.where(F.col("attribute") == period).groupBy("attribute", "value")
    opened = opened.agg(F.avg(F.col("__open").cast("double")).alias("censored_share"))
    out = join_on(out, opened, ["attribute", "value"], "left")
    late = (F.col("attribute") == period) & (F.col("value") >= F.lit(partial_from))
    return out.withColumn("partial_period", late if partial_from else F.lit(False))


def values_for_share(mass: DataFrame, target: float = 0.8) -> DataFrame:
    """Per attribute: how many values carry ``target`` of the mass."""
    reached = F.min(F.when(F.col("cum_share") >= target - 1e-12, F.col("rank")))
    return mass.groupBy("attribute").agg(
        F.count(F.lit(1)).alias("n_values"),
        F.coalesce(reached, F.max("rank")).cast("bigint").alias("values_for_share"),
        F.max_by("value", -F.col("rank")).alias("top_value"),
        F.max(F.when(F.col("rank") == 1, F.col("share"))).alias("top_share"),
    )


def worst_cases(scored: DataFrame, norm: Norm, view: str, n: int, where: Column | None = None) -> DataFrame:
    """The ``n`` lowest scores with the ids of the violated constraints."""
    s = named(f"score__{view}")
    rows = scored.where(s.isNotNull() if where is None else s.isNotNull() & holds(where))
    missed = F.array_compact(F.array(*[F.when(named(f"v__{c.id}") > 0, F.lit(c.id)) for c in norm.constraints]))
    return rows.orderBy(s.asc(), F.asc("case_id")).limit(n).select("case_id", s.alias("score"), missed.alias("violated"))


# --------------------------------------------------------------------------- kinds
def problem_kind(table: DataFrame, keys: Sequence[str], margin: float = KIND_MARGIN) -> DataFrame:
    """acute / systematic / widespread / none from the percentile ranks of gap and size."""
    rows = store(table.select(*all_named(keys), "n_cases", "stable_gap"))
    total_groups = rows.agg(F.count(F.lit(1))).scalar()
    positive = rows.where(F.col("stable_gap") > 0)
    n_positive = positive.agg(F.count(F.lit(1))).scalar()
    gap = average_rank(positive, "stable_gap").select("stable_gap", (F.col("avg_rank") / n_positive).alias("gap_pct"))
    size = average_rank(rows, "n_cases").select("n_cases", (F.col("avg_rank") / total_groups).alias("size_pct"))
    out = rows.join(gap, "stable_gap", "left").join(size, "n_cases")
    kind = (
        F.when(F.col("gap_pct").isNull(), "none")
        .when(F.col("gap_pct") - F.col("size_pct") >= margin, "acute")
        .when(F.col("size_pct") - F.col("gap_pct") >= margin, "widespread")
        .otherwise("systematic")
    )
    return out.select(*all_named(keys), "n_cases", "stable_gap", "gap_pct", "size_pct", kind.alias("kind"))


def problem_kinds(scored: DataFrame, keys: Sequence[str], views: Sequence[str], gamma: float = GAMMA) -> DataFrame:
    """One kind per group across views: the first view's, else the first view with a positive gap."""
    out: DataFrame | None = None
    for v in views:
        groups = store(group_scores(scored, keys, v))
        table = shortfall(groups, overall(groups), gamma)
        part = problem_kind(table, keys).select(
            *all_named(keys), F.col("kind").alias(f"kind__{v}"), F.col("stable_gap").alias(f"gap__{v}")
        )
        out = part if out is None else join_full(out, part, keys)
    kinds = [F.coalesce(named(f"kind__{v}"), F.lit("none")) for v in views]
    chosen = F.coalesce(*[F.when(k != "none", k) for k in kinds], F.lit("none"))
    positive = [holds(named(f"gap__{v}") > 0) for v in views]
    some = total([p.cast("int") for p in positive])
    return out.withColumns({f"kind__{v}": k for v, k in zip(views, kinds, strict=True)}).withColumns(
        {"kind": chosen, "changes_sign": (some > 0) & (some < len(views))}
    )


def join_full(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join on keys that are never NULL."""
    return left.join(right, list(keys), "full_outer")


def points_below(mean: Column, baseline: Column) -> tuple[Column, Column]:
    """Distance to the baseline in score points and in percent of the baseline."""
    points = (baseline - mean) * 100
    return points, F.when(baseline > 0, F.abs(points) / (baseline * 100) * 100)


# --------------------------------------------------------------------------- comparing backlogs
def top_k_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Jaccard overlap of the two top-k key sets."""
    left = a.where(F.col("rank") <= k).select(*all_named(keys), F.lit(1).alias("__a"))
    right = b.where(F.col("rank") <= k).select(*all_named(keys), F.lit(1).alias("__b"))
    both = join_full(left, right, keys)
    inter = F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull())
    return both.agg(inter.alias("common"), F.count(F.lit(1)).alias("either")).select(
        "common", "either", F.when(F.col("either") > 0, F.col("common") / F.col("either")).alias("jaccard")
    )


def rank_correlation(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spearman correlation of the two ranks over the groups both rank; NULL below three groups."""
    both = a.select(*all_named(keys), F.col("rank").alias("__a")).join(b.select(*all_named(keys), F.col("rank").alias("__b")), list(keys))
    d = F.col("__a") - F.col("__b")
    return both.agg(F.count(F.lit(1)).alias("n"), F.sum((d * d).cast("double")).alias("d2")).select(
        "n", F.when(F.col("n") >= 3, 1 - 6 * F.col("d2") / (F.col("n").cast("double") * (F.col("n") * F.col("n") - 1))).alias("rank_correlation")
    )


def view_agreement(scored: DataFrame, keys: Sequence[str], views: Sequence[str], k: int = 20, gamma: float = GAMMA) -> DataFrame:
    """Per pair of views: top-k overlap and rank correlation of their backlogs."""
    tables = {v: store(backlog(scored, keys, v, gamma=gamma).select(*all_named(keys), "rank")) for v in views}
    out: DataFrame | None = None
    for i, x in enumerate(views):
        for y in views[i + 1 :]:
            overlap = top_k_overlap(tables[x], tables[y], keys, k).select("common", "jaccard")
            corr = rank_correlation(tables[x], tables[y], keys).select("rank_correlation")
            row = overlap.select(
                F.lit(x).alias("view_a"), F.lit(y).alias("view_b"), "common", "jaccard", corr.scalar().alias("rank_correlation")
            )
            out = row if out is None else out.unionByName(row)
    return out


def concentration(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cumulative share of the priority over the ranked groups."""
    rows = store(table.select(*all_named(keys), "rank", "PI", "n_cases"))
    whole = rows.agg(F.sum("PI")).scalar()
    n = rows.agg(F.sum("n_cases")).scalar()
    out = running(rows, [], [F.asc("rank")], {"__p": F.col("PI"), "__n": F.col("n_cases")})
    return out.select(
        *all_named(keys),
        "rank",
        "PI",
        F.when(whole > 0, F.col("__p") / whole).otherwise(0.0).alias("cum_share_PI"),
        (F.col("__n") / n).alias("cum_share_cases"),
    )


def compare(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two backlogs side by side: entered, left or changed, and the differences."""
    cols = ("n_cases", "mean_score", "stable_PI", "rank")
    a = before.select(*all_named(keys), *[named(c).alias(f"{c}_before") for c in cols])
    b = after.select(*all_named(keys), *[named(c).alias(f"{c}_after") for c in cols])
    out = join_full(a, b, keys)
    state = F.when(F.col("rank_before").isNull(), "entered").when(F.col("rank_after").isNull(), "left").otherwise("changed")
    out = out.withColumns(
        {
            "state": state,
            "delta_cases": F.col("n_cases_after") - F.col("n_cases_before"),
            "delta_mean_points": F.round((F.col("mean_score_after") - F.col("mean_score_before")) * 100, 4),
            "delta_priority": F.round(F.col("stable_PI_after") - F.col("stable_PI_before"), 6),
            "delta_rank": F.col("rank_before") - F.col("rank_after"),
        }
    )
    same = (
        (F.abs("delta_mean_points") < 0.05) & (F.abs("delta_priority") < 0.05) & (F.col("delta_rank") == 0)
    )
    return out.withColumn("unchanged", F.when(F.col("state") == "changed", same))


def compare_summary(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Group counts, top-ten overlap and rank agreement of two backlogs."""
    rows = compare(before, after, keys)
    top = holds((F.col("rank_before") <= 10) & (F.col("rank_after") <= 10))
    out = rows.agg(
        F.count("rank_before").alias("groups_before"),
        F.count("rank_after").alias("groups_after"),
        F.count_if(F.col("state") == "changed").alias("groups_compared"),
        F.count_if(holds(~F.col("unchanged"))).alias("groups_changed"),
        F.count_if(F.col("state") == "entered").alias("entered"),
        F.count_if(F.col("state") == "left").alias("left"),
        (F.count_if(top) / 10).alias("top_ten_overlap"),
        F.sum("stable_PI_before").alias("priority_before"),
        F.sum("stable_PI_after").alias("priority_after"),
    )
    return out.withColumn("rank_agreement", rank_correlation(before, after, keys).select("rank_correlation").scalar())


# --------------------------------------------------------------------------- validation, facets, tiles
def validation(scored: DataFrame, keys: Sequence[str], view: str, gamma: float = GAMMA) -> DataFrame:
    """Per group: open and replicated shares, and the gap with and without open cases.

    Each gap is measured against the mean of its own population.  ``scored``
    carries boolean columns ``censored`` and ``replicated``.
    """
    s = named(f"score__{view}")
    kept = ~F.col("censored")
    extra = [
        F.avg(F.col("censored").cast("double")).alias("censored_share"),
        F.avg(F.col("replicated").cast("double")).alias("replicated_share"),
        F.count(F.when(kept, s)).alias("n_closed"),
        F.sum(F.when(kept, s)).alias("sum_closed"),
    ]
    groups = store(group_scores(scored, keys, view, extra=extra))
    out = shortfall(groups, overall(groups), gamma)
    closed_mean = groups.agg(F.sum("sum_closed") / F.sum("n_closed")).scalar()
    n = F.col("n_closed")
    gap = F.greatest(closed_mean - F.col("sum_closed") / n, F.lit(0.0))
    out = out.withColumn("stable_gap_closed", F.when(n > 0, n / (n + F.lit(float(gamma))) * gap))
    retained = F.when(F.col("stable_gap") > 0, F.col("stable_gap_closed") / F.col("stable_gap"))
    return out.withColumn("retained", retained).select(
        *all_named(keys), "n_cases", "censored_share", "replicated_share", "stable_gap", "stable_gap_closed", "retained", "stable_PI"
    )


def facets(scored: DataFrame, value: Column, view: str, baseline: Column, gamma: float = GAMMA) -> DataFrame:
    """Board row per facet value: cases, shares, gap, priority, open share and exposure."""
    s = named(f"score__{view}")
    rows = scored.withColumn("value", F.coalesce(value.cast("string"), F.lit(MISSING)))
    n_total = scored.agg(F.count(F.lit(1))).scalar()
    groups = rows.groupBy("value").agg(
        F.count(named(s)).alias("n_cases"),
        F.avg(named(s)).alias("mean_score"),
        F.stddev_samp(named(s)).alias("sd_score"),
        F.count_if(s < 1.0).alias("cases_below"),
        F.count_if(F.col("censored")).alias("open_cases"),
        F.avg(F.col("censored").cast("double")).alias("open_share"),
        F.sum(F.coalesce("exposure", F.lit(0.0))).alias("exposure"),
    )
    out = shortfall(groups.where(F.col("n_cases") > 0).withColumn("volume", F.col("n_cases").cast("double")), baseline, gamma)
    return out.select(
        "value",
        F.col("n_cases").alias("cases"),
        (F.col("n_cases") / n_total).alias("share"),
        "mean_score",
        "cases_below",
        (F.col("cases_below") / F.col("n_cases")).alias("share_below"),
        "gap",
        "stable_PI",
        "open_cases",
        "open_share",
        "exposure",
    )


def tiles(scored: DataFrame, selected: Column, keys: Sequence[str], view: str, baseline: Column, gamma: float = GAMMA) -> DataFrame:
    """The board's numbers for a selection: items, share below expectation, priority, open share, score."""
    s = named(f"score__{view}")
    pick = scored.where(holds(selected))
    groups = shortfall(group_scores(pick, keys, view), baseline, gamma)
    sums = groups.agg(F.struct(F.sum("stable_PI").alias("p"), F.count(F.lit(1)).alias("g"))).scalar()
    out = pick.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count(named(s)).alias("scored"),
        F.count_if(s < 1.0).alias("cases_below"),
        F.avg(named(s)).alias("mean_score"),
        F.count_if(F.col("censored")).alias("open_cases"),
    )
    return out.select(
        "cases",
        scored.agg(F.count(F.lit(1))).scalar().alias("cases_total"),
        "scored",
        F.when(F.col("scored") > 0, F.col("cases_below") / F.col("scored")).alias("share_below"),
        F.coalesce(sums["p"], F.lit(0.0)).alias("priority_at_stake"),
        sums["g"].alias("groups"),
        F.when(F.col("cases") > 0, F.col("open_cases") / F.col("cases")).alias("open_share"),
        "mean_score",
    )


def flow_comparison(scored: DataFrame, views: Sequence[str], norm: Norm) -> DataFrame:
    """Per flow type: cases, means and gaps per view, and the most-missed constraint."""
    first: list[Column] = [F.count(F.lit(1)).alias("cases"), F.avg(F.col("censored").cast("double")).alias("censored_share")]
    for v in views:
        first += [F.avg(named(f"score__{v}")).alias(f"mean__{v}"), F.sum(named(f"score__{v}")).alias(f"__s_{v}"), F.count(named(f"score__{v}")).alias(f"__n_{v}")]
    fields = {"hit": lambda c: F.count_if(named(f"v__{c.id}") > 0), "seen": lambda c: F.count(named(f"v__{c.id}"))}
    rows = label_keys(scored, ["flow_type"])
    groups = store(rows.groupBy("flow_type").agg(*first))
    whole = groups.agg(
        F.struct(F.sum("cases").alias("cases"), *[(F.sum(named(f"__s_{v}")) / F.sum(named(f"__n_{v}"))).alias(v) for v in views])
    ).scalar()
    missed = constraint_rows(rows, norm, fields, keys=["flow_type"]).where(F.col("seen") > 0)
    missed = missed.withColumn("missed_share", F.col("hit") / F.col("seen"))
    missed = top_per_key(missed, ["flow_type"], [F.desc("missed_share"), F.asc("position")], 1)
    missed = missed.select("flow_type", F.col("constraint_id").alias("most_missed"), "missed_share")
    out = groups.withColumn("share", F.col("cases") / whole["cases"])
    out = out.withColumns({f"gap__{v}": F.greatest(whole[v] - named(f"mean__{v}"), F.lit(0.0)) for v in views})
    out = join_on(out, missed, ["flow_type"], "left")
    return out.select(
        "flow_type", "cases", "share", *all_named(c for v in views for c in (f"mean__{v}", f"gap__{v}")), "censored_share", "most_missed", "missed_share"
    )


def flow_top_groups(scored: DataFrame, keys: Sequence[str], view: str, k: int = 3, gamma: float = GAMMA) -> DataFrame:
    """The top groups inside each flow type, measured against the overall score."""
    groups = store(group_scores(scored, ["flow_type", *keys], view))
    out = shortfall(groups, overall(groups), gamma)
    order = [F.desc("stable_PI"), F.desc("n_cases"), *[F.asc(named(c)) for c in keys]]
    return top_per_key(out, ["flow_type"], order, k).select("flow_type", *all_named(keys), "n_cases", "gap", "stable_PI", "rank")


# --------------------------------------------------------------------------- bands and grouping design
# The units of edge texts.
EDGE_UNITS = {"": 1.0, "k": 1e3, "M": 1e6}


def short_number(x: float) -> str:
    """Edge text with a unit; whole numbers below a thousand in full, others with three digits."""
    unit = max((u for u, size in EDGE_UNITS.items() if abs(x) >= size), key=EDGE_UNITS.get, default="")
    scaled = x / EDGE_UNITS[unit]
    return f"{scaled:.0f}" if not unit and scaled.is_integer() else f"{scaled:.3g}{unit}"


def band_edges(cases: DataFrame, attribute: str, q: int = 4, cuts: Sequence[float] | None = None) -> list[float]:
    """Inner band edges: given cuts, or the distinct inner quantiles strictly between minimum and maximum."""
    if cuts is not None:
        return [float(c) for c in cuts]
    numbers = cases.select(named(attribute).cast("string").try_cast("double").alias("x"))
    found = quantiles(numbers, [], "x", {f"q{i}": i / q for i in range(q + 1)}).first()
    if found is None:
        raise ValueError(f"{attribute!r} has no numeric values to band")
    return sorted({e for e in found[1:-1] if found[0] < e < found[-1]})


def band_labels(edges: Sequence[float]) -> list[str]:
    """A label below the first edge, one for each pair of neighbours, one from the last edge on."""
    if not edges:
        return ["all"]
    texts = list(map(short_number, edges))
    return [f"< {texts[0]}"] + [" – ".join(texts[i : i + 2]) for i in range(len(texts) - 1)] + [f"≥ {texts[-1]}"]


def band(attribute: str, edges: Sequence[float]) -> Column:
    """Band label of a value; bands are closed on the left."""
    x = F.expr(f"try_cast(cast({quoted(attribute)} as string) as double)")
    labels = band_labels(edges)
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels, strict=False))):
        out = F.when(x < F.lit(edge), F.lit(label)).otherwise(out)
    return F.when(x.isNull(), F.lit(MISSING)).otherwise(out)


def slicing_preview(scored: DataFrame, keys: Sequence[str], min_cases: int = MIN_CASES) -> DataFrame:
    """Number and sizes of the groups a slicing would give."""
    groups = store(label_keys(scored, keys).groupBy(*all_named(keys)).agg(F.count(F.lit(1)).alias("n")))
    out = groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("cases"),
        F.count_if(F.col("n") < min_cases).alias("below_min"),
        F.min("n").alias("size_min"),
        F.max("n").alias("size_max"),
    )
    q = quantiles(groups, [], "n", {"m": 0.5, "p": 0.9}).select(F.struct("m", "p")).scalar()
    return out.withColumns({"size_median": q["m"], "size_p90": q["p"]})


def largest_groups(scored: DataFrame, keys: Sequence[str], k: int = 10) -> DataFrame:
    groups = label_keys(scored, keys).groupBy(*all_named(keys)).agg(F.count(F.lit(1)).alias("n_cases"))
    return groups.orderBy(F.desc("n_cases"), *[F.asc(named(c)) for c in keys]).limit(k)


def grouping_options(cases: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per column: distinct and missing counts, numeric or categorical, and whether to suggest it."""
    types = dict(cases.dtypes)
    items = []
    for n in names:
        text = F.trim(named(n).cast("string"))
        number = F.expr(f"try_cast(cast({quoted(n)} as string) as double)")
        blank = named(n).isNull() | text.isin("", MISSING)
        items.append(
            F.struct(
                F.lit(n).alias("name"),
                F.when(~blank, text).alias("value"),
                F.when(~blank, number).alias("num"),
                F.lit(types[n] in ("boolean",) or types[n].startswith(("timestamp", "date"))).alias("fixed"),
            )
        )
    counts = cases.select(F.inline(F.array(*items))).groupBy("name", "value", "fixed").agg(
        F.count(F.lit(1)).alias("n"), F.count("num").alias("k")
    )
    out = counts.groupBy("name").agg(
        F.count("value").alias("distinct"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.sum("n").alias("rows"),
        F.sum("k").alias("numbers"),
        F.bool_or("fixed").alias("fixed"),
    )
    present = F.col("rows") - F.col("missing")
    numeric = ~F.col("fixed") & (present > 0) & (F.col("numbers") == present)
    identifier = (F.col("distinct") > 200) | ((F.col("distinct") >= 20) & (F.col("distinct") >= 0.8 * F.col("rows")))
    suggest = F.when(numeric, F.col("distinct") >= 2).otherwise((F.col("distinct") > 0) & ~identifier)
    return out.select(
        "name", F.when(numeric, "numeric").otherwise("categorical").alias("type"), "distinct", "missing", suggest.alias("suggested")
    )


def grouping_discovery(
    cases: DataFrame, columns: Sequence[str], min_cases: int, relevance: Mapping[str, float], widths: Sequence[int] = (1, 2, 3)
) -> DataFrame:
    """Score every combination of up to three columns by support and relevance.

    All combinations come from one ``GROUPING SETS`` aggregate over the cases.
    """
    from itertools import combinations

    combos = [c for w in widths for c in combinations(columns, w)]
    rows = label_keys(cases.select(*all_named(columns)), columns)
    # Equal rows are counted first: every combination then works on the counted rows.
    rows = rows.groupBy(*all_named(columns)).agg(F.count(F.lit(1)).alias("c"))
    sets = [[named(c) for c in combo] for combo in combos]
    grouped = rows.groupingSets(sets, *all_named(columns)).agg(F.sum("c").alias("n"), F.grouping_id().alias("gid"))
    full = (1 << len(columns)) - 1
    ids = {combo: full - sum(1 << (len(columns) - 1 - columns.index(c)) for c in combo) for combo in combos}
    missing = F.lit(False)
    for c in columns:
        missing = missing | holds(F.trim(named(c)).isin("", MISSING))
    per_set = grouped.groupBy("gid").agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("cases"),
        F.count_if(F.col("n") < min_cases).alias("below_min"),
        F.coalesce(F.sum(F.when(F.col("n") >= min_cases, F.col("n"))), F.lit(0)).alias("supported"),
        F.coalesce(F.sum(F.when(~missing, F.col("n"))), F.lit(0)).alias("support"),
    )
    name, rel = F.lit(None).cast("string"), F.lit(0.0)
    for combo, gid in ids.items():
        name = F.when(F.col("gid") == gid, F.lit(" × ".join(combo))).otherwise(name)
        rel = F.when(F.col("gid") == gid, F.lit(float(min(1.0, sum(relevance.get(c, 0.0) for c in combo))))).otherwise(rel)
    out = per_set.withColumns({"grouping": name, "relevance": rel})
    ratio = F.col("supported") / F.col("cases") * F.col("support") / F.col("cases")
    return out.withColumn("score", F.round(0.7 * ratio + 0.3 * F.col("relevance"), 6)).drop("gid")
