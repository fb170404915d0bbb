"""Observation window, readiness checks and data caveats.

Every check returns its evidence as a DataFrame; ``readiness`` turns the headline
numbers into one status row per check.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import all_named, holds, join_on, micros, named, period_label, text_rows
from ..functions.ordered import quantiles
from ..session import store
from .prepare import PLACEHOLDER_DATES

# The thresholds of the readiness checks.
THRESHOLDS: dict[str, float] = {
    "sentinel_gap_days": 365.0,
    "sentinel_share_warn": 0.0,
    "sentinel_share_fail": 0.005,
    "concentration_share_warn": 0.01,
    "concentration_min_events": 100,
    "duplicate_share_warn": 0.001,
    "duplicate_share_fail": 0.05,
    "precision_min_events": 20,
    "precision_mix_low": 0.05,
    "precision_mix_fail": 0.20,
    "drift_min_events": 200,
    "drift_jsd_warn": 0.05,
    "drift_label_share_fail": 0.01,
    "frequency_min_cases": 50,
    "frequency_step_warn": 0.10,
    "frequency_step_fail": 0.30,
    "asymmetry_share_warn": 0.10,
    "asymmetry_share_fail": 0.50,
    "exposure_zero_warn": 0.0,
    "exposure_zero_fail": 0.20,
    "exposure_decades": 2.0,
    "exposure_far_share_warn": 0.01,
    "exposure_far_share_fail": 0.10,
    "edge_share_warn": 0.05,
    "edge_share_fail": 0.20,
    "censored_share_warn": 0.02,
    "censored_share_fail": 0.20,
    "retained_fail": 0.5,
    "replication_ratio_flag": 2.0,
    "replicated_cases_warn": 0.02,
    "replicated_cases_fail": 0.25,
    "replicated_slice_fail": 0.5,
}

# First words that name a setting activity and the one releasing it.
VERB_PAIRS = (
    ("set", "remove"),
    ("set", "release"),
    ("set", "unset"),
    ("set", "clear"),
    ("set", "delete"),
    ("block", "unblock"),
    ("block", "release"),
    ("lock", "unlock"),
    ("hold", "release"),
    ("open", "close"),
    ("start", "end"),
    ("start", "finish"),
    ("start", "complete"),
    ("start", "stop"),
    ("add", "remove"),
    ("create", "delete"),
    ("create", "cancel"),
    ("record", "cancel"),
    ("assign", "unassign"),
    ("activate", "deactivate"),
    ("raise", "resolve"),
    ("raise", "close"),
    ("grant", "revoke"),
    ("suspend", "resume"),
    ("reserve", "release"),
)

# Caveat kinds with their case flag and the thresholds of their status.
CAVEATS = (
    ("censoring", "censored", "censored_share_warn", "censored_share_fail"),
    ("replication", "replicated", "replicated_cases_warn", "replicated_slice_fail"),
    ("duplicates", "duplicate", "duplicate_share_warn", "duplicate_share_fail"),
    ("sentinel_dates", "sentinel", "sentinel_share_warn", "sentinel_share_fail"),
    ("window_edge", "window_edge", "edge_share_warn", "edge_share_fail"),
)

DAY = 86_400_000_000


def status(value: Column, warn: float | None, fail: float | None) -> Column:
    """pass / warn / fail of a share; a warn threshold of 0 means any occurrence."""
    out = F.lit("pass")
    if warn is not None:
        out = F.when((value > warn) if warn == 0.0 else (value >= warn), "warn").otherwise(out)
    if fail is not None:
        out = F.when(value >= fail, "fail").otherwise(out)
    return F.when(value.isNull() | F.isnan(value), "skipped").otherwise(out)


# --------------------------------------------------------------------------- window
@dataclass(frozen=True)
class Bulk:
    """The stamps within three median deviations and a year of the median, in microseconds."""

    low: float
    high: float
    start: int
    end: int


TIMES = "__times"


def counted(events: DataFrame, *keys: Column | str) -> DataFrame:
    """Equal rows as one, with the column ``TIMES``; the checks below take a counted log like a plain one."""
    return events.groupBy(*all_named(keys)).agg(rows_in(events).alias(TIMES))


def rows_in(events: DataFrame, cond: Column | None = None) -> Column:
    """Aggregate: the number of events, or of those that meet a condition."""
    if TIMES in events.columns:
        return F.coalesce(F.sum(TIMES if cond is None else F.when(cond, F.col(TIMES))), F.lit(0))
    return F.count(F.lit(1)) if cond is None else F.count_if(cond)


def _weight(events: DataFrame) -> str | None:
    return TIMES if TIMES in events.columns else None


def bulk(events: DataFrame, gap_days: float = THRESHOLDS["sentinel_gap_days"]) -> Bulk | None:
    """Where the bulk of the timestamps lies; three scalar results, no row leaves the cluster."""
    rows = events.where(F.col("ts").isNotNull()).select(micros(F.col("ts")).alias("m"), *([TIMES] if _weight(events) else []))
    found = quantiles(rows, [], "m", {"med": 0.5}, times=True, weight=_weight(events)).first()
    if found is None:
        return None
    med = found["med"]
    far = rows.withColumn("d", F.abs(F.col("m") - F.lit(med)))
    mad = quantiles(far, [], "d", {"mad": 0.5}, weight=_weight(events)).first()["mad"]
    low, high = med - 3.0 * mad - gap_days * DAY, med + 3.0 * mad + gap_days * DAY
    ends = rows.where(F.col("m").between(low, high)).agg(F.min("m").alias("a"), F.max("m").alias("b")).first()
    return Bulk(low, high, ends["a"], ends["b"])


def sentinel_flag(b: Bulk) -> Column:
    m = micros(F.col("ts"))
    return holds((m < F.lit(b.low)) | (m > F.lit(b.high)))


def sentinel_dates(events: DataFrame, b: Bulk) -> DataFrame:
    """One row: far-out events, their share, and where the bulk starts and ends."""
    far = rows_in(events, sentinel_flag(b))
    return events.agg(
        far.alias("n_far"),
        (far / rows_in(events)).alias("share"),
        F.lit(b.start).cast("bigint").alias("bulk_start_us"),
        F.lit(b.end).cast("bigint").alias("bulk_end_us"),
    )


def sentinel_stamps(events: DataFrame, b: Bulk, k: int = 10) -> DataFrame:
    """The most frequent far-out stamps."""
    total = events.agg(F.count(F.lit(1))).scalar()
    counts = events.where(sentinel_flag(b)).groupBy("ts").agg(F.count(F.lit(1)).alias("n_events"))
    return counts.orderBy(F.desc("n_events"), F.asc("ts")).limit(k).withColumn("share", F.col("n_events") / total)


def observation_window(events: DataFrame, q: float = 0.001, gap_days: float = 365.0) -> tuple[int, int]:
    """Robust window in microseconds: quantiles of case starts and ends, or the bulk where those lie far out.

    The rule for the start mirrors the one for the end.
    """
    ends = events.groupBy("case_id").agg(F.min(micros(F.col("ts"))).alias("a"), F.max(micros(F.col("ts"))).alias("b"))
    ends = store(ends)
    start = quantiles(ends, [], "a", {"x": q}, times=True).first()
    end = quantiles(ends, [], "b", {"x": 1 - q}, times=True).first()
    b = bulk(events, gap_days)
    if start is None or end is None or b is None:
        raise ValueError("the log has no timestamps")
    first, last = int(start["x"]), int(end["x"])
    return (b.start if first < b.start - gap_days * DAY else first), (b.end if last > b.end + gap_days * DAY else last)


# --------------------------------------------------------------------------- timestamps
def concentration(events: DataFrame, k: int = 10, thresholds: Mapping[str, float] = THRESHOLDS) -> DataFrame:
    """The busiest stamps, their share of all events, and whether they count as heavy."""
    total = events.agg(rows_in(events)).scalar()
    counts = events.where(F.col("ts").isNotNull()).groupBy("ts").agg(rows_in(events).alias("n_events"))
    top = counts.orderBy(F.desc("n_events"), F.asc("ts")).limit(k).withColumn("share", F.col("n_events") / total)
    heavy = (F.col("share") > thresholds["concentration_share_warn"]) & (
        F.col("n_events") >= int(thresholds["concentration_min_events"])
    )
    return top.withColumn("heavy", heavy)


def duplicate_events(events: DataFrame) -> DataFrame:
    """Key duplicates and exact duplicates: events, share, cases.  Counted as copies beyond the first."""
    n = events.agg(F.count(F.lit(1))).scalar()
    kinds = {"key": ["case_id", "activity", "ts"], "exact": [c for c in events.columns if c != "seq"]}
    out: DataFrame | None = None
    for kind, cols in kinds.items():
        copies = events.groupBy(*all_named(cols)).agg((F.count(F.lit(1)) - 1).alias("x"))
        cases = copies.groupBy("case_id").agg(F.sum("x").alias("x"))
        row = cases.agg(F.sum("x").alias("n_events"), F.count_if(F.col("x") > 0).alias("n_cases"))
        row = row.select(F.lit(kind).alias("kind"), "n_events", (F.col("n_events") / n).alias("share"), "n_cases")
        out = row if out is None else out.unionByName(row)
    return out


def midnight(ts: Column) -> Column:
    return ts == F.date_trunc("day", ts).cast("timestamp_ntz")


def day_precision(events: DataFrame, thresholds: Mapping[str, float] = THRESHOLDS) -> DataFrame:
    """Per activity: the share of date-only stamps and day / time / mixed."""
    low = thresholds["precision_mix_low"]
    date_only = rows_in(events, holds(midnight(F.col("ts")))) / rows_in(events)
    out = events.groupBy(F.coalesce("activity", F.lit("(null)")).alias("activity")).agg(
        rows_in(events).alias("n_events"), date_only.alias("share_date_only")
    )
    p = F.col("share_date_only")
    kind = F.when(p >= 1.0 - low, "day").when(p <= low, "time").otherwise("mixed")
    eligible = F.col("n_events") >= int(thresholds["precision_min_events"])
    return out.withColumn("precision", kind).withColumn("mixed", eligible & (kind == "mixed"))


def stamp_precision(events: DataFrame) -> DataFrame:
    """Per activity: the coarsest unit that at least 95 % of the dated events keep to."""
    m = micros(F.col("ts"))
    units = {"day_share": DAY, "minute_share": 60_000_000, "second_share": 1_000_000}
    rows = events.where(F.col("ts").isNotNull()).groupBy("activity")
    out = rows.agg(
        F.count(F.lit(1)).alias("n_events"), *[F.avg((F.pmod(m, F.lit(u)) == 0).cast("double")).alias(n) for n, u in units.items()]
    )
    kind = (
        F.when(F.col("day_share") >= 0.95, "day")
        .when(F.col("minute_share") >= 0.95, "minute")
        .when(F.col("second_share") >= 0.95, "second")
        .otherwise("sub-second")
    )
    return out.withColumn("precision", kind)


def lag_precision_notes(precision: DataFrame, lags: Mapping[str, tuple[Sequence[str], Sequence[str]]]) -> DataFrame:
    """Lags whose two ends differ in their date-only share by more than one half."""
    aggs, rows = [], []
    for i, (cid, (a, b)) in enumerate(lags.items()):
        for side, labels in (("a", a), ("b", b)):
            aggs.append(F.avg(F.when(F.col("activity").isin(list(labels)), F.col("share_date_only"))).alias(f"{side}{i}"))
        rows.append(F.struct(F.lit(cid).alias("constraint_id"), named(f"a{i}").alias("share_a"), named(f"b{i}").alias("share_b")))
    out = precision.agg(*aggs).select(F.inline(F.array(*rows)))
    return out.where(F.abs(F.col("share_a") - F.col("share_b")) > 0.5)


def placeholder_stamps(events: DataFrame, start_us: int, end_us: int, min_events: int = 5, k: int = 10) -> DataFrame:
    """Repeated stamps outside the window, known placeholder dates, and the outermost stamps."""
    m = micros(F.col("ts"))
    outside = events.where((m < start_us) | (m > end_us)).groupBy("ts").agg(F.count(F.lit(1)).alias("n_events"))
    known = F.date_format("ts", "yyyy-MM-dd").isin(list(PLACEHOLDER_DATES))
    repeated = outside.where((F.col("n_events") >= min_events) | known)
    repeated = repeated.orderBy(F.desc("n_events"), F.asc("ts")).limit(k)
    repeated = repeated.select("ts", "n_events", F.lit("repeated stamp outside the window").alias("reason"))
    extreme = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).select(
        F.inline(
            F.array(
                F.struct(F.col("lo").alias("ts"), F.lit("earliest timestamp").alias("reason")),
                F.struct(F.col("hi").alias("ts"), F.lit("latest timestamp").alias("reason")),
            )
        )
    )
    edges = extreme.join(outside, "ts").join(repeated.select("ts"), "ts", "left_anti")
    return repeated.unionByName(edges.select("ts", "n_events", "reason"))


# --------------------------------------------------------------------------- drift
def dense(counts: DataFrame, row_key: str, column_key: str) -> DataFrame:
    """All pairs of the (few) periods and labels of a grouped table, with 0 where a pair is absent."""
    periods = counts.agg(F.sort_array(F.collect_set(column_key))).scalar()
    grid = counts.select(row_key).distinct().withColumn(column_key, F.explode(periods))
    return join_on(grid, counts, [row_key, column_key], "left").fillna(0)


def vocabulary_drift(
    events: DataFrame, grain: str = "month", min_events: int = 200, *, reference: str | None = None, expected: Sequence[str] | None = None
) -> DataFrame:
    """Per period: Jensen-Shannon divergence to the pooled earlier eligible periods, new and vanished labels.

    The first eligible period is compared with the later ones.  With ``reference``, the label of a period that the log
    holds, all periods are compared with that one, whether eligible or not; a label that it does not hold changes nothing.
    With ``expected``, say the activities of a norm, ``missing_labels`` lists those that a period lacks.
    """
    rows = events.where(F.col("ts").isNotNull())
    counts = rows.groupBy(F.coalesce("activity", F.lit("(null)")).alias("activity"), period_label(F.col("ts"), grain).alias("period"))
    grid = dense(store(counts.agg(rows_in(events).alias("n"))), "activity", "period")
    in_period = Window.partitionBy("period")
    grid = grid.withColumn("n_events", F.sum("n").over(in_period))
    grid = grid.withColumn("eligible", F.col("n_events") >= min_events)
    counted = F.when(F.col("eligible"), F.col("n")).otherwise(0)
    by_label = Window.partitionBy("activity").orderBy("period")
    earlier = by_label.rowsBetween(Window.unboundedPreceding, -1)
    later = by_label.rowsBetween(1, Window.unboundedFollowing)
    usable = F.col("eligible").cast("int")
    grid = grid.withColumns(
        {
            "before": F.coalesce(F.sum(named(counted)).over(earlier), F.lit(0)),
            "after": F.coalesce(F.sum(named(counted)).over(later), F.lit(0)),
            "has_before": F.coalesce(F.sum(named(usable)).over(earlier), F.lit(0)) > 0,
        }
    )
    ref = F.when(F.col("has_before"), F.col("before")).otherwise(F.col("after"))
    if reference is not None:
        # Every label has a row in every period, so the named period answers for each label by itself.
        ref = F.coalesce(F.max(F.when(F.col("period") == reference, F.col("n"))).over(Window.partitionBy("activity")), ref)
    grid = grid.withColumn("ref", ref)
    grid = grid.withColumn("ref_total", F.sum("ref").over(in_period))
    p, q = F.col("n") / F.col("n_events"), F.when(F.col("ref_total") > 0, F.col("ref") / F.col("ref_total"))
    m = (p + q) / 2
    terms = F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)
    is_new = (F.col("n") > 0) & (F.col("ref") == 0)
    gone = (F.col("n") == 0) & (F.col("ref") > 0)
    known = F.max("ref_total") > 0

    def names(cond: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_list(F.when(cond, F.col("activity")))), ", ")

    lacking = []
    if expected is not None:
        wanted = F.array(*[F.lit(x) for x in sorted(set(expected))]).cast("array<string>")
        present = F.collect_list(F.when((F.col("n") > 0) & F.col("activity").isin(list(expected)), F.col("activity")))
        lacking.append(F.array_join(F.array_except(wanted, present), ", ").alias("missing_labels"))
    return grid.groupBy("period").agg(
        F.max("n_events").alias("n_events"),
        F.bool_or("eligible").alias("eligible"),
        F.when(known, F.sum(0.5 * terms)).alias("jsd"),
        names(is_new).alias("new_labels"),
        F.when(known, F.sum(F.when(is_new, F.col("n")).otherwise(0)) / F.max("n_events")).alias("new_share"),
        names(gone).alias("vanished_labels"),
        F.when(known, F.sum(F.when(gone, F.col("ref")).otherwise(0)) / F.max("ref_total")).alias("vanished_share"),
        *lacking,
    )


def frequency_drift(
    events: DataFrame, grain: str = "month", *, end: str, window_days: int = 60, min_cases: int = 50
) -> DataFrame:
    """Share of cases with each activity by the period of the case start.

    A period that ends within ``window_days`` of ``end`` is marked censored.
    """
    pairs = events.groupBy("case_id", "activity").agg(F.min("ts").alias("t"))
    pairs = pairs if _weight(events) else store(pairs)
    starts = pairs.groupBy("case_id").agg(F.min("t").alias("start")).where(F.col("start").isNotNull())
    starts = starts.select("case_id", period_label(F.col("start"), grain).alias("period"), "start")
    per_period = starts.groupBy("period").agg(F.count(F.lit(1)).alias("n_cases"), F.max("start").alias("__any"))
    labelled = pairs.where(F.col("activity").isNotNull())
    counts = join_on(labelled, starts, ["case_id"]).groupBy("activity", "period").agg(F.count(F.lit(1)).alias("n_with"))
    periods = per_period.agg(F.sort_array(F.collect_set("period"))).scalar()
    grid = labelled.select("activity").distinct().withColumn("period", F.explode(periods))
    grid = join_on(grid, counts, ["activity", "period"], "left").fillna(0)
    out = grid.join(per_period, "period")
    step = {"month": "MONTH", "quarter": "QUARTER", "year": "YEAR"}[grain]
    first_day = F.date_trunc(step, F.col("__any")).cast("timestamp_ntz")
    next_start = F.timestamp_add(step, F.lit(1), first_day)
    limit = F.timestamp_add("DAY", F.lit(-window_days), F.lit(end).cast("timestamp_ntz"))
    return out.select(
        "activity",
        "period",
        "n_cases",
        "n_with",
        (F.col("n_with") / F.col("n_cases")).alias("share"),
        (F.col("n_cases") >= min_cases).alias("eligible"),
        (next_start > limit).alias("censored"),
    )


def frequency_steps(table: DataFrame) -> DataFrame:
    """Per activity: the split of the usable periods with the largest change of the case-weighted share."""
    usable = table.where(F.col("eligible") & ~F.col("censored"))
    by = Window.partitionBy("activity")
    run = by.orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    rows = usable.withColumns(
        {
            "cn": F.sum("n_cases").over(run),
            "cw": F.sum("n_with").over(run),
            "tn": F.sum("n_cases").over(by),
            "tw": F.sum("n_with").over(by),
        }
    )
    before = F.col("cw") / F.col("cn")
    after = (F.col("tw") - F.col("cw")) / (F.col("tn") - F.col("cn"))
    rows = rows.withColumns({"share_before": before, "share_after": after, "step_size": F.abs(after - before)})
    order = F.row_number().over(by.orderBy("period"))
    rows = rows.withColumn("__i", order)
    best = F.max_by(
        F.struct(F.col("period").alias("step_period"), "share_before", "share_after", "step_size"),
        F.when(F.col("cn").isNotNull(), F.struct(F.round("step_size", 9), -F.col("__i"))),
    )
    found = rows.groupBy("activity").agg(
        F.count(F.lit(1)).alias("n_periods"),
        F.min("share").alias("share_min"),
        F.max("share").alias("share_max"),
        F.min_by("share", "__i").alias("share_first"),
        F.max_by("share", "__i").alias("share_last"),
        best.alias("best"),
    )
    censored = table.groupBy("activity").agg(F.count_if(F.col("censored")).alias("n_censored"))
    out = join_on(censored, found, ["activity"], "left")
    return out.select(
        "activity", F.coalesce("n_periods", F.lit(0)).alias("n_periods"), "n_censored", "share_min", "share_max", "share_first", "share_last", "best.*"
    )


# --------------------------------------------------------------------------- labels that belong together
def activity_pairs(labels: DataFrame) -> DataFrame:
    """Setting / releasing pairs among the distinct labels: same remainder, a known verb pair."""
    words = labels.select("activity", F.split(F.trim("activity"), r"\s+").alias("w")).where(F.size("w") >= 2)
    words = words.select(
        "activity",
        F.lower(F.element_at("w", 1)).alias("verb"),
        F.lower(F.array_join(F.slice("w", 2, F.size("w")), " ")).alias("stem"),
    )
    verbs = text_rows(labels.sparkSession, VERB_PAIRS, ["verb", "other"])
    left = words.join(verbs, "verb").select(F.col("activity").alias("setting"), "stem", F.col("other").alias("verb"))
    right = words.select(F.col("activity").alias("releasing"), "stem", "verb")
    return left.join(right, ["stem", "verb"]).select("setting", "releasing").distinct()


def logging_asymmetry(events: DataFrame, pairs: DataFrame, norm_labels: Sequence[str] = ()) -> DataFrame:
    """Per pair: events on both sides, and cases with a release but no logged setting event."""
    counts = events.where(F.col("activity").isNotNull()).groupBy("activity", "case_id").agg(rows_in(events).alias("n"))
    # Stored, the few pairs have a known size, so the counts meet them where they are.  Per case, a number stands for both labels.
    numbered = store(pairs.distinct().withColumn("pair", F.monotonically_increasing_id()))
    sides = [F.struct(named(c).alias("activity"), F.lit(c == "setting").alias("sets")) for c in ("setting", "releasing")]
    rows = counts.join(numbered.select("pair", F.inline(F.array(*sides))), "activity")
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    both = rows.groupBy("pair", "case_id").agg(F.sum(F.when(F.col("sets"), n).otherwise(zero)).alias("s"), F.sum(F.when(F.col("sets"), zero).otherwise(n)).alias("r"))
    out = both.groupBy("pair").agg(
        F.sum("s").alias("n_setting_events"),
        F.sum("r").alias("n_releasing_events"),
        F.count_if(F.col("r") > 0).alias("cases_with_release"),
        F.count_if((F.col("r") > 0) & (F.col("s") == 0)).alias("cases_release_without_set"),
    )
    out = numbered.join(out, "pair").drop("pair")
    labelled = list(norm_labels) or [""]
    return out.withColumns(
        {
            "event_ratio": F.when(F.col("n_setting_events") > 0, F.col("n_releasing_events") / F.col("n_setting_events")),
            "share_release_without_set": F.when(
                F.col("cases_with_release") > 0, F.col("cases_release_without_set") / F.col("cases_with_release")
            ),
            "setting_in_norm": F.col("setting").isin(labelled),
            "releasing_in_norm": F.col("releasing").isin(labelled),
        }
    )


def norm_evidence(events: DataFrame, labelled: Mapping[str, Sequence[str]]) -> DataFrame:
    """Labels that constraints name but the log never carries."""
    rows = [(cid, label) for cid, labels in labelled.items() for label in labels]
    wanted = text_rows(events.sparkSession, rows, ["constraint_id", "activity"])
    return join_on(wanted, events.select("activity").distinct(), ["activity"], "left_anti")


def norm_relevance(events: DataFrame, labelled: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per constraint: events and distinct cases that carry one of its labels."""
    rows = [(cid, label) for cid, labels in labelled.items() for label in labels]
    wanted = text_rows(events.sparkSession, rows, ["constraint_id", "activity"])
    counts = events.groupBy("case_id", "activity").agg(F.count(F.lit(1)).alias("n"))
    hit = counts.join(wanted, "activity").groupBy("constraint_id", "case_id").agg(F.sum("n").alias("n"))
    hit = hit.groupBy("constraint_id").agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("cases"))
    ids = wanted.select("constraint_id").distinct()
    return join_on(ids, hit, ["constraint_id"], "left").fillna(0)


# --------------------------------------------------------------------------- exposure, edges, replication
def exposure_sanity(cases: DataFrame, group: str, decades: float = THRESHOLDS["exposure_decades"]) -> DataFrame:
    """Per group: median magnitude, its distance to the overall median, share of cases far from the group median."""
    rows = cases.where(F.col("exposure") > 0).select(
        F.coalesce(named(group).cast("string"), F.lit("(missing)")).alias("group"), F.log10("exposure").alias("lg")
    )
    rows = store(rows)
    whole = quantiles(rows, [], "lg", {"m": 0.5}).scalar()
    med = quantiles(rows, ["group"], "lg", {"median_log10": 0.5})
    far = join_on(rows, med, ["group"]).groupBy("group").agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.max("median_log10").alias("median_log10"),
        F.avg((F.abs(F.col("lg") - F.col("median_log10")) > decades).cast("double")).alias("far_share"),
    )
    return far.withColumn("decades_from_overall", F.col("median_log10") - whole)


def exposure_zero_share(cases: DataFrame) -> DataFrame:
    return cases.agg(F.avg((F.coalesce("exposure", F.lit(0.0)) <= 0).cast("double")).alias("zero_share"))


def window_edges(cases: DataFrame, lags: Mapping[str, tuple[str, int]], end_us: int, by: Sequence[str] = ()) -> DataFrame:
    """Per lag (and group): cases whose activation lies within the lag's horizon of the window end.

    ``lags`` maps a constraint to its activation column and horizon in microseconds.
    """
    aggs, rows = [], []
    for i, (cid, (col, horizon)) in enumerate(lags.items()):
        aggs += [F.count(named(col)).alias(f"n{i}"), F.count_if(micros(named(col)) > F.lit(end_us - horizon)).alias(f"e{i}")]
        rows.append(
            F.struct(F.lit(cid).alias("constraint_id"), named(f"n{i}").alias("n_with_activation"), named(f"e{i}").alias("n_edge"))
        )
    out = (cases.groupBy(*all_named(by)) if by else cases).agg(*aggs).select(*all_named(by), F.inline(F.array(*rows)))
    ratio = F.when(F.col("n_with_activation") > 0, F.col("n_edge") / F.col("n_with_activation"))
    return out.withColumn("edge_share", ratio)


def replication(events: DataFrame) -> DataFrame:
    """Per case: events per distinct timestamp, the share of repeated stamps, and the flag."""
    stamps = events.where(F.col("ts").isNotNull()).groupBy("case_id", "ts").agg(rows_in(events).alias("n"))
    out = stamps.groupBy("case_id").agg(
        F.sum("n").alias("n_events"),
        F.count(F.lit(1)).alias("n_stamps"),
        (F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("replicated_share"),
    )
    ratio = F.col("n_events") / F.col("n_stamps")
    return out.withColumn("replication_ratio", ratio).withColumn("replicated", ratio > THRESHOLDS["replication_ratio_flag"])


def cross_case_replication(events: DataFrame, document: str) -> DataFrame:
    """Per case: share of its events whose document, activity and stamp also occur in another case."""
    rows = events.where(named(document).isNotNull() & F.col("ts").isNotNull())
    per_case = rows.groupBy(named(document), "activity", "ts", "case_id").agg(rows_in(events).alias("n"))
    per_case = store(per_case)
    shared = per_case.groupBy(named(document), "activity", "ts").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1)
    marked = join_on(per_case, shared, [document, "activity", "ts"], "left")
    n = F.sum("n")
    return marked.groupBy("case_id").agg(
        n.alias("n_events"), (F.sum(F.when(F.col("k").isNotNull(), F.col("n")).otherwise(0)) / n).alias("cross_share")
    )


# --------------------------------------------------------------------------- caveats and the report
def case_flags(events: DataFrame, b: Bulk) -> DataFrame:
    """Per case: duplicate, sentinel and replicated flags."""
    key = events.groupBy("case_id", "activity", "ts").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(sentinel_flag(b)).alias("far")
    )
    flags = key.groupBy("case_id").agg(
        F.bool_or(F.col("n") > 1).alias("duplicate"),
        F.bool_or("far").alias("sentinel"),
        (F.sum(F.when(F.col("ts").isNotNull(), F.col("n"))) / F.count_distinct("ts")).alias("__ratio"),
    )
    return flags.withColumn("replicated", holds(F.col("__ratio") > THRESHOLDS["replication_ratio_flag"])).drop("__ratio")


def caveats_by(cases: DataFrame, by: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Per group: its size and the share of flagged cases per caveat kind."""
    flags = {kind: flag for kind, flag, _, _ in CAVEATS if kind in kinds}
    shares = [F.avg(holds(F.col(flag)).cast("double")).alias(f"{kind}_share") for kind, flag in flags.items()]
    return cases.groupBy(*all_named(by)).agg(F.count(F.lit(1)).alias("n_cases"), *shares)


def caveats_long(groups: DataFrame, by: Sequence[str], kinds: Sequence[str], min_share: float = 0.0) -> DataFrame:
    """One row per group and caveat above ``min_share``, with its status."""
    items = [
        F.struct(
            F.lit(kind).alias("caveat"),
            named(f"{kind}_share").alias("share"),
            status(named(f"{kind}_share"), THRESHOLDS[warn], THRESHOLDS[fail]).alias("status"),
        )
        for kind, _, warn, fail in CAVEATS
        if kind in kinds
    ]
    return groups.select(*all_named(by), "n_cases", F.inline(F.array(*items))).where(F.col("share") > min_share)


def caveat_summary(long: DataFrame, groups: DataFrame, factor: float = 1.5) -> DataFrame:
    """Per caveat: case-weighted share over the page, the largest share, groups that carry it, display threshold."""
    weight = groups.agg(F.sum("n_cases")).scalar()
    out = long.groupBy("caveat").agg(
        (F.sum(F.col("share") * F.col("n_cases")) / weight).alias("page_share"),
        F.max("share").alias("max_share"),
        F.count(F.lit(1)).alias("groups"),
    )
    return out.withColumn("threshold", F.col("page_share") * factor)


def check_row(df: DataFrame, name: str, value: Column, state: Column) -> DataFrame:
    """One report row from a one-row or grouped evidence table."""
    return df.agg(value.cast("double").alias("value"), state.alias("status")).select(F.lit(name).alias("check_name"), "value", "status")


def leading_slices(scored: DataFrame, by: Sequence[str], view: str, gamma: float, k: int, edge: Column | None) -> DataFrame:
    """The ``k`` slices with the highest priority: open, replicated and edge shares of their cases, and the gap retained without open cases."""
    from .backlog import label_keys, validation

    top = validation(scored, by, view, gamma).orderBy(F.desc_nulls_last("stable_PI"), F.desc("n_cases"), *all_named(by)).limit(k)
    shares = label_keys(scored, by).groupBy(*all_named(by)).agg(
        F.avg(holds(F.col("replicated")).cast("double")).alias("replicated_all"),
        F.avg((holds(edge) if edge is not None else F.lit(False)).cast("double")).alias("edge_all"),
    )
    return store(join_on(top, shares, by))


def readiness(
    events: DataFrame,
    cases: DataFrame,
    b: Bulk | None = None,
    *,
    end: str,
    group: str,
    lags: Mapping[str, tuple[str, int]],
    end_us: int,
    grain: str = "month",
    document: str | None = None,
    t: Mapping[str, float] = THRESHOLDS,
    norm_labels: Sequence[str] = (),
    lag_labels: Mapping[str, tuple[Sequence[str], Sequence[str]]] | None = None,
    scored: DataFrame | None = None,
    by: Sequence[str] = (),
    view: str | None = None,
    gamma: float = 0.0,
    k: int = 10,
) -> DataFrame:
    """All checks as rows ``check_name, value, status``.

    The events are read once, into a counted table of case, activity and stamp; four smaller tables of
    it serve all checks.  ``cases`` is a stored table with the ``censored`` flag and the activation
    columns of ``lags``.  ``norm_labels`` and ``lag_labels`` are what the norm names.  With ``scored``
    (a case table with the columns of ``cases``, a score, ``censored`` and ``replicated``), ``by`` and
    ``view``, the slices that lead the backlog can lower the status of three checks.
    """
    rows: list[DataFrame] = []

    def add(name: str, df: DataFrame, value: Column, warn: float | None, fail: float | None, at_least: str = "pass") -> None:
        out = df.agg(value.cast("double").alias("value"))
        rows.append(out.select(F.lit(name).alias("check_name"), "value", worse(status(F.col("value"), warn, fail), at_least).alias("status")))

    def worse(found: Column, at_least: str) -> Column:
        higher = {"pass": (), "warn": ("pass",), "fail": ("pass", "warn")}[at_least]
        return F.when(found.isin(list(higher)), at_least).otherwise(found) if higher else found

    cube = store(counted(events, "case_id", "activity", "ts", *([document] if document else [])))
    stamps = store(counted(cube, "ts"))
    # Any stamp of the same period and precision stands for the others.
    kinds = [F.col("activity"), period_label(F.col("ts"), grain).alias("period"), midnight(F.col("ts")).alias("date_only")]
    labels = store(cube.groupBy(*kinds).agg(F.min("ts").alias("ts"), F.sum(TIMES).alias(TIMES)))
    of_case = store(cube.groupBy("case_id", "activity").agg(F.min("ts").alias("ts"), F.sum(TIMES).alias(TIMES)))

    b = bulk(stamps, t["sentinel_gap_days"]) if b is None else b
    add("sentinel_dates", sentinel_dates(stamps, b), F.max("share"), t["sentinel_share_warn"], t["sentinel_share_fail"])
    heavy = concentration(stamps)
    rows.append(check_row(heavy, "timestamp_concentration", F.max("share"), F.when(F.bool_or("heavy"), "warn").otherwise("pass")))
    per_key = counted(cube, "case_id", "activity", "ts") if document else cube
    add("duplicate_events", per_key, F.sum(F.col(TIMES) - 1) / F.sum(TIMES), t["duplicate_share_warn"], t["duplicate_share_fail"])
    p = F.col("share_date_only")
    precision = store(day_precision(labels))
    apart = bool(lag_labels) and not lag_precision_notes(precision, lag_labels).isEmpty()
    minority = F.coalesce(F.max(F.when(F.col("mixed"), F.least(p, 1 - p))), F.lit(0.0))
    precise = F.when(minority >= t["precision_mix_fail"], "fail").when(F.bool_or("mixed") | F.lit(apart), "warn").otherwise("pass")
    rows.append(check_row(precision, "timestamp_precision", minority, precise))
    drift = vocabulary_drift(labels, grain, int(t["drift_min_events"])).where(F.col("eligible") & F.col("jsd").isNotNull())
    any_new = F.bool_or(F.col("new_labels") != "")
    changed = F.bool_or((F.col("new_labels") != "") | (F.col("vanished_labels") != ""))
    value = F.when(any_new, F.max("new_share")).otherwise(F.max("jsd"))
    state = (
        F.when(F.count(F.lit(1)) == 0, "skipped")
        .when(F.max("new_share") >= t["drift_label_share_fail"], "fail")
        .when(changed | (F.max("jsd") >= t["drift_jsd_warn"]), "warn")
        .otherwise("pass")
    )
    rows.append(check_row(drift, "vocabulary_drift", value, state))
    steps = frequency_steps(frequency_drift(of_case, grain, end=end, min_cases=int(t["frequency_min_cases"])))
    add("activity_frequency_drift", steps.where(F.col("n_periods") >= 2), F.max("step_size"), t["frequency_step_warn"], t["frequency_step_fail"])
    pairs = activity_pairs(labels.select("activity").distinct())
    asym = logging_asymmetry(of_case, pairs, norm_labels)
    share = F.max("share_release_without_set")
    lost = F.bool_or((F.col("share_release_without_set") >= t["asymmetry_share_fail"]) & F.col("setting_in_norm"))
    rows.append(check_row(asym, "logging_asymmetry", share, F.when(share.isNotNull() & holds(lost), "fail").otherwise(status(share, t["asymmetry_share_warn"], None))))
    add("exposure_zero", exposure_zero_share(cases), F.max("zero_share"), t["exposure_zero_warn"], t["exposure_zero_fail"])
    far = store(exposure_sanity(cases, group))
    far_share = F.sum(F.col("far_share") * F.col("n_cases")) / F.sum("n_cases")
    add("exposure_far", far, far_share, t["exposure_far_share_warn"], t["exposure_far_share_fail"])
    add("exposure_units", far, F.max(F.abs("decades_from_overall")), None, t["exposure_decades"])
    edge = store(window_edges(cases, lags, end_us))
    slices = {"edge": "pass", "retained": "pass", "replicated": "pass"}
    if scored is not None and by and view:
        first = edge.where("edge_share is not null").orderBy(F.desc("edge_share")).limit(1).select("constraint_id").first()
        at_edge = None
        if first is not None:
            column, horizon = lags[first["constraint_id"]]
            at_edge = micros(named(column)) > F.lit(end_us - horizon)
        top = leading_slices(scored, by, view, gamma, k, at_edge)
        found = top.agg(
            F.bool_or(F.col("edge_all") >= t["edge_share_warn"]).alias("edge"),
            F.bool_or((F.col("stable_gap") > 0) & (F.col("retained") < t["retained_fail"])).alias("retained"),
            F.bool_or(F.col("replicated_all") >= t["replicated_slice_fail"]).alias("replicated"),
        ).first()
        slices = {"edge": "warn" if found["edge"] else "pass", "retained": "fail" if found["retained"] else "pass", "replicated": "fail" if found["replicated"] else "pass"}
    add("window_edge", edge, F.max("edge_share"), t["edge_share_warn"], t["edge_share_fail"], slices["edge"])
    add("right_censoring", cases, F.avg(holds(F.col("censored")).cast("double")), t["censored_share_warn"], t["censored_share_fail"], slices["retained"])
    rep = replication(cube)
    add("event_replication", rep, F.avg(F.col("replicated").cast("double")), t["replicated_cases_warn"], t["replicated_cases_fail"], slices["replicated"])
    if document:
        cross = cross_case_replication(cube, document)
        rows.append(
            check_row(cross, "cross_case_replication", F.avg((F.col("cross_share") > 0).cast("double")), F.lit("pass"))
        )
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def overall_status(report: DataFrame) -> DataFrame:
    """The worst status of a report."""
    worst = F.when(F.bool_or(F.col("status") == "fail"), "fail").when(F.bool_or(F.col("status") == "warn"), "warn").otherwise("pass")
    return report.agg(worst.alias("status"), F.count_if(F.col("status") == "fail").alias("failed"), F.count_if(F.col("status") == "warn").alias("warned"))
