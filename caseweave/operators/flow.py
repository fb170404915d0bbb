"""Process map, variants and timing between activities."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import all_named, elapsed, holds, join_on, named, text_rows
from ..functions.ordered import log_order, quantiles, sort_key, with_next
from ..session import store
from .backlog import constraint_rows
from .norm import Norm
from .profile import top_per_key

# The labels of a longer case are not listed per case, only per variant.
CHUNK_STEPS = 10_000


def _keyed(events: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    cols = ["case_id", "activity", "ts", *(["ord"] if "ord" in events.columns else []), "seq", *extra]
    return events.select(*dict.fromkeys(cols))


def sequence(events: DataFrame, extra: Sequence[str] = (), *, hot_events: int = 1_000_000) -> DataFrame:
    """Events with position and successor; one exchange by case, which everything per case below reuses."""
    return with_next(_keyed(events, extra), hot_events=hot_events)


# --------------------------------------------------------------------------- directly-follows graph
# What a map counts.
KINDS = ("node", "edge", "start", "end", "case")


def map_counts(seq: DataFrame, kinds: Sequence[str] = KINDS, keys: Sequence[str] = ()) -> DataFrame:
    """Everything a map shows, counted in one pass over the events: ``kind, source, target, hours, n, cases``.

    An event counts for its activity, for the pair with its successor and for the ends of its case.  The
    first event of a case that shows an activity or a pair carries the case, so distinct cases are sums.
    The result has a row per pair and distinct duration; it is stored, the events are not.
    """
    here, then = F.col("activity"), F.col("nxt_activity")
    of_case = [*all_named(keys), F.col("case_id"), here]
    hours = elapsed(F.col("ts"), F.col("nxt_ts"), "h")
    rows = seq.select(*all_named(keys), "case_id", "activity", "nxt_activity", "pos", "is_first", hours.alias("hours"))
    if "node" in kinds:
        rows = rows.withColumn("first_node", F.row_number().over(Window.partitionBy(*of_case).orderBy("nxt_activity", "pos")) == 1)
    if "edge" in kinds:
        rows = rows.withColumn("first_edge", F.row_number().over(Window.partitionBy(*of_case, "nxt_activity").orderBy("pos")) == 1)
    none, labelled, nowhere = F.lit(None).cast("string"), here.isNotNull(), F.lit(None).cast("double")

    def item(kind: str, target: Column, hours: Column, case: Column) -> Column:
        source = none if kind == "case" else here
        return F.struct(F.lit(kind).alias("kind"), source.alias("source"), target.alias("target"), hours.alias("hours"), case.cast("bigint").alias("case"))

    one = F.lit(1)
    shown = {
        "node": lambda: F.when(labelled, item("node", none, nowhere, F.col("first_node"))),
        "edge": lambda: F.when(labelled & then.isNotNull(), item("edge", then, F.col("hours"), F.col("first_edge"))),
        "start": lambda: F.when(labelled & F.col("is_first"), item("start", none, nowhere, one)),
        "end": lambda: F.when(labelled & then.isNull(), item("end", none, nowhere, one)),
        "case": lambda: F.when(F.col("is_first"), item("case", none, nowhere, one)),
    }
    long = rows.select(*all_named(keys), F.inline(F.array_compact(F.array(*[shown[k]() for k in kinds]))))
    return store(long.groupBy("kind", *all_named(keys), "source", "target", "hours").agg(F.count(F.lit(1)).alias("n"), F.sum("case").alias("cases")))


def _counted(rows: DataFrame, kinds: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``rows`` is a sequence, or what ``map_counts`` made of one."""
    return rows if "kind" in rows.columns else map_counts(rows, kinds, keys)


def nodes(seq: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    rows = _counted(seq, ["node"], keys).where("kind = 'node'")
    return rows.groupBy(*all_named(keys), F.col("source").alias("activity")).agg(F.sum("n").alias("events"), F.sum("cases").alias("cases"))


def edges(seq: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Directly-follows pairs: count, distinct cases and median hours."""
    rows = _counted(seq, ["edge"], keys).where("kind = 'edge'")
    key = [*keys, "source", "target"]
    counts = rows.groupBy(*all_named(key)).agg(F.sum("n").alias("n"), F.sum("cases").alias("cases"))
    return join_on(counts, quantiles(rows, key, "hours", {"median_hours": 0.5}, weight="n"), key, "left")


def boundaries(seq: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Start and end counts of the map: first events, and events without a labelled successor."""
    rows = _counted(seq, ["start", "end"], keys).where("kind in ('start', 'end')")
    return rows.groupBy(*all_named(keys), F.col("source").alias("activity"), F.col("kind").alias("side")).agg(F.sum("n").alias("n"))


def focus_paths(seq: DataFrame, focus: str, violated: DataFrame) -> DataFrame:
    """Paths into and out of one activity: count, cases, median hours, share of cases with a violation."""
    hours = elapsed(F.col("ts"), F.col("nxt_ts"), "h").alias("hours")
    here, then = F.col("activity"), F.col("nxt_activity")
    rows = seq.where(here.isNotNull() & then.isNotNull() & ((here == focus) | (then == focus)))
    first = F.row_number().over(Window.partitionBy("case_id", "activity", "nxt_activity").orderBy("pos")) == 1
    rows = join_on(rows.withColumn("first", first), violated.select("case_id", "violated"), ["case_id"], "left")
    into, out = (F.when(c, F.struct(F.lit(d).alias("direction"), o.alias("other"))) for c, d, o in ((then == focus, "incoming", here), (here == focus, "outgoing", then)))
    hit = holds(F.col("violated"))
    long = rows.select(F.inline(F.array_compact(F.array(into, out))), hours, "first", hit.alias("hit"))
    key = ["direction", "other"]
    long = store(long.groupBy(*key, "hours").agg(F.count(F.lit(1)).alias("n"), F.count_if("first").alias("cases"), F.count_if(F.col("first") & F.col("hit")).alias("violated_cases")))
    counts = long.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("n", "cases", "violated_cases")])
    counts = counts.withColumn("violation_share", F.col("violated_cases") / F.col("cases"))
    return join_on(counts, quantiles(long, key, "hours", {"median_hours": 0.5}, weight="n"), key, "left")


def hidden_paths(paths: DataFrame, focus: str, drawn: DataFrame) -> DataFrame:
    """Paths of the focus activity that the drawn edges leave out, per direction."""
    ends = paths.withColumns(
        {
            "source": F.when(F.col("direction") == "incoming", F.col("other")).otherwise(F.lit(focus)),
            "target": F.when(F.col("direction") == "incoming", F.lit(focus)).otherwise(F.col("other")),
        }
    )
    marked = ends.join(drawn.select("source", "target", F.lit(True).alias("__drawn")), ["source", "target"], "left")
    hidden = F.col("__drawn").isNull()
    return marked.groupBy("direction").agg(
        F.count(F.lit(1)).alias("paths"),
        F.count_if(hidden).alias("hidden"),
        F.coalesce(F.sum(F.when(hidden, F.col("cases"))), F.lit(0)).alias("hidden_cases"),
    )


def n_cases(seq: DataFrame) -> Column:
    return _counted(seq, ["case"], ()).where("kind = 'case'").agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()


def abstraction(seq: DataFrame, share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and boundaries carried by at least ``share`` of the cases; edges need both nodes."""
    seq = _counted(seq, KINDS, ())
    total = n_cases(seq)
    kept = nodes(seq).where(F.col("cases") / total >= share)
    labels = kept.select("activity")
    linked = edges(seq).where(F.col("cases") / total >= share)
    linked = linked.join(labels, linked.source == labels.activity, "left_semi").join(labels, linked.target == labels.activity, "left_semi")
    ends = boundaries(seq).where(F.col("n") / total >= share).join(labels, "activity", "left_semi")
    return kept, linked, ends


def violation_shares(scored: DataFrame, norm: Norm) -> DataFrame:
    """Per constraint: evaluated cases, share violated and mean violation."""
    fields = {
        "evaluated": lambda c: F.count(named(f"v__{c.id}")),
        "share_violated": lambda c: F.avg((named(f"v__{c.id}") > 0).cast("double")),
        "mean_violation": lambda c: F.avg(named(f"v__{c.id}")),
    }
    return constraint_rows(scored, norm, fields).drop("position")


def activity_violation(shares: DataFrame, norm: Norm) -> DataFrame:
    """Per activity: the largest share violated among the constraints that name it."""
    mentioned = [(c.id, a) for c in norm.constraints for a in c.activities()]
    lookup = text_rows(shares.sparkSession, mentioned, ["constraint_id", "activity"])
    joined = lookup.join(shares, "constraint_id")
    return joined.groupBy("activity").agg(F.max("share_violated").alias("violation_share"), F.count(F.lit(1)).alias("constraints"))


def constraint_arcs(shares: DataFrame, norm: Norm) -> DataFrame:
    """One arc per source and target label of every lag and precedence constraint."""
    arcs = [
        (c.id, a, b) for c in norm.constraints if c.type in ("lag", "precedence") for a in c.labels("a") for b in c.labels("b")
    ]
    lookup = text_rows(shares.sparkSession, arcs, ["constraint_id", "source", "target"])
    return lookup.join(shares, "constraint_id").select("constraint_id", "source", "target", "evaluated", "share_violated")


# --------------------------------------------------------------------------- variants
def _quoted(label: Column) -> Column:
    """A label in JSON form."""
    listed = F.coalesce(F.to_json(F.array(label)), F.lit("[null]"))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _digest(labels: Column) -> Column:
    """SHA-256 of a label list in JSON form; NULL steps stay in the list."""
    inner = F.transform(labels, _quoted)
    return F.sha2(F.concat(F.lit("["), F.array_join(inner, ","), F.lit("]")), 256)


def case_sequences(events: DataFrame, *, chunk: int = CHUNK_STEPS, hot_events: int = 1_000_000) -> DataFrame:
    """Per case: the digest of its full label sequence, its length and, up to ``chunk`` steps, the labels.

    Every case is identified by the SHA-256 of the JSON list of its labels.  Ordinary cases are
    sorted inside their group; the steps of longer ones are sorted in their task and digested as
    a stream, so no group or list holds a long case.
    """
    rows = _keyed(events)
    sizes = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("__n"))
    long_ids = sizes.where(F.col("__n") > chunk).select("case_id")
    out_cols = ["case_id", "n_steps", "labels", "variant"]

    if long_ids.isEmpty():
        short = rows
    else:
        long_ids = store(long_ids)
        short = join_on(rows, long_ids, ["case_id"], "left_anti")
    item = F.struct(F.col("ts").isNull().alias("u"), "ts", *([F.col("ord")] if "ord" in rows.columns else []), "seq", "activity")
    packed = short.groupBy("case_id").agg(F.array_sort(F.collect_list(item)).alias("steps"))
    packed = packed.withColumn("labels", F.transform("steps", lambda s: s["activity"]))
    result = packed.select(
        "case_id", F.size("labels").cast("bigint").alias("n_steps"), "labels", _digest(F.col("labels")).alias("variant")
    )
    if short is rows:
        return result
    placed = with_next(join_on(rows, long_ids, ["case_id"], "left_semi"), ("activity",), hot_events=hot_events)
    steps = placed.select("case_id", "pos", _quoted(F.col("activity")).alias("step")).repartition("case_id").sortWithinPartitions("case_id", "pos")
    case_type = rows.schema["case_id"].dataType.simpleString()
    longer = steps.select("case_id", "step").mapInArrow(_stream_digests, f"case_id {case_type}, n_steps bigint, variant string")
    longer = longer.withColumn("labels", F.lit(None).cast("array<string>"))
    return result.select(*out_cols).unionByName(longer.select(*out_cols))


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``case_id, n_steps, variant`` of sorted steps, each in JSON form; holds one batch at a time."""

    def row() -> pa.RecordBatch:
        digest.update(b"]")
        return pa.RecordBatch.from_arrays([case, pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], ["case_id", "n_steps", "variant"])

    case, n, digest = None, 0, hashlib.sha256()
    for b in batches:
        ids, steps, at = b.column("case_id"), b.column("step").to_pylist(), 0
        keys = ids.to_pylist()
        while at < len(steps):
            if case is None or keys[at] != case[0].as_py():
                if case is not None:
                    yield row()
                case, n, digest = ids.slice(at, 1), 0, hashlib.sha256()
            end = at
            while end < len(steps) and keys[end] == keys[at]:
                end += 1
            digest.update((("," if n else "[") + ",".join(steps[at:end])).encode())
            n, at = n + end - at, end
    if case is not None:
        yield row()


def variants(events: DataFrame, total_cases: Column, *, examples: int = 3, chunk: int = CHUNK_STEPS, hot_events: int = 1_000_000) -> DataFrame:
    """Distinct sequences: cases, share, median span in hours (cases with every stamp), example ids.

    ``labels`` is whole for every variant; long ones are read off one example case each.
    """
    seqs = case_sequences(events, chunk=chunk, hot_events=hot_events)
    spans = events.groupBy("case_id").agg(
        F.min("ts").alias("lo"), F.max("ts").alias("hi"), (F.count("ts") == F.count(F.lit(1))).alias("complete")
    )
    hours = F.when(F.col("complete"), elapsed(F.col("lo"), F.col("hi"), "h"))
    rows = store(join_on(seqs, spans.select("case_id", hours.alias("hours")), ["case_id"]))
    groups = rows.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n_cases"), F.max("n_steps").alias("n_steps"), F.count("hours").alias("duration_cases")
    )
    shown = top_per_key(rows.withColumn("id", F.col("case_id").cast("string")), ["variant"], [F.asc("id")], examples)
    shown = shown.groupBy("variant").agg(F.sort_array(F.collect_list("id")).alias("examples"), F.max_by("labels", -F.col("rank")).alias("labels"))
    long_ = rows.where(F.col("labels").isNull()).groupBy("variant").agg(F.min("case_id").alias("case_id"))
    if not long_.isEmpty():
        steps = variant_steps(events, long_, hot_events=hot_events)
        listed = steps.groupBy("variant").agg(F.array_sort(F.collect_list(F.struct("pos", "activity"))).alias("steps"))
        listed = listed.select("variant", F.transform("steps", lambda s: s["activity"]).alias("all_labels"))
        shown = join_on(shown, listed, ["variant"], "left").withColumn("labels", F.coalesce("labels", "all_labels")).drop("all_labels")
    out = join_on(join_on(groups, quantiles(rows, ["variant"], "hours", {"median_hours": 0.5}), ["variant"], "left"), shown, ["variant"])
    return out.withColumn("share", F.col("n_cases") / total_cases)


def top_variants(table: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent variants, ties by their JSON form, with the share of cases they cover together."""
    top = table.orderBy(F.desc("n_cases"), F.to_json("labels", {"ignoreNullFields": "false"}).asc_nulls_last(), "variant").limit(k)
    total = table.agg(F.struct(F.sum("n_cases").alias("n"), F.count(F.lit(1)).alias("v"))).scalar()
    covered = top.agg(F.sum("n_cases")).scalar()
    return top.withColumns({"coverage": covered / total["n"], "total_variants": total["v"]})


def variant_steps(events: DataFrame, example_cases: DataFrame, *, hot_events: int = 1_000_000) -> DataFrame:
    """Long form of variants of any length: ``variant, pos, activity`` read off one example case each."""
    rows = join_on(_keyed(events), example_cases.select("case_id"), ["case_id"], "left_semi")
    placed = with_next(rows, ("activity",), hot_events=hot_events).select("case_id", "pos", "activity")
    return join_on(placed, example_cases.select("case_id", "variant"), ["case_id"]).select("variant", "pos", "activity")


# --------------------------------------------------------------------------- repetition, pairs, coverage
def repetition(events: DataFrame) -> DataFrame:
    """Per activity: events, cases, cases with at least two occurrences, occurrences beyond the first."""
    per_case = events.where(F.col("activity").isNotNull()).groupBy("activity", "case_id").agg(F.count(F.lit(1)).alias("n"))
    return per_case.groupBy("activity").agg(
        F.sum("n").alias("events"),
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.col("n") >= 2).alias("repeated_cases"),
        F.sum(F.col("n") - 1).alias("extra_events"),
    )


def direct_pairs(seq: DataFrame) -> DataFrame:
    rows = seq.where(F.col("activity").isNotNull() & F.col("nxt_activity").isNotNull())
    return rows.select(
        "case_id",
        F.col("activity").alias("source"),
        F.col("nxt_activity").alias("target"),
        elapsed(F.col("ts"), F.col("nxt_ts"), "h").alias("hours"),
    )


def pair_timing(pairs: DataFrame, keys: Sequence[str] = ("source", "target")) -> DataFrame:
    """Per pair: counts, clock coverage, ties, median and p90, and the median of per-case medians.

    The median of a case is read off the middle of its sorted durations, next to which everything else
    is counted; only counted durations and medians leave the partitions of the cases.
    """
    keys = list(keys)
    of_case = Window.partitionBy("case_id", *all_named(keys))
    rows = pairs.select("case_id", *all_named(keys), "hours")
    rows = rows.withColumns({"place": F.row_number().over(of_case.orderBy(F.asc_nulls_last("hours"))), "m": F.count("hours").over(of_case)})
    middle = (F.col("place") == F.floor((F.col("m") + 1) / 2)) | (F.col("place") == F.floor(F.col("m") / 2) + 1)
    rows = rows.withColumn("median", F.avg(F.when(middle, F.col("hours"))).over(of_case))

    def item(kind: str, x: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), x.alias("x"))

    both = F.array_compact(F.array(item("hours", F.col("hours")), F.when(F.col("place") == 1, item("case", F.col("median")))))
    long = store(rows.select(*all_named(keys), F.inline(both)).groupBy(*all_named(keys), "kind", "x").agg(F.count(F.lit(1)).alias("n")))
    hours, cases, n = F.col("kind") == "hours", F.col("kind") == "case", F.col("n")

    def number(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))

    counts = long.groupBy(*all_named(keys)).agg(
        number(hours).alias("pairs"),
        number(cases).alias("cases"),
        number(hours & F.col("x").isNotNull()).alias("measured_pairs"),
        number(cases & F.col("x").isNotNull()).alias("measured_cases"),
        number(hours & (F.col("x") == 0)).alias("equal_stamp_pairs"),
    )
    counts = counts.withColumn("clock_coverage", F.col("measured_pairs") / F.col("pairs"))
    q = quantiles(long.where(hours), keys, "x", {"median_hours": 0.5, "p90_hours": 0.9}, weight="n")
    weighted = quantiles(long.where(cases), keys, "x", {"case_weighted_median_hours": 0.5}, weight="n")
    return join_on(join_on(counts, q, keys, "left"), weighted, keys, "left")


def eventual_pairs(seq: DataFrame, source: str, target: str) -> DataFrame:
    """The first source of a case and the first target at a strictly later position."""
    hit = seq.where(F.col("activity").isin(source, target)).select("case_id", "activity", "ts", "pos")
    first = hit.where(F.col("activity") == source).groupBy("case_id").agg(
        F.min("pos").alias("p0"), F.min_by("ts", "pos").alias("t0")
    )
    later = join_on(hit.where(F.col("activity") == target), first, ["case_id"]).where(F.col("pos") > F.col("p0"))
    found = later.groupBy("case_id").agg(F.min_by("ts", "pos").alias("t1"), F.min("t0").alias("t0"))
    return found.select(
        "case_id", F.lit(source).alias("source"), F.lit(target).alias("target"), elapsed(F.col("t0"), F.col("t1"), "h").alias("hours")
    )


def frequent_pairs(seq: DataFrame, k: int = 10) -> DataFrame:
    counts = direct_pairs(seq).groupBy("source", "target").agg(F.count(F.lit(1)).alias("pairs"))
    return counts.orderBy(F.desc("pairs"), F.asc("source"), F.asc("target")).limit(k)


def recorded_boundaries(events: DataFrame) -> DataFrame:
    """Label of the first and last event of each case, missing labels included, with case counts."""
    key = sort_key(events)
    ends = events.groupBy("case_id").agg(
        F.min_by(F.struct("activity"), key).alias("a"), F.max_by(F.struct("activity"), key).alias("b")
    )
    ends = ends.select("case_id", F.col("a.activity").alias("a"), F.col("b.activity").alias("b"))
    rows = ends.select(
        F.inline(
            F.array(
                F.struct(F.lit("start").alias("side"), F.col("a").alias("activity")),
                F.struct(F.lit("end").alias("side"), F.col("b").alias("activity")),
            )
        )
    )
    return rows.groupBy("side", "activity").agg(F.count(F.lit(1)).alias("cases"))


def identity_coverage(events: DataFrame, resource: str = "resource") -> DataFrame:
    """Per activity: events with a non-blank resource and distinct identities."""
    who = F.nullif(F.trim(named(resource).cast("string")), F.lit(""))
    per_who = events.groupBy("activity", who.alias("who")).agg(F.count(F.lit(1)).alias("n"))
    return per_who.groupBy("activity").agg(
        F.sum("n").alias("events"),
        F.coalesce(F.sum(F.when(F.col("who").isNotNull(), F.col("n"))), F.lit(0)).alias("known"),
        F.count("who").alias("identities"),
    )


def missingness(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: missing (null or blank text) and available rows."""
    aggs, rows = [], []
    for i, c in enumerate(columns):
        blank = named(c).isNull() | (F.trim(named(c).cast("string")) == "")
        aggs.append(F.count_if(blank).alias(f"m{i}"))
        rows.append(F.struct(F.lit(c).alias("name"), named(f"m{i}").alias("missing"), (F.col("n") - named(f"m{i}")).alias("available")))
    return table.agg(F.count(F.lit(1)).alias("n"), *aggs).select(F.inline(F.array(*rows)))


def support(cases: DataFrame, affected: DataFrame) -> DataFrame:
    """Affected cases of any id set: share, median span, measured spans, open cases.

    ``cases`` carries ``span_hours`` (NULL when a stamp is missing) and ``censored``.
    """
    rows = store(join_on(cases, affected.select("case_id").distinct(), ["case_id"], "left_semi"))
    total = cases.agg(F.count(F.lit(1))).scalar()
    out = rows.agg(
        F.count(F.lit(1)).alias("affected_cases"),
        F.count("span_hours").alias("measured_cases"),
        F.count_if(F.col("span_hours").isNull()).alias("unmeasured_cases"),
        F.count_if(holds(F.col("censored"))).alias("open_cases"),
    )
    q = quantiles(rows, [], "span_hours", {"m": 0.5}).scalar()
    return out.withColumns({"case_share": F.col("affected_cases") / total, "median_span_hours": q})


def stage_lanes(counts: DataFrame, lookup: DataFrame) -> DataFrame:
    """Activities of a map with their canonical activity and stage; ``lookup`` is the small matched table."""
    return join_on(counts, lookup, ["activity"], "left")


def complete_span(events: DataFrame) -> Mapping[str, Column]:
    """Case aggregate: first-to-last hours where every event has a stamp."""
    span = F.when(F.count("ts") == F.count(F.lit(1)), elapsed(F.min("ts"), F.max("ts"), "h"))
    return {"span_hours": span}


def ordered_trace(events: DataFrame, case_id) -> DataFrame:
    """The events of one case in log order."""
    return events.where(F.col("case_id") == F.lit(case_id)).orderBy(*log_order(events))
