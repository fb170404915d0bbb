"""Column, attribute and activity profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import all_named, join_on, named, quoted
from ..functions.ordered import quantiles, running
from ..session import store

# Aggregates of one pass are kept below the size where generated code stops compiling well.
COLUMNS_PER_PASS = 12

# The share of parsable values that decides a type, and the longest category text.
PARSE_SHARE = 0.95

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def is_numeric(dtype: str) -> bool:
    return dtype.startswith(NUMERIC)


def as_timestamp(column: str) -> Column:
    """Text that names at least a full date, as a timestamp; a bare number is none."""
    parsed = F.expr(f"try_cast(cast({quoted(column)} as string) as timestamp_ntz)")
    return F.when(named(column).cast("string").rlike(r"^\s*[0-9]{4,}-[0-9]{1,2}-[0-9]{1,2}"), parsed)


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: empty and parsable counts, approximate distinct count and a type guess."""
    out: DataFrame | None = None
    for start in range(0, len(df.columns), COLUMNS_PER_PASS):
        part = df.columns[start : start + COLUMNS_PER_PASS]
        types = dict(df.dtypes)
        aggs: list[Column] = [F.count(F.lit(1)).alias("n")]
        rows = []
        for i, c in enumerate(part):
            text = named(c).cast("string")
            aggs += [
                F.count_if(named(c).isNull() | (text == "")).alias(f"e{i}"),
                F.approx_count_distinct(named(c)).alias(f"d{i}"),
                F.count(F.expr(f"try_cast(cast({quoted(c)} as string) as double)")).alias(f"x{i}"),
                F.count(as_timestamp(c)).alias(f"t{i}"),
            ]
            present = F.col("n") - named(f"e{i}")
            if types[c].startswith(("timestamp", "date")):
                guess = F.lit("timestamp")
            elif is_numeric(types[c]):
                guess = F.lit("number")
            else:
                guess = (
                    F.when((present > 0) & (named(f"t{i}") / present > PARSE_SHARE), "timestamp")
                    .when((present > 0) & (named(f"x{i}") / present > PARSE_SHARE), "number")
                    .otherwise("string")
                )
            rows.append(
                F.struct(
                    F.lit(c).alias("name"),
                    F.lit(types[c]).alias("storage"),
                    guess.alias("guess"),
                    F.col("n").alias("n_rows"),
                    named(f"e{i}").alias("n_empty"),
                    named(f"d{i}").alias("approx_distinct"),
                    named(f"x{i}").alias("n_numeric"),
                    named(f"t{i}").alias("n_timestamp"),
                )
            )
        profile = df.agg(*aggs).select(F.inline(F.array(*rows)))
        out = profile if out is None else out.unionByName(profile)
    return out


def distinct_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct values of a (multi-column) activity key with their counts."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))


def activity_inventory(events: DataFrame) -> DataFrame:
    """Events and distinct cases per label; NULL is shown as ``(null)``."""
    per_case = events.groupBy("activity", "case_id").agg(F.count(F.lit(1)).alias("n"))
    out = per_case.groupBy("activity").agg(F.sum("n").alias("events"), F.count_distinct("case_id").alias("cases"))
    return out.select(F.coalesce("activity", F.lit("(null)")).alias("label"), "events", "cases")


def log_profile(events: DataFrame) -> DataFrame:
    """One row: events, cases, activities and the time range of a log."""
    return events.agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_distinct("case_id").alias("n_cases"),
        F.count_distinct("activity").alias("n_activities"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


# Names by which a column is known, lower-case and without blanks and underscores, first match first.
ROLE_NAMES = {
    "case_id": ("caseid", "case", "caseconcept:name", "incidentid", "ticketid", "srnumber", "case:concept:name"),
    "activity": ("activity", "concept:name", "event", "activitytype", "incidentactivitytype", "status"),
    "ts": ("timestamp", "time:timestamp", "completetimestamp", "datestamp", "time", "starttimestamp", "startdate"),
}


def guess_columns(columns: Sequence[str]) -> dict[str, str | None]:
    """The column of each role by its name, None if no name is known; of equal names the first column."""
    known: dict[str, str] = {}
    for c in columns:
        known.setdefault(c.lower().replace(" ", "").replace("_", ""), c)
    return {role: next((known[n] for n in names if n in known), None) for role, names in ROLE_NAMES.items()}


def log_details(events: DataFrame, *, activity: str = "activity", lifecycle: str | None = None, attributes: Sequence[str] = (), top: int = 8) -> DataFrame:
    """``part, name, n``: the ``top`` most common activities, events per lifecycle step, events that carry each attribute.

    Activities tied on their count are cut by name.  NULL activities and steps are not listed, nor attributes without
    any value.  The events are read once, into a counted table of activity and step.
    """
    has = [f"n{i}" for i in range(len(attributes))]
    labels = events.select(
        named(activity).cast("string").alias("a"),
        (named(lifecycle) if lifecycle else F.lit(None)).cast("string").alias("l"),
        *[named(x).isNotNull().cast("bigint").alias(n) for x, n in zip(attributes, has, strict=True)],
    )
    counted = store(labels.groupBy("a", "l").agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in has]))
    per = {c: counted.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("name")).agg(F.sum("n").alias("n")) for c in ("a", "l")}
    out = per["a"].orderBy(F.desc("n"), "name").limit(top).select(F.lit("activity").alias("part"), "name", "n")
    if lifecycle:
        out = out.unionByName(per["l"].select(F.lit("lifecycle").alias("part"), "name", "n"))
    if attributes:
        rows = [F.struct(F.lit("attribute").alias("part"), F.lit(x).alias("name"), F.col(n).alias("n")) for x, n in zip(attributes, has, strict=True)]
        out = out.unionByName(counted.agg(*[F.sum(n).alias(n) for n in has]).select(F.inline(F.array(*rows))).where("n > 0"))
    return out


def _values(cases: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Attributes as rows: ``name, value, num``."""
    items = [
        F.struct(
            F.lit(a).alias("name"),
            named(a).cast("string").alias("value"),
            F.expr(f"try_cast(cast({quoted(a)} as string) as double)").alias("num"),
        )
        for a in attributes
    ]
    return cases.select(F.inline(F.array(*items)))


def attribute_inventory(cases: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Per attribute: kind, distinct and missing counts and, for numbers, five quantiles."""
    rows = _values(cases, attributes)
    counts = rows.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"), F.count("num").alias("k"))
    out = counts.groupBy("name").agg(
        F.sum("n").alias("total"),
        F.count("value").alias("distinct"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.sum("k").alias("parsed"),
    )
    number = (F.col("parsed") / F.col("total") > PARSE_SHARE).alias("is_number")
    out = out.select("name", "total", "distinct", "missing", number)
    probs = {"min": 0.0, "p10": 0.1, "median": 0.5, "p90": 0.9, "max": 1.0}
    out = join_on(out, quantiles(rows, ["name"], "num", probs), ["name"], "left")
    return out.select(
        "name",
        F.when(F.col("is_number"), "number").otherwise("text").alias("kind"),
        "distinct",
        "missing",
        *[F.when(F.col("is_number"), named(p)).alias(p) for p in probs],
    )


def top_values(cases: DataFrame, attributes: Sequence[str], k: int = 10, search: str | None = None) -> DataFrame:
    """The most frequent values of each attribute with their share of all cases."""
    total = cases.agg(F.count(F.lit(1))).scalar()
    rows = _values(cases, attributes).select("name", F.coalesce("value", F.lit("(missing)")).alias("value"))
    counts = rows.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    if search:
        counts = counts.where(F.contains(F.lower("value"), F.lit(search.lower())))
    return top_per_key(counts, ["name"], [F.desc("n"), F.asc("value")], k).withColumn("share", F.col("n") / total)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows per key; Spark cuts each partition to ``k`` before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(*all_named(keys)).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(named(name) <= k)


def category(col: Column, dtype: str, missing_label: str | None = "(missing)") -> Column:
    """The exploratory category of a value: NULL for null, empty text and the missing label."""
    text = F.when(col, "True").when(~col, "False") if dtype == "boolean" else col.cast("string")
    bad = (text == "") | (text == F.lit(missing_label)) if missing_label else text == ""
    return F.when(~bad, text)


def field_profiles(marked: DataFrame, fields: Sequence[str], missing_label: str = "(missing)") -> DataFrame:
    """Per field: distinct values, missing in all and in the selection, and quantiles of selected numbers."""
    types = dict(marked.dtypes)
    aggs, rows, numbers = [], [], []
    for i, f in enumerate(fields):
        c = category(named(f), types[f], missing_label)
        aggs += [F.count_if(c.isNull()).alias(f"m{i}"), F.count_if(F.col("selected") & c.isNull()).alias(f"s{i}")]
        rows.append(F.struct(F.lit(f).alias("name"), named(f"m{i}").alias("missing_total"), named(f"s{i}").alias("missing_selected")))
        if is_numeric(types[f]):
            numbers.append(F.struct(F.lit(f).alias("name"), named(f).cast("double").alias("num")))
    out = marked.agg(*aggs).select(F.inline(F.array(*rows)))
    items = [F.struct(F.lit(f).alias("name"), category(named(f), types[f], missing_label).alias("v")) for f in fields]
    distinct = marked.select(F.inline(F.array(*items))).where(F.col("v").isNotNull()).distinct()
    distinct = distinct.groupBy("name").agg(F.count(F.lit(1)).alias("distinct"))
    out = join_on(out, distinct, ["name"], "left").fillna(0, ["distinct"])
    probs = {"min": 0.0, "median": 0.5, "p90": 0.9, "max": 1.0}
    if not numbers:
        return out.withColumns({p: F.lit(None).cast("double") for p in probs})
    values = marked.where("selected").select(F.inline(F.array(*numbers)))
    finite = values.where(F.abs("num") < float("inf"))
    return join_on(out, quantiles(finite, ["name"], "num", probs), ["name"], "left")


def average_rank(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per distinct value: its count, the rows below it and the average 1-based rank of its ties."""
    hist = store(df.groupBy(*all_named(keys), named(value)).agg(F.count(F.lit(1)).alias("ties")))
    out = running(hist, keys, [named(value).asc()], {"__cum": F.col("ties")})
    return out.select(
        *all_named(keys),
        value,
        "ties",
        (F.col("__cum") - F.col("ties")).alias("below"),
        (F.col("__cum") - F.col("ties") + (F.col("ties") + 1) / 2).alias("avg_rank"),
    )
