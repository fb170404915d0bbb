"""Log sources: CSV (all text), Parquet and XES."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import store

# The printable characters that code page 1252 puts on the control codes 0x80 to 0x9F.
CP1252 = dict(
    zip(
        "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f",
        "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ",
        strict=True,
    )
)

# The element names that carry an attribute in an XES document.
XES_TYPES = ("string", "date", "int", "float", "boolean", "id")


def _stripped(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def read_csv(spark: SparkSession, path: str, *, sep: str = ",") -> DataFrame:
    """A CSV file with a header; every column stays text, names are stripped.

    Quotes follow RFC 4180: a quote inside a quoted cell is doubled.  One look at the raw lines
    decides two things.  Lines that are not valid UTF-8 make the file code page 1252 (a replacement
    character that is written in the file is ordinary text).  A line with an odd number of quotes
    holds the start of a cell with a line break; such files are read one file per task.
    """
    lines = spark.read.text(path)
    quotes = F.octet_length("value") - F.octet_length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    look = lines.agg(F.coalesce(F.bool_or(~F.is_valid_utf8("value")), F.lit(False)).alias("foreign"), F.coalesce(F.bool_or(quotes % 2 == 1), F.lit(False)).alias("broken")).first()
    reader = spark.read.option("header", True).option("inferSchema", False).option("sep", sep)
    reader = reader.option("quote", '"').option("escape", '"').option("multiLine", look["broken"])
    df = reader.option("encoding", "ISO-8859-1" if look["foreign"] else "UTF-8").csv(path)
    if look["foreign"]:
        # Latin-1 maps every byte to one character; the few that differ are replaced.
        source, target = "".join(CP1252), "".join(CP1252.values())
        df = df.select(
            *[F.translate(F.col(f"`{c}`"), source, target).alias(c.translate(str.maketrans(CP1252))) for c in df.columns]
        )
    return _stripped(df)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with its own types; names are stripped."""
    return _stripped(spark.read.parquet(path))


def with_sequence(df: DataFrame, name: str = "seq") -> DataFrame:
    """Add the position of a row in its source file, for logs without an event id.

    File name and row index are both stored in the file's own order, so the value
    does not depend on how the scan is split.
    """
    return df.withColumn(name, F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")))


def read_xes(
    spark: SparkSession, path: str, trace_keys: list[str] | None = None, event_keys: list[str] | None = None
) -> DataFrame:
    """An XES log as one row per event; trace attributes get the prefix ``case:``.

    The text is cut at the end tags of traces, so one large file is read by many
    tasks.  Attribute values stay text, which is also what attributes of mixed type
    become.  Without given keys the names are found by one distinct pass.
    """
    attribute = "array<struct<_key:string,_value:string>>"
    fields = ",".join(f"`{t}`:{attribute}" for t in XES_TYPES)
    schema = ", ".join(f"`{t}` {attribute}" for t in XES_TYPES) + f", event array<struct<{fields}>>"
    pieces = spark.read.option("lineSep", "</trace>").text(path)
    body = F.concat(F.regexp_substr("value", F.lit(r"(?s)<trace[\s>].*$")), F.lit("</trace>"))
    parsed = F.from_xml(body, schema, {"rowTag": "trace"})
    traces = pieces.where(F.col("value").rlike(r"<trace[\s>]")).select(parsed.alias("x")).select("x.*")

    def attributes(prefix: str) -> Column:
        parts = [F.coalesce(F.col(f"{prefix}{t}"), F.array().cast(attribute)) for t in XES_TYPES]
        entries = F.flatten(F.array(*parts))
        return F.map_from_entries(
            F.transform(
                F.array_distinct(F.transform(entries, lambda e: e["_key"])),
                lambda k: F.struct(
                    k.alias("key"), F.element_at(F.filter(entries, lambda e: e["_key"] == k), 1)["_value"].alias("value")
                ),
            )
        )

    events = traces.select(attributes("").alias("t"), F.posexplode("event").alias("n", "e"))
    events = events.select("t", "n", attributes("e.").alias("a"))
    if trace_keys is None or event_keys is None:
        events = store(events)
    if trace_keys is None or event_keys is None:
        keys = events.select(
            F.explode(F.concat(F.transform(F.map_keys("t"), lambda k: F.concat(F.lit("case:"), k)), F.map_keys("a"))).alias("k")
        )
        names = sorted(r["k"] for r in keys.distinct().collect())
        trace_keys = [n[5:] for n in names if n.startswith("case:")]
        event_keys = [n for n in names if not n.startswith("case:")]
        if not names:
            raise ValueError(f"no events in {path}")
    cols = [F.col("t").getItem(k).alias(f"case:{k}") for k in trace_keys]
    cols += [F.col("a").getItem(k).alias(k) for k in event_keys]
    return events.select(*cols, F.col("n").alias("event_index"))
