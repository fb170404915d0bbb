"""Table sinks, content hashes and saved selections."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import all_named, join_on


def content_hash(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and an order-independent 38-digit sum of row hashes."""
    cols = list(columns or df.columns)
    h = F.xxhash64(*all_named(sorted(cols))).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(h), F.lit(0)).cast("decimal(38,0)").alias("hash"))


def log_fingerprint(events: DataFrame, columns: Sequence[str], *, decimals: int = 6) -> DataFrame:
    """Portable fingerprint: the sum of the leading 60 bits of an MD5 over the row's text form."""
    parts: list[Column] = []
    for name in columns:
        dtype = dict(events.dtypes)[name]
        col = F.col(name)
        if dtype in ("double", "float"):
            col = F.round(col * F.lit(10.0**decimals)).cast("bigint")
        elif dtype.startswith("timestamp"):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        parts.append(F.coalesce(col.cast("string"), F.lit("\\N")))
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("decimal(38,0)")
    return events.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(digest).cast("decimal(38,0)").alias("fingerprint"))


# The manifest lies inside the table, where readers of Parquet do not look.
MANIFEST = "_manifest"


def write_table(df: DataFrame, path: str, *, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write Parquet (ZSTD) beside ``path``, take its place, and return the one-row manifest of what was written.

    Rows, size and content hash of every file are written last, so a table with a manifest is whole.
    Until the staged table is, ``path`` keeps what it held; if taking its place fails, that is put back.
    Renaming is atomic on file systems, not on plain object stores.
    """
    spark = df.sparkSession
    files = _Files(spark)
    base, name = path.rstrip("/").rsplit("/", 1)
    stage, old = (f"{base}/.{name}-{kind}-{uuid.uuid4().hex}" for kind in ("stage", "old"))
    try:
        writer = df.write.mode("errorifexists").option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(stage)
        listed = _listing(spark, stage, df.columns)
        listed.coalesce(1).write.mode("errorifexists").parquet(f"{stage}/{MANIFEST}")
        replaced = files.exists(path)
        if replaced:
            files.rename(path, old)
        try:
            files.rename(stage, path)
        except Exception:
            if replaced:
                files.rename(old, path)
            raise
    finally:
        files.delete(stage)
    files.delete(old)
    return manifest(spark, path)


def read_table(spark: SparkSession, path: str, *, content: bool = False) -> DataFrame:
    """A table that ``write_table`` finished, after its files are compared with the manifest.

    Sizes and row counts are compared always, the hashes of all rows with ``content``.
    """
    if not _Files(spark).exists(f"{path}/{MANIFEST}/_SUCCESS"):
        raise ValueError(f"{path} holds no finished table")
    listed = spark.read.parquet(f"{path}/{MANIFEST}")
    table = spark.read.parquet(path)
    now = _listing(spark, path, table.columns if content else None)
    said = listed if content else listed.withColumn("hash", F.lit(None).cast("decimal(38,0)"))
    both = said.select("file", F.struct("bytes", "n_rows", "hash").alias("said")).join(now.select("file", F.struct("bytes", "n_rows", "hash").alias("now")), "file", "full")
    wrong = [r["file"] for r in both.where(~F.col("said").eqNullSafe(F.col("now"))).orderBy("file").limit(3).collect()]
    if wrong:
        raise ValueError(f"{path} does not match its manifest: {', '.join(wrong)}")
    return table


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row: ``path, n_rows, hash`` of a written table."""
    listed = spark.read.parquet(f"{path}/{MANIFEST}")
    total = [F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("hash"), F.lit(0)).cast("decimal(38,0)").alias("hash")]
    return listed.agg(*total).select(F.lit(path).alias("path"), "n_rows", "hash")


def _listing(spark: SparkSession, path: str, columns: Sequence[str] | None) -> DataFrame:
    """``file, bytes, n_rows, hash`` of every file that holds rows; without columns no value is read and the hash is NULL."""
    rows = spark.read.parquet(path)
    inside = F.regexp_replace(F.col("_metadata.file_path"), "^.*/" + re.escape(path.rstrip("/").rsplit("/", 1)[1]) + "/", "")
    names = sorted(columns or ())
    value = F.xxhash64(*all_named(names)).cast("decimal(38,0)") if names else F.lit(None).cast("decimal(38,0)")
    rows = rows.select(inside.alias("file"), F.col("_metadata.file_size").alias("bytes"), value.alias("h"))
    return rows.groupBy("file", "bytes").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("h").cast("decimal(38,0)").alias("hash"))


class _Files:
    """Whole-folder steps on whatever file system a path names."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.conf), at

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def rename(self, old: str, new: str) -> None:
        fs, at = self._at(old)
        if not fs.rename(at, self._at(new)[1]):
            raise OSError(f"{old} could not be renamed to {new}")

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)


def save_selection(cases: DataFrame, path: str, source_hash: str) -> DataFrame:
    """Store the ids of a selection together with the identity of its source; duplicates are an error."""
    ids = cases.select("case_id")
    if not ids.groupBy("case_id").count().where((F.col("count") > 1) | F.col("case_id").isNull()).isEmpty():
        raise ValueError("case ids of a selection must be unique and not null")
    members = write_table(ids, f"{path}/members")
    write_table(members.withColumn("source", F.lit(source_hash)), f"{path}/manifest")
    return members


def resolve_selection(cases: DataFrame, path: str, source_hash: str) -> DataFrame:
    """The selected rows of ``cases``, after checking the stored ids and the source identity."""
    spark = cases.sparkSession
    saved = read_table(spark, f"{path}/manifest").first()
    if saved["source"] != source_hash:
        raise ValueError("the selection was saved from another source")
    members = read_table(spark, f"{path}/members", content=True)
    now = manifest(spark, f"{path}/members").first()
    if (now["n_rows"], now["hash"]) != (saved["n_rows"], saved["hash"]):
        raise ValueError("the stored selection does not match its manifest")
    return join_on(cases, members, ["case_id"], "left_semi")
