"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings that let AQE split a hot join key even where that costs one
# more exchange; without the second one a skewed join below a group-by on the
# same key would stay in a single task.  A task takes little of a file or a shuffle, and there
# are partitions enough to cut a large one that way, so that sorts stay in memory whatever the
# input.  A generated method beyond 8,000 bytes of code is never compiled by the JVM, so Spark runs
# such a stage without it.  Packed files are weighed by about the size of their rows in memory, or Spark
# would broadcast millions of well packed rows through the driver.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "600",
    "spark.sql.sources.fileCompressionFactor": "10.0",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
}

SHARED = "spark.checkpoint.dir"
# Tables that each session stored, by application id.
_STORED: dict[str, list[str]] = {}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    configured = spark.conf.get(SHARED, None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        raise ValueError(f"set {SHARED} to a folder that driver and executors share")
    return configured


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later branches scan columns of a Parquet table instead of repeating the
    plan, survive lost executors, and carry real sizes, so that Spark's own
    broadcast threshold decides on joins.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/caseweave-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    _STORED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> int:
    """Remove the tables that this session stored; results that still read them must be done."""
    paths = _STORED.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)
