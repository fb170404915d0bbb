"""Tables that are whole or not there."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from caseweave.sources import sinks


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "table")
    first = sinks.write_table(spark.range(100).withColumn("a.b", F.col("id") % 3), path).first()
    broken = spark.range(50).select(F.when(F.col("id") == 40, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        sinks.write_table(broken, path)
    assert sinks.read_table(spark, path, content=True).count() == 100 == first["n_rows"]
    second = sinks.write_table(spark.range(7).toDF("id"), path).first()
    assert sinks.read_table(spark, path).count() == 7 == second["n_rows"] and second["hash"] != first["hash"]
    assert [p.name for p in tmp_path.iterdir()] == ["table"]


def test_a_rename_that_fails_puts_the_old_table_back(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    sinks.write_table(spark.range(5), path)
    rename = sinks._Files.rename

    def fails(self, old, new):
        if "-stage-" in old:
            raise OSError("no space")
        rename(self, old, new)

    monkeypatch.setattr(sinks._Files, "rename", fails)
    with pytest.raises(OSError):
        sinks.write_table(spark.range(9), path)
    assert sinks.read_table(spark, path, content=True).count() == 5 and len(list(tmp_path.iterdir())) == 1


@pytest.mark.parametrize("partitioned", [[], ["part"]])
def test_changed_tables_are_found(spark, tmp_path, partitioned):
    path = str(tmp_path / "table")
    df = spark.range(1000).select("id", F.concat(F.lit("p/ %"), (F.col("id") % 3).cast("string")).alias("part"), (F.col("id") * 2).alias("x"))
    sinks.write_table(df.repartition(4), path, partition_by=partitioned)
    assert sinks.read_table(spark, path, content=True).agg(F.sum("x")).first()[0] == 999_000
    # The same numbers of rows with one value changed.
    other = str(tmp_path / "other")
    sinks.write_table(df.withColumn("x", F.when(F.col("id") == 5, 11).otherwise(F.col("x"))).repartition(4), other, partition_by=partitioned)
    assert sinks.manifest(spark, other).first()["hash"] != sinks.manifest(spark, path).first()["hash"]
    spark.range(3).select("id", F.lit("new").alias("part"), "id").toDF("id", "part", "x").write.mode("append").parquet(path, partitionBy=partitioned or None)
    with pytest.raises(ValueError, match="manifest"):
        sinks.read_table(spark, path)
    spark.range(3).write.parquet(str(tmp_path / "plain"))
    with pytest.raises(ValueError, match="finished"):
        sinks.read_table(spark, str(tmp_path / "plain"))


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path / "none")
    assert sinks.write_table(spark.range(0), path).first()["n_rows"] == 0
    assert sinks.read_table(spark, path, content=True).count() == 0
