from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from caseweave.session import tune

    yield tune(session)
    session.stop()


@pytest.fixture(scope="session")
def make_log(spark):
    """A log from ``(case, activity, time or None)`` rows; ``seq`` is the row number."""

    def make(rows, *extra):
        names = "case_id string, activity string, ts timestamp_ntz, seq bigint"
        cols = "".join(f", {e}" for e in extra)
        import datetime as dt

        def stamp(t):
            return None if t is None else dt.datetime.fromisoformat(t)

        data = [(r[0], r[1], stamp(r[2]), i, *r[3:]) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, names + cols)

    return make
