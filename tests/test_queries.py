"""Every registered query against its SQL on the smallest data."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest
from oracle import compare, connect

from caseweave.plans import load

SF = "/root/testdata/sf0.001"
ENTRIES = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query_equals_sql(spark, con, name):
    entry = ENTRIES[name]
    assert entry.sql is not None
    difference = compare(spark, con, entry.run, entry.sql, SF)
    # The smallest data may leave a report empty; it must then be empty on both sides.
    assert difference in (None, "no rows")


def test_queries_and_sql_load_without_a_session():
    code = "import __spark_entry__ as e; q, o = set(e.queries()), set(e.oracle_sql()); assert o <= q; print(len([n for n in q if not n.startswith('op') and n != 'pipeline']))"
    root = Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) == len(ENTRIES)


def test_entry_has_rows(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() > 0
    assert set(ENTRIES) <= set(oracle_sql()) <= set(queries())
