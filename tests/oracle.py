"""Runs registered queries next to their SQL and compares rows, columns and types."""

from __future__ import annotations

import datetime as dt
import decimal
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int | decimal.Decimal):
        return "int"
    if isinstance(value, float):
        return "float"
    if isinstance(value, dt.datetime):
        return "time"
    if isinstance(value, list):
        return "list"
    return "text"


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return int(value)
    if isinstance(value, list):
        return tuple(value)
    return value


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    out.sort(key=lambda r: tuple((kind(v), str(v)) for v in r))
    kinds = [{kind(r[i]) for r in out} - {"null"} for i in range(len(order))]
    return [columns[i] for i in order], out, kinds


def compare(spark, con, run, sql: str, sf_dir: str) -> str | None:
    """``None`` when equal, else a short description of the first difference."""
    df = run(spark, sf_dir)
    mine = table_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs = table_of([c[0] for c in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} != {len(theirs[1])}"
    for name, a, b in zip(mine[0], mine[2], theirs[2], strict=True):
        if a and b and a != b:
            return f"type of {name}: {a} != {b}"
    if not mine[1]:
        return "no rows"
    bad = [(a, b) for a, b in zip(mine[1], theirs[1], strict=True) if a != b]
    if bad:
        a, b = bad[0]
        cols = [(n, x, y) for n, x, y in zip(mine[0], a, b, strict=True) if x != y]
        return f"{len(bad)} of {len(mine[1])} rows differ, first: {cols[:4]} in {a} / {b}"
    return None
