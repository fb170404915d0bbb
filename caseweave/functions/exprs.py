"""Small Column expressions used across operators."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Microseconds per duration unit.
MICROS = {"s": 1e6, "S": 1e6, "min": 6e7, "M": 6e7, "h": 3.6e9, "H": 3.6e9, "D": 8.64e10, "W": 6.048e11}


def quoted(name: str) -> str:
    """A column name that may hold dots or backticks."""
    return "`" + name.replace("`", "``") + "`"


def named(name: str | Column) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return name if isinstance(name, Column) else F.col(quoted(name))


def all_named(names: Iterable[str | Column]) -> list[Column]:
    return [named(n) for n in names]


def elapsed(start: Column, end: Column, unit: str = "D") -> Column:
    """``end - start`` as a number in ``unit``; works on both timestamp types."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(MICROS[unit])


def micros(ts: Column) -> Column:
    """Microseconds since 1970 as a long, for either timestamp type."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def from_micros(value: Column) -> Column:
    return F.timestamp_add(
        "MICROSECOND", value.cast("bigint"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    )


def plus(ts: Column, amount: Column, unit: str) -> Column:
    """``ts`` moved by ``amount`` units, keeping the timestamp type."""
    return F.timestamp_add("MICROSECOND", F.round(amount * F.lit(MICROS[unit])).cast("bigint"), ts)


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def all_of(conds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def any_of(conds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def holds(cond: Column) -> Column:
    """NULL counts as false."""
    return F.coalesce(cond, F.lit(False))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` keeping the keys of ``left``; NULL equals NULL, except for case ids.

    A case id is never NULL, and plain equality lets Spark reuse the partitioning
    by case of an earlier aggregate.
    """
    if list(keys) == ["case_id"]:
        return left.join(right, "case_id", how)
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = all_of(
        left[k] == renamed[f"__r_{k}"] if k == "case_id" else left[quoted(k)].eqNullSafe(renamed[quoted(f"__r_{k}")]) for k in keys
    )
    joined = left.join(renamed, cond, how)
    return joined.drop(*[f"__r_{k}" for k in keys]) if how not in ("left_semi", "left_anti") else joined


def period_label(ts: Column, grain: str) -> Column:
    """Text label of the calendar period that contains ``ts``."""
    if grain == "year":
        return F.date_format(ts, "yyyy")
    if grain == "quarter":
        return F.concat(F.date_format(ts, "yyyy"), F.lit("-Q"), F.quarter(ts).cast("string"))
    if grain == "month":
        return F.date_format(ts, "yyyy-MM")
    if grain == "week":
        return F.concat(
            F.extract(F.lit("YEAROFWEEK"), ts).cast("string"),
            F.lit("-W"),
            F.lpad(F.weekofyear(ts).cast("string"), 2, "0"),
        )
    raise ValueError(f"unknown period {grain!r}")


def label_tag(*groups: str | Sequence[str]) -> str:
    """A column-name part that stands for groups of labels, whatever characters the labels contain."""
    parts = [[g] if isinstance(g, str) else sorted(g) for g in groups]
    return hashlib.md5(json.dumps(parts).encode()).hexdigest()[:16]


def text_rows(spark: SparkSession, rows: Sequence[Sequence[str]], names: Sequence[str]) -> DataFrame:
    """A small lookup of text rows (labels of a norm, verb pairs) as a DataFrame."""
    if not rows:
        return spark.range(0).select(*[F.lit("").alias(n) for n in names])
    items = [F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*items)))
