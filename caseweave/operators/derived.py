"""Derived case attributes: recipes of a norm document, planned in the order of what they read.

Event recipes are aggregates and join the first pass over the events.  Column recipes are
expressions on the case row, each after the attributes it names, whatever order the document
lists them in.  A scaled attribute needs one quantile over all cases.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import holds, named
from ..functions.ordered import quantiles
from ..session import store

Recipes = Mapping[str, Mapping[str, Any]]
# Recipes over the events of a case, and recipes over its row.
EVENT_KINDS = ("count", "count_events", "nunique", "cv")
CASE_KINDS = ("eval", "ratio", "quantile_scale", "indicator_times")


def _where(where: str | Mapping[str, str] | None) -> Column:
    if not where:
        return F.lit(True)
    column, regex = ("activity", where) if isinstance(where, str) else (where["column"], where["regex"])
    return named(column).cast("string").rlike(regex)


OPERATORS: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.when(b != 0, a / b),
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
}


def arithmetic(text: str, names: Sequence[str]) -> Column:
    """A Column from names, numbers, ``+ - * /`` and comparisons; anything else is an error."""

    def column(node: ast.expr) -> Column:
        match node:
            case ast.Name(id=name) if name in names:
                return named(name)
            case ast.Constant(value=value) if isinstance(value, int | float):
                return F.lit(value)
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -column(x)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in OPERATORS:
                return OPERATORS[type(op)](column(a), column(b))
            case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in OPERATORS:
                return OPERATORS[type(op)](column(a), column(b))
        raise ValueError(f"{ast.unparse(node)!r} cannot be resolved in an expression")

    return column(ast.parse(text, mode="eval").body)


def recipe_aggregates(recipes: Mapping[str, Mapping[str, Any]]) -> dict[str, Column]:
    """Event-level recipes as case aggregates: ``count``, ``count_events``, ``nunique``, ``cv``.

    ``where`` is a pattern for the activity, or an object with a ``column`` of the events and a ``regex``.
    """
    out: dict[str, Column] = {}
    for name, r in recipes.items():
        where = _where(r.get("where"))
        kind = r["kind"]
        if kind == "count":
            out[name] = F.count_if(F.col("activity").isin(list(r["activities"])))
        elif kind == "count_events":
            out[name] = F.count_if(holds(where))
        elif kind == "nunique":
            out[name] = F.count_distinct(F.when(holds(where), named(r["column"])))
        elif kind == "cv":
            x = F.when(holds(where), named(r["column"]).cast("double"))
            mean = F.avg(x)
            out[name] = F.when(mean != 0, F.stddev_samp(x) / mean)
        elif kind == "indicator_times":
            hit = F.count_if(F.col("activity").isin(list(r["activities"]))) > 0
            out[f"__hit_{name}"] = hit
        elif kind not in ("eval", "ratio", "quantile_scale"):
            raise ValueError(f"unknown recipe kind {kind!r}")
    return out


def distinct_counts(events: DataFrame, recipes: Recipes) -> DataFrame | None:
    """``nunique`` recipes as a table per case: one grouping per column, apart from the aggregates that need no distinct step."""
    out: DataFrame | None = None
    columns = {r["column"] for r in recipes.values() if r["kind"] == "nunique"}
    for column in sorted(columns):
        of = {n: r for n, r in recipes.items() if r["kind"] == "nunique" and r["column"] == column}
        rows = events.where(named(column).isNotNull()).groupBy("case_id", named(column).alias("__value"))
        rows = rows.agg(*[F.bool_or(holds(_where(r.get("where")))).alias(n) for n, r in of.items()])
        found = rows.groupBy("case_id").agg(*[F.count_if(named(n)).alias(n) for n in of])
        out = found if out is None else out.join(found, "case_id", "full")
    return out


def reads(name: str, recipe: Mapping[str, Any]) -> set[str]:
    """The case columns and attributes that a column recipe names."""
    kind = recipe["kind"]
    if kind == "eval":
        return {node.id for node in ast.walk(ast.parse(recipe["expr"], mode="eval")) if isinstance(node, ast.Name)}
    if kind == "ratio":
        return {recipe["numerator"], recipe["denominator"]}
    return {recipe["attribute"]} if kind in ("quantile_scale", "indicator_times") else set()


def in_order(recipes: Recipes) -> list[str]:
    """Column recipes such that each follows those it reads; a recipe that reads itself is an error."""
    todo = {n: reads(n, r) & set(recipes) for n, r in recipes.items() if r["kind"] in CASE_KINDS}
    out: list[str] = []
    while todo:
        free = [n for n, needed in todo.items() if not needed & set(todo)]
        if not free:
            raise ValueError(f"derived attributes read each other in a circle: {', '.join(sorted(todo))}")
        out += free
        todo = {n: needed for n, needed in todo.items() if n not in free}
    return out


def recipe_columns(cases: DataFrame, recipes: Recipes) -> DataFrame:
    """Case-level recipes: ``eval``, ``ratio``, ``quantile_scale``, ``indicator_times``, in the order they need.

    An ``eval`` expression may only use columns of the case table, numbers, arithmetic and comparisons.
    """
    out, kept = cases, False
    for name in in_order(recipes):
        r = recipes[name]
        kind = r["kind"]
        unknown = reads(name, r) - set(out.columns)
        if unknown:
            raise ValueError(f"derived attribute {name}: {', '.join(sorted(unknown))} cannot be resolved")
        if kind == "eval":
            out = out.withColumn(name, arithmetic(r["expr"], out.columns))
        elif kind == "ratio":
            den = named(r["denominator"]).cast("double")
            out = out.withColumn(name, F.when(den != 0, named(r["numerator"]).cast("double") / den))
        elif kind == "indicator_times":
            value = F.when(named(f"__hit_{name}"), named(r["attribute"])).otherwise(F.lit(0.0))
            out = out.withColumn(name, value)
        elif kind == "quantile_scale":
            # Read for the quantile and again for the result.
            out, kept = (out if kept else store(out)), True
            top = quantiles(out, [], r["attribute"], {"q": r["q"]}).select("q").scalar()
            out = out.withColumn(name, F.when(top > 0, F.least(named(r["attribute"]).cast("double") / top, F.lit(1.0))))
    return out.drop(*[f"__hit_{n}" for n in recipes])
