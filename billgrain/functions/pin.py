"""Evaluate expensive expressions once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters read instead of computing them again.

    The optimizer pushes a filter on a computed column below the projection that
    computes it, which repeats the expression; over several layers of array
    expressions the copies multiply. A one-row ``inline`` is a step that such filters
    stop at, while filters on the input columns still pass through.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    fields = [column.alias(name) for name, column in columns.items()]
    return df.select(*kept, F.inline(F.array(F.struct(*fields))))


def explode_found(df: DataFrame, name: str, *candidates: Column) -> DataFrame:
    """One row per candidate that is not NULL."""
    found = F.array_compact(F.array(*candidates))
    return df.select("*", F.explode(found).alias(name))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    Inside nested lambdas nothing else shares a subexpression, and each mention of a
    column argument would repeat all of it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unless_empty(text: Column) -> Column:
    """The text, NULL if it is empty. Inside a lambda ``nullif`` would work out its text twice."""
    return let(text, lambda t: F.when(t != "", t))
