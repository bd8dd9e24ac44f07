"""Amounts: order-independent sums, NaN-safe comparisons and number rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(38,6)"


def cents(value: Column) -> Column:
    """Round a non-negative amount to two decimals the same way on every engine."""
    return F.round(value * 100 + 0.000001).cast("bigint").cast("double") / 100


def exact_sum(value: Column) -> Column:
    """Aggregate sum that does not depend on row order.

    Values no decimal can hold (NaN, infinity) are added as doubles, so that they carry
    through to the sum, and so are values whose sum no decimal can hold.
    """
    exact = value.try_cast(MONEY)
    return F.when(
        F.count_if(value.isNotNull() & exact.isNull()) > 0, F.sum(value)
    ).otherwise(F.coalesce(F.try_sum(exact).cast("double"), F.sum(value)))


def array_sum(values: Column) -> Column:
    """The same sum over an array of doubles in one row."""
    zero = F.lit(0).cast(MONEY)
    exact = F.aggregate(values, zero, lambda acc, v: F.try_add(acc, v.try_cast(MONEY)).try_cast(MONEY))
    return F.coalesce(exact.cast("double"), F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v))


def exceeds(value: Column, limit) -> Column:
    """``value > limit``, where NaN and NULL never exceed anything."""
    return F.coalesce(~F.isnan(value) & (value > limit), F.lit(False))


def two_decimals(value: Column) -> Column:
    return F.format_string("%.2f", value)


def plain_number(value: Column) -> Column:
    """Shortest decimal rendering, without an exponent between 1e-4 and 1e16."""
    text = value.cast("string")
    size = F.abs(value)
    wide = (size >= 1e7) & (size < 1e16) | (size < 1e-3) & (size >= 1e-4)
    digits = F.rtrim(value.try_cast("decimal(38,18)").cast("string"), F.lit("0"))
    padded = F.when(F.endswith(digits, F.lit(".")), F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.when(wide, padded).otherwise(text)
