"""Line totals that cannot be right, replaced by a number printed in the document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plausibility window and threshold.
MISMATCH = 0.5
LOW = 0.5
HIGH = 1.05
NUMBER_TOKEN = r"\p{Nd}+(?:[,.]\p{Nd}+)?"
SAME = 5e-5  # two amounts agree to four decimals


def number_tokens(text: Column) -> Column:
    """All numbers of a text in order; a comma is a decimal point."""
    tokens = F.regexp_extract_all(text, F.lit(NUMBER_TOKEN), 0)
    numbers = F.transform(
        tokens, lambda t: F.replace(t, F.lit(","), F.lit(".")).try_cast("double")
    )
    return F.filter(numbers, lambda n: n.isNotNull())


def is_implausible(quantity: Column, price: Column, total: Column) -> Column:
    """More than half off quantity x price. Free or empty lines are never touched."""
    expected = quantity * price
    return F.when(
        (quantity > 0) & (price > 0), F.try_divide(F.abs(total - expected), expected) > MISMATCH
    ).otherwise(False)


def in_window(candidate: Column, expected: Column) -> Column:
    return (candidate >= expected * LOW) & (candidate <= expected * HIGH)


def same_amount(a: Column, b: Column) -> Column:
    return F.abs(a - b) < SAME


def substitute(item: Column, candidates: Column) -> Column:
    """Closest candidate in the window that is not the item's own number; first wins.

    ``candidates`` are structs (value, pos).
    """
    expected = item["quantity"] * item["unit_price"]
    usable = F.filter(
        candidates,
        lambda c: in_window(c["value"], expected)
        & ~same_amount(c["value"], item["quantity"])
        & ~same_amount(c["value"], item["unit_price"])
        & ~F.coalesce(same_amount(c["value"], item["line_total"]), F.lit(False)),
    )
    ranked = F.transform(
        usable, lambda c: F.struct(F.abs(c["value"] - expected).alias("d"), c["pos"].alias("p"), c["value"].alias("v"))
    )
    return F.array_min(ranked)["v"]


def with_position(numbers: Column) -> Column:
    return F.transform(numbers, lambda v, i: F.struct(v.alias("value"), i.alias("pos")))


def repaired_items(items: Column, numbers: Column) -> Column:
    """Items with implausible line totals replaced where the text offers a number."""

    def fix(item: Column) -> Column:
        wrong = is_implausible(item["quantity"], item["unit_price"], item["line_total"])
        better = F.when(wrong, substitute(item, numbers))
        return item.withField("line_total", F.coalesce(better, item["line_total"]))

    return F.transform(items, fix)
