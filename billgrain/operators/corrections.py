"""Corrections before validation: price suspicion and line totals from printed numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billgrain.functions import repairs, rules
from billgrain.functions.pin import pin
from billgrain.session import cut_lineage

# Own quantity, price and total each rule out numbers of at most two neighbouring
# four-decimal classes, so the closest allowed number is among the next seven classes.
NEIGHBOURS = 7
CLASSES_PER_UNIT = 10_000
SLICES_PER_DOUBLING = 16


def corrected(df: DataFrame, invoice: str = "invoice", text: str = "text") -> DataFrame:
    """Nested layout: price suspicion first, then repaired line totals, within the row."""
    inv = F.col(invoice)
    numbered = pin(df, _numbers=repairs.with_position(repairs.number_tokens(F.col(text))))
    items = repairs.repaired_items(inv["items"], F.col("_numbers"))
    matching = F.size(F.filter(inv["items"], lambda i: rules.is_rate_like(i["unit_price"])))
    return pin(
        numbered,
        price_suspicion=F.when(inv.isNotNull(), rules.suspicion_level(matching, F.size(inv["items"]))),
        **{invoice: F.when(inv.isNotNull(), inv.withField("items", items))},
    ).drop("_numbers")


def tokens(lines: DataFrame, order: Column, *keys: str) -> DataFrame:
    """One row per number of a text line; ``order`` places the line in its document."""
    numbers = repairs.number_tokens(F.col("text"))
    return lines.select(
        *keys, order.alias("line_order"), F.posexplode(numbers).alias("idx", "value")
    )


def _class(value: Column) -> Column:
    # stays a double: printed numbers may have more digits than a bigint
    return F.round(value * CLASSES_PER_UNIT)


def _slice(number: Column) -> Column:
    return F.floor(F.log2(F.greatest(number, F.lit(1.0))) * SLICES_PER_DOUBLING)


def _block(rank: Column) -> Column:
    """Ranks in blocks as wide as the ranks that one line looks at."""
    return F.floor(rank / (2 * NEIGHBOURS + 2))


def repaired_lines(
    lines: DataFrame, texts: DataFrame, many_lines: int = 2_000, many_chars: int = 40_000
) -> DataFrame:
    """Flat layout: the same repair with lines and printed text in separate tables.

    ``texts`` holds the text lines (doc_id, line_order, text). Doubtful lines are found first;
    then each meets only the ranks around it of the numbers of its document, so no document
    of any size pairs all its lines with all its numbers. ``many_lines`` and ``many_chars``
    once chose between two ways and no longer matter.
    """
    doubtful = lines.filter(
        repairs.is_implausible(F.col("quantity"), F.col("unit_price"), F.col("line_total"))
    ).withColumn("expected", F.col("quantity") * F.col("unit_price"))
    # numbers outside the windows of all doubtful lines of their document are left out before any is moved
    spans = doubtful.groupBy("doc_id").agg(
        F.min(F.col("expected") * repairs.LOW).alias("lowest"), F.max(F.col("expected") * repairs.HIGH).alias("highest")
    )
    numbers = tokens(texts.join(spans, "doc_id"), F.col("line_order"), "doc_id", "lowest", "highest")
    within = numbers.filter(F.col("value").between(F.col("lowest"), F.col("highest"))).drop("lowest", "highest")
    best = _best_by_rank(doubtful, within)
    return lines.join(best, ["doc_id", "line_no"], "left").select(
        "doc_id",
        "line_no",
        F.left("description", F.lit(40)).alias("label"),
        F.col("line_total").alias("printed"),
        F.coalesce("better", "line_total").alias("line_total"),
        F.col("better").isNotNull().alias("repaired"),
    )


def _allowed(value: Column, item: str = "") -> Column:
    """In the window around quantity x price, and none of the line's own numbers."""
    condition = repairs.in_window(value, F.col(f"{item}expected"))
    for name in ("quantity", "unit_price", "line_total"):
        own = F.coalesce(repairs.same_amount(value, F.col(f"{item}{name}")), F.lit(False))
        condition = condition & ~own
    return condition


def _closest(value: Column, expected: Column, *place: str) -> Column:
    """The value nearest to the expected one, first in the text on a tie."""
    order = F.struct(F.abs(value - expected).alias("d"), F.struct(*place).alias("p"), value.alias("v"))
    return F.min(order)["v"].alias("better")


def _best_by_rank(doubtful: DataFrame, numbers: DataFrame) -> DataFrame:
    """Each line meets only the few ranks of its document's numbers around quantity x price.

    Ranks are built slice by slice (slices of the number scale, with the counts of lower
    slices added), so even one document with most of the data is ranked by many tasks.
    """
    distinct = numbers.groupBy("doc_id", "value").agg(F.min(F.struct("line_order", "idx")).alias("pos"))
    classes = (
        distinct.groupBy("doc_id", _class(F.col("value")).alias("cls"))
        # distinct doubles that agree to four decimals: a handful at most
        .agg(F.collect_list(F.struct("value", "pos")).alias("members"))
        .withColumn("slice", _slice(F.col("cls")))
    )
    item = F.struct("line_no", "expected", "quantity", "unit_price", "line_total")
    seekers = doubtful.select(
        "doc_id", _class(F.col("expected")).alias("cls"), item.alias("item")
    ).withColumn("slice", _slice(F.col("cls")))
    no_item = F.lit(None).cast(seekers.schema["item"].dataType).alias("item")
    no_members = F.lit(None).cast(classes.schema["members"].dataType).alias("members")
    everyone = cut_lineage(
        classes.select("doc_id", "slice", "cls", "members", no_item).unionByName(
            seekers.select("doc_id", "slice", "cls", no_members, "item")
        )
    )
    is_class = F.col("members").isNotNull().cast("int")
    # one row per slice of the number scale, so this window stays short for any document
    before = Window.partitionBy("doc_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        everyone.groupBy("doc_id", "slice").agg(F.sum(is_class).alias("n"))
        .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    within = (
        Window.partitionBy("doc_id", "slice")
        .orderBy("cls", F.col("item").isNotNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = everyone.withColumn("local", F.sum(is_class).over(within)).join(offsets, ["doc_id", "slice"])
    ranked = ranked.withColumn("rank", F.col("local") + F.col("offset"))
    # the wanted ranks lie in two blocks at most, so a line moves twice and not once for each rank
    lowest, highest = F.col("rank") - NEIGHBOURS, F.col("rank") + NEIGHBOURS + 1
    wanted = ranked.filter("item IS NOT NULL").select(
        "doc_id",
        "item",
        lowest.alias("lowest"),
        highest.alias("highest"),
        F.explode(F.array_distinct(F.array(_block(lowest), _block(highest)))).alias("block"),
    )
    offered = ranked.filter("members IS NOT NULL").select("doc_id", "rank", _block(F.col("rank")).alias("block"), "members")
    value = F.col("c.value")
    return (
        wanted.join(offered, ["doc_id", "block"])
        .filter(F.col("rank").between(F.col("lowest"), F.col("highest")))
        .select("doc_id", "item", F.explode("members").alias("c"))
        .filter(_allowed(value, "item."))
        .groupBy("doc_id", F.col("item.line_no").alias("line_no"))
        .agg(_closest(value, F.col("item.expected"), "c.pos.line_order", "c.pos.idx"))
    )


def assembled(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Headers with their lines in the flat layout: one row per line, by ``doc_id``.

    An invoice without lines has one row, with NULL line columns. The grain is the same for
    every size, so no invoice grows a row without bound and none is cut into parts.
    """
    return headers.join(lines, "doc_id", "left")
