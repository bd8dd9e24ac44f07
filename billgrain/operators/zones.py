"""Text items of a page: signals, geometry, zones, reading order and zone text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billgrain.functions import zones
from billgrain.functions.pin import pin
from billgrain.functions.text import is_blank, strip

TAX_ID_TEXT = r"(?iu)(?<![\p{L}\p{N}_])([A-Z]-?\p{Nd}{7,8}-?[A-Z0-9]?)(?![\p{L}\p{N}_])"


def _with_forms(items: DataFrame) -> DataFrame:
    """The lower-case and stripped text, computed once for all patterns."""
    return items.withColumn("_low", F.lower("text")).withColumn("_stripped", strip(F.col("text")))


def with_signals(items: DataFrame) -> DataFrame:
    """Add the five content signals of every item."""
    return pin(_with_forms(items), signals=zones.signals(F.col("text"), F.col("_low"), F.col("_stripped"))).drop("_low", "_stripped")


def with_geometry(items: DataFrame) -> DataFrame:
    return pin(items, geo=zones.geometry(F.col("bbox"), F.col("height"), F.col("width")))


def classified(items: DataFrame, region_type: Column | None = None) -> DataFrame:
    """Add geometry and zone to every non-blank item. A malformed box means CONTENT."""
    placed = _with_forms(with_geometry(items.filter(~is_blank(F.col("text")))))
    zone = zones.zone(
        F.col("text"), F.col("geo.x_center"), F.col("geo.y_center"),
        F.col("height"), F.col("width"), region_type, F.col("_low"), F.col("_stripped"),
    )
    return pin(placed, zone=F.when(F.col("geo.valid"), zone).otherwise("CONTENT")).drop("_low", "_stripped")


def in_reading_order(pages: DataFrame) -> DataFrame:
    """One row per item with its rank on the page, top to bottom, left to right."""
    ordered = zones.zoned_items(F.col("items"), F.col("height"), F.col("width"))
    return pages.select("src", "doc_id", F.posexplode(ordered).alias("rank", "item")).select(
        "src", "doc_id", "rank", "item.pos", "item.zone"
    )


def zone_texts(pages: DataFrame, region_type: Column | None = None) -> DataFrame:
    """One text per page with the items grouped under zone titles. Works within the row."""
    zoned = pin(
        pages,
        zoned=zones.zoned_items(F.col("items"), F.col("height"), F.col("width"), region_type),
    )
    return zoned.select("src", "doc_id", zones.zone_text(F.col("zoned")).alias("text"))


def distribution(items: DataFrame) -> DataFrame:
    return classified(items).groupBy("zone").agg(F.count(F.lit(1)).alias("n_items"))


def parties(items: DataFrame) -> DataFrame:
    """Vendor, customer and registered tax id of each document, by zone.

    The first header item names the vendor, the first customer item the customer, and
    the first footer item with a tax id gives the vendor's. ``min_by`` combines on the
    map side, so one huge document does not gather in one task.
    """
    zoned = classified(items)
    order = F.struct("geo.y_center", "geo.x_center", "pos")
    footer_id = F.when(F.col("zone") == "FOOTER", F.regexp_extract("text", TAX_ID_TEXT, 1))

    def first(condition: Column, value: Column) -> Column:
        return F.min(F.when(condition, F.struct(order.alias("o"), value.alias("v"))))["v"]

    return zoned.groupBy("src", "doc_id").agg(
        first(F.col("zone") == "HEADER", F.col("text")).alias("vendor"),
        first(F.col("zone") == "CUSTOMER", F.col("text")).alias("customer"),
        first(footer_id != "", footer_id).alias("vendor_tax_id"),
    )


def confident_text(pages: DataFrame, limit: float = 0.5) -> DataFrame:
    """Plain page text: items above the confidence limit, joined by spaces in input order."""
    sure = F.filter("items", lambda i: i["confidence"] > limit)
    return pages.select(
        "src", "doc_id", F.array_join(F.transform(sure, lambda i: i["text"]), " ").alias("text")
    )
