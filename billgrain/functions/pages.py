"""Regions of a page to text, as columns over the page's own array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from billgrain.functions import html, zones
from billgrain.functions.pin import let, unless_empty

# Region kinds, full-page limits, mode threshold and text markers.
ZONED_TYPES = ("figure", "text", "title")
LABELLED_TYPES = ("header", "footer", "reference")
CORNER_LIMIT = 50
WIDTH_SHARE = 0.9
ENOUGH_CHARS = 200


def is_full_page(bbox: Column, width: Column) -> Column:
    def at(i: int) -> Column:
        return F.get(bbox, F.lit(i))

    test = (
        (F.size(bbox) >= 4) & (at(0) < CORNER_LIMIT) & (at(1) < CORNER_LIMIT)
        & ((at(2) - at(0)) > width * WIDTH_SHARE)
    )
    return F.coalesce(test, F.lit(False))


def plain_text(region: Column) -> Column:
    """Text of a region by the shape of its result."""
    listed = F.filter(
        F.transform(region["items"], lambda i: i["text"]), lambda t: F.coalesce(t, F.lit("")) != ""
    )
    return (
        F.when(region["res_kind"] == "list", F.array_join(listed, "\n"))
        .when(region["res_kind"].isin("dict", "str"), F.coalesce(region["text"], F.lit("")))
        .otherwise("")
    )


def region_html(region: Column) -> Column:
    """HTML of a table region, NULL if there is none."""
    return F.when(
        (region["type"] == "table") & (region["res_kind"] == "dict"), F.nullif(region["html"], F.lit(""))
    )


def routed_text(region: Column, table_no: Column, page_no: Column, height: Column, width: Column) -> Column:
    """The text a region contributes, NULL for nothing."""
    def table_text(markup: Column) -> Column:
        compact = html.toon(html.structure(html.toon_rows(markup)), table_no, page_no)
        entities = unless_empty(html.entity_text(markup, html.cells(markup)))
        chosen = F.when(is_full_page(region["bbox"], width), entities).otherwise(compact)
        return F.when(markup.isNotNull(), chosen)

    def titled(title: Column) -> Column:
        """NULL where the region has no text of its own."""
        return F.concat(title, unless_empty(plain_text(region)))

    def by_kind(kind: Column) -> Column:
        has_items = (region["res_kind"] == "list") & (F.size(region["items"]) > 0)
        zoned = zones.zone_text(zones.zoned_items(region["items"], height, width, kind))
        return (
            F.when(kind == "table", let(region_html(region), table_text))
            .when(kind.isin(*ZONED_TYPES) & has_items, unless_empty(zoned))
            .when(kind.isin(*ZONED_TYPES), titled(F.lit("[DOCUMENT TEXT]\n")))
            .when(
                kind.isin(*LABELLED_TYPES),
                titled(F.concat(F.lit("["), F.upper(kind), F.lit("]\n"))),
            )
            .otherwise(titled(F.lit("")))
        )

    return let(F.coalesce(region["type"], F.lit("Unknown")), by_kind)


def numbered(regions: Column) -> Column:
    """Regions in order with their place (from 0) and, if they are tables, their number on the page (from 1)."""

    def is_table(placed: Column) -> Column:
        return F.coalesce(placed["region"]["type"] == "table", F.lit(False))

    def row(placed: Column, number: Column) -> Column:
        return F.struct(placed["pos"].alias("pos"), number.cast("int").alias("table_num"), placed["region"].alias("region"))

    placed = F.transform(regions, lambda r, i: F.struct(i.alias("pos"), r.alias("region")))
    tables = F.transform(F.filter(placed, is_table), lambda p, n: row(p, n + 1))
    others = F.transform(F.filter(placed, lambda p: ~is_table(p)), lambda p: row(p, F.lit(None)))
    return F.sort_array(F.concat(tables, others))


def routed(regions: Column, page_no: Column, height: Column, width: Column) -> Column:
    """Struct (text, html, table_count) of a page; tables count even without HTML."""
    # the numbers are told from the kinds alone, so no region is moved
    numbers = numbered(F.transform(regions, lambda r: F.struct(r["type"].alias("type"))))["table_num"]
    parts = let(
        numbers,
        lambda n: F.transform(regions, lambda r, i: routed_text(r, F.get(n, i), page_no, height, width)),
    )
    return F.struct(
        F.array_join(F.array_compact(parts), "\n\n").alias("text"),
        F.array_join(F.array_compact(F.transform(regions, region_html)), "\n").alias("html"),
        F.size(F.filter(regions, lambda r: r["type"] == "table")).alias("table_count"),
    )


def fallback_text(regions: Column, page_no: Column) -> Column:
    """All regions with their number, or a marker when there is nothing."""

    def part(region: Column, index: Column) -> Column:
        title = F.concat(
            F.lit("["), F.upper(F.coalesce(region["type"], F.lit("unknown"))), F.lit(" "),
            (index + 1).cast("string"), F.lit("]\n"),
        )
        joined = F.array_join(F.transform(region["items"], lambda i: F.coalesce(i["text"], F.lit(""))), "\n")
        return (
            F.when(region["res_kind"] == "dict", F.concat(title, F.nullif(region["text"], F.lit(""))))
            .when((region["res_kind"] == "list") & (F.size(region["items"]) > 0), F.concat(title, joined))
            .when(region["res_kind"] == "str", F.concat(title, F.coalesce(region["text"], F.lit(""))))
        )

    text = F.array_join(F.array_compact(F.transform(regions, part)), "\n\n")
    nothing = F.concat(F.lit("[PAGE "), page_no.cast("string"), F.lit(" - NO TEXT EXTRACTED]"))
    return let(text, lambda t: F.when(t == "", nothing).otherwise(t))


def assembled(pages: Column) -> Column:
    """Pages in number order between start and end markers."""
    def one(page: Column) -> Column:
        number = page["page_number"].cast("string")
        return F.concat(
            F.lit("[INICIO PÁGINA "), number, F.lit("]\n"), page["text"],
            F.lit("\n[FIN PÁGINA "), number, F.lit("]"),
        )

    return F.array_join(F.transform(F.array_sort(pages), one), "\n\n")
