"""Signals in a text line, and the layout zone that follows from them.

All functions take and return columns, so they work on flat rows as well as
inside ``transform`` over an array of text items.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from billgrain.functions.pin import let
from billgrain.functions.text import (
    DIGIT as D,
    SPACE as S,
    WORD as W,
    WORD_END,
    WORD_START,
    contains_any,
    has_phrase,
    has_word,
    strip,
)

# Word lists of the classification rules.
PRICE_WORDS = (
    "precio", "price", "pvp", "importe", "amount", "total", "subtotal",
    "base", "cuota", "iva", "igic", "tax", "dto", "descuento",
)
CUSTOMER_PHRASES = (
    "cliente", "customer", "bill to", "ship to", "facturar a",
    "destinatario", "comprador", "buyer",
)
ADDRESS_PHRASES = (
    "calle", "c/", "av.", "avda", "plaza", "street", "road",
    "paseo", "carretera", "urbanización", "edif", "edificio",
    "piso", "puerta", "pta", "bajo", "local",
)

# Zone limits as shares of the page, and length limits in characters.
HEADER_SHARE = 0.18
FOOTER_SHARE = 0.85
CUSTOMER_X_SHARE = 0.55
CUSTOMER_Y_SHARE = 0.35
PRICE_MAX_CHARS = 20
PRICE_WORD_MAX_CHARS = 30
POSTAL_MIN_CHARS = 15
IBAN_MIN_CHARS = 20  # two letters, two digits, sixteen digits

# Patterns only have to answer "does it occur", so optional tails are left out.
EMAIL = rf"[\p{{L}}\p{{N}}_.+-]@[\p{{L}}\p{{N}}_.-]+\.{W}"
PHONE = rf"{D}{{3}}(?:{S}|[.-])?{D}{{3}}(?:{S}|[.-])?{D}{{3}}"
IBAN = rf"(?iu)[A-Z]{{2}}{D}{{2}}{S}?{D}{{4}}{S}?{D}{{4}}{S}?{D}{{4}}{S}?{D}{{4}}"
WEBSITE = rf"(?iu)www\.[\p{{L}}\p{{N}}_.-]+\.{W}"
TAX_ID = rf"(?iu){WORD_START}[A-Z]-?{D}{{7,8}}-?[A-Z0-9]?{WORD_END}"
SIGN = r"[$\xa3\u20ac]"  # $ £ €, in ASCII as the patterns of ``text``
CURRENCY = rf"[\p{{Nd}}.,]{S}*+{SIGN}|{SIGN}{S}*+[\p{{Nd}}.,]|{D}[.,]{D}{{2}}"
PURE_NUMBER = rf"\A{S}*[\p{{Nd}}.,]+{S}*[%{SIGN[1:]}?{S}*\z"
POSTAL_CODE = rf"{WORD_START}{D}{{5}}{WORD_END}"


def has_vendor_contact(text: Column, lowered: Column | None = None) -> Column:
    """The substring tests come first: they are cheap and rule out most lines."""
    low = F.lower(text) if lowered is None else lowered
    return (
        (text.contains("@") & text.rlike(EMAIL))
        | (low.contains("www.") & text.rlike(WEBSITE))
        | (contains_any(low, ("tel", "tfno")) & text.rlike(PHONE))
        | ((F.length(text) >= IBAN_MIN_CHARS) & text.rlike(IBAN))
    )


def is_numeric_price(text: Column, lowered: Column | None = None, stripped: Column | None = None) -> Column:
    """Stripped text is a number, a short amount, or holds a price word of its own."""
    t = strip(text) if stripped is None else stripped
    low = F.lower(text) if lowered is None else lowered
    size = F.length(t)
    return (size > 0) & (
        F.when(size < PRICE_MAX_CHARS, t.rlike(f"{PURE_NUMBER}|{CURRENCY}")).otherwise(t.rlike(PURE_NUMBER))
        | ((size < PRICE_WORD_MAX_CHARS) & has_word(low, PRICE_WORDS))
    )


def has_address(text: Column, lowered: Column | None = None) -> Column:
    """The length rule looks at the text as it is, not stripped."""
    low = F.lower(text) if lowered is None else lowered
    return contains_any(low, ADDRESS_PHRASES) | (
        (F.length(text) > POSTAL_MIN_CHARS) & text.rlike(POSTAL_CODE)
    )


def has_customer_phrase(text: Column, lowered: Column | None = None) -> Column:
    return has_phrase(F.lower(text) if lowered is None else lowered, CUSTOMER_PHRASES)


def has_tax_id(text: Column) -> Column:
    return text.rlike(TAX_ID)


def signals(text: Column, lowered: Column | None = None, stripped: Column | None = None) -> Column:
    """The five signals as one struct."""
    return F.struct(
        has_vendor_contact(text, lowered).alias("has_vendor_contact"),
        is_numeric_price(text, lowered, stripped).alias("is_numeric_price"),
        has_address(text, lowered).alias("has_address"),
        has_customer_phrase(text, lowered).alias("has_customer_keyword"),
        has_tax_id(text).alias("has_tax_id"),
    )


def geometry(bbox: Column, height: Column, width: Column) -> Column:
    """Corners and centre of a box given as 4 points (8 numbers) or 2 corners (4 numbers).

    Any other shape is marked ``valid = false`` and sits at the page centre.
    """
    points = F.size(bbox) == 8
    corners = F.size(bbox) == 4
    valid = F.coalesce(points | corners, F.lit(False))
    zero = F.lit(0.0)

    def pick(four_point_index: int, two_corner_index: int) -> Column:
        return (
            F.when(points, F.get(bbox, F.lit(four_point_index)))
            .when(corners, F.get(bbox, F.lit(two_corner_index)))
            .otherwise(zero)
        )

    x1, y1, x2, y2 = pick(0, 0), pick(1, 1), pick(4, 2), pick(5, 3)
    return F.struct(
        valid.alias("valid"),
        x1.alias("x1"),
        y1.alias("y1"),
        x2.alias("x2"),
        y2.alias("y2"),
        F.when(valid, (x1 + x2) / 2).otherwise(width / 2).alias("x_center"),
        F.when(valid, (y1 + y2) / 2).otherwise(height / 2).alias("y_center"),
    )


def _first_of(*branches: tuple[Column, Column | str], otherwise: str) -> Column:
    """One ``CASE`` inside the other: inside a lambda a long ``CASE`` walks to each of its branches from the start."""
    result = F.lit(otherwise)
    for condition, value in reversed(branches):
        result = F.when(condition, value).otherwise(result)
    return result


def zone(
    text: Column,
    x: Column,
    y: Column,
    height: Column,
    width: Column,
    region_type: Column | None = None,
    lowered: Column | None = None,
    stripped: Column | None = None,
) -> Column:
    """Content first, then the region's own type, then the position on the page.

    ``lowered`` and ``stripped`` are those forms of the text, if they are already at hand.
    ``CASE WHEN`` is lazy, so later patterns run only where earlier ones missed.
    """
    header_y, footer_y = height * HEADER_SHARE, height * FOOTER_SHARE
    region = F.lower(region_type) if region_type is not None else None
    right_upper = (
        (x > width * CUSTOMER_X_SHARE)
        & (y < height * CUSTOMER_Y_SHARE)
        & (y > header_y * 0.5)
    )
    looks_like_customer = has_address(text, lowered) | has_tax_id(text)
    by_region = [(region == "header", "HEADER"), (region == "footer", "FOOTER"), (region == "table", "CONTENT")]
    return _first_of(
        (is_numeric_price(text, lowered, stripped), "CONTENT"),
        (has_vendor_contact(text, lowered), F.when(y > footer_y, "FOOTER").otherwise("HEADER")),
        (has_customer_phrase(text, lowered), "CUSTOMER"),
        *(by_region if region is not None else []),
        (right_upper, F.when(looks_like_customer, "CUSTOMER").otherwise("CONTENT")),
        (y < header_y, "HEADER"),
        (y > footer_y, "FOOTER"),
        otherwise="CONTENT",
    )


def centre(bbox: Column, height: Column, width: Column) -> Column:
    """``valid`` and the centre of :func:`geometry`, for places where nothing shares the corners."""
    points, corners = F.size(bbox) == 8, F.size(bbox) == 4

    def at(i: int) -> Column:
        return F.get(bbox, F.lit(i))

    def middle(a: int, four_point: int, two_corner: int, otherwise: Column) -> Column:
        return (
            F.when(corners, (at(a) + at(two_corner)) / 2)
            .when(points, (at(a) + at(four_point)) / 2)
            .otherwise(otherwise / 2)
        )

    return F.struct(
        F.coalesce(corners | points, F.lit(False)).alias("valid"),
        middle(0, 4, 2, width).alias("x_center"),
        middle(1, 5, 3, height).alias("y_center"),
    )


def zoned_items(
    items: Column, height: Column, width: Column, region_type: Column | None = None
) -> Column:
    """Classify every non-blank item of an array and put them in reading order.

    Sorting structs by (y_center, x_center, pos) keeps equal positions in input order.
    ``sort_array`` compares the structs itself; ``array_sort`` would run a lambda for each pair.
    """

    def prepared(item: Column) -> Column:
        return F.struct(
            item["pos"].alias("pos"),
            item["text"].alias("text"),
            F.lower(item["text"]).alias("low"),
            strip(item["text"]).alias("stripped"),
            centre(item["bbox"], height, width).alias("geo"),
        )

    def classify(item: Column) -> Column:
        geo = item["geo"]
        placed = zone(
            item["text"], geo["x_center"], geo["y_center"], height, width, region_type,
            item["low"], item["stripped"],
        )
        return F.struct(
            geo["y_center"].alias("y_center"),
            geo["x_center"].alias("x_center"),
            item["pos"].alias("pos"),
            item["text"].alias("text"),
            F.when(geo["valid"], placed).otherwise("CONTENT").alias("zone"),
        )

    kept = F.filter(F.transform(items, prepared), lambda p: F.length(p["stripped"]) > 0)
    return F.sort_array(F.transform(kept, classify))


def zone_text(zoned: Column) -> Column:
    """Zone sections in fixed order, only those with items, separated by a blank line."""
    # Section titles.
    sections = (
        ("HEADER", "[VENDOR_HEADER]"),
        ("CUSTOMER", "[CUSTOMER_INFO]"),
        ("CONTENT", "[INVOICE_CONTENT]"),
        ("FOOTER", "[VENDOR_FOOTER]"),
    )

    def section(ordered: Column, name: str, title: str) -> Column:
        """No item's text is empty, so the joined text is empty only without items. ``array_join`` leaves NULL out."""
        texts = F.transform(ordered, lambda i: F.when(i["zone"] == name, i["text"]))
        return let(F.array_join(texts, "\n"), lambda t: F.when(t != "", F.concat(F.lit(title + "\n"), t)))

    return let(
        zoned,
        lambda ordered: F.concat_ws(
            "\n\n", *[section(ordered, name, title) for name, title in sections]
        ),
    )
