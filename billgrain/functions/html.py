"""HTML tables as arrays of cells.

A row runs from its last opening tag to its closing tag and a cell likewise, which is
what an event parser yields for balanced markup. Tables whose opening and closing tags
do not pair up are marked by :func:`malformed`.
"""

from __future__ import annotations

import json
from html import unescape as _unescape_text
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from billgrain.functions.pin import let
from billgrain.functions.text import SPACE, collapse_spaces, contains_any, strip

HIDDEN = r"(?is)<(?:script\b.*?</script\s*>|style\b.*?</style\s*>|!--.*?-->)"
TAG = r"""</?[A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<[!?][^>]*>"""
MARK = "\x00"

# Named references from the language's own table; those without ";" may be followed
# by more letters, so they are matched longest first.
_WITHOUT_SEMICOLON = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
# A map is searched from its start, so names are found by their first letter first.
_BY_INITIAL = {c: {n: t for n, t in html5.items() if n[0] == c} for c in sorted({n[0] for n in html5})}
_STARTS = "#" + "".join(_BY_INITIAL)
_LOW_NUMBERS = {str(n): _unescape_text(f"&#{n};") for n in range(160)}


def unescape(text: Column) -> Column:
    """Replace character references once, left to right."""
    names = F.from_json(F.lit(json.dumps(_BY_INITIAL)), "map<string,map<string,string>>")
    low = F.from_json(F.lit(json.dumps(_LOW_NUMBERS)), "map<string,string>")
    prefix = f"^({'|'.join(_WITHOUT_SEMICOLON)})"

    def character(number: Column) -> Column:
        n = F.coalesce(number, F.lit(0x110000))
        dropped = n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        encoded = F.unhex(F.lpad(F.hex(n), 8, "0"))
        return (
            F.when(n < 160, F.element_at(low, n.cast("string")))
            .when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "�")
            .when(dropped, "")
            .otherwise(F.decode(encoded, "UTF-32"))
        )

    def named(name: Column) -> Column:
        """What the name stands for, NULL if nothing."""
        return F.try_element_at(F.try_element_at(names, F.substring(name, 1, 1)), name)

    def after_ampersand(piece: Column) -> Column:
        decimal = F.regexp_extract(piece, r"^#([0-9]+);?", 1)
        hexadecimal = F.regexp_extract(piece, r"^#[xX]([0-9a-fA-F]+);?", 1)
        name = F.regexp_extract(piece, "^([^\\t\\n\\f <&#;]{1,32};?)", 1)
        stem = F.regexp_extract(piece, prefix, 1)
        hex_number = F.when(
            F.length(F.ltrim(hexadecimal, F.lit("0"))) <= 8, F.conv(hexadecimal, 16, 10)
        ).cast("bigint")
        return (
            # the three most frequent ones without any pattern
            F.when(F.startswith(piece, F.lit("amp;")), F.concat(F.lit("&"), F.substr(piece, F.lit(5))))
            .when(F.startswith(piece, F.lit("lt;")), F.concat(F.lit("<"), F.substr(piece, F.lit(4))))
            .when(F.startswith(piece, F.lit("gt;")), F.concat(F.lit(">"), F.substr(piece, F.lit(4))))
            # no reference begins like this
            .when(~F.contains(F.lit(_STARTS), F.substring(piece, 1, 1)), F.concat(F.lit("&"), piece))
            .when(
                decimal != "",
                F.concat(
                    character(decimal.try_cast("bigint")), F.regexp_replace(piece, "^#[0-9]+;?", "")
                ),
            )
            .when(
                hexadecimal != "",
                F.concat(character(hex_number), F.regexp_replace(piece, "^#[xX][0-9a-fA-F]+;?", "")),
            )
            .when(named(name).isNotNull(), F.concat(named(name), F.substr(piece, F.length(name) + 1)))
            .when(
                (F.length(stem) > 1) & (F.length(name) > F.length(stem)),
                F.concat(named(stem), F.substr(piece, F.length(stem) + 1)),
            )
            .otherwise(F.concat(F.lit("&"), piece))
        )

    def joined(pieces: Column) -> Column:
        tail = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
        return F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(tail, after_ampersand), ""))

    return let(
        text, lambda t: F.when(t.contains("&"), let(F.split(t, "&"), joined)).otherwise(t)
    )


def strip_tags(html: Column) -> Column:
    """Every tag becomes a space, white space collapses."""
    return collapse_spaces(F.regexp_replace(html, "<[^>]+>", " "))


def _open(tags: str) -> str:
    return rf"<(?:{tags})(?:{SPACE}[^>]*)?/?>"


def _close(tags: str) -> str:
    return rf"</(?:{tags}){SPACE}*>"


def _cell_text(inner: Column) -> Column:
    """Drop tags, then decode; the mark keeps a tag from joining two halves of a reference."""

    def decoded(marked: Column) -> Column:
        return strip(F.replace(unescape(marked), F.lit(MARK), F.lit("")))

    marked = F.when(inner.contains("<"), F.regexp_replace(inner, TAG, MARK)).otherwise(inner)
    # most cells hold neither tags nor references
    return F.when(inner.rlike(f"[<&{MARK}]"), decoded(marked)).otherwise(strip(inner))


def cells(html: Column, row_tag: str = "tr", cell_tags: str = "td|th", header_tag: str = "th") -> Column:
    """Rows of structs (text, is_header). Rows without any cell are left out."""
    visible = F.regexp_replace(html, HIDDEN, "")

    def after_last(inner: Column, tags: str) -> Column:
        """``inner`` ends where its closing tag begins; an opening tag within it may reach into that tag."""
        whole = F.concat(inner, F.lit(f"</{tags.split('|')[0]}>"))
        last = F.regexp_replace(whole, rf"(?is)\A.*{_open(tags)}|{_close(tags)}\z", "")
        return F.when(inner.rlike(f"(?i)<(?:{tags})"), last).otherwise(inner)

    def inside(text: Column, tags: str) -> Column:
        """What stands between each first opening tag and the closing tag after it."""
        return F.regexp_extract_all(text, F.lit(rf"(?is){_open(tags)}(.*?){_close(tags)}"), 1)

    def to_row(row: Column) -> Column:
        opened = F.regexp_extract_all(row, F.lit(rf"(?is)({_open(cell_tags)}).*?{_close(cell_tags)}"), 1)
        titled = F.transform(opened, lambda o: o.rlike(rf"(?i)\A{_open(header_tag)}"))
        headers = F.when(row.rlike(f"(?i){_open(header_tag)}"), titled)

        return F.struct(inside(row, cell_tags).alias("inner"), headers.alias("headers"))

    def with_texts(row: Column) -> Column:
        return F.transform(
            row["inner"],
            lambda inner, i: F.struct(
                _cell_text(after_last(inner, cell_tags)).alias("text"),
                F.coalesce(F.get(row["headers"], i), F.lit(False)).alias("is_header"),
            ),
        )

    rows = F.transform(F.transform(inside(visible, row_tag), lambda r: after_last(r, row_tag)), to_row)
    return F.transform(F.filter(rows, lambda r: F.size(r["inner"]) > 0), with_texts)


def texts(row: Column) -> Column:
    return F.transform(row, lambda c: c["text"])


def malformed(html: Column, row_tag: str = "tr", cell_tags: str = "td|th") -> Column:
    """Opening and closing tags of rows or cells do not pair up."""

    def unequal(tags: str) -> Column:
        return F.regexp_count(html, F.lit("(?i)" + _open(tags))) != F.regexp_count(
            html, F.lit("(?i)" + _close(tags))
        )

    return unequal(row_tag) | unequal(cell_tags)


def table_text(rows: Column) -> Column:
    """Non-empty cells joined by a bar, one line per row, empty rows left out."""

    def line(row: Column) -> Column:
        return F.array_join(F.filter(texts(row), lambda t: t != ""), " | ")

    return F.array_join(F.filter(F.transform(rows, line), lambda t: t != ""), "\n")


def is_vendor_cell(cell: Column) -> Column:
    """Cell-level contact test; stricter and different from the one for text lines."""
    return (
        (cell.contains("@") & F.substring_index(cell, "@", -1).contains("."))
        | cell.rlike(rf"(?iu)Tel(?:[:]|{SPACE})*\p{{Nd}}{{6,}}")
        | (cell.contains("ES") & cell.rlike(rf"ES\p{{Nd}}{{2}}{SPACE}*\p{{Nd}}{{4}}"))
    )


def entity_text(html: Column, rows: Column) -> Column:
    """Contact cells first, then all other cells without repeats; no rows: bare text."""
    # Block titles.
    vendor_title, other_title = "[VENDOR_INFO - Has contact details]\n", "[DOCUMENT_CONTENT]\n"

    def block(title: str, lines: Column) -> Column:
        return let(
            lines, lambda a: F.when(F.size(a) > 0, F.concat(F.lit(title), F.array_join(a, "\n")))
        )

    def blocks(filled: Column) -> Column:
        def of_vendors(vendors: Column) -> Column:
            others = F.array_distinct(F.filter(filled, lambda _, i: F.get(vendors, i).isNull()))
            return F.concat_ws("\n\n", block(vendor_title, F.array_compact(vendors)), block(other_title, others))

        return let(F.transform(filled, lambda t: F.when(is_vendor_cell(t), t)), of_vendors)

    def of_rows(parsed: Column) -> Column:
        filled = F.filter(F.flatten(F.transform(parsed, texts)), lambda t: t != "")
        return F.when(F.size(parsed) == 0, strip_tags(html)).otherwise(let(filled, blocks))

    return F.when(F.coalesce(html, F.lit("")) == "", "").otherwise(let(rows, of_rows))


def structure(rows: Column) -> Column:
    """Headers and data rows. A row with any header cell is a header row; the last one counts."""
    def is_header(row: Column) -> Column:
        return F.exists(row, lambda c: c["is_header"])

    def generic(first_row: Column) -> Column:
        return F.transform(first_row, lambda _, i: F.concat(F.lit("col"), (i + 1).cast("string")))

    def with_headers(parts: Column) -> Column:
        titled, data = parts["titled"], parts["data"]
        headers = (
            F.when(F.size(titled) > 0, texts(F.element_at(titled, -1)))
            .when(F.size(data) > 0, generic(F.get(data, F.lit(0))))
            .otherwise(F.array().cast("array<string>"))
        )
        return F.struct(headers.alias("headers"), data.alias("rows"))

    def split(parsed: Column) -> Column:
        titled = F.filter(parsed, is_header)
        data = F.transform(F.filter(parsed, lambda r: ~is_header(r)), texts)
        return let(F.struct(titled.alias("titled"), data.alias("data")), with_headers)

    return let(rows, split)


def toon_rows(html: Column, **tags: str) -> Column:
    """Rows for the compact notation: the text is decoded before and during parsing."""
    return cells(unescape(html), **tags)


def toon(table: Column, table_no: Column, page_no: Column) -> Column:
    """Compact table text: title with row count, headers in braces, one line per row."""
    title = F.concat(
        F.lit("TABLE "), table_no.cast("string"), F.lit(" (Page "), page_no.cast("string"), F.lit(")")
    )

    def body(parsed: Column) -> Column:
        headers, rows = parsed["headers"], parsed["rows"]
        width = F.size(headers)

        def line(row: Column) -> Column:
            padded = F.slice(F.concat(row, F.array_repeat(F.lit(""), width)), F.lit(1), width)
            escaped = F.transform(padded, lambda c: F.replace(c, F.lit(","), F.lit("\\,")))
            return F.array_join(escaped, ", ")

        full = F.concat(
            title, F.lit(" ["), F.size(rows).cast("string"), F.lit("]\n{"),
            F.array_join(headers, ", "), F.lit("}\n"), F.array_join(F.transform(rows, line), "\n"),
        )
        return F.when(F.size(rows) == 0, F.concat(title, F.lit(": Empty table"))).otherwise(full)

    return let(table, body)


def toon_fallback(html: Column, table_no: Column, page_no: Column) -> Column:
    """The table's bare text under its title."""
    return F.format_string("TABLE %s (Page %s): %s", table_no, page_no, strip_tags(html))


# Header words that tell the table kinds apart.
EXPENSE_HEADERS = (
    "HONORARIOS", "SUPLIDOS", "PROVISIONES", "PROV.FONDOS",
    "RETENCION", "BASE IMP", "BASE IMPONIBLE",
)
ITEM_HEADERS = (
    "DESCRIPCION", "DESCRIPTION", "CONCEPTO", "ITEM",
    "CANTIDAD", "QUANTITY", "QTY", "UNITS", "UNIDADES",
    "PRECIO", "PRICE", "PVP", "UNIT PRICE", "PRECIO UNITARIO",
    "TOTAL", "IMPORTE", "AMOUNT", "LINE TOTAL",
)
# Hint per table kind.
HINTS = {
    "expense_category_table": (
        "STRUCTURE: Expense category table. Columns represent expense types. "
        "Extract ONE item per row with non-zero category as line_total."
    ),
    "standard_line_items": (
        "STRUCTURE: Standard line item table. Each row is a separate product/service. "
        "Extract one item per row."
    ),
    "generic": "",
}


def table_type(headers: Column) -> Column:
    def matching(wanted: tuple[str, ...]) -> Column:
        upper = F.transform(headers, lambda h: F.upper(h))
        return F.size(F.filter(upper, lambda h: contains_any(h, wanted)))

    return (
        F.when(matching(EXPENSE_HEADERS) >= 2, "expense_category_table")
        .when(matching(ITEM_HEADERS) >= 3, "standard_line_items")
        .otherwise("generic")
    )


def table_hint(kind: Column) -> Column:
    hint = F.lit("")
    for name, text in HINTS.items():
        hint = F.when(kind == name, text).otherwise(hint)
    return hint
