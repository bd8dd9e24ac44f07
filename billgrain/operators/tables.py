"""HTML tables: rows, text forms, structure, compact notation and kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billgrain.functions import extract, html
from billgrain.functions.pin import pin


def with_rows(df: DataFrame, row_tag: str = "tr", cell_tags: str = "td|th", header_tag: str = "th") -> DataFrame:
    """Add ``cells``: rows of (text, is_header), decoded once."""
    return pin(df, cells=html.cells(F.col("html"), row_tag, cell_tags, header_tag))


def rows(df: DataFrame, key: str, **tags: str) -> DataFrame:
    """One row per table row."""
    parsed = with_rows(df, **tags)
    return parsed.select(key, F.posexplode("cells").alias("row_no", "row")).select(
        key, "row_no", F.size("row").alias("n_cells"), html.texts(F.col("row")).alias("cells")
    )


def with_structure(df: DataFrame) -> DataFrame:
    """Add ``table``: headers and data rows, from text decoded before parsing as well."""
    parsed = pin(df, cells=html.toon_rows(F.col("html")))
    return pin(parsed, table=html.structure(F.col("cells"))).drop("cells")


def compact(df: DataFrame) -> DataFrame:
    """Compact notation of each table; bare text where no structure could be built."""
    table = with_structure(df)
    compacted = html.toon(F.col("table"), F.col("table_num"), F.col("page_num"))
    bare = html.toon_fallback(F.col("html"), F.col("table_num"), F.col("page_num"))
    return table.select("doc_id", F.coalesce(compacted, bare).alias("toon"))


def kinds(df: DataFrame) -> DataFrame:
    """Kind of each table, the hint for it, its headers and its row count."""
    typed = pin(with_structure(df), structure_type=html.table_type(F.col("table.headers")))
    return typed.select(
        "doc_id",
        "structure_type",
        html.table_hint(F.col("structure_type")).alias("hint"),
        F.col("table.headers").alias("headers"),
        F.size("table.rows").alias("row_count"),
        F.col("table.rows").alias("rows"),
    )


def cell_parties(df: DataFrame) -> DataFrame:
    """Every filled cell, and whether it carries contact details of the vendor."""
    return (
        with_rows(df)
        .select("doc_id", F.posexplode("cells").alias("row_no", "row"))
        .select("doc_id", "row_no", F.posexplode("row").alias("cell_no", "c"))
        .filter("c.text <> ''")
        .select("doc_id", "row_no", "cell_no", F.col("c.text").alias("cell"), html.is_vendor_cell(F.col("c.text")).alias("is_vendor"))
    )


def category_items(df: DataFrame) -> DataFrame:
    """Expense tables: one item per row, priced by its first non-zero category column."""
    typed = kinds(df).filter("structure_type = 'expense_category_table'")
    row = F.col("row")
    amounts = F.transform(
        F.slice(row, F.lit(2), F.greatest(F.size(row) - 1, F.lit(0))),
        lambda c, i: F.struct(
            extract.number(c).alias("amount"),
            F.get(F.col("headers"), i + 1).alias("category"),
        ),
    )
    priced = F.get(F.filter(amounts, lambda a: a["amount"] != 0), F.lit(0))
    exploded = typed.select("doc_id", "headers", F.posexplode("rows").alias("row_no", "row"))
    return pin(exploded, priced=priced).filter("priced IS NOT NULL").select(
        "doc_id",
        "row_no",
        F.get(row, F.lit(0)).alias("description"),
        F.col("priced.category").alias("category"),
        F.lit(1.0).alias("quantity"),
        F.col("priced.amount").alias("unit_price"),
        F.col("priced.amount").alias("line_total"),
    )
