"""Pages: regions to text, choice of extraction mode, document text, requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billgrain.functions import pages
from billgrain.functions.pin import pin
from billgrain.functions.text import truncate_middle
from billgrain.session import counted_keys, cut_lineage


def scan_regions(df: DataFrame) -> DataFrame:
    """One row per region with defaults; a page without regions keeps one empty row."""
    exploded = df.select("doc_id", "page_number", "width", F.posexplode_outer("regions").alias("region_idx", "r"))
    return exploded.select(
        "doc_id",
        "page_number",
        "width",
        "region_idx",
        F.when(F.col("region_idx").isNotNull(), F.coalesce("r.type", F.lit("Unknown"))).alias("type"),
        F.coalesce("r.bbox", F.array().cast("array<double>")).alias("bbox"),
        F.coalesce("r.res_kind", F.lit("dict")).alias("res_kind"),
        F.coalesce(F.size("r.items"), F.lit(0)).alias("n_items"),
    )


def numbered_tables(df: DataFrame) -> DataFrame:
    """Running table number of every table region on its page."""
    kinds = F.transform("regions", lambda r: F.struct(r["type"].alias("type")))
    rows = df.select("doc_id", "page_number", F.explode(pages.numbered(kinds)).alias("t"))
    return rows.filter("t.table_num IS NOT NULL").select("doc_id", "page_number", F.col("t.pos").alias("region_idx"), "t.table_num")


def page_results(df: DataFrame, mode: str) -> DataFrame:
    """Text, HTML and counts of every page. Pages with regions but no text fall back."""
    routed = pin(
        df,
        routed=pages.routed(F.col("regions"), F.col("page_number"), F.col("height"), F.col("width")),
    )
    text = F.when(
        (F.col("routed.text") == "") & (F.size("regions") > 0),
        pages.fallback_text(F.col("regions"), F.col("page_number")),
    ).otherwise(F.col("routed.text"))
    return pin(routed, text=text).select(
        "doc_id",
        "page_number",
        "text",
        F.col("routed.html").alias("html"),
        F.col("routed.table_count").alias("table_count"),
        F.size("regions").alias("region_count"),
        F.lit(1.0).alias("structure_score"),
        F.lit(mode).alias("extraction_mode"),
    )


def choose_mode(layout: DataFrame, table: DataFrame, enough: int = pages.ENOUGH_CHARS) -> DataFrame:
    """Layout result unless it is short and the table result is strictly longer.

    Both sides hold one row per page, so the join has no hot key. Pages with enough
    text leave the key empty on purpose: they need no partner.
    """
    key = ["doc_id", "page_number"]
    values = [c for c in layout.columns if c not in key]
    short = F.length("text") < enough
    left = layout.select(
        *key, F.struct(*values).alias("l"), F.when(short, F.col("page_number")).alias("wanted")
    )
    right = table.select(
        F.col("doc_id").alias("t_doc"), F.col("page_number").alias("t_page"), F.struct(*values).alias("t")
    )
    joined = left.join(
        right, (F.col("doc_id") == F.col("t_doc")) & (F.col("wanted") == F.col("t_page")), "left"
    )
    longer = F.coalesce(F.length("t.text") > F.length("l.text"), F.lit(False))
    return joined.select(*key, F.when(longer, F.col("t")).otherwise(F.col("l")).alias("r")).select(*key, "r.*")


def adaptive(layout_pages: DataFrame, table_pages: DataFrame, enough: int = pages.ENOUGH_CHARS) -> DataFrame:
    """``choose_mode`` over both readings of the pages (doc_id, page_number, height, width, regions).

    The layout's results are written once; only the pages that they leave short are read in
    table mode and joined, so no other page's tables are parsed and no other page is moved.
    Pages that one side lacks, empty tables and pages without regions go through as in
    ``choose_mode``; a page without a number keeps its layout result.
    """
    layout = cut_lineage(page_results(layout_pages, "layout"))
    key = ["doc_id", "page_number"]
    is_short = F.coalesce(F.length("text") < enough, F.lit(False))
    few = layout.where(is_short)
    _, short = counted_keys(few.select(*key))
    wanted = table_pages.join(short, key, "left_semi")
    return layout.where(~is_short).unionByName(choose_mode(few, page_results(wanted, "table"), enough))


def document_summary(results: DataFrame) -> DataFrame:
    """Totals per document over its pages."""
    return results.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.sum("table_count").alias("n_tables"),
        F.sum("region_count").alias("n_regions"),
        F.sum(F.length("text")).alias("n_chars"),
    )


def assemble(df: DataFrame) -> DataFrame:
    """Document text from the document's array of pages."""
    return df.select("doc_id", pages.assembled(F.col("pages")).alias("text"))


#: Pages that one task joins at a time.
PART_PAGES = 256


def page_texts(items: DataFrame, limit: float = 0.5, *key: str) -> DataFrame:
    """One row per page from one row per item (page_number, pos, text, confidence): the items
    above the confidence limit in their order, joined by spaces. A page of which nothing is
    left has an empty text."""
    key = key or ("doc_id",)
    sure = F.when(F.col("confidence") > limit, F.struct("pos", "text"))
    read = F.transform(F.sort_array(F.collect_list(sure)), lambda i: i["text"])
    return items.groupBy(*key, "page_number").agg(F.array_join(read, " ").alias("text"))


def assemble_rows(page_rows: DataFrame, *key: str) -> DataFrame:
    """Document text from one row per page (page_number, text), ordered by page number.

    Ranges of ``PART_PAGES`` pages are joined first, each on its own, and then the ranges of a
    document, so a huge document is the work of several tasks. Pages without a number come
    last and are shown as N/A; a page without text is empty; pages with one number stand in
    the order of their texts.
    """
    key = key or ("doc_id",)
    number = F.coalesce(F.col("page_number").cast("string"), F.lit("N/A"))
    shown = F.concat(
        F.lit("[INICIO PÁGINA "), number, F.lit("]\n"), F.coalesce("text", F.lit("")), F.lit("\n[FIN PÁGINA "), number, F.lit("]")
    )
    last = F.col("page_number").isNull().alias("last")
    part = F.floor(F.col("page_number") / PART_PAGES).alias("part")
    parts = page_rows.select(*key, last, part, F.struct("page_number", shown.alias("text")).alias("page"))
    joined = lambda rows: F.array_join(F.transform(F.sort_array(F.collect_list(rows)), lambda r: r["text"]), "\n\n")
    parts = parts.groupBy(*key, "last", "part").agg(joined("page").alias("text"), F.count(F.lit(1)).alias("n"))
    whole = parts.groupBy(*key).agg(joined(F.struct("last", "part", "text")).alias("text"), F.sum("n").alias("n_pages"))
    return whole.select(*key, "n_pages", "text")


PROMPT = (
    "Read the invoice text below and answer with one JSON object of this type:\n{schema}\n"
    "Use only what the text states. Text:\n"
)


def prompts(df: DataFrame, schema: str, template: str = PROMPT) -> DataFrame:
    """One request per document: instructions, target type, text (shortened in the middle)."""
    return df.select(
        "doc_id",
        F.concat(F.lit(template.replace("{schema}", schema)), truncate_middle(F.col("text"))).alias("prompt"),
    )
