"""Queries over HTML tables and pages with regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from billgrain.functions import html, pages as page_text, schema
from billgrain.functions.text import truncate_middle as shorten
from billgrain.operators import pages, tables
from billgrain.plans import texts


def html_rows(spark, sf_dir):
    ours = tables.rows(texts.html_tables(spark, sf_dir), "doc_id").withColumn("src", F.lit("inv"))
    web = texts.web_pages(spark, sf_dir).withColumnRenamed("page_id", "doc_id")
    given = tables.rows(web, "doc_id", row_tag="ul", cell_tags="li", header_tag="dt").withColumn("src", F.lit("web"))
    return ours.unionByName(given).select(
        "src", "doc_id", "row_no", "n_cells", F.array_join("cells", " ¦ ").alias("cells")
    )


def html_table_text(spark, sf_dir):
    df = tables.with_rows(texts.html_tables(spark, sf_dir))
    return df.select("doc_id", html.table_text(F.col("cells")).alias("text"), html.malformed(F.col("html")).alias("malformed"))


def html_entity_text(spark, sf_dir):
    df = tables.with_rows(texts.html_tables(spark, sf_dir))
    return df.select("doc_id", html.entity_text(F.col("html"), F.col("cells")).alias("text"))


def html_table_struct(spark, sf_dir):
    df = tables.with_structure(texts.html_tables(spark, sf_dir))
    return df.select(
        "doc_id",
        F.array_join("table.headers", " ¦ ").alias("headers"),
        F.size("table.rows").alias("n_rows"),
        F.array_join(F.transform("table.rows", lambda r: F.array_join(r, " ¦ ")), "\n").alias("rows"),
    )


def table_to_toon(spark, sf_dir):
    return tables.compact(texts.html_tables(spark, sf_dir))


def table_type(spark, sf_dir):
    return tables.kinds(texts.html_tables(spark, sf_dir)).select(
        "doc_id", "structure_type", "hint", F.array_join("headers", " ¦ ").alias("headers"), "row_count"
    )


def cell_party_split(spark, sf_dir):
    return tables.cell_parties(texts.html_tables(spark, sf_dir))


def expense_rows(spark, sf_dir):
    return tables.category_items(texts.html_tables(spark, sf_dir))


def strip_tags(spark, sf_dir):
    ours = texts.html_tables(spark, sf_dir).select(F.lit("inv").alias("src"), "doc_id", "html")
    given = texts.web_pages(spark, sf_dir).select(F.lit("web").alias("src"), F.col("page_id").alias("doc_id"), "html")
    return ours.unionByName(given).select("src", "doc_id", html.strip_tags(F.col("html")).alias("text"))


def region_scan(spark, sf_dir):
    return pages.scan_regions(texts.region_pages(spark, sf_dir)).select(
        "doc_id", "page_number", "region_idx", "type", F.size("bbox").alias("bbox_size"), "res_kind", "n_items"
    )


def full_page_tables(spark, sf_dir):
    scanned = pages.scan_regions(texts.region_pages(spark, sf_dir)).filter("type = 'table'")
    return scanned.select(
        "doc_id", "region_idx", page_text.is_full_page(F.col("bbox"), F.col("width")).alias("is_full_page")
    )


def table_numbering(spark, sf_dir):
    return pages.numbered_tables(texts.region_pages(spark, sf_dir))


def region_route(spark, sf_dir):
    df = texts.region_pages(spark, sf_dir)
    routed = page_text.routed(F.col("regions"), F.col("page_number"), F.col("height"), F.col("width"))
    return df.select("doc_id", "page_number", routed.alias("r")).select("doc_id", "page_number", "r.*")


def region_fallback_text(spark, sf_dir):
    return texts.region_pages(spark, sf_dir).select(
        "doc_id", page_text.fallback_text(F.col("regions"), F.col("page_number")).alias("text")
    )


def adaptive_mode(spark, sf_dir):
    return pages.adaptive(texts.region_pages(spark, sf_dir), texts.table_mode_pages(spark, sf_dir))


def doc_ocr_summary(spark, sf_dir):
    results = pages.page_results(texts.region_pages(spark, sf_dir), "layout")
    return pages.document_summary(results.withColumn("doc_id", F.expr("doc_id div 3")))


def page_assembly(spark, sf_dir):
    numbered = F.transform(
        F.split("text", "\n"), lambda t, i: F.struct((i + 1).alias("page_number"), t.alias("text"))
    )
    return pages.assemble(texts.documents(spark, sf_dir).select("doc_id", numbered.alias("pages")))


def _documents_of_pages(spark, sf_dir):
    """Every three pages of a source form a document; items come as rows, in no order."""
    items = texts.ocr_items(spark, sf_dir).select(
        "src", F.expr("doc_id div 3").alias("doc_id"), F.expr("cast(doc_id % 3 + 1 AS int)").alias("page_number"), "pos", "text", "confidence"
    )
    return pages.assemble_rows(pages.page_texts(items, 0.5, "src", "doc_id"), "src", "doc_id")


def document_pages(spark, sf_dir):
    return _documents_of_pages(spark, sf_dir)


def document_requests(spark, sf_dir):
    documents = _documents_of_pages(spark, sf_dir)
    named = documents.select(F.concat_ws("-", "src", "doc_id").alias("doc_id"), "text")
    return pages.prompts(named, schema.INVOICE)


def prompt_rows(spark, sf_dir):
    return pages.prompts(texts.documents(spark, sf_dir), schema.INVOICE)


def truncate_middle(spark, sf_dir):
    return texts.documents(spark, sf_dir).select(
        "doc_id", shorten(F.col("text"), limit=1500, head=1000, tail=500).alias("text")
    )


QUERIES = {
    f.__name__: f
    for f in (
        html_rows, html_table_text, html_entity_text, html_table_struct, table_to_toon, table_type,
        cell_party_split, expense_rows, strip_tags, region_scan, full_page_tables, table_numbering,
        region_route, region_fallback_text, adaptive_mode, doc_ocr_summary, page_assembly,
        document_pages, document_requests, prompt_rows, truncate_middle,
    )
}
