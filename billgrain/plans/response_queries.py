"""Queries over model answers, corrections and the whole processing chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from billgrain.functions import json_text
from billgrain.operators import corrections, responses, validation
from billgrain.plans import corpora, texts

STAGES = {
    "ocr_time": "cast(doc_id % 900 + 100 AS double) / 1000",
    "structuring_time": "cast(doc_id % 400 + 50 AS double) / 1000",
    "correction_time": "cast(doc_id % 7 AS double) / 1000",
    "mathematical_validation_time": "cast(doc_id % 5 AS double) / 1000",
    "validation_time": "cast(doc_id % 3 AS double) / 1000",
}


def _outcomes(spark, sf_dir):
    return responses.with_outcome(texts.responses(spark, sf_dir))


def _processed(spark, sf_dir):
    """Text-grounded correction, arithmetic with correction, then the semantic check."""
    chain = corrections.corrected(texts.invoices_with_text(spark, sf_dir).filter("invoice IS NOT NULL"))
    checked = validation.apply_subtotal(validation.with_arithmetic_check(chain))
    return validation.with_semantic_check(checked).withColumn("document_hash", F.sha2("text", 256))


def json_strip_fence(spark, sf_dir):
    return texts.responses(spark, sf_dir).select("doc_id", json_text.strip_fence(F.col("raw")).alias("text"))


def json_strip_comments(spark, sf_dir):
    return responses.with_cleaned(texts.responses(spark, sf_dir)).select("doc_id", "text")


def json_repair(spark, sf_dir):
    return responses.with_parsed(texts.responses(spark, sf_dir)).select("doc_id", "parse")


def schema_violations(spark, sf_dir):
    return _outcomes(spark, sf_dir).filter("value IS NOT NULL").select(
        "doc_id", F.size("violations").alias("n_violations"), F.array_join("violations", ", ").alias("violations")
    )


def ingest_status_counts(spark, sf_dir):
    return responses.status_counts(_outcomes(spark, sf_dir))


def ingest_status_rollup(spark, sf_dir):
    return responses.status_rollup(_outcomes(spark, sf_dir))


def structuring_failures(spark, sf_dir):
    return responses.failures(_outcomes(spark, sf_dir))


def accepted_invoices(spark, sf_dir):
    """Typed fields of the accepted answers."""
    return responses.accepted(_outcomes(spark, sf_dir)).select(
        "doc_id",
        F.col("invoice.metadata.issue_date").alias("issue_date"),
        F.col("invoice.parties.vendor.name").alias("vendor"),
        F.col("invoice.financial_details.subtotal").alias("subtotal"),
        F.col("invoice.financial_details.total_amount").alias("total"),
        F.size("invoice.items").alias("n_items"),
        "extra",
    )


def corrected_invoices(spark, sf_dir):
    df = corrections.corrected(texts.invoices_with_text(spark, sf_dir))
    return df.select("doc_id", "price_suspicion", F.posexplode("invoice.items").alias("item_no", "i")).select(
        "doc_id", "price_suspicion", "item_no", "i.line_total"
    )


def number_tokens(spark, sf_dir):
    ours = texts.invoice_texts(spark, sf_dir).select(F.lit("inv").alias("src"), F.col("k").alias("doc_id"), "text")
    given = texts.documents(spark, sf_dir).select(F.lit("doc").alias("src"), "doc_id", "text")
    return corrections.tokens(ours.unionByName(given), F.lit(0), "src", "doc_id").select(
        "src", "doc_id", "idx", "value"
    )


def line_total_fix(spark, sf_dir):
    printed = corpora.line_texts(spark, sf_dir).withColumnRenamed("line_no", "line_order")
    return corrections.repaired_lines(corpora.line_records(spark, sf_dir), printed)


def invoice_assemble(spark, sf_dir):
    built = corrections.assembled(corpora.line_headers(spark, sf_dir), corpora.line_records(spark, sf_dir))
    return built.select("doc_id", "custkey", "subtotal", "line_no", "description", "quantity", "unit_price", "line_total")


def processing_results(spark, sf_dir):
    times = {name: F.expr(sql) for name, sql in STAGES.items()}
    df = responses.results(_processed(spark, sf_dir), times)
    r = "processing_results"
    return df.select(
        "doc_id",
        f"{r}.success",
        f"{r}.document_hash",
        f"{r}.processing_method",
        F.col(f"{r}.validation.is_valid").alias("is_valid"),
        F.col(f"{r}.validation.quality_score").alias("quality_score"),
        F.col(f"{r}.mathematical_validation.is_valid").alias("math_valid"),
        F.size(f"{r}.mathematical_validation.issues").alias("n_issues"),
        F.round(f"{r}.total_processing_time", 3).alias("total_time"),
    )


def response_envelope(spark, sf_dir):
    times = {name: F.expr(sql) for name, sql in STAGES.items()}
    return responses.envelopes(responses.results(_processed(spark, sf_dir), times), "operator")


def stage_times(spark, sf_dir):
    orders = corpora.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    timed = orders.select("doc_id", *[F.expr(sql).alias(name) for name, sql in STAGES.items()])
    return responses.stage_times(timed, list(STAGES))


QUERIES = {
    f.__name__: f
    for f in (
        json_strip_fence, json_strip_comments, json_repair, schema_violations, ingest_status_counts,
        ingest_status_rollup, structuring_failures, accepted_invoices, corrected_invoices,
        number_tokens, line_total_fix, invoice_assemble, processing_results, response_envelope,
        stage_times,
    )
}
