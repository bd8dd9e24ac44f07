"""Queries over admission, result reuse and streams of arrivals."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from billgrain.operators import intake, reuse, validation
from billgrain.plans import corpora, response_queries
from billgrain.session import shared_dir
from billgrain.sources import store
from billgrain.streaming import jobs

TYPES = (*intake.ACCEPTED_TYPES, "text/plain", "application/zip")
NOW = "TIMESTAMP '2024-01-02 12:00:00'"


def _uploads(spark, sf_dir):
    """The given documents as uploads; some have no content."""
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("doc_id") % 11 + 1).cast("int"))
    return corpora.table(spark, sf_dir, "documents").select(
        "doc_id",
        kind.alias("content_type"),
        F.encode(F.when(F.col("doc_id") % 23 == 0, "").otherwise(F.col("text")), "UTF-8").alias("content"),
    ).withColumn("length", F.octet_length("content").cast("bigint"))


def _pdfs(spark, sf_dir):
    """All documents as PDFs, with the time they came in (one or two days in 2024) and what was read from them."""
    return corpora.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.sha2("text", 256).alias("hash"),
        F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id % 48 AS int))").alias("came"),
        F.expr("""named_struct(
          'metadata', named_struct('invoice_number', concat('D-', doc_id), 'issue_date', CAST(NULL AS string), 'due_date', CAST(NULL AS string)),
          'notes', CASE WHEN doc_id % 3 = 0 THEN lang END,
          'parties', named_struct('vendor', named_struct('name', source, 'tax_id', CAST(NULL AS string))),
          'financial_details', named_struct('currency', 'EUR', 'total_amount', cast(n_chars AS double) / 100, 'discount', CAST(NULL AS struct<amount:double>)),
          'items', CAST(array() AS array<struct<description:string>>))""").alias("invoice"),
    )


def _store(spark, sf_dir):
    return reuse.entries(_pdfs(spark, sf_dir), F.col("came"))


def _arrivals(events):
    return events.select(
        F.sha2(F.concat(F.col("user_id").cast("string"), F.col("event_type")), 256).alias("hash"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("arrival_id"),
    )


def doc_intake(spark, sf_dir):
    hashed = intake.with_hash(_uploads(spark, sf_dir))
    return hashed.select("doc_id", "content_type", "length", "hash")


def doc_sha256(spark, sf_dir):
    return corpora.table(spark, sf_dir, "documents").select(
        "doc_id", intake.content_hash(F.encode("text", "UTF-8")).alias("hash")
    )


def admit_documents(spark, sf_dir):
    return intake.admit(_uploads(spark, sf_dir), max_bytes=5000).select("doc_id", "reject_reason")


def dedup_exact(spark, sf_dir):
    return reuse.first_of_each(_pdfs(spark, sf_dir), "doc_id")


def _answers(found):
    lists = [F.array_join(c, " | ").alias(c) for c in ("errors", "warnings")]
    return found.select("doc_id", "hash", "invoice", "processing_method", "is_valid", *lists, "quality_score")


def cache_store(spark, sf_dir):
    def shown(c):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)

    kept = _store(spark, sf_dir)
    return kept.select("hash", "invoice", shown("cached_at"), shown("expires_at"), F.col("cached_date").cast("string").alias("cached_date"))


def cache_hits(spark, sf_dir):
    return _answers(reuse.hits(_pdfs(spark, sf_dir), _store(spark, sf_dir), F.expr(NOW)))


def store_lookup(spark, sf_dir):
    """The results of both days written to a stored table, each day on its own, and all documents looked up in it."""
    path, pdfs = f"{shared_dir(spark)}/results/{uuid.uuid4().hex}", _pdfs(spark, sf_dir)
    for day in ("2024-01-02", "2024-01-01"):
        store.append(pdfs.filter(F.to_date("came") == day), path, F.col("came"))
    return _answers(store.lookup(pdfs, path, F.expr(NOW)))


def cache_misses(spark, sf_dir):
    return reuse.misses(_pdfs(spark, sf_dir), _store(spark, sf_dir), F.expr(NOW)).select("doc_id", "hash")


def cache_invalidate(spark, sf_dir):
    store = _store(spark, sf_dir)
    return reuse.invalidation_report(store, store.filter("cached_date < DATE '2024-01-02'"))


def all_results(spark, sf_dir):
    """Hits from the store and freshly processed misses as one table."""
    done = response_queries._processed(spark, sf_dir).select(
        "doc_id", F.col("document_hash").alias("hash"), "semantic.is_valid", "semantic.quality_score",
        F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id % 48 AS int))").alias("came"),
    )
    store = reuse.entries(done, F.col("came"))
    hits = reuse.hits(done, store, F.expr(NOW)).select("doc_id", "processing_method", "is_valid", "quality_score")
    fresh = reuse.misses(done, store, F.expr(NOW)).select(
        "doc_id", F.lit("paddleocr_gemini_text").alias("processing_method"), "is_valid", "quality_score"
    )
    return hits.unionByName(fresh)


def ttl_dedup(spark, sf_dir):
    arrivals = _arrivals(corpora.table(spark, sf_dir, "events"))
    return reuse.with_reuse(arrivals).select("arrival_id", "is_hit")


def cache_stats(spark, sf_dir):
    return reuse.statistics(reuse.with_reuse(_arrivals(corpora.table(spark, sf_dir, "events"))))


def stream_ttl_dedup(spark, sf_dir):
    return jobs.with_reuse(_arrivals(jobs.files(spark, sf_dir, "events.parquet"))).select("arrival_id", "is_hit")


def stream_dedup(spark, sf_dir):
    stream = jobs.without_repeats(_arrivals(jobs.files(spark, sf_dir, "events.parquet")))
    return jobs.result(stream).select("hash")


def stream_validate(spark, sf_dir):
    """The batch rules on a stream of orders: same columns, same findings."""
    orders = jobs.files(spark, sf_dir, "orders.parquet")
    invoices = corpora.invoices_from(orders)
    checked = validation.apply_subtotal(validation.with_arithmetic_check(invoices))
    stream = validation.with_semantic_check(checked).select(
        "doc_id",
        "semantic.is_valid",
        F.array_join("semantic.errors", " | ").alias("errors"),
        F.array_join("semantic.warnings", " | ").alias("warnings"),
        "semantic.quality_score",
    )
    return jobs.result(stream)


def stream_arrival_counts(spark, sf_dir):
    """Hits and misses per hour, from the stored output of the reuse stream."""
    arrivals = _arrivals(jobs.files(spark, sf_dir, "events.parquet"))
    rows = jobs.reuse_rows(arrivals)
    again = spark.readStream.schema(jobs.flagged_schema(arrivals)).parquet(rows)
    return jobs.latest(jobs.hourly_counts(again)).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm"))


QUERIES = {
    f.__name__: f
    for f in (
        doc_intake, doc_sha256, admit_documents, dedup_exact, cache_store, cache_hits, store_lookup, cache_misses,
        cache_invalidate, all_results, ttl_dedup, cache_stats, stream_ttl_dedup, stream_dedup,
        stream_validate, stream_arrival_counts,
    )
}
