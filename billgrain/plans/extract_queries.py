"""Queries over extraction rules, page quality and the documented extra checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from billgrain.functions import extract, quality
from billgrain.functions.pin import pin
from billgrain.operators import responses
from billgrain.plans import corpora, response_queries, texts, validation_queries


def _docs(spark, sf_dir):
    return texts.invoice_texts(spark, sf_dir).select(F.col("k").alias("doc_id"), "text_lines", "text")


def _lines(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return docs.select("doc_id", F.posexplode("text_lines").alias("line_no", "line"))


def spanish_dates(spark, sf_dir):
    lines = _lines(spark, sf_dir).filter(F.col("line").rlike(extract.DATE))
    return lines.select("doc_id", "line", extract.iso_date(F.col("line")).alias("iso_date"))


def currency_norm(spark, sf_dir):
    """The currency of every line that names one."""
    found = pin(_lines(spark, sf_dir), currency=extract.currency(F.col("line"))).filter("currency IS NOT NULL")
    return found.select("doc_id", "line_no", "currency")


def payment_method(spark, sf_dir):
    method = extract.first_found(F.col("text_lines"), extract.payment_method)
    return _docs(spark, sf_dir).select("doc_id", method.alias("method"))


def vendor_from_email(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", extract.vendor_from_email(F.col("text")).alias("vendor"))


def tax_lines(spark, sf_dir):
    found = _docs(spark, sf_dir).select(
        "doc_id", F.posexplode(extract.tax_lines(F.col("text_lines"))).alias("seq", "t")
    )
    role = F.when(F.col("seq") == 0, "primary").otherwise("additional")
    return found.select("doc_id", "seq", role.alias("role"), "t.type", "t.rate", "t.amount")


def pattern_c_rows(spark, sf_dir):
    rows = pin(_lines(spark, sf_dir), row=extract.item_row(F.col("line")))
    return rows.filter("row IS NOT NULL").select("doc_id", "row.*")


def utility_lines(spark, sf_dir):
    rows = pin(_lines(spark, sf_dir), row=extract.utility_line(F.col("line")))
    return rows.filter("row IS NOT NULL").select("doc_id", "row.*")


def item_exclusions(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_no", extract.is_excluded(F.col("line")).alias("excluded"))


def null_defaults(spark, sf_dir):
    """Answers as they come, with 0.0 and Unknown where a required value is missing, one row per item.

    An answer without items has one row, with NULL item columns.
    """
    parsed = responses.with_parsed(texts.responses(spark, sf_dir)).filter("value IS NOT NULL")

    def amount(path):
        return F.coalesce(F.try_variant_get("value", path, "double"), F.lit(0.0))

    def text(path):
        return F.coalesce(F.try_variant_get("value", path, "string"), F.lit("Unknown"))

    filled = parsed.select(
        "doc_id",
        "value",
        text("$.parties.customer.name").alias("customer"),
        text("$.financial_details.tax.type").alias("tax_type"),
        amount("$.financial_details.subtotal").alias("subtotal"),
        amount("$.financial_details.total_amount").alias("total"),
    )
    return responses.item_amounts(filled, keep_empty=True).drop("value")


def item_defaults(spark, sf_dir):
    """All items of the answers as they come, with what stands for a missing amount."""
    parsed = responses.with_parsed(texts.responses(spark, sf_dir)).filter("value IS NOT NULL")
    return responses.item_amounts(parsed).select("doc_id", "item_no", "quantity", "unit_price", "line_total")


def ocr_digit_fix(spark, sf_dir):
    """Printed rows with digits misread as letters, and the rows set right again."""
    misread = F.when(
        (F.col("doc_id") + F.col("line_no")) % 3 == 0, F.translate("text", "0158", "OlSB")
    ).otherwise(F.translate("text", "0", "O"))
    return corpora.line_texts(spark, sf_dir).select(
        "doc_id", "line_no", extract.fix_digits(misread).alias("text")
    )


def _page_metrics(spark, sf_dir):
    return corpora.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_quantity") * 6).alias("sharpness"),
        (F.col("l_linenumber") * 13 % 90).cast("double").alias("contrast"),
        (F.col("l_suppkey") % 9 - 4).cast("double").alias("rotation"),
        (F.col("l_partkey") % 60).cast("double").alias("noise"),
    )


def _rated(spark, sf_dir):
    m = {c: F.col(c) for c in ("sharpness", "contrast", "rotation", "noise")}
    scanned = _page_metrics(spark, sf_dir).withColumn(
        "is_scan", quality.is_scan(m["sharpness"], m["contrast"], m["noise"])
    )
    return scanned.withColumn("score", quality.score(**m, scan=F.col("is_scan")))


def page_quality(spark, sf_dir):
    return _rated(spark, sf_dir).withColumn("needs_preparation", F.col("score") < quality.GATE)


def preprocess_plan(spark, sf_dir):
    plan = quality.preparation(*[F.col(c) for c in ("score", "contrast", "rotation", "noise", "is_scan")])
    return (
        _rated(spark, sf_dir).select(F.array_join(plan, ">").alias("plan"))
        .groupBy("plan").agg(F.count(F.lit(1)).alias("n_pages"))
    )


def format_checks(spark, sf_dir):
    inv = corpora.invoices(spark, sf_dir).filter("invoice IS NOT NULL")
    dates, code = F.col("invoice.metadata"), F.col("invoice.financial_details.currency")
    return inv.groupBy(F.coalesce(code, F.lit("none")).alias("currency")).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(extract.is_iso_date(dates["issue_date"])).alias("n_dates"),
        F.count_if(extract.is_iso_date(dates["due_date"])).alias("n_due_dates"),
        F.count_if((dates["due_date"] != "") & ~extract.is_iso_date(dates["due_date"])).alias("n_bad_due_dates"),
        F.count_if(code.rlike(r"^[A-Z]{3}\z")).alias("n_codes"),
    )


def tax_id_check(spark, sf_dir):
    ids = pin(_lines(spark, sf_dir), tax_id=extract.tax_id(F.col("line"))).filter("tax_id IS NOT NULL")
    return ids.select(
        "doc_id", "tax_id", extract.tax_id_kind(F.col("tax_id")).alias("kind"),
        extract.tax_id_valid(F.col("tax_id")).alias("is_valid"),
    )


def completeness(spark, sf_dir):
    inv = corpora.invoices(spark, sf_dir).filter("invoice IS NOT NULL")
    return inv.select("doc_id", extract.completeness(F.col("invoice")).alias("share"))


def is_invoice(spark, sf_dir):
    ours = _docs(spark, sf_dir).select(F.lit("inv").alias("src"), "doc_id", "text")
    given = texts.documents(spark, sf_dir).select(F.lit("doc").alias("src"), "doc_id", "text")
    scored = pin(ours.unionByName(given), score=extract.invoice_score(F.col("text")))
    return scored.select("src", "doc_id", "score", (F.col("score") >= 3).alias("is_invoice"))


def quality_metrics(spark, sf_dir):
    """Success rate of structuring and mean quality of the checked invoices, per model."""
    source = F.concat(F.lit("model"), (F.col("doc_id") % 4).cast("string"))
    outcomes = response_queries._outcomes(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("status") == responses.SUCCESS).alias("n_success")
    )
    scores = validation_queries.invoice_validation(spark, sf_dir).groupBy(source.alias("source")).agg(
        F.sum(F.col("quality_score").cast("bigint")).alias("points")
    )
    return outcomes.join(scores, "source").select(
        "source",
        "n_docs",
        (F.col("n_success").cast("double") / F.col("n_docs")).alias("success_rate"),
        (F.col("points").cast("double") / F.col("n_docs")).alias("mean_score"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        spanish_dates, currency_norm, payment_method, vendor_from_email, tax_lines, pattern_c_rows,
        utility_lines, item_exclusions, null_defaults, item_defaults, ocr_digit_fix, page_quality, preprocess_plan,
        format_checks, tax_id_check, completeness, is_invoice, quality_metrics,
    )
}
