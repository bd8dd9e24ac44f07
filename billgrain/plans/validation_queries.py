"""Validation queries over the derived invoices and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billgrain.functions import rules
from billgrain.functions.pin import explode_found, pin
from billgrain.operators import validation
from billgrain.plans import corpora


def _text(values: Column | str) -> Column:
    return F.array_join(values, " | ")


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices after arithmetic validation; struct not yet updated."""
    return validation.with_arithmetic_check(corpora.invoices(spark, sf_dir))


def _corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.apply_subtotal(_checked(spark, sf_dir))


def subtotal_issues(spark, sf_dir):
    facts = validation.line_facts(corpora.line_records(spark, sf_dir))
    return validation.subtotal_issues(corpora.line_headers(spark, sf_dir), facts)


def subtotal_corrected(spark, sf_dir):
    facts = validation.line_facts(corpora.line_records(spark, sf_dir))
    return validation.corrected_subtotals(corpora.line_headers(spark, sf_dir), facts)


def negative_amount_issues(spark, sf_dir):
    return validation.negative_amounts(corpora.line_records(spark, sf_dir), F.col("line_no") - 1)


def unit_price_suspicion(spark, sf_dir):
    return validation.price_suspicion(validation.line_facts(corpora.line_records(spark, sf_dir)))


def total_issues(spark, sf_dir):
    df = _checked(spark, sf_dir)
    issue = rules.total_issue(F.col("invoice.financial_details"), F.col("subtotal"))
    return explode_found(df, "issue", issue).select(
        "doc_id", "issue.expected", "issue.actual", "issue.message"
    )


def reasonableness_issues(spark, sf_dir):
    df = _checked(spark, sf_dir)
    found = rules.reasonableness_issues(F.col("invoice.financial_details"), F.col("subtotal"))
    return df.select("doc_id", F.explode(found).alias("issue")).select("doc_id", "issue.*")


def math_findings(spark, sf_dir):
    return validation.issues_only(_checked(spark, sf_dir))


def math_validation(spark, sf_dir):
    return _checked(spark, sf_dir).filter("invoice IS NOT NULL").select(
        "doc_id",
        "math.is_valid",
        F.size("math.issues").cast("bigint").alias("n_issues"),
        F.array_join(F.transform("math.issues", lambda i: i["issue_type"]), ",").alias("issue_types"),
        "math.corrections_applied",
        "subtotal",
    )


def required_field_errors(spark, sf_dir):
    df = corpora.invoices(spark, sf_dir).filter("invoice IS NOT NULL")
    return (
        pin(df, found=rules.required_field_errors(F.col("invoice")))
        .filter(F.size("found") > 0)
        .select("doc_id", F.size("found").alias("n_errors"), _text("found").alias("errors"))
    )


def semantic_total_errors(spark, sf_dir):
    df = _corrected(spark, sf_dir).filter("invoice IS NOT NULL")
    check = rules.semantic_total(F.col("invoice"), F.col("invoice.financial_details.subtotal"))
    return (
        pin(df, check=check)
        .filter("check.outcome <> 'ok'")
        .select(
            "doc_id",
            "check.outcome",
            "check.expected",
            "check.actual",
            rules.semantic_total_error(F.col("check")).alias("message"),
        )
    )


def data_quality_warnings(spark, sf_dir):
    df = corpora.invoices(spark, sf_dir).filter("invoice IS NOT NULL")
    return (
        pin(df, found=rules.data_quality_warnings(F.col("invoice")))
        .filter(F.size("found") > 0)
        .select("doc_id", F.size("found").alias("n_warnings"), _text("found").alias("warnings"))
    )


def invoice_validation(spark, sf_dir):
    return validation.with_semantic_check(_corrected(spark, sf_dir)).select(
        "doc_id",
        "semantic.is_valid",
        _text("semantic.errors").alias("errors"),
        _text("semantic.warnings").alias("warnings"),
        "semantic.quality_score",
    )


def quick_validation(spark, sf_dir):
    return validation.with_quick_check(corpora.invoices(spark, sf_dir)).select(
        "doc_id", "semantic.is_valid", _text("semantic.errors").alias("errors"), "semantic.quality_score"
    )


def quality_score(spark, sf_dir):
    df = validation.with_semantic_check(_corrected(spark, sf_dir))
    return df.groupBy(F.col("semantic.quality_score").alias("quality_score")).agg(
        F.count(F.lit(1)).alias("n_docs")
    )


def suspicious_item_sample(spark, sf_dir):
    return validation.suspicious_samples(corpora.invoices(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        subtotal_issues, subtotal_corrected, negative_amount_issues, unit_price_suspicion,
        total_issues, reasonableness_issues, math_findings, math_validation,
        required_field_errors, semantic_total_errors, data_quality_warnings,
        invoice_validation, quick_validation, quality_score, suspicious_item_sample,
    )
}
