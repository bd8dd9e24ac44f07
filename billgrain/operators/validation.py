"""Validation of invoices: arithmetic, required fields, data quality, score.

Two layouts. *Nested*: one row per invoice struct, checked in place, no shuffle.
*Flat*: one row per line plus one row per header; line facts are pre-aggregated per
document (map-side combine) before they meet the header, so a document with a huge
number of lines never sits in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billgrain.functions import rules
from billgrain.functions.money import exact_sum
from billgrain.functions.pin import explode_found, pin
from billgrain.functions.schema import ISSUE

FATAL = "FATAL: Invoice object is None, indicating a catastrophic failure in parsing."


def with_arithmetic_check(df: DataFrame, auto_correct: bool = True, invoice: str = "invoice") -> DataFrame:
    """Add ``math`` (is_valid, issues, corrections_applied) and the corrected subtotal.

    The subtotal issue comes first, then items, total and reasonableness. Later rules
    see the corrected subtotal. A corrected subtotal still counts as an error.
    """
    inv = F.col(invoice)
    fin = inv["financial_details"]
    summed = df.withColumn("_sum", rules.items_sum(inv["items"]))
    flagged = summed.withColumn(
        "_sub", rules.subtotal_issue(fin["subtotal"], F.size(inv["items"]), F.col("_sum"))
    )
    corrected = (
        F.when(F.col("_sub").isNotNull(), F.col("_sum")).otherwise(fin["subtotal"])
        if auto_correct
        else fin["subtotal"]
    )
    with_subtotal = flagged.withColumn("subtotal", corrected)
    subtotal = F.col("subtotal")
    issues = F.filter(
        F.concat(
            F.array(F.col("_sub")),
            F.coalesce(rules.negative_item_issues(inv["items"]), F.array().cast(f"array<{ISSUE}>")),
            F.array(rules.total_issue(fin, subtotal)),
            rules.reasonableness_issues(fin, subtotal),
        ),
        lambda i: i.isNotNull(),
    )
    corrections = (
        F.when(F.col("_sub").isNotNull(), 1).otherwise(0) if auto_correct else F.lit(0)
    )
    listed = with_subtotal.withColumn("_issues", F.when(inv.isNotNull(), issues))
    math = F.when(
        inv.isNotNull(),
        F.struct(
            rules.no_error(F.col("_issues")).alias("is_valid"),
            F.col("_issues").alias("issues"),
            corrections.alias("corrections_applied"),
        ),
    )
    return pin(listed, math=math, subtotal=subtotal).drop("_sum", "_sub", "_issues")


def apply_subtotal(df: DataFrame, invoice: str = "invoice", subtotal: str = "subtotal") -> DataFrame:
    """Put the corrected subtotal into the invoice struct."""
    inv = F.col(invoice)
    updated = inv.withField("financial_details.subtotal", F.col(subtotal))
    return df.withColumn(invoice, F.when(inv.isNotNull(), updated)).drop(subtotal)


def _fatal_or(inv: Column, otherwise: Column) -> Column:
    return F.when(inv.isNull(), F.array(F.lit(FATAL))).otherwise(otherwise)


def _strings() -> Column:
    return F.array().cast("array<string>")


def with_semantic_check(df: DataFrame, invoice: str = "invoice") -> DataFrame:
    """Add ``semantic``: is_valid, errors, warnings, quality_score (floored at 0)."""
    inv = F.col(invoice)
    checked = df.withColumn(
        "_total", rules.semantic_total(inv, inv["financial_details"]["subtotal"])
    )
    total = F.col("_total")
    errors = F.concat(
        rules.required_field_errors(inv), F.array_compact(F.array(rules.semantic_total_error(total)))
    )
    warnings = F.concat(
        F.array_compact(F.array(rules.semantic_total_warning(total))), rules.data_quality_warnings(inv)
    )
    return _with_result(df=checked, inv=inv, errors=errors, warnings=warnings).drop("_total")


def with_quick_check(df: DataFrame, invoice: str = "invoice") -> DataFrame:
    """Required fields only."""
    inv = F.col(invoice)
    return _with_result(df, inv, rules.required_field_errors(inv), _strings())


def _with_result(df: DataFrame, inv: Column, errors: Column, warnings: Column) -> DataFrame:
    found = df.withColumn("_errors", _fatal_or(inv, errors)).withColumn(
        "_warnings", F.when(inv.isNull(), _strings()).otherwise(warnings)
    )
    errors, warnings = F.col("_errors"), F.col("_warnings")
    score = rules.quality_score(F.size(errors), F.size(warnings))
    semantic = F.struct(
        (F.size(errors) == 0).alias("is_valid"),
        errors.alias("errors"),
        warnings.alias("warnings"),
        F.when(inv.isNull(), F.lit(0.0)).otherwise(score).alias("quality_score"),
    )
    return pin(found, semantic=semantic).drop("_errors", "_warnings")


# --- flat layout ------------------------------------------------------------------


def line_facts(lines: DataFrame) -> DataFrame:
    """What the header rules need to know about the lines of each document."""
    def count_if(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint")

    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        exact_sum(F.col("line_total")).alias("items_sum"),
        count_if(rules.is_rate_like(F.col("unit_price"))).alias("n_rate_like"),
        count_if(F.col("line_total") < 0).alias("n_negative_total"),
        count_if(F.col("unit_price") < 0).alias("n_negative_price"),
        count_if(F.col("quantity") < 0).alias("n_negative_quantity"),
    )


def subtotal_issues(headers: DataFrame, facts: DataFrame) -> DataFrame:
    """Documents whose stated subtotal is not the sum of their lines."""
    joined = headers.join(facts, "doc_id")
    issue = rules.subtotal_issue(F.col("subtotal"), F.col("n_items"), F.col("items_sum"))
    return explode_found(joined, "issue", issue).select("doc_id", "issue.*")


def corrected_subtotals(headers: DataFrame, facts: DataFrame) -> DataFrame:
    """Every document with its stated and corrected subtotal."""
    joined = headers.join(facts, "doc_id", "left")
    issue = rules.subtotal_issue(F.col("subtotal"), F.col("n_items"), F.col("items_sum"))
    wrong = issue.isNotNull()
    return joined.select(
        "doc_id",
        F.col("subtotal").alias("stated"),
        F.when(wrong, F.col("items_sum")).otherwise(F.col("subtotal")).alias("subtotal"),
        F.when(wrong, 1).otherwise(0).alias("corrections_applied"),
    )


def negative_amounts(lines: DataFrame, index: Column) -> DataFrame:
    """One row per negative amount, price or quantity of a line."""
    item = F.struct("description", "quantity", "unit_price", "line_total")
    checks = (
        ("line_total", "negative_amount"),
        ("unit_price", "negative_price"),
        ("quantity", "negative_quantity"),
    )
    found = [rules.negative_item_issue(item, index, name, code) for name, code in checks]
    return explode_found(lines, "issue", *found).select("doc_id", "issue.*")


def price_suspicion(facts: DataFrame) -> DataFrame:
    """Share of lines whose price looks like a tax rate, and how suspicious that is."""
    return facts.select(
        "doc_id",
        "n_items",
        F.col("n_rate_like"),
        rules.suspicion_level(F.col("n_rate_like"), F.col("n_items")).alias("level"),
    )


# --- nested layout: reports -------------------------------------------------------


def issues_only(df: DataFrame, column: str = "math") -> DataFrame:
    """One row per finding, with its position in the list."""
    return df.select("doc_id", F.posexplode(f"{column}.issues").alias("seq", "issue")).select(
        "doc_id", "seq", "issue.*"
    )


def suspicious_samples(df: DataFrame, invoice: str = "invoice") -> DataFrame:
    """The first five items of a critical invoice, then those of them with a rate-like price."""
    items = F.col(invoice)["items"]
    matching = F.size(F.filter(items, lambda i: rules.is_rate_like(i["unit_price"])))
    critical = df.filter(rules.suspicion_level(matching, F.size(items)) == "critical")
    return critical.select(
        "doc_id", F.posexplode(F.slice(items, 1, 5)).alias("index", "item")
    ).filter(rules.is_rate_like(F.col("item.unit_price"))).select(
        "doc_id",
        (F.col("index") + 1).alias("item_no"),
        F.left(F.col("item.description"), F.lit(40)).alias("label"),
        F.col("item.unit_price").alias("unit_price"),
    )
