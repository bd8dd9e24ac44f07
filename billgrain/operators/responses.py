"""Model answers: clean, parse, repair, check, and sort into outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billgrain.functions import json_text
from billgrain.functions.pin import pin

# Outcome names.
PARSE_ERROR = "JSON parse error"
SCHEMA_ERROR = "Validation error"
TOO_DEEP = "maximum recursion depth exceeded"
SUCCESS = "success"
METHOD = "paddleocr_gemini_text"


def with_cleaned(df: DataFrame) -> DataFrame:
    return df.withColumn("text", json_text.cleaned(F.col("raw")))


def with_parsed(df: DataFrame) -> DataFrame:
    """Add ``value`` (VARIANT), ``parse`` (parsed, repaired or failed) and the ``problem`` of a failed one.

    Only texts the JVM parser refuses are handed to the Python decoder; all others
    send it a NULL.
    """
    cleaned = pin(df, text=json_text.cleaned(F.col("raw")))
    strict = pin(cleaned, strict=json_text.parse_strict(F.col("text")))
    repaired = strict.withColumn(
        "fix", json_text.repair(F.when(F.col("strict").isNull(), F.col("text")))
    )
    status = F.when(F.col("strict").isNotNull(), "parsed").otherwise(F.col("fix.status"))
    value = F.coalesce("strict", F.try_parse_json("fix.json"))
    return pin(repaired, value=value, parse=status, cut_at=F.col("fix.position"), problem=F.col("fix.problem")).drop("strict", "fix")


def with_outcome(df: DataFrame) -> DataFrame:
    """Add ``violations`` and ``status``; an answer with any violation is rejected whole.

    A number too long to read is a broken value like any other; nesting too deep for the
    decoder is an outcome of its own.
    """
    checked = pin(with_parsed(df), violations=json_text.violations(F.col("value")))
    status = (
        F.when(F.col("value").isNull() & (F.col("problem") == "value"), SCHEMA_ERROR)
        .when(F.col("value").isNull() & (F.col("problem") == "depth"), TOO_DEEP)
        .when(F.col("value").isNull(), PARSE_ERROR)
        .when(F.size("violations") > 0, SCHEMA_ERROR)
        .otherwise(SUCCESS)
    )
    return pin(checked, status=status)


def accepted(outcomes: DataFrame) -> DataFrame:
    """Typed invoices of the accepted answers, with unknown top-level fields kept as JSON."""
    kept = outcomes.filter(F.col("status") == SUCCESS)
    return pin(
        kept,
        invoice=json_text.to_invoice(F.col("value")),
        extra=json_text.unknown_fields(F.col("value")),
    ).drop("value", "text", "raw")


#: What stands for a missing amount of an item.
ITEM_DEFAULTS = {"quantity": 1.0, "unit_price": 0.0, "line_total": 0.0}


def item_amounts(parsed: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per item of each parsed answer (``value``): its number from 0 and its amounts, or their defaults.

    An element that is no object has defaults only; answers without items have no rows, or with
    ``keep_empty`` one row with NULL item columns.
    """
    items = parsed.withColumn("items", F.try_variant_get("value", "$.items", "array<variant>"))
    explode = F.posexplode_outer if keep_empty else F.posexplode
    rows = items.select(*parsed.columns, explode("items").alias("item_no", "_item"))
    given = F.col("item_no").isNotNull()
    amounts = {
        name: F.when(given, F.coalesce(F.try_variant_get("_item", f"$.{name}", "double"), F.lit(default)))
        for name, default in ITEM_DEFAULTS.items()
    }
    return rows.withColumns(amounts).drop("_item")


def failures(outcomes: DataFrame) -> DataFrame:
    """The answers that gave no invoice, and why."""
    failed = outcomes.filter(F.col("status") != SUCCESS)
    return failed.select(
        "doc_id",
        F.lit(False).alias("success"),
        F.col("status").alias("error"),
        F.array_join("violations", ", ").alias("error_detail"),
        F.lit(METHOD).alias("processing_method"),
    )


def status_counts(outcomes: DataFrame, *by: str) -> DataFrame:
    return outcomes.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n_docs"))


def status_rollup(outcomes: DataFrame) -> DataFrame:
    return outcomes.rollup("source", "status").agg(F.count(F.lit(1)).alias("n_docs"))


def results(df: DataFrame, stages: dict[str, Column], model: str | None = None, answer: Column | None = None) -> DataFrame:
    """Processing metadata: flags, model and length of its answer, both validation results, method and stage times."""
    times = [value.alias(name) for name, value in stages.items()]
    length = F.lit(None) if answer is None else F.char_length(answer)

    def shown(issue: Column) -> Column:
        kept = [issue[c].alias(c) for c in ("field", "message", "severity", "expected", "actual")]
        return F.struct(kept[0], issue["issue_type"].alias("type"), *kept[1:])

    return df.withColumn(
        "processing_results",
        F.struct(
            F.lit(True).alias("success"),
            F.lit(model).cast("string").alias("model"),
            length.cast("int").alias("raw_json_length"),
            F.struct(
                "semantic.is_valid", "semantic.errors", "semantic.warnings", "semantic.quality_score"
            ).alias("validation"),
            F.struct("math.is_valid", F.transform("math.issues", shown).alias("issues"), "math.corrections_applied").alias(
                "mathematical_validation"
            ),
            F.coalesce("document_hash", F.lit("N/A for non-PDF files")).alias("document_hash"),
            F.lit(METHOD).alias("processing_method"),
            sum(stages.values(), F.lit(0.0)).alias("total_processing_time"),
            F.struct(*times).alias("performance_breakdown"),
        ),
    )


def envelopes(df: DataFrame, user: str) -> DataFrame:
    """The answer to the caller: invoice, metadata, user and a fresh job id, as JSON with all NULL fields."""
    body = F.struct("invoice", "processing_results", F.lit(user).alias("user"), F.uuid().alias("job_id"))
    return df.select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("response"))


def stage_times(df: DataFrame, stages: list[str]) -> DataFrame:
    """Count, mean and median of every stage over all documents."""
    unpivoted = df.unpivot(["doc_id"], stages, "stage", "seconds")
    return unpivoted.groupBy("stage").agg(
        F.count(F.lit(1)).alias("n_docs"),
        (F.sum((F.col("seconds") * 1000).cast("bigint")) / F.count(F.lit(1)) / 1000).alias("mean_seconds"),
        F.percentile_approx("seconds", 0.5, 10000).alias("median_seconds"),
        F.max("seconds").alias("max_seconds"),
    )
