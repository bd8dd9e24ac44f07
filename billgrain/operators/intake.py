"""Admission of uploaded documents and their content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted types and the size limit in bytes.
ACCEPTED_TYPES = (
    "application/pdf",
    "image/jpeg",
    "image/png",
    "image/jpg",
    "image/webp",
    "image/bmp",
    "image/tiff",
    "image/heic",
    "image/heif",
)
PDF = "application/pdf"
MAX_BYTES = 10 * 1024 * 1024


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def reject_reason(content_type: Column, length: Column, max_bytes: int = MAX_BYTES) -> Column:
    """Type first, then emptiness, then size. NULL means admitted."""
    return (
        F.when(~F.coalesce(content_type.isin(*ACCEPTED_TYPES), F.lit(False)), "unsupported_type")
        .when(length == 0, "empty")
        .when(length > max_bytes, "too_large")
    )


def admit(documents: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add ``reject_reason``; ``length`` is read, never the bytes themselves."""
    return documents.withColumn(
        "reject_reason", reject_reason(F.col("content_type"), F.col("length"), max_bytes)
    )


def with_hash(documents: DataFrame) -> DataFrame:
    """Only PDFs get a hash and so take part in result reuse."""
    return documents.withColumn(
        "hash", F.when(F.col("content_type") == PDF, content_hash(F.col("content")))
    )
