"""Inputs: document files, OCR output, model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billgrain.functions import ocr_input

# Content type by file name ending.
TYPE_BY_ENDING = {
    "pdf": "application/pdf",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "webp": "image/webp",
    "bmp": "image/bmp",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "heic": "image/heic",
    "heif": "image/heif",
    "txt": "text/plain",
}


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Document files with their declared type; files over 2 GiB cannot be read this way."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    types = F.create_map(*[F.lit(x) for pair in TYPE_BY_ENDING.items() for x in pair])
    ending = F.lower(F.substring_index("path", ".", -1))
    return files.select(
        "path", "length", "content", F.coalesce(types[ending], F.lit("application/octet-stream")).alias("content_type")
    )


def pages(spark: SparkSession, path: str) -> DataFrame:
    """OCR output, one JSON object per page: doc_id, page_number, height, width, regions.

    Regions are read as VARIANT because their results come as object, list or text, then
    brought to one schema. Missing page sizes fall back to 1000 x 800.
    """
    raw = spark.read.schema("doc_id bigint, page_number int, height double, width double, regions variant").json(path)
    return raw.select(
        "doc_id",
        "page_number",
        F.coalesce("height", F.lit(1000.0)).alias("height"),
        F.coalesce("width", F.lit(800.0)).alias("width"),
        ocr_input.regions(F.col("regions")).alias("regions"),
    )


def responses(spark: SparkSession, path: str) -> DataFrame:
    """Model answers, one JSON object per document: doc_id, source, raw."""
    return spark.read.schema("doc_id bigint, source string, raw string").json(path)
