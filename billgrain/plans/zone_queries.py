"""Queries over OCR text items."""

from __future__ import annotations

from pyspark.sql import functions as F

from billgrain.functions import ocr_input
from billgrain.operators import zones
from billgrain.plans import texts


def zone_signals(spark, sf_dir):
    return zones.with_signals(texts.ocr_items(spark, sf_dir)).select("src", "doc_id", "pos", "signals.*")


def item_geometry(spark, sf_dir):
    return zones.with_geometry(texts.ocr_items(spark, sf_dir)).select("src", "doc_id", "pos", "geo.*")


def zone_classify(spark, sf_dir):
    items = texts.ocr_items(spark, sf_dir).withColumn(
        "region_type",
        F.expr("CASE doc_id % 6 WHEN 0 THEN 'Header' WHEN 1 THEN 'footer' WHEN 2 THEN 'table' ELSE 'text' END"),
    )
    return zones.classified(items, F.col("region_type")).select("src", "doc_id", "pos", "zone")


def reading_order(spark, sf_dir):
    return zones.in_reading_order(texts.ocr_pages(spark, sf_dir))


def zone_text(spark, sf_dir):
    return zones.zone_texts(texts.ocr_pages(spark, sf_dir))


def zone_distribution(spark, sf_dir):
    return zones.distribution(texts.ocr_items(spark, sf_dir))


def party_by_zone(spark, sf_dir):
    return zones.parties(texts.ocr_items(spark, sf_dir))


def confident_text(spark, sf_dir):
    return zones.confident_text(texts.ocr_pages(spark, sf_dir))


def ocr_item_normalise(spark, sf_dir):
    raw = texts.raw_items(spark, sf_dir)
    shaped = ocr_input.items(F.try_parse_json("raw"))
    box = F.array_join(F.transform("i.bbox", lambda n: n.cast("string")), " ")
    return raw.select("doc_id", F.explode(shaped).alias("i")).select(
        "doc_id", "i.pos", "i.text", "i.confidence", box.alias("bbox")
    )


QUERIES = {
    f.__name__: f
    for f in (
        zone_signals, item_geometry, zone_classify, reading_order, zone_text,
        zone_distribution, party_by_zone, confident_text, ocr_item_normalise,
    )
}
