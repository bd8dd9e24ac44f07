"""Zone rules at their limits."""

import pytest
from pyspark.sql import functions as F

from billgrain.functions import zones
from billgrain.functions.ocr_input import items

PAGE = "1000D AS h, 800D AS w"


CASES = [
    ("Tel 922.272.555", 100, 50, None, "CONTENT"),  # reads as an amount first
    ("Tel 922 272 555 atención", 100, 50, None, "HEADER"),
    ("ñandú@acme.es y más texto", 100, 850, None, "HEADER"),
    ("ñandú@acme.es y más texto", 100, 851, None, "FOOTER"),
    ("total:", 100, 500, None, "CONTENT"),
    ("total: de la cuenta", 100, 50, None, "HEADER"),  # "total:" is not the word "total"
    ("total de la cuenta", 100, 50, None, "CONTENT"),
    ("FACTURAR A nosotros", 100, 900, None, "CUSTOMER"),
    ("algo", 100, 500, "Header", "HEADER"),
    ("algo", 100, 50, "TABLE", "CONTENT"),
    ("algo", 100, 180, None, "CONTENT"),
    ("algo", 100, 179.9, None, "HEADER"),
    ("algo", 100, 850, None, "CONTENT"),
    ("algo", 100, 850.1, None, "FOOTER"),
    ("localidad", 441, 91, None, "CUSTOMER"),  # "local" matches inside a word
    ("localidad", 440, 91, None, "HEADER"),
    ("localidad", 441, 90, None, "HEADER"),
    ("nada aquí", 441, 100, None, "CONTENT"),
    ("B12345678 registro", 500, 200, None, "CUSTOMER"),
    ("ñB12345678", 500, 200, None, "CONTENT"),  # no word boundary before B
]


def test_zone(spark):
    rows = [(t, float(x), float(y), kind, expected) for t, x, y, kind, expected in CASES]
    df = spark.createDataFrame(rows, "t string, x double, y double, k string, expected string")
    column = zones.zone(F.col("t"), F.col("x"), F.col("y"), F.lit(1000.0), F.lit(800.0), F.col("k"))
    for r in df.withColumn("got", column).collect():
        assert r.got == r.expected, r


@pytest.mark.parametrize(
    "text, expected",
    [("12345 y mas texto", True), ("12345 y texto", False), ("  12345 y texto", False), ("   12345 y texto", True), ("", False), ("a123456 y mas texto", False)],
)
def test_postal_code_length_is_unstripped(spark, text, expected):
    assert spark.range(1).select(zones.has_address(F.lit(text))).first()[0] is expected


@pytest.mark.parametrize(
    "text, expected",
    [("", False), ("   ", False), ("12,5 %", True), ("1" * 19 + "€", True), ("x" * 18 + "€1", False), ("a" * 15 + " 9€", True), ("iva " + "x" * 25, True), ("iva " + "x" * 26, False), ("  5  ", True)],
)
def test_numeric_price(spark, text, expected):
    assert spark.range(1).select(zones.is_numeric_price(F.lit(text))).first()[0] is expected


def test_malformed_box_is_content_at_page_centre(spark):
    df = spark.sql(f"SELECT array(named_struct('text', 'Cliente', 'bbox', array(1D), 'pos', 0, 'confidence', 1D)) AS items, {PAGE}")
    item = df.select(zones.zoned_items(F.col("items"), F.col("h"), F.col("w"))).first()[0][0]
    assert (item.zone, item.x_center, item.y_center) == ("CONTENT", 400.0, 500.0)


def test_equal_positions_keep_their_order_and_missing_box_is_header(spark):
    raw = '[{"text":"b"},{"text":"a"},{"text":" "},["x"],[[1,2,3,4],"c"]]'
    df = spark.createDataFrame([(raw,)], "raw string")
    zoned = zones.zoned_items(items(F.parse_json("raw")), F.lit(1000.0), F.lit(800.0))
    got = df.select(zoned, zones.zone_text(zoned)).first()
    assert [i.text for i in got[0]] == ["b", "a", "c"]
    assert got[1] == "[VENDOR_HEADER]\nb\na\nc"
