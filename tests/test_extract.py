"""Amounts with thousands marks, tax lines, e-mail domains and lines that are no items."""

from pyspark.sql import functions as F

from billgrain.functions import extract
from billgrain.functions.schema import INVOICE


def column(spark, values, rule):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.got for r in df.select("i", rule(F.col("v")).alias("got")).orderBy("i").collect()]


def test_amounts(spark):
    values = ["1.234,56", "1,234.56", "1.234.567", "1,234,567.5", "45,50", "10,000", "45", "", "x", None]
    expected = [1234.56, 1234.56, 1234567.0, 1234567.5, 45.5, 10.0, 45.0, None, None, None]
    assert column(spark, values, extract.number) == expected


def test_tax_lines(spark):
    values = ["IVA 21%: 1.234,56€", "IVA 21% 45,50 €", "IGIC 7%", "VAT (20%): £12.34", "IVA: 21% 45,50", "Potencia 12,50"]
    got = [r and (r.rate, r.amount) for r in column(spark, values, extract.tax_line)]
    assert got == [(21.0, 1234.56), (21.0, 45.5), (7.0, 0.0), (20.0, 12.34), (21.0, 45.5), None]


def test_vendor_from_email(spark):
    values = ["info@acme-corp.com", "a ventas@mail.acme.es.", "x@acme.co.uk y", "no mail", None]
    assert column(spark, values, extract.vendor_from_email) == ["Acme Corp", "Acme", "Acme", None, None]


def test_rows_with_thousands_marks(spark):
    row = column(spark, ["SKU-1 Part 12 2,000 1.500,00 10,00 2.900,00 21,0"], extract.item_row)[0]
    assert (row.description, row.quantity, row.unit_price, row.line_total) == ("Part 12", 2.0, 1500.0, 2900.0)
    discounted = column(spark, ["SKU-1 Part 1,000 10,00 10,00 9,00 21,0", "SKU-1 Part 2,000 10,00 20,00 21,0", "SKU-1 Part 2,000 15,00 30,00 21,00"], extract.item_row)
    assert [r.line_total for r in discounted] == [9.0, 20.0, 30.0]
    line = column(spark, ["2,5 kW × 30 días × 13,94 €/kW día = 1.045,50 €"], extract.utility_line)[0]
    assert line.line_total == 1045.5


def test_lines_that_are_no_items(spark):
    values = ["IVA 21%: 45,50€", "VAT 20%", "IGIC 7%", "Descuento", "Fees", "Recargos", "Potencia contratada", "Tostadora"]
    assert column(spark, values, extract.is_excluded) == [True] * 6 + [False] * 2


def test_completeness_counts_every_leaf(spark):
    answers = [
        "{}",
        '{"notes":"x","metadata":{"due_date":""},"items":[{"quantity":0},{"quantity":1,"item_id":"a"},null]}',
        '{"financial_details":{"subtotal":0,"tax":{"rate":21},"surcharges":[],"additional_taxes":[{"amount":1},{"rate":2}]}}',
        '{"parties":{"vendor":{"contact":{"email":"a@b.es"}},"customer":null},"extensions":{"a":1}}',
    ]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, raw string")
    inv = F.from_json("raw", INVOICE)
    shares = [r.share for r in df.select("i", extract.completeness(inv).alias("share")).orderBy("i").collect()]
    assert [round(s * 52) for s in shares] == [0, 3, 4, 2]


def test_iso_dates(spark):
    values = ["2024-02-29", "2023-02-29", "2024-2-9", "29/02/2024", "2024-02-29 ", "", None]
    assert column(spark, values, extract.is_iso_date) == [True, False, False, False, False, False, False]
