"""Line total repair: limits, the worked example, and both layouts against brute force."""

import random
import re

from pyspark.sql import functions as F

from billgrain.functions import repairs
from billgrain.operators import corrections


def brute_force(items, numbers):
    fixed = []
    for q, p, t in items:
        best = None
        if q > 0 and p > 0 and abs(t - q * p) / (q * p) > 0.5:
            e = q * p
            near = [
                (abs(c - e), i, c)
                for i, c in enumerate(numbers)
                if 0.5 * e <= c <= 1.05 * e and round(c, 4) not in {round(q, 4), round(p, 4), round(t, 4)}
            ]
            best = min(near)[2] if near else None
        fixed.append(t if best is None else best)
    return fixed


def numbers_of(text):
    return [float(t.replace(",", ".")) for t in re.findall(r"\d+(?:[,.]\d+)?", text)]


def nested(spark, docs):
    rows = [(i, [(f"d{j}", *x) for j, x in enumerate(items)], text) for i, (items, text) in enumerate(docs)]
    df = spark.createDataFrame(
        rows, "doc_id int, items array<struct<description:string,quantity:double,unit_price:double,line_total:double>>, text string"
    )
    numbers = repairs.with_position(repairs.number_tokens(F.col("text")))
    fixed = F.transform(repairs.repaired_items(F.col("items"), numbers), lambda i: i["line_total"])
    return [r[1] for r in sorted(df.select("doc_id", fixed).collect())]


def flat(spark, docs, **limits):
    lines = [(i, j, f"d{j}", *x) for i, (items, _) in enumerate(docs) for j, x in enumerate(items)]
    texts = [(i, n, line) for i, (_, text) in enumerate(docs) for n, line in enumerate(text.split("\n"))]
    lines = spark.createDataFrame(lines, "doc_id int, line_no int, description string, quantity double, unit_price double, line_total double")
    texts = spark.createDataFrame(texts, "doc_id int, line_order int, text string")
    fixed = corrections.repaired_lines(lines, texts, **limits)
    found = {(r.doc_id, r.line_no): r.line_total for r in fixed.collect()}
    return [[found[(i, j)] for j in range(len(items))] for i, (items, _) in enumerate(docs)]


def random_docs(count, size):
    rnd = random.Random(11)
    docs = []
    for _ in range(count):
        items = [
            (float(rnd.randint(0, 5)), rnd.randint(0, 900) / 100, rnd.choice([5.0, 10.0, -3.0, rnd.randint(0, 4000) / 100]))
            for _ in range(rnd.randint(1, size))
        ]
        words = [f"{rnd.randint(0, 4500) / 100:.2f}".replace(".", rnd.choice(",.")) for _ in range(rnd.randint(0, 4 * size))]
        words += [rnd.choice(["7", "x", "1.234,56", "2.00001", "2,00002"]) for _ in range(4)]
        docs.append((items, "\n".join(" ".join(words[i : i + 3]) for i in range(0, len(words), 3))))
    return docs


def test_both_layouts_like_brute_force(spark):
    docs = random_docs(150, 6)
    expected = [brute_force(items, numbers_of(text)) for items, text in docs]
    assert nested(spark, docs) == expected
    assert flat(spark, docs) == expected
    assert flat(spark, docs, many_lines=3, many_chars=60) == expected
    assert flat(spark, docs, many_lines=0, many_chars=0) == expected


def test_one_document_with_nearly_all_rows(spark):
    docs = random_docs(1, 1) + random_docs(1, 1500)[:1]
    rnd = random.Random(2)
    items = [(float(rnd.randint(1, 50)), rnd.randint(1, 9000) / 100, 5.0) for _ in range(3000)]
    text = "\n".join(f"{rnd.randint(1, 450000) / 100:.2f}" for _ in range(6000))
    docs.append((items, text))
    assert flat(spark, docs) == [brute_force(i, numbers_of(t)) for i, t in docs]


def test_worked_example(spark):
    docs = [([(10.0, 2.0, 5.0)], "SKU-001 Widget A 10,000 2,000 5,00 19,00 21,0"), ([(4.0, 12.5, 10.0)], "Widget B 4,000 12,500 10,00 45,00 21,0")]
    assert nested(spark, docs) == [[19.0], [45.0]]


LIMITS = [
    ((2.0, 10.0, 10.0), "20", 10.0),  # off by exactly half: kept
    ((2.0, 10.0, 9.99), "20", 20.0),
    ((2.0, 10.0, 1.0), "10 21", 21.0),  # own price is no candidate; upper limit counts
    ((2.0, 10.0, 1.0), "21,01", 1.0),
    ((2.0, 100.0, 1.0), "100,5 99,9", 100.5),
    ((0.0, 10.0, 5.0), "0", 5.0),
    ((1.0, 0.0, 5.0), "0", 5.0),
    ((2.0, 10.0, 1.0), "", 1.0),
    ((2.0, 10.0, 1.0), "19 21", 19.0),  # equally far: first in the text
    ((2.0, 10.0, 1.0), "21 19", 21.0),
    ((2.0, 617.28, 1.0), "1.234,56", 1.0),  # thousands are read as 1.234 and 56
]


def test_limits(spark):
    docs = [([item], text) for item, text, _ in LIMITS]
    expected = [[value] for *_, value in LIMITS]
    assert nested(spark, docs) == expected
    assert flat(spark, docs) == expected
    assert flat(spark, docs, many_lines=0) == expected


def test_numbers_of_many_digits(spark):
    long = ["1234567890123456", "12345678901234567", "123456789012345678", "9223372036854775808", "99999999999999999999", "9" * 400]
    text = "IBAN 19 " + " ".join(long)
    items = [(2.0, 10.0, 1.0), (1e8, 1.3e8, 1.0), (1e10, 1.0e10, 1.0)]
    docs = [(items, text), (items, "\n".join([text] + [f"{n} 21" for n in range(3000, 12000)]))]
    expected = [brute_force(items, numbers_of(text)) for items, text in docs]
    assert expected[0] == [19.0, 12345678901234567.0, 99999999999999999999.0]
    assert nested(spark, docs) == expected
    assert flat(spark, docs) == expected
    assert flat(spark, docs, many_lines=0, many_chars=0) == expected


def test_assembly_keeps_all_lines_and_empty_invoices(spark):
    lines = spark.range(1, 2501).selectExpr(
        "1 AS doc_id", "cast(id AS int) AS line_no", "'x' AS description", "1D AS quantity", "1D AS unit_price", "1D AS line_total"
    )
    headers = spark.createDataFrame([(1, "h"), (2, "empty")], "doc_id int, name string")
    rows = corrections.assembled(headers, lines).collect()
    assert sorted(r.line_no for r in rows if r.doc_id == 1) == list(range(1, 2501))
    assert [r.line_no for r in rows if r.doc_id == 2] == [None]


def test_null_invoice_stays_null(spark):
    from billgrain.functions.schema import INVOICE

    df = spark.createDataFrame([(1, "5 6")], "doc_id int, text string").withColumn("invoice", F.lit(None).cast(INVOICE))
    assert corrections.corrected(df).first().invoice is None
