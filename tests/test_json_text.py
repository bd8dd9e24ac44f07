"""Cleaning, repair and schema check of model answers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from billgrain.functions import json_text
from billgrain.operators import responses


def column(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in sorted(df.select("i", make(F.col("t"))).collect())]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("```json\n{}\n```", "{}"),
        ("```json\n{}```", "{}```"),
        ("```json {}```", "```json {}```"),
        ("  {} \n", "{}"),
        ("{}\n```", "{}"),
        ("a\n```b\n```", "a\n```b"),
        (" {} ", "{}"),
    ],
)
def test_fence(spark, raw, expected):
    assert column(spark, [raw], json_text.strip_fence) == [expected]


def test_fence_is_idempotent(spark):
    once = column(spark, ["```json\n{}\n```", " x "], json_text.strip_fence)
    assert column(spark, once, json_text.strip_fence) == once


def without_comments(text):
    """Character by character: quotes open and close without escapes, per line."""
    done = []
    for line in text.split("\n"):
        quote, end = None, len(line)
        for i, ch in enumerate(line):
            if quote is None and ch == "#":
                end = i
                break
            if ch in "\"'":
                quote = ch if quote is None else None if ch == quote else quote
        done.append(line[:end].rstrip() if "#" in line else line)
    return "\n".join(done)


def test_comments_like_a_character_loop(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("#\"'\\a \n\r") for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    assert column(spark, texts, json_text.strip_comments) == [without_comments(t) for t in texts]


@pytest.mark.parametrize(
    "text, status, value",
    [
        ('{"a":1}', "parsed", {"a": 1}),
        ('{"a":1} xyz', "repaired", {"a": 1}),
        ('{"a":1}{"b":2}', "repaired", {"a": 1}),
        ('{"a":1}] x', "repaired", {"a": 1}),
        ('{"a":1}} x', "repaired", {"a": 1}),
        ('{"a":1},', "repaired", {"a": 1}),
        ('{"items":[{"a":1},', "repaired", {"items": [{"a": 1}]}),
        ('{"items":[{"a":1},{"a":2', "failed", None),
        ('{"a":"x[","b":[1,', "failed", None),
        ('{"a":1,"a":2}', "parsed", {"a": 2}),
        ('{"a":NaN}', "parsed", {"a": "nan"}),
        ("", "failed", None),
        ('{"a":"ñ€"}', "parsed", {"a": "ñ€"}),
    ],
)
def test_parse_and_repair(spark, text, status, value):
    df = spark.createDataFrame([(text,)], "raw string")
    row = responses.with_parsed(df).select("parse", F.to_json("value").alias("v")).first()
    assert row.parse == status
    assert (None if row.v is None else json.loads(row.v)) == value


GOOD = {
    "parties": {"vendor": {"name": ""}, "customer": {"name": "b"}},
    "financial_details": {"subtotal": 1, "tax": {"type": "IVA", "rate": 21, "amount": 0}, "total_amount": 1},
    "items": [],
}


def changed(**paths):
    answer = json.loads(json.dumps(GOOD))
    for path, value in paths.items():
        *way, last = path.split("__")
        place = answer
        for step in way:
            place = place[step]
        if value is KeyError:
            del place[last]
        else:
            place[last] = value
    return json.dumps(answer)


ITEM = {"quantity": 1, "unit_price": 1, "line_total": 1}
F_ = "financial_details__"


ANSWERS = [
    (changed(), []),
    (changed(parties__customer=None), ["parties.customer: type"]),
    (changed(parties__vendor__name=KeyError), ["parties.vendor.name: missing"]),
    (changed(parties__vendor__name=5), ["parties.vendor.name: type"]),
    (changed(**{F_ + "subtotal": "1.5"}), []),
    (changed(**{F_ + "subtotal": " 1_0.5e1 "}), []),
    (changed(**{F_ + "subtotal": "12,5"}), ["financial_details.subtotal: type"]),
    (changed(**{F_ + "subtotal": "1.5d"}), ["financial_details.subtotal: type"]),
    (changed(**{F_ + "subtotal": True}), []),
    (changed(**{F_ + "subtotal": None}), ["financial_details.subtotal: type"]),
    (changed(**{F_ + "subtotal": "NaN"}), []),
    (changed(**{F_ + "currency": None}), []),
    (changed(**{F_ + "currency": "eur"}), ["financial_details.currency: pattern"]),
    (changed(**{F_ + "currency": "EUR\n"}), ["financial_details.currency: pattern"]),
    (changed(**{F_ + "payment": {"method": "BARTER"}}), ["financial_details.payment.method: enum"]),
    (changed(**{F_ + "additional_taxes": [{"type": "x", "rate": 1}]}), ["financial_details.additional_taxes[0].amount: missing"]),
    (changed(items=None), ["items: type"]),
    (changed(items=KeyError), ["items: missing"]),
    (changed(items=[ITEM, {**ITEM, "quantity": -1}]), ["items[1].quantity: negative"]),
    (changed(items=[{**ITEM, "unit_price": "nan"}]), ["items[0].unit_price: negative"]),
    (changed(items=[{**ITEM, "line_total": "inf"}]), []),
    (changed(items=[5]), ["items[0]: type"]),
    (changed(extensions=[1]), ["extensions: type"]),
    ("[1]", [": type"]),
]


def test_schema(spark):
    found = column(spark, [answer for answer, _ in ANSWERS], lambda t: json_text.violations(F.parse_json(t)))
    for (answer, codes), got in zip(ANSWERS, found):
        assert got == codes, answer


def test_typed_invoice_and_unknown_fields(spark):
    answer = changed(**{F_ + "subtotal": "1.5", "origin": {"x": 1}, "items": [{**ITEM, "odd": 1}]})
    value = F.parse_json("t")
    row = spark.createDataFrame([(answer,)], "t string").select(json_text.to_invoice(value), json_text.unknown_fields(value)).first()
    assert row[0].financial_details.subtotal == 1.5 and row[0]["items"][0].quantity == 1.0
    assert json.loads(row[1]) == {"origin": {"x": 1}}


def test_one_bad_row_does_not_end_the_job(spark):
    texts = ['{"a": ' + "9" * 5000 + "}", "[" * 100_000 + "NaN", '{"a": NaN, "b": "\\ud800"}', '{"a": NaN}']
    table = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.r for r in table.select("id", json_text.repair(F.col("t")).alias("r")).collect()}
    assert [got[k].status for k in range(4)] == ["failed", "failed", "parsed", "parsed"]
    assert json.loads(got[2].json)["b"] == "\ud800"


def test_numbers_with_marks_between_digits_are_kept(spark):
    answer = changed(**{
        F_ + "subtotal": "1_000", F_ + "total_amount": " 1_2_3.50 ", "notes": "2_0", "extensions": {"rate": "1_0"}, "items": [{**ITEM, "quantity": "1_0", "description": '"rate":"1_0"'}],
    })
    table = spark.createDataFrame([(1, answer)], "doc_id int, raw string")
    outcome = responses.with_outcome(table)
    row = responses.accepted(outcome).select("invoice", F.to_json("invoice.extensions").alias("open")).first()
    assert row.invoice.financial_details.subtotal == 1000.0 and row.invoice.financial_details.total_amount == 123.5
    assert row.invoice["items"][0].quantity == 10.0 and row.invoice["items"][0].description == '"rate":"1_0"'
    assert row.invoice.notes == "2_0" and json.loads(row.open) == {"rate": "1_0"}


def test_four_outcomes(spark):
    raw = {1: changed(), 2: "no json", 3: changed(notes=[1]), 4: '{"a": ' + "9" * 5000 + "}", 5: "[" * 100_000}
    outcome = responses.with_outcome(spark.createDataFrame(list(raw.items()), "doc_id int, raw string"))
    got = {r.doc_id: r.status for r in outcome.collect()}
    assert got == {1: responses.SUCCESS, 2: responses.PARSE_ERROR, 3: responses.SCHEMA_ERROR, 4: responses.SCHEMA_ERROR, 5: responses.TOO_DEEP}


def test_defaults_of_all_items(spark):
    raw = {1: '{"items":[{"quantity":2,"unit_price":"3.5"},{},7,{"line_total":null,"unit_price":1}]}', 2: '{"items":{}}', 3: "{}", 4: "x", 5: '{"items":[]}'}
    parsed = responses.with_parsed(spark.createDataFrame([*raw.items(), (6, None)], "doc_id int, raw string"))
    got = sorted(tuple(r) for r in responses.item_amounts(parsed).select("doc_id", "item_no", "quantity", "unit_price", "line_total").collect())
    assert got == [(1, 0, 2.0, 3.5, 0.0), (1, 1, 1.0, 0.0, 0.0), (1, 2, 1.0, 0.0, 0.0), (1, 3, 1.0, 1.0, 0.0)]
    kept = sorted((r.doc_id, r.item_no is None, r.quantity) for r in responses.item_amounts(parsed, keep_empty=True).collect())
    assert kept == [(1, False, 1.0), (1, False, 1.0), (1, False, 1.0), (1, False, 2.0), *((i, True, None) for i in range(2, 7))]
