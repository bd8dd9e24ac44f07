"""Validation rules on hand-made invoices and at their limits."""

import pytest
from pyspark.sql import functions as F

from billgrain.functions.schema import INVOICE
from billgrain.operators import validation


def invoice(items, subtotal, tax, total, **more):
    fin = {
        "currency": "EUR",
        "subtotal": subtotal,
        "tax": {"type": "IVA", "rate": more.pop("rate", 21.0), "amount": tax},
        "additional_taxes": [],
        "surcharges": [],
        "total_amount": total,
        "payment": {"method": "BANK_TRANSFER"},
    }
    for name in ("discount", "withholding"):
        if name in more:
            fin[name] = {"type": "IRPF", "rate": 15.0, "amount": more.pop(name)}
    if "surcharge" in more:
        fin["surcharges"] = [{"description": "r", "amount": more.pop("surcharge")}]
    vendor, customer = more.pop("vendor", "Empresa Emisora S.L."), more.pop("customer", "Cliente Receptor S.A.")
    return {
        "metadata": {"invoice_number": "2025/001", "issue_date": more.pop("date", "2025-01-15")},
        "parties": {"vendor": {"name": vendor, "tax_id": "B12345678"}, "customer": {"name": customer}},
        "financial_details": fin,
        "items": [
            {"description": f"Item {i}", "quantity": q, "unit_price": p, "line_total": t}
            for i, (q, p, t) in enumerate(items)
        ],
        "ext": more.pop("ext", None),
    }


TWO = [(1.0, 100.0, 100.0), (2.0, 50.0, 100.0)]
ONE = [(1.0, 100.0, 100.0)]
NAN = float("nan")

CASES = {
    "valid": invoice(TWO, 200.0, 42.0, 242.0),
    "one cent off": invoice(TWO, 200.01, 42.0, 242.0),
    "two cents off": invoice(TWO, 200.02, 42.0, 242.0),
    "subtotal": invoice(TWO, 195.0, 42.0, 242.0),
    "total": invoice(ONE, 100.0, 21.0, 150.0),
    "no vendor": invoice(ONE, 100.0, 21.0, 121.0, vendor=""),
    "zero": invoice([(1.0, 0.0, 0.0)], 0.0, 0.0, 0.0),
    "no items": invoice([], 200.0, 42.0, 242.0),
    "nan": invoice(TWO, NAN, 42.0, 242.0),
    "nan item": invoice([(1.0, 1.0, NAN)], 0.0, 0.0, 500.0),
    "endless item": invoice([(1.0, 1.0, float("inf"))], 100.0, 0.0, 100.0),
    "negative": invoice([(-1.0, -2.0, -3.0)], -3.0, 0.0, -3.0),
    "tax rate": invoice(ONE, 100.0, 21.0, 121.0, rate=100.5),
    "tax rate limit": invoice(ONE, 100.0, 21.0, 121.0, rate=100.0),
    "discount": invoice(ONE, 100.0, 21.0, 20.0, discount=101.0),
    "withholding": invoice(ONE, 100.0, 21.0, 136.0, withholding=-15.0),
    "nine cents": invoice(ONE, 100.0, 21.0, 121.09),
    "far total": invoice(ONE, 100.0, 21.0, 500.0),
    "flag": invoice(ONE, 100.0, 21.0, 500.0, ext='{"multi_period_invoice":{"has_regularizations":true}}'),
    "flag text": invoice(ONE, 100.0, 21.0, 500.0, ext='{"multi_period_invoice":{"has_regularizations":"no"}}'),
    "flag zero": invoice(ONE, 100.0, 21.0, 500.0, ext='{"multi_period_invoice":{"has_regularizations":0}}'),
    "flag absent": invoice(ONE, 100.0, 21.0, 500.0, ext='{"other":1}'),
    "flag null": invoice(ONE, 100.0, 21.0, 500.0, ext='{"multi_period_invoice":null}'),
    "flag text period": invoice(ONE, 100.0, 21.0, 500.0, ext='{"multi_period_invoice":"x"}'),
    "negative total": invoice(ONE, 100.0, 21.0, -121.0),
    "none": None,
}


@pytest.fixture(scope="module")
def results(spark):
    import json

    rows = [(name, None if inv is None else json.dumps(inv).replace("NaN", '"NaN"').replace("Infinity", '"Infinity"')) for name, inv in CASES.items()]
    df = spark.createDataFrame(rows, "doc_id string, body string")
    value = F.parse_json("body")
    inv = F.try_variant_get(value, "$", INVOICE)
    ext = F.parse_json(F.try_variant_get(value, "$.ext", "string"))
    df = df.select("doc_id", F.when(F.col("body").isNotNull(), inv.withField("extensions", ext)).alias("invoice"))
    plain = validation.with_arithmetic_check(df, auto_correct=False).select("doc_id", F.col("math").alias("plain_math"))
    done = validation.with_semantic_check(validation.apply_subtotal(validation.with_arithmetic_check(df)))
    quick = validation.with_quick_check(df).select("doc_id", F.col("semantic").alias("quick"))
    return {r.doc_id: r for r in done.join(plain, "doc_id").join(quick, "doc_id").collect()}


def kinds(row, column="math"):
    return [i.issue_type for i in row[column].issues]


def test_valid(results):
    row = results["valid"]
    assert row.math.is_valid and not row.math.issues and row.math.corrections_applied == 0
    assert row.semantic.is_valid and row.semantic.quality_score == 100.0


def test_subtotal_tolerance_is_strict_in_binary(results):
    assert kinds(results["one cent off"]) == []
    # 200.02 - 200.0 is a little more than 0.02 in binary
    assert "subtotal_mismatch" in kinds(results["two cents off"])


def test_subtotal_is_corrected_and_still_an_error(results):
    row = results["subtotal"]
    assert kinds(row) == ["subtotal_mismatch"]
    assert row.invoice.financial_details.subtotal == 200.0
    assert row.math.corrections_applied == 1 and not row.math.is_valid


def test_without_correction_the_total_is_off_too(results):
    row = results["subtotal"]
    assert kinds(row, "plain_math") == ["subtotal_mismatch", "total_mismatch"]
    assert row.plain_math.corrections_applied == 0


def test_total_is_a_warning_and_excused(results):
    row = results["total"]
    assert kinds(row) == ["total_mismatch"] and row.math.issues[0].severity == "warning"
    assert row.math.is_valid and row.semantic.errors == []


@pytest.mark.parametrize(
    "name, part",
    [("no vendor", "Vendor name"), ("zero", "Total amount"), ("no items", "line item"), ("none", "FATAL")],
)
def test_required(results, name, part):
    row = results[name]
    assert any(part in e for e in row.semantic.errors) and not row.semantic.is_valid
    assert any(part in e for e in row.quick.errors)


def test_none_scores_zero(results):
    assert results["none"].semantic.quality_score == 0.0 and results["none"].math is None


def test_nan_never_exceeds(results):
    row = results["nan"]
    assert kinds(row) == [] and row.semantic.errors == []


def test_nan_item_matches_nothing_and_endless_item_is_off(results):
    assert kinds(results["nan item"]) == ["total_mismatch"]
    assert any("Math error" in e for e in results["nan item"].semantic.errors)
    assert kinds(results["endless item"])[0] == "subtotal_mismatch"


def test_flat_sums_carry_nan_and_infinity(spark):
    rows = [(1, 0.1), (1, 0.2), (2, NAN), (2, 1.0), (3, float("inf")), (3, 5.0)]
    lines = spark.createDataFrame(rows, "doc_id int, line_total double").selectExpr(
        "*", "1D AS unit_price", "1D AS quantity"
    )
    sums = {r.doc_id: repr(r.items_sum) for r in validation.line_facts(lines).collect()}
    assert sums == {1: "0.3", 2: "nan", 3: "inf"}


def test_negative_items_in_order(results):
    row = results["negative"]
    assert [i.field for i in row.math.issues][:3] == ["items[0].line_total", "items[0].unit_price", "items[0].quantity"]
    assert kinds(row)[-1] == "negative_total"


def test_reasonableness_limits(results):
    assert "unreasonable_tax_rate" in kinds(results["tax rate"])
    assert kinds(results["tax rate limit"]) == []
    assert "excessive_discount" in kinds(results["discount"])


def test_withholding_sign_differs_between_rules(results):
    # signed: 100 + 21 + 15 = 136 fits; absolute: 106 is 30 off, but under 30 percent
    assert kinds(results["withholding"]) == []
    assert results["withholding"].semantic.errors == []


def test_tolerances_differ(results):
    assert kinds(results["nine cents"]) == ["total_mismatch"]
    assert results["nine cents"].semantic.errors == []


@pytest.mark.parametrize(
    "name, is_error", [("far total", True), ("flag", False), ("flag text", False), ("flag zero", True), ("flag absent", True)]
)
def test_regularisation_flag(results, name, is_error):
    assert any("Math error" in e for e in results[name].semantic.errors) is is_error


@pytest.mark.parametrize("name", ["flag null", "flag text period"])
def test_unreadable_flag_is_a_warning(results, name):
    row = results[name].semantic
    assert row.errors == [] and any("Could not verify" in w for w in row.warnings)


def test_negative_total_is_excused_by_matching_items(results):
    assert not any("Math error" in e for e in results["negative total"].semantic.errors)


def test_score(spark):
    from billgrain.functions.rules import quality_score, raw_score

    df = spark.createDataFrame([(0, 0), (2, 0), (0, 3), (10, 0)], "e int, w int")
    rows = df.select(quality_score(F.col("e"), F.col("w")), raw_score(F.col("e"), F.col("w"))).collect()
    assert [r[0] for r in rows] == [100.0, 60.0, 85.0, 0.0] and rows[3][1] == -100.0


@pytest.mark.parametrize("hits, total, level", [(4, 5, "warning"), (5, 6, "critical"), (1, 2, "none"), (2, 3, "warning"), (0, 0, "none")])
def test_suspicion_limits(spark, hits, total, level):
    from billgrain.functions.rules import suspicion_level

    row = spark.range(1).select(suspicion_level(F.lit(hits), F.lit(total))).first()
    assert row[0] == level


def test_sums_beyond_any_decimal(spark):
    from billgrain.functions import money

    df = spark.createDataFrame([(9e31,), (9e31,)], "v double")
    assert df.agg(money.exact_sum(F.col("v"))).first()[0] == 1.8e32
    assert spark.range(1).select(money.array_sum(F.array(F.lit(9e31), F.lit(9e31)))).first()[0] == 1.8e32
