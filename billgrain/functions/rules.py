"""Arithmetic and completeness rules over one invoice struct, as columns.

Every rule looks at a struct of type ``schema.INVOICE``. Sums over items come from
the struct's own array, so a table of invoices is checked without any shuffle. The
flat layout (one row per line) has the same rules as joins in
``operators.validation``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from billgrain.functions.money import array_sum, exceeds, plain_number, two_decimals
from billgrain.functions.schema import ISSUE
from billgrain.functions.text import missing

# Tolerances and limits of the rules.
ARITHMETIC_TOLERANCE = 0.02
SEMANTIC_TOLERANCE = 0.10
LEGITIMATE_PERCENT = 30
MAX_TAX_RATE = 100
RATE_LIKE_PRICES = (0.0, 3.0, 7.0, 15.0, 21.0)
CRITICAL_SHARE = 0.8
WARNING_SHARE = 0.5
ERROR_COST = 20
WARNING_COST = 5


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _issue(field, kind: str, message: Column, severity: str, expected=None, actual=None) -> Column:
    return F.struct(
        (F.lit(field) if isinstance(field, str) else field).alias("field"),
        F.lit(kind).alias("issue_type"),
        message.alias("message"),
        F.lit(severity).alias("severity"),
        (_none("double") if expected is None else expected).alias("expected"),
        (_none("double") if actual is None else actual).alias("actual"),
    ).cast(ISSUE)


def _kept(*candidates: Column) -> Column:
    """Array of the candidates that are not NULL."""
    return F.filter(F.array(*candidates), lambda c: c.isNotNull())


def _amounts(values: Column) -> Column:
    return F.coalesce(
        F.transform(values, lambda v: v["amount"]), F.array().cast("array<double>")
    )


def item_totals(items: Column) -> Column:
    return F.transform(items, lambda i: i["line_total"])


def items_sum(items: Column) -> Column:
    return array_sum(item_totals(items))


def has_items(items: Column) -> Column:
    return F.coalesce(F.size(items) > 0, F.lit(False))


def subtotal_issue(stated: Column, item_count: Column, total_of_items: Column) -> Column:
    diff = F.abs(total_of_items - stated)
    return F.when(
        F.coalesce(item_count > 0, F.lit(False)) & exceeds(diff, ARITHMETIC_TOLERANCE),
        _issue(
            "financial_details.subtotal",
            "subtotal_mismatch",
            F.concat(
                F.lit("Subtotal mismatch: sum of items is "), two_decimals(total_of_items),
                F.lit(", but subtotal is "), two_decimals(stated),
            ),
            "error",
            total_of_items,
            stated,
        ),
    )


def negative_item_issues(items: Column) -> Column:
    """One error per negative amount, price or quantity, in item order."""
    # The field checked and the code it is reported under.
    checks = (
        ("line_total", "negative_amount"),
        ("unit_price", "negative_price"),
        ("quantity", "negative_quantity"),
    )

    def of_item(item: Column, index: Column) -> Column:
        return _kept(
            *[negative_item_issue(item, index, name, code) for name, code in checks]
        )

    return F.flatten(F.transform(items, of_item))


def negative_item_issue(item: Column, index: Column, name: str, code: str) -> Column:
    value = item[name]
    return F.when(
        value < 0,
        _issue(
            F.concat(F.lit("items["), index.cast("string"), F.lit("]." + name)),
            code,
            F.concat(
                F.lit("Item '"), F.coalesce(item["description"], F.lit("None")),
                F.lit(f"' has negative {name}: "), plain_number(value),
            ),
            "error",
            actual=value,
        ),
    )


def total_issue(fin: Column, subtotal: Column) -> Column:
    """Signed withholding, tight tolerance, only a warning."""
    calculated = (
        subtotal
        + F.coalesce(fin["tax"]["amount"], F.lit(0.0))
        + array_sum(_amounts(fin["additional_taxes"]))
        - F.coalesce(fin["discount"]["amount"], F.lit(0.0))
        + array_sum(_amounts(fin["surcharges"]))
        - F.coalesce(fin["withholding"]["amount"], F.lit(0.0))
    )
    diff = F.abs(calculated - fin["total_amount"])
    return F.when(
        exceeds(diff, ARITHMETIC_TOLERANCE),
        _issue(
            "financial_details.total_amount",
            "total_mismatch",
            F.concat(
                F.lit("Total mismatch: calculated "), two_decimals(calculated),
                F.lit(", stated "), two_decimals(fin["total_amount"]),
                F.lit(" (diff: "), two_decimals(diff), F.lit(")"),
            ),
            "warning",
            calculated,
            fin["total_amount"],
        ),
    )


def reasonableness_issues(fin: Column, subtotal: Column) -> Column:
    rate, discount, total = fin["tax"]["rate"], fin["discount"]["amount"], fin["total_amount"]
    return _kept(
        F.when(
            (rate < 0) | exceeds(rate, MAX_TAX_RATE),
            _issue(
                "financial_details.tax.rate",
                "unreasonable_tax_rate",
                F.concat(
                    F.lit("Tax rate "), plain_number(rate),
                    F.lit("% is outside reasonable range (0-100%)"),
                ),
                "warning",
                actual=rate,
            ),
        ),
        F.when(
            exceeds(discount, subtotal) & ~F.isnan(subtotal),
            _issue(
                "financial_details.discount.amount",
                "excessive_discount",
                F.concat(
                    F.lit("Discount "), plain_number(discount),
                    F.lit(" exceeds subtotal "), plain_number(subtotal),
                ),
                "error",
                subtotal,
                discount,
            ),
        ),
        F.when(
            total < 0,
            _issue(
                "financial_details.total_amount",
                "negative_total",
                F.concat(F.lit("Total amount is negative: "), plain_number(total)),
                "error",
                actual=total,
            ),
        ),
    )


def no_error(issues: Column) -> Column:
    return ~F.exists(issues, lambda i: i["severity"] == "error")


# --- semantic rules -------------------------------------------------------------


def required_field_errors(inv: Column) -> Column:
    fin = inv["financial_details"]
    return _kept(
        F.when(missing(inv["parties"]["vendor"]["name"]), "Vendor name is missing."),
        F.when(missing(inv["parties"]["customer"]["name"]), "Customer name is required"),
        F.when(fin["total_amount"] <= 0, "Total amount must be greater than zero"),
        F.when(~has_items(inv["items"]), "At least one line item is required"),
    )


def data_quality_warnings(inv: Column) -> Column:
    return _kept(
        F.when(missing(inv["metadata"]["issue_date"]), "Invoice date is missing"),
        F.when(missing(inv["parties"]["vendor"]["tax_id"]), "Vendor tax ID is missing"),
        F.when(missing(inv["financial_details"]["currency"]), "Currency is not specified"),
    )


def semantic_total(inv: Column, subtotal: Column) -> Column:
    """Struct with the expected total, the difference and what the rule concludes.

    ``outcome`` is ``ok``, ``excused``, ``error`` or ``unverified``. The last one is
    a warning: the flag lookup cannot be carried out on what the extension holds.
    """
    fin = inv["financial_details"]
    total = fin["total_amount"]

    def add_all(start: Column, values: Column) -> Column:
        return F.aggregate(_amounts(values), start, lambda acc, v: acc + v)

    expected = subtotal - F.coalesce(fin["discount"]["amount"], F.lit(0.0)) + fin["tax"]["amount"]
    expected = add_all(expected, fin["additional_taxes"])
    expected = expected - F.abs(F.coalesce(fin["withholding"]["amount"], F.lit(0.0)))
    expected = add_all(expected, fin["surcharges"])
    diff = F.abs(expected - total)
    percent = F.when(total > 0, F.try_divide(diff, total) * 100).otherwise(0.0)
    items_match = F.coalesce(
        F.abs(F.coalesce(items_sum(inv["items"]), F.lit(0.0)) - subtotal) <= SEMANTIC_TOLERANCE,
        F.lit(False),
    )
    flag = regularisation(inv["extensions"])
    outcome = (
        F.when(~exceeds(diff, SEMANTIC_TOLERANCE), "ok")
        .when(flag == "unreadable", "unverified")
        .when((flag == "yes") | (items_match & (percent < LEGITIMATE_PERCENT)), "excused")
        .otherwise("error")
    )
    return F.struct(
        expected.alias("expected"),
        total.alias("actual"),
        diff.alias("difference"),
        percent.alias("percent"),
        outcome.alias("outcome"),
    )


def regularisation(extensions: Column) -> Column:
    """``yes``, ``no`` or ``unreadable`` for the multi-period regularisation flag."""
    period = F.try_variant_get(extensions, "$.multi_period_invoice", "variant")
    flag = F.try_variant_get(period, "$.has_regularizations", "variant")
    as_text = F.to_json(flag)
    falsy = (
        flag.isNull()
        | as_text.isin("null", "false", '""', "[]", "{}")
        | F.coalesce(
            (~F.startswith(as_text, F.lit('"'))) & (as_text.try_cast("double") == 0), F.lit(False)
        )
    )
    return (
        F.when(~F.startswith(F.schema_of_variant(extensions), F.lit("OBJECT")), "no")
        .when(period.isNull(), "no")
        .when(~F.startswith(F.schema_of_variant(period), F.lit("OBJECT")), "unreadable")
        .when(falsy, "no")
        .otherwise("yes")
    )


def semantic_message(check: Column) -> Column:
    return F.concat(
        F.lit("Math error: expected "), two_decimals(check["expected"]),
        F.lit(" ≠ actual "), two_decimals(check["actual"]),
        F.lit(" (difference: "), two_decimals(check["difference"]),
        F.lit(", "), F.format_string("%.1f", check["percent"]), F.lit("%)"),
    )


def semantic_total_error(check: Column) -> Column:
    return F.when(check["outcome"] == "error", semantic_message(check))


def semantic_total_warning(check: Column) -> Column:
    return F.when(
        check["outcome"] == "unverified",
        F.lit("Could not verify mathematical consistency: unreadable multi-period extension"),
    )


def raw_score(error_count: Column, warning_count: Column) -> Column:
    """Not floored: it may go below zero while findings are added."""
    return F.lit(100.0) - ERROR_COST * error_count - WARNING_COST * warning_count


def quality_score(error_count: Column, warning_count: Column) -> Column:
    return F.greatest(F.lit(0.0), raw_score(error_count, warning_count))


def suspicion_level(matching: Column, item_count: Column) -> Column:
    share = F.try_divide(matching.cast("double"), item_count.cast("double"))
    return (
        F.when(share > CRITICAL_SHARE, "critical")
        .when(share > WARNING_SHARE, "warning")
        .otherwise("none")
    )


def is_rate_like(price: Column) -> Column:
    return price.isin(*RATE_LIKE_PRICES)
