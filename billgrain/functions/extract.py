"""Extraction rules over text lines: dates, currency, payment, taxes, item rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from billgrain.functions.pin import let
from billgrain.functions.repairs import in_window
from billgrain.functions.schema import MODEL
from billgrain.functions.text import SPACE as S, WORD_END, WORD_START, strip

DATE = rf"({WORD_START}[0-9]{{1,2}})(?: de |\.|/)([0-9]{{1,2}})(?: de |\.|/)([0-9]{{4}}){WORD_END}"

# Currency signs and the codes recognised as they are.
SIGNS = {"€": "EUR", "$": "USD", "£": "GBP", "¥": "JPY", "₹": "INR"}
CODES = ("EUR", "USD", "GBP", "CAD", "AUD", "INR", "JPY")

# Payment words per method, in order of precedence.
PAYMENT_WORDS = {
    "BANK_TRANSFER": ("Bank Transfer", "Wire", "Transferencia", "Überweisung"),
    "CARD": ("Card", "Tarjeta", "Credit Card", "Karte"),
    "CASH": ("Cash", "Efectivo", "Bar"),
    "CHECK": ("Check", "Cheque"),
    "DIRECT_DEBIT": ("Direct Debit", "Domiciliación", "Domiciliacion Bancaria"),
}
# Words that mark a tax line, and lines that are no goods or services.
TAX_WORDS = ("Tax", "VAT", "IVA", "GST", "IGIC", "MwSt", "TVA", "BTW", "MOMS", "Sales Tax", "Impuesto", "Steuer")
NOT_ITEMS = ("Recargo", "Alquiler", "Otros", "Impuesto", "Surcharge", "Rental", "Other", "Fee")
DISCOUNTS = ("Descuento", "Dto", "Discount")

# An amount as printed: digits with decimal and thousands marks.
AMOUNT = "[0-9]+(?:[.,][0-9]+)*"


def _word(words: tuple[str, ...]) -> str:
    return rf"(?iu){WORD_START}(?:{'|'.join(words)}){WORD_END}"


def number(text: Column) -> Column:
    """A printed amount: ``1.234,56``, ``1,234.56``, ``1.234.567``, ``45,50`` or ``45``.

    The last mark is the decimal one, unless the same mark stands there twice or more and no
    other one. A single mark is a decimal mark.
    """
    whole = text.rlike(r"\A[^.,]*([.,])(?:[^.,]*\1)+[^.,]*\z")
    last_only = F.regexp_replace(text, r"[.,](?=.*[.,])", "")
    plain = F.when(whole, F.regexp_replace(text, "[.,]", "")).otherwise(F.replace(last_only, F.lit(","), F.lit(".")))
    return plain.try_cast("double")


def iso_date(text: Column) -> Column:
    """First day-first date of a text as yyyy-MM-dd; NULL if there is none or it is no date."""
    day, month, year = (F.regexp_extract(text, DATE, i) for i in (1, 2, 3))
    parsed = F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-M-d"))
    return F.date_format(parsed, "yyyy-MM-dd")


def currency(text: Column) -> Column:
    """Code of the first known sign in fixed order, else an explicit code."""
    code = F.nullif(F.regexp_extract(text, f"{WORD_START}({'|'.join(CODES)}){WORD_END}", 1), F.lit(""))
    for sign, name in reversed(SIGNS.items()):
        code = F.when(text.contains(sign), name).otherwise(code)
    return code


def payment_method(text: Column) -> Column:
    method = F.lit(None).cast("string")
    for name, wording in reversed(PAYMENT_WORDS.items()):
        method = F.when(text.rlike(_word(wording)), name).otherwise(method)
    return method


def first_found(lines: Column, rule) -> Column:
    """What the rule gives for the first line where it gives anything."""
    return F.get(F.filter(F.transform(lines, rule), lambda v: v.isNotNull()), F.lit(0))


# The label before the top-level domain; second-level ones such as co.uk count as part of that.
EMAIL_DOMAIN = (
    r"[\p{L}\p{N}_.+-]@(?:[\p{L}\p{N}_-]+\.)*?([\p{L}\p{N}_-]+)\.(?:(?:co|com|org|net|gob|gov|ac|edu)\.)?"
    r"[\p{L}\p{N}_]+(?![\p{L}\p{N}_-]|\.[\p{L}\p{N}_])"
)


def vendor_from_email(text: Column) -> Column:
    """Company name from the first e-mail domain: mail.acme-corp.com becomes Acme Corp."""
    domain = F.regexp_extract(text, EMAIL_DOMAIN, 1)
    return F.nullif(F.initcap(F.replace(domain, F.lit("-"), F.lit(" "))), F.lit(""))


def tax_line(line: Column) -> Column:
    """Struct (type, rate, amount) of a tax line, else NULL. Amounts are never computed.

    The amount is the number after a colon, else the last one with a decimal mark; rates aside.
    """
    rate = F.regexp_extract(line, rf"([0-9]+(?:[.,][0-9]+)?){S}*%", 1)
    unrated = F.regexp_replace(line, rf"{AMOUNT}{S}*%", " ")
    named = F.regexp_extract(unrated, rf":{S}*[€$£]?{S}*({AMOUNT})", 1)
    amount = F.when(named != "", named).otherwise(F.regexp_extract(unrated, r"\A.*(?<![0-9.,])([0-9]+(?:[.,][0-9]+)+)", 1))
    name = strip(F.regexp_extract(line, r"\A([^0-9(:%]*)", 1))
    return F.when(
        line.rlike(_word(TAX_WORDS)),
        F.struct(
            name.alias("type"),
            F.coalesce(number(rate), F.lit(0.0)).alias("rate"),
            F.coalesce(number(amount), F.lit(0.0)).alias("amount"),
        ),
    )


def tax_lines(lines: Column) -> Column:
    return F.filter(F.transform(lines, tax_line), lambda t: t.isNotNull())


ITEM_ROW = r"\A([A-Z]+-[0-9]+) (.*?)((?: [0-9]+(?:[.,][0-9]+)+){3,})\z"


def item_row(line: Column) -> Column:
    """Row with more numbers than it needs: the total is the number after a discount rate that explains it, else the first plausible later number."""
    numbers = F.transform(
        F.filter(F.split(F.regexp_extract(line, ITEM_ROW, 3), " "), lambda t: t != ""), number
    )

    def build(n: Column) -> Column:
        quantity, price = F.get(n, F.lit(0)), F.get(n, F.lit(1))
        rest = F.slice(n, F.lit(3), F.greatest(F.size(n) - 2, F.lit(0)))
        later = lambda k: F.slice(rest, F.lit(k), F.greatest(F.size(rest) - k + 1, F.lit(0)))
        # a total before a tax rate can look like a discount before a total: then a third number must follow
        reduced = F.filter(
            F.arrays_zip(rest.alias("rate"), later(2).alias("total"), later(3).alias("more")),
            lambda p: (p["rate"] > 0)
            & (p["rate"] < 100)
            & (F.abs(p["total"] - quantity * price * (1 - p["rate"] / 100)) < 0.01)
            & (p["more"].isNotNull() | ~in_window(p["rate"], quantity * price)),
        )
        plausible = F.filter(rest, lambda c: in_window(c, quantity * price))
        total = F.coalesce(F.get(reduced, F.lit(0))["total"], F.get(plausible, F.lit(0)))
        return F.when(
            F.size(n) > 0,
            F.struct(
                F.regexp_extract(line, ITEM_ROW, 1).alias("item_id"),
                F.regexp_extract(line, ITEM_ROW, 2).alias("description"),
                quantity.alias("quantity"),
                price.alias("unit_price"),
                total.alias("line_total"),
            ),
        )

    return let(numbers, build)


UTILITY = (
    rf"([0-9.,]+){S}*kW{S}*×{S}*([0-9.,]+){S}*días{S}*×{S}*([0-9.,]+){S}*€/kW día{S}*={S}*([0-9.,]+){S}*€"
)


def utility_line(line: Column) -> Column:
    """Power x days x price = total."""
    power, days, price, total = (number(F.regexp_extract(line, UTILITY, i)) for i in (1, 2, 3, 4))
    return F.when(
        line.rlike(UTILITY),
        F.struct((power * days).alias("quantity"), price.alias("unit_price"), total.alias("line_total")),
    )


def is_excluded(line: Column) -> Column:
    """Taxes, discounts, surcharges and fees, in singular or plural, are no items."""
    words = "|".join((*NOT_ITEMS, *TAX_WORDS, *DISCOUNTS))
    return line.rlike(rf"(?iu){WORD_START}(?:{words})(?:e?s)?{WORD_END}")


def fix_digits(text: Column) -> Column:
    """Letters read for digits (O, o, l, I, S, B) inside tokens that are mostly a number.

    A token counts as a number if it holds only digits, such letters and separators, has
    at least as many digits as letters, and starts with a digit or holds a separator.
    """

    def fix(token: Column) -> Column:
        digits = F.length(F.regexp_replace(token, "[^0-9]", ""))
        letters = F.length(F.regexp_replace(token, "[^OolISB]", ""))
        numeric = (
            token.rlike(r"\A[0-9OolISB.,]+\z") & (digits > 0) & (digits >= letters) & token.rlike("\\A[0-9]|[.,]")
        )
        return F.when(numeric, F.translate(token, "OolISB", "001158")).otherwise(token)

    return F.array_join(F.transform(F.split(text, " "), fix), " ")


# --- checks named in the documentation ---------------------------------------------

NIF_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
CIF_LETTERS = "JABCDEFGHI"
TAX_ID = rf"{WORD_START}([0-9]{{8}}[A-Z]|[XYZ][0-9]{{7}}[A-Z]|[A-HJNP-SUVW]-?[0-9]{{7}}-?[0-9A-J]){WORD_END}"


def tax_id(text: Column) -> Column:
    """First Spanish tax id of a text, without hyphens."""
    found = F.replace(F.regexp_extract(text, TAX_ID, 1), F.lit("-"), F.lit(""))
    return F.nullif(found, F.lit(""))


def tax_id_kind(value: Column) -> Column:
    return (
        F.when(value.rlike("^[0-9]"), "NIF").when(value.rlike("^[XYZ]"), "NIE").when(value.isNotNull(), "CIF")
    )


def tax_id_valid(value: Column) -> Column:
    """The public check-letter rules of NIF, NIE and CIF."""

    def personal(digits: Column) -> Column:
        place = (digits.try_cast("bigint") % 23 + 1).cast("int")
        return F.right(value, F.lit(1)) == F.substr(F.lit(NIF_LETTERS), place, F.lit(1))

    body = F.translate(F.left(value, F.lit(8)), "XYZ", "012")

    def digit(i: int) -> Column:
        return F.substr(value, F.lit(i + 1), F.lit(1)).try_cast("int")

    def doubled(i: int) -> Column:
        return F.floor(digit(i) * 2 / 10) + digit(i) * 2 % 10

    total = sum((digit(i) for i in (2, 4, 6)), F.lit(0)) + sum((doubled(i) for i in (1, 3, 5, 7)), F.lit(0))
    control = ((10 - total % 10) % 10).cast("int")
    last = F.right(value, F.lit(1))
    company = (last == control.cast("string")) | (last == F.substr(F.lit(CIF_LETTERS), control + 1, F.lit(1)))
    return F.when(tax_id_kind(value) == "CIF", company).otherwise(personal(body))


INVOICE_WORDS = ("factura", "invoice", "total", "iva", "igic", "vat", "cif", "n.i.f", "forma de pago", "importe")


def invoice_score(text: Column) -> Column:
    lowered = F.lower(text)
    return sum((lowered.contains(w).cast("int") for w in INVOICE_WORDS), F.lit(0))


def _filled_leaves(spec: dict, value: Column) -> list[Column]:
    """For each leaf of the record below ``value``: does it hold anything but an empty text?"""
    if spec["kind"] == "object":
        return [leaf for name, part in spec["fields"].items() for leaf in _filled_leaves(part, value[name])]
    if spec["kind"] == "list":
        def somewhere(i: int) -> Column:
            return F.exists(value, lambda element: _filled_leaves(spec["of"], element)[i])

        return [somewhere(i) for i in range(len(_filled_leaves(spec["of"], value[0])))]
    return [value != "" if spec["kind"] == "text" else value.isNotNull()]


def completeness(inv: Column) -> Column:
    """Share of all leaves of the invoice's type that are filled; a leaf of a list is, where one element fills it."""
    leaves = _filled_leaves(MODEL, inv)
    return sum((F.coalesce(leaf, F.lit(False)).cast("int") for leaf in leaves), F.lit(0)) / len(leaves)


def is_iso_date(text: Column) -> Column:
    """Is it a day of the calendar, written as year-month-day? NULL is not."""
    parsed = F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))
    return F.coalesce(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & parsed.isNotNull(), F.lit(False))
