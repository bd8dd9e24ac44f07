"""Types of the records that move through the jobs."""

from __future__ import annotations

PARTY = (
    "struct<name:string,tax_id:string,"
    "contact:struct<email:string,phone:string,fax:string>,"
    "address:struct<street:string,city:string,state:string,postal_code:string,country:string>>"
)
TAX = "struct<type:string,rate:double,amount:double,taxable_base:double>"
ITEM = "struct<item_id:string,description:string,quantity:double,unit_price:double,line_total:double>"
FINANCIAL = (
    "struct<currency:string,subtotal:double,"
    "discount:struct<description:string,rate:double,amount:double>,"
    f"tax:{TAX},additional_taxes:array<{TAX}>,"
    "withholding:struct<type:string,rate:double,amount:double>,"
    "surcharges:array<struct<description:string,amount:double>>,"
    "total_amount:double,payment:struct<method:string,number:string>>"
)
INVOICE = (
    "struct<metadata:struct<invoice_number:string,issue_date:string,due_date:string,order_number:string>,"
    "notes:string,"
    f"parties:struct<vendor:{PARTY},customer:{PARTY}>,"
    f"financial_details:{FINANCIAL},"
    f"items:array<{ITEM}>,"
    "extensions:variant>"
)
ISSUE = (
    "struct<field:string,issue_type:string,message:string,severity:string,"
    "expected:double,actual:double>"
)
OCR_ITEM = "struct<text:string,confidence:double,bbox:array<double>,pos:int>"
REGION = f"struct<type:string,bbox:array<double>,res_kind:string,html:string,text:string,items:array<{OCR_ITEM}>>"
HTML_TABLE = "struct<headers:array<string>,rows:array<array<string>>>"

# The payment methods an invoice may name.
PAYMENT_METHODS = (
    "BANK_TRANSFER", "BANK_DEPOSIT", "CARD", "CASH", "CHECK", "DIRECT_DEBIT", "OTHER",
)
CURRENCY_CODE = r"^[A-Z]{3}\z"

#: Fields that hold numbers, wherever they stand; no other field has one of these names.
NUMBER_FIELDS = ("subtotal", "rate", "amount", "taxable_base", "total_amount", "quantity", "unit_price", "line_total")


# --- the same record as a checklist, for answers that arrive as JSON ---------------


def _text(required: bool = False, rule: str | None = None) -> dict:
    return {"kind": "text", "required": required, "rule": rule}


def _number(required: bool = False, rule: str | None = None) -> dict:
    return {"kind": "number", "required": required, "rule": rule}


def _object(required: bool, **fields: dict) -> dict:
    return {"kind": "object", "required": required, "fields": fields}


def _list(required: bool, of: dict) -> dict:
    return {"kind": "list", "required": required, "of": of}


def _texts(*names: str) -> dict:
    return {name: _text() for name in names}


_PARTY = _object(
    True,
    name=_text(True),
    tax_id=_text(),
    contact=_object(False, **_texts("email", "phone", "fax")),
    address=_object(False, **_texts("street", "city", "state", "postal_code", "country")),
)
_TAX = _object(
    True, type=_text(True), rate=_number(True), amount=_number(True), taxable_base=_number()
)

MODEL = _object(
    True,
    metadata=_object(False, **_texts("invoice_number", "issue_date", "due_date", "order_number")),
    notes=_text(),
    parties=_object(True, vendor=_PARTY, customer=_PARTY),
    financial_details=_object(
        True,
        currency=_text(rule="currency"),
        subtotal=_number(True),
        discount=_object(False, description=_text(), rate=_number(), amount=_number(True)),
        tax=_TAX,
        additional_taxes=_list(False, _TAX),
        withholding=_object(False, type=_text(True), rate=_number(True), amount=_number(True)),
        surcharges=_list(False, _object(True, description=_text(True), amount=_number(True))),
        total_amount=_number(True),
        payment=_object(False, method=_text(rule="payment"), number=_text()),
    ),
    items=_list(
        True,
        _object(
            True,
            item_id=_text(),
            description=_text(),
            quantity=_number(True, "non-negative"),
            unit_price=_number(True, "non-negative"),
            line_total=_number(True, "non-negative"),
        ),
    ),
    extensions={"kind": "any object", "required": False},
)
