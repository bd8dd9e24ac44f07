"""Model answers: from raw text to checked JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billgrain.functions import schema
from billgrain.functions.pin import let
from billgrain.functions.text import SPACE, rstrip, strip

FENCE = "```"


def strip_fence(text: Column) -> Column:
    """Remove a Markdown fence. The closing one goes only where a newline precedes it."""

    def opened(t: Column) -> Column:
        fenced = F.startswith(t, F.lit(FENCE)) & t.contains("\n")
        return let(F.when(fenced, F.substr(t, F.locate("\n", t) + 1)).otherwise(t), closed)

    def closed(body: Column) -> Column:
        fenced = F.endswith(body, F.lit(FENCE)) & body.contains("\n" + FENCE)
        tail = F.length(F.substring_index(body, "\n" + FENCE, -1))
        return strip(F.when(fenced, F.left(body, F.length(body) - tail - 4)).otherwise(body))

    return let(strip(text), opened)


def strip_comments(text: Column) -> Column:
    """Cut ``#`` comments outside quotes, line by line.

    Quotes have no escapes here and do not carry over to the next line. Lines without
    ``#`` stay untouched, others lose trailing white space.
    """
    before_comment = r"""\A((?:[^#"']++|"[^"]*+"|'[^']*+')*+(?:["'][\s\S]*)?)"""

    def clean(line: Column) -> Column:
        return F.when(
            line.contains("#"), rstrip(F.regexp_extract(line, before_comment, 1))
        ).otherwise(line)

    def lines(t: Column) -> Column:
        cleaned_lines = F.array_join(F.transform(F.split(t, "\n"), clean), "\n")
        return F.when(t.contains("#"), cleaned_lines).otherwise(t)

    return let(text, lines)


def cleaned(raw: Column) -> Column:
    return strip_comments(strip_fence(raw))


def parse_strict(text: Column) -> Column:
    """VARIANT of a text that is exactly one JSON value, else NULL.

    The parser stops after the first value. Only a text with nothing behind that value
    stays valid both as the sole element of an array and as the sole member of an object.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    elements = F.try_variant_get(listed, "$", "array<variant>")
    return let(elements, lambda e: F.when((F.size(e) == 1) & member.isNotNull(), F.get(e, F.lit(0))))


REPAIRED = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("json", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("problem", T.StringType()),
    ]
)


def repair(text: Column) -> Column:
    """Close a cut-off JSON text at the decoder's error position, once.

    Gives a struct of status (parsed, repaired or failed), JSON, error position and, for a
    failed one, the problem: ``text`` (no JSON), ``value`` (a number too long to read) or
    ``depth`` (nested too deep). NULL input (the rows that parse as they are) passes through
    untouched. The functions are local so that they travel to the executors by value.
    """

    import re

    SURROGATE = re.compile("[\ud800-\udfff]")

    def finite(value):
        # NaN and infinity are not JSON; as text they still convert to DOUBLE.
        if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
            return str(value)
        if isinstance(value, dict):
            return {k: finite(v) for k, v in value.items()}
        if isinstance(value, list):
            return [finite(v) for v in value]
        return value

    def load(text):
        value = finite(json.loads(text))
        shown = json.dumps(value, ensure_ascii=False, allow_nan=False)
        # a lone surrogate is no text outside of an escape
        return shown if shown.isascii() or not SURROGATE.search(shown) else json.dumps(value, allow_nan=False)

    def problem(error):
        if isinstance(error, RecursionError):
            return "depth"
        return "text" if isinstance(error, json.JSONDecodeError) else "value"

    def attempt(text):
        try:
            return "parsed", load(text), None, None
        except json.JSONDecodeError as error:
            head = text[: error.pos].rstrip()
            braces = head.count("{") - head.count("}")
            brackets = head.count("[") - head.count("]")
            closed = head.removesuffix(",") + "]" * brackets + "}" * braces
            try:
                return "repaired", load(closed), error.pos, None
            except (ValueError, RecursionError) as second:
                return "failed", None, error.pos, problem(second)
        except (ValueError, RecursionError) as error:
            # numbers of thousands of digits, nesting without end: this row fails, not the job
            return "failed", None, None, problem(error)

    def decode(texts: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None, None) if t is None else attempt(t) for t in texts]
        frame = pd.DataFrame(rows, columns=["status", "json", "position", "problem"])
        return frame.astype({"position": "Int32"})

    return F.pandas_udf(decode, REPAIRED)(text)


# --- schema check -----------------------------------------------------------------

NUMERIC_TEXT = (
    rf"(?i)\A{SPACE}*[+-]?(?:(?:[0-9]+(?:_[0-9]+)*\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|nan|inf|infinity){SPACE}*\z"
)


class _Place:
    """Where a value stands, as shown to the reader: a column for list places, then fixed text."""

    def __init__(self, before: Column | None = None, text: str = ""):
        self.before, self.text = before, text

    def field(self, name: str) -> _Place:
        return _Place(self.before, f"{self.text}.{name}" if self.text or self.before is not None else name)

    def element(self, number: Column) -> _Place:
        return _Place(F.concat(self._shown("["), number.cast("string"), F.lit("]")))

    def code(self, problem: str) -> Column:
        return self._shown(f": {problem}")

    def _shown(self, more: str) -> Column:
        fixed = F.lit(self.text + more)
        return fixed if self.before is None else F.concat(self.before, fixed)


def _is_object(root: Column, at: str) -> Column:
    """Asked through a field that no answer has to hold, so nothing of the object is copied."""
    return F.try_variant_get(root, at, "struct<`-`:variant>").isNotNull()


def _check_text(value: Column, place: _Place, rule: str | None) -> Column:
    text = F.try_variant_get(value, "$", "string")
    broken = F.lit(None).cast("string")
    if rule == "currency":
        broken = F.when(~text.rlike(schema.CURRENCY_CODE), place.code("pattern"))
    elif rule == "payment":
        broken = F.when(~text.isin(*schema.PAYMENT_METHODS), place.code("enum"))
    return F.when(F.schema_of_variant(value) != "STRING", place.code("type")).otherwise(broken)


def _check_number(value: Column, place: _Place, rule: str | None) -> Column:
    text = F.try_variant_get(value, "$", "string")
    numeric = let(
        F.schema_of_variant(value),
        lambda kind: F.when(kind == "STRING", text.rlike(NUMERIC_TEXT)).otherwise(
            F.startswith(kind, F.lit("DECIMAL")) | F.startswith(kind, F.lit("BIGINT")) | F.startswith(kind, F.lit("DOUBLE"))
            | F.startswith(kind, F.lit("FLOAT")) | (kind == "BOOLEAN")
        ),
    )
    broken = F.lit(None).cast("string")
    if rule == "non-negative":
        number = F.try_variant_get(value, "$", "double")
        broken = F.when((number < 0) | F.isnan(number), place.code("negative"))
    return F.when(~numeric, place.code("type")).otherwise(broken)


def _fields(root: Column, at: str, place: _Place, fields: dict) -> Column:
    """Array of violation codes (with NULLs) of an object's fields, in their order."""
    parts, run = [], []
    for name, field in fields.items():
        found = _check_field(root, f"{at}.{name}", place.field(name), field)
        if field["kind"] in ("text", "number"):
            run.append(found)
            continue
        parts, run = [*parts, *([F.array(*run)] if run else []), found], []
    return F.concat(*parts, *([F.array(*run)] if run else []))


def _check_field(root: Column, at: str, place: _Place, field: dict) -> Column:
    """One code of a text or a number, an array of codes of anything else.

    Values are read by their whole path from ``root``: taking an object out to look into it
    copies it, once more at each level.
    """
    none = F.array().cast("array<string>")
    value = F.try_variant_get(root, at, "variant")

    def skipped(inner: Column) -> Column:
        return inner.isNull() if field["required"] else inner.isNull() | F.is_variant_null(inner)

    absent = place.code("missing") if field["required"] else F.lit(None).cast("string")
    if field["kind"] in ("text", "number"):
        check = _check_text if field["kind"] == "text" else _check_number
        return let(value, lambda v: F.when(skipped(v), absent).otherwise(check(v, place, field["rule"])))
    other = let(value, lambda v: F.array(F.when(skipped(v), absent).otherwise(place.code("type"))))
    if field["kind"] == "list":

        def of_elements(elements: Column) -> Column:
            found = F.transform(elements, lambda e, i: _check_element(e, place.element(i), field["of"]))
            return F.when(elements.isNull(), other).otherwise(F.coalesce(F.flatten(found), none))

        return let(F.try_variant_get(root, at, "array<variant>"), of_elements)
    inside = none if field["kind"] == "any object" else _fields(root, at, place, field["fields"])
    return F.when(_is_object(root, at), inside).otherwise(other)


def _check_element(value: Column, place: _Place, spec: dict) -> Column:
    """Codes of an object that is the whole value."""
    return F.when(_is_object(value, "$"), _fields(value, "$", place, spec["fields"])).otherwise(F.array(place.code("type")))


def violations(value: Column) -> Column:
    """All broken schema rules of a parsed answer, in field order. NULL stays NULL."""
    codes = F.array_compact(_check_element(value, _Place(), schema.MODEL))
    return F.when(value.isNotNull(), codes)


#: Marks between the digits of a number that is text, where such a number may stand. The look back
#: follows the mark: before it, every place of the answer would look back over all lengths.
_SPACED_NUMBER = rf'_(?=[0-9])(?<="(?:{"|".join(schema.NUMBER_FIELDS)})":"[-+0-9_.eE ]{{0,60}}[0-9]_)'


def to_invoice(value: Column) -> Column:
    """The typed invoice of an answer without violations.

    Texts such as ``1_000`` are numbers to the check, so they have to be numbers here.
    """
    shown = F.to_json(value)
    invoice = F.try_variant_get(value, "$", schema.INVOICE)
    plain = F.try_variant_get(F.try_parse_json(F.regexp_replace(shown, _SPACED_NUMBER, "")), "$", schema.INVOICE)
    # only such answers are written out and read again; what the schema leaves open stays as it was
    return F.when(shown.rlike(_SPACED_NUMBER), plain.withField("extensions", invoice["extensions"])).otherwise(invoice)


def unknown_fields(value: Column) -> Column:
    """Top-level keys outside the schema, as JSON; nested ones are dropped."""
    known = list(schema.MODEL["fields"])
    members = F.try_variant_get(value, "$", "map<string,variant>")
    return F.to_json(F.map_filter(members, lambda k, v: ~k.isin(*known)))
