"""OCR output in its several shapes, brought to one schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from billgrain.functions.pin import let
from billgrain.functions.schema import REGION
from billgrain.functions.text import is_blank

NO_BOX = [0.0] * 8


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _numbers(box: Column) -> Column:
    """Four points become eight numbers, two corners stay four."""
    return F.coalesce(
        F.flatten(_get(box, "$", "array<array<double>>")), _get(box, "$", "array<double>")
    )


def item(value: Column, pos: Column) -> Column:
    """Struct (text, confidence, bbox, pos) of one item; NULL for shapes that carry no text."""
    nothing = F.array(*[F.lit(n) for n in NO_BOX])
    region, box = _get(value, "$.text_region", "variant"), _get(value, "$.bbox", "variant")
    has_region = F.coalesce(F.size(_get(region, "$", "array<variant>")) > 0, F.lit(False))
    parts, pair = _get(value, "$", "array<variant>"), _get(value, "$[1]", "array<variant>")
    from_map = F.struct(
        F.coalesce(_get(value, "$.text", "string"), F.lit("")).alias("text"),
        F.coalesce(_get(value, "$.confidence", "double"), F.lit(0.0)).alias("confidence"),
        F.when(has_region, _numbers(region)).when(box.isNull(), nothing).otherwise(_numbers(box)).alias("bbox"),
        pos.cast("int").alias("pos"),
    )
    from_list = F.struct(
        F.coalesce(_get(value, "$[1][0]", "string"), _get(value, "$[1]", "string")).alias("text"),
        F.coalesce(_get(value, "$[1][1]", "double"), F.lit(0.0)).alias("confidence"),
        _numbers(_get(value, "$[0]", "variant")).alias("bbox"),
        pos.cast("int").alias("pos"),
    )
    readable = (F.size(parts) >= 2) & (pair.isNull() | (F.size(pair) > 0))
    return F.when(_get(value, "$", "map<string,variant>").isNotNull(), from_map).when(readable, from_list)


def items(value: Column) -> Column:
    """All items with text, with their place in the input."""
    shaped = F.transform(_get(value, "$", "array<variant>"), item)
    return F.filter(shaped, lambda i: i.isNotNull() & ~is_blank(i["text"]))


def region(value: Column) -> Column:
    """One region: type, box and the result as HTML, text or items by its kind."""
    result = _get(value, "$.res", "variant")

    def shaped(res: Column) -> Column:
        is_map = _get(res, "$", "map<string,variant>").isNotNull()
        is_list = _get(res, "$", "array<variant>").isNotNull()
        is_text = F.schema_of_variant(res) == "STRING"
        return F.struct(
            _get(value, "$.type", "string").alias("type"),
            _get(value, "$.bbox", "array<double>").alias("bbox"),
            F.when(res.isNull() | is_map, "dict").when(is_list, "list").when(is_text, "str").otherwise("other").alias("res_kind"),
            _get(res, "$.html", "string").alias("html"),
            F.when(is_text, _get(res, "$", "string")).otherwise(_get(res, "$.text", "string")).alias("text"),
            items(res).alias("items"),
        ).cast(REGION)

    return let(result, shaped)


def regions(value: Column) -> Column:
    return F.transform(_get(value, "$", "array<variant>"), region)
