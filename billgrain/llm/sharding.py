"""Contiguous shards of nearly equal bytes from global prefix sums.

All rows stand in one order: by the digest of the text, then by id, so that equal texts are
neighbours. Totals per range of digests give each range its first byte and first row; inside
a range, prefix sums over its texts give each text its place; copies of one text have equal
sizes, so a copy's place is its text's place plus its number times the size. The order is cut
at equal targets. No step sorts all rows and no group of copies meets in one task: copies are
numbered in salted parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billgrain.llm.common import stored, text_of

#: Hex digits of a digest that name its range: at most 4096 ranges at every size.
RANGE_DIGITS = 3
#: Hex digits of an id's digest that name the part in which a copy is numbered: 256 parts.
SALT_DIGITS = 2


def byte_shards(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", whole_share: float = 0.01
) -> DataFrame:
    """``id, size, text_crc32, shard, slot`` for each row; size is the UTF-8 bytes plus one.

    Copies of a text stay in one shard as long as together they hold at most ``whole_share`` of
    a shard's target; larger groups are cut like everything else, so that sizes stay near equal.
    Null texts count as empty, a null id sorts first, rows equal in id and text are
    interchangeable. An empty table gives no rows; other columns are not read.
    """
    text = text_of(text_col)
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("crc"),
            F.md5(text).alias("digest"),
        ).withColumn("salt", F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, SALT_DIGITS))
    )
    parts = rows.groupBy("digest", "salt").agg(F.count("*").alias("n"), F.first("size").alias("bytes_each"))
    by_text = Window.partitionBy("digest")
    parts = parts.select(
        "digest",
        "salt",
        "bytes_each",
        F.coalesce(F.sum("n").over(by_text.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("copies_before"),
        F.sum("n").over(by_text).alias("copies"),
        F.substring("digest", 1, RANGE_DIGITS).alias("range"),
        F.row_number().over(by_text.orderBy("salt")).alias("part"),
    )
    texts = parts.where("part = 1").select("range", "digest", "copies", (F.col("copies") * F.col("bytes_each")).alias("total"))
    ranges = texts.groupBy("range").agg(F.sum("total").alias("range_bytes"), F.sum("copies").alias("range_rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over at most 4096 totals
    ranges = ranges.select(
        "range",
        F.coalesce(F.sum("range_bytes").over(before), F.lit(0)).alias("byte0"),
        F.coalesce(F.sum("range_rows").over(before), F.lit(0)).alias("row0"),
        F.sum("range_bytes").over(Window.partitionBy(F.lit(0))).alias("all_bytes"),
    )
    inside = Window.partitionBy("range").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    texts = (
        texts.select(
            "range",
            "digest",
            "total",
            F.coalesce(F.sum("total").over(inside), F.lit(0)).alias("byte1"),
            F.coalesce(F.sum("copies").over(inside), F.lit(0)).alias("row1"),
        )
        .join(F.broadcast(ranges), "range")
        .select("digest", "total", "all_bytes", (F.col("byte0") + F.col("byte1")).alias("first_byte"), (F.col("row0") + F.col("row1")).alias("first_row"))
    )
    places = parts.select("digest", "salt", "copies_before").join(texts, "digest")
    number = F.row_number().over(Window.partitionBy("digest", "salt").orderBy("id")) - 1
    copy = F.col("copies_before") + F.col("in_part")
    whole = F.col("total") * shards <= F.col("all_bytes") * F.lit(whole_share)
    start = F.when(whole, F.col("first_byte")).otherwise(F.col("first_byte") + copy * F.col("size"))
    placed = stored(
        rows.withColumn("in_part", number)
        .join(places, ["digest", "salt"])
        .select(
            "id",
            "size",
            "crc",
            F.least(F.lit(shards - 1), F.floor(start.cast("decimal(38,0)") * shards / F.col("all_bytes"))).cast("int").alias("shard"),
            (F.col("first_row") + copy).alias("row"),
        )
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("shard_row"))  # a row per shard
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("row") - F.col("shard_row")).alias("slot")
    )
