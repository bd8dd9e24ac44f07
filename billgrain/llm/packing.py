"""Best-fit packing into sequences by minimum bin slack.

A bin takes the longest piece left and the fullest combination of other lengths that its rest
allows, found with a bitset of reachable sums. Pieces of one length are alike, so the search
runs over the histogram of lengths, at most one entry per length: a combination is found once
and used for as many bins as its scarcest length allows, which are the bins that a search per
bin would fill one after another. Spark counts the lengths, numbers the pieces of each length
in salted parts, and gives each number its bin and place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billgrain.llm.common import short_batches, stored, text_of
from billgrain.llm.words import text_ids

#: Parts in which the pieces of one length are numbered.
SALTS = 64
#: Texts tokenised at once.
TEXTS = 200


def token_pieces(docs: DataFrame, tokeniser: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, piece, start, length, ids``: each document's ids and ``end_id``, cut only where longer than a sequence.

    ``ids`` are little-endian unsigned 32-bit integers. ``tokeniser`` is a file of the
    ``tokenizers`` library that drops white space. A null or empty text gives one piece with
    the end alone. Rows are taken as they are, so repeated rows give repeated pieces.
    """
    short_batches(docs.sparkSession)
    kind, end = docs.schema[id_col].dataType.simpleString(), np.array([end_id], "<u4").tobytes()
    names = ["id", "piece", "start", "length", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                some = batch.slice(at, TEXTS)
                found = [i + end for i in text_ids([t.as_buffer().to_pybytes() for t in some.column("text")], tokeniser)]
                rows = [(n, k, ids[k * 4 * capacity : (k + 1) * 4 * capacity]) for n, ids in enumerate(found) for k in range(-(-len(ids) // (4 * capacity)))]
                owners, pieces, parts = zip(*rows, strict=True)
                columns = [
                    some.column("id").take(pa.array(owners)),
                    pa.array(pieces, pa.int32()),
                    pa.array([k * capacity for k in pieces], pa.int64()),
                    pa.array([len(p) // 4 for p in parts], pa.int64()),
                    pa.array(parts, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids binary")


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, each at most as often as ``counts`` has it, with the largest sum up to ``room``."""
    reach, steps, whole = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            grown = (reach | reach << length) & whole
            if grown == reach:
                break
            steps.append((length, reach))
            reach = grown
            if reach >> room:
                break
        if reach >> room:
            break
    total, taken = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> total & 1:
            taken.append(length)
            total -= length
    return taken


def combinations(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths (each with how often) and the number of bins of each.

    Every combination uses up a length, so there are at most as many as lengths.
    """
    counts, found = {k: v for k, v in histogram.items() if v}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        chosen = [longest, *fullest(counts, capacity - longest)]
        counts[longest] += 1
        often = {x: chosen.count(x) for x in chosen}
        bins = min(counts[x] // n for x, n in often.items())
        found.append((often, bins))
        for x, n in often.items():
            counts[x] -= n * bins
            if not counts[x]:
                del counts[x]
    return found


def _places(spark, histogram: dict[int, int], capacity: int) -> DataFrame:
    """``length, first, last, each, bin0, offset0``: which numbers of a length go into which bins.

    The lengths of a combination are different and sum up to the capacity at most, so it has at
    most sqrt(2 * capacity) of them: 64 * 2048 rows for sequences of 2048 tokens.
    """
    used, rows, bin0 = dict.fromkeys(histogram, 0), [], 0
    for often, bins in combinations(histogram, capacity):
        offset = 0
        for length, each in sorted(often.items(), reverse=True):
            rows.append((length, used[length], used[length] + each * bins, each, bin0, offset))
            used[length] += each * bins
            offset += each * length
        bin0 += bins
    return spark.createDataFrame(rows, "length long, first long, last long, each long, bin0 long, offset0 long")


def packed(pieces: DataFrame, capacity: int = 2048, keys: tuple[str, ...] = ("id", "piece"), length: str = "length") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows that have a ``length`` from 1 to ``capacity``.

    ``pieces`` is read twice and should be a stored table. All rows and columns stay; rows with
    equal ``keys`` are interchangeable, null keys count as a value. Offsets in a sequence are
    gapless from 0. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    rows = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int"))
    parts = rows.groupBy(length, "_salt").agg(F.count("*").alias("_n"))
    counts = parts.groupBy(length).agg(F.sum("_n")).collect()  # at most one row per length
    places = _places(spark, {n: c for n, c in counts}, capacity)
    before = Window.partitionBy(length).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(length, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy(length, "_salt").orderBy(*keys)) - 1
    numbered = rows.withColumn("_in", number).join(parts, [length, "_salt"]).withColumn("_number", F.col("_before") + F.col("_in"))
    places = places.select(F.col("length").alias("_length"), *[F.col(c).alias(f"_{c}") for c in ("first", "last", "each", "bin0", "offset0")])
    here = (F.col(length) == F.col("_length")) & (F.col("_number") >= F.col("_first")) & (F.col("_number") < F.col("_last"))
    turn = F.col("_number") - F.col("_first")
    return numbered.join(F.broadcast(places), here).select(
        *pieces.columns,
        (F.col("_bin0") + F.floor(turn / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset0") + (turn % F.col("_each")) * F.col(length)).cast("long").alias("offset"),
    )


def packed_documents(docs: DataFrame, tokeniser: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset`` of all pieces of all documents."""
    pieces = token_pieces(docs, tokeniser, capacity, end_id, id_col, text_col)
    pieces = stored(pieces.select(F.col("id").alias(id_col), "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packed(pieces, capacity, (id_col, "piece", "ids_crc32"))


def sequences(docs: DataFrame, tokeniser: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``sequence_id, ids, n_ids``: the packed sequences themselves, ids as in ``token_pieces``."""
    pieces = packed(stored(token_pieces(docs, tokeniser, capacity, end_id, id_col, text_col)), capacity)
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_ids"))
    ids = F.aggregate("parts", F.lit(b""), lambda all_ids, part: F.concat(all_ids, part["ids"]))
    return whole.select("sequence_id", ids.alias("ids"), "n_ids")
