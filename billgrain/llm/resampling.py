"""Importance resampling towards a target distribution of hashed word runs.

Features are runs of consecutive words, hashed into buckets. Line breaks separate words, so
texts are cut into lines first: runs inside a line are counted once for each different line
and multiplied by the line's occurrences; runs that reach over a line's end are counted for
each document on its own. The log ratio of a bucket's share in the target to its share in all
documents is its gain, a document's weight is the mean gain of its features, and Gumbel noise
from a digest of its id turns drawing in proportion to the weights into taking the highest
scores.

Only digests of lines, bucket numbers and sums are shuffled after the lines were gathered.
Gains are one number per bucket. Ranks come from a histogram of the scores, which are bounded
whole numbers, so no step sorts all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billgrain.llm.common import join_hot, short_batches, stored, text_of
from billgrain.llm.words import REMEMBERED, remembered

#: ASCII letters and digits and all bytes of other characters belong to words; A-Z become a-z.
AS_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

COUNTS = "words long, n long, buckets array<int>, counts array<int>"


class Buckets(dict):
    """Bucket numbers of features, remembered."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[feature] = bucket = zlib.crc32(feature) % self.n
        return bucket


def line_features(line: bytes, longest: int) -> tuple[int, list[bytes]]:
    """The number of words and all runs of up to ``longest`` words of a line."""
    words = line.translate(AS_WORDS).split()
    features = words
    for k in range(2, longest + 1):
        features = features + [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    return len(words), features


def crossing_features(text: bytes, longest: int) -> tuple[int, list[bytes]]:
    """Runs of 2 to ``longest`` words that reach over the end of a line; their words are counted with the lines."""
    lines = [line.translate(AS_WORDS).split() for line in text.split(b"\n")]
    words = [w for line in lines for w in line]
    line_of = np.repeat(np.arange(len(lines)), [len(line) for line in lines])
    found = []
    for k in range(2, longest + 1):
        for i in np.flatnonzero(line_of[: max(len(words) - k + 1, 0)] != line_of[k - 1 :]).tolist():
            found.append(b" ".join(words[i : i + k]))
    return 0, found


def _counting(make, longest: int, n_buckets: int):
    """Texts to sparse counts of buckets, with the other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = remembered(f"buckets {n_buckets}", lambda: Buckets(n_buckets))
        for batch in batches:
            words, sizes, flat = [], [], []
            for text in batch.column("text"):
                n, features = make(text.as_buffer().to_pybytes(), longest)
                words.append(n)
                sizes.append(len(features))
                flat += map(bucket.__getitem__, features)
            owner = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
            cells, times = np.unique(owner * n_buckets + np.array(flat, np.int64), return_counts=True)
            ends = np.searchsorted(cells, np.arange(len(sizes) + 1) * n_buckets).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(a.astype(np.int32))) for a in (cells % n_buckets, times)]
            kept = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), *lists], [*kept, "words", "n", "buckets", "counts"])

    return run


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _totals(counted: DataFrame, n_buckets: int) -> DataFrame:
    """``bucket, total``: counts times occurrences, added up in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            times = np.repeat(batch.column("times").to_numpy(), batch.column("buckets").value_lengths().to_numpy())
            np.add.at(total, _flat(batch, "buckets"), _flat(batch, "counts") * times)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["bucket", "total"])

    parts = counted.select("times", "buckets", "counts").mapInArrow(run, "bucket int, total long")
    return parts.groupBy("bucket").agg(F.sum("total").alias("total"))


def _gained(counted: DataFrame, gains: np.ndarray) -> DataFrame:
    """The sum of gains of each row's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.r_[0, np.cumsum(gains[_flat(batch, "buckets")] * _flat(batch, "counts"))]
            ends = np.r_[0, np.cumsum(batch.column("buckets").value_lengths().to_numpy())]
            kept = [name for name in batch.schema.names if name not in ("buckets", "counts")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(upto[ends[1:]] - upto[ends[:-1]])], [*kept, "gain"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counted.schema if f.name not in ("buckets", "counts"))
    return counted.mapInArrow(run, f"{kept}, gain long")


def _lines(docs: DataFrame) -> DataFrame:
    return docs.withColumn("line", F.explode(F.split("text", "\n")))


def line_counts(texts: DataFrame, longest: int, n_buckets: int) -> DataFrame:
    """``h1, h2, times, words, n, buckets, counts``: each different line once, with its occurrences."""
    different = _lines(texts).groupBy("line").agg(F.count("*").alias("times"))
    rows = different.select(*_digests(), "times", F.col("line").cast("binary").alias("text"))
    return rows.mapInArrow(_counting(line_features, longest, n_buckets), f"h1 long, h2 long, times long, {COUNTS}")


def _digests() -> list:
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")]


def gains(documents: DataFrame, target: DataFrame, n_buckets: int) -> np.ndarray:
    """The gain of each bucket from two tables ``bucket, total``: ``n_buckets`` numbers, whatever the tables hold."""
    both = documents.withColumnRenamed("total", "s").join(target.withColumnRenamed("total", "t"), "bucket", "full")
    sums = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    s, t = (F.coalesce(name, F.lit(0)).cast("double") for name in ("s", "t"))
    ratio = (t + 1.0) * F.lit(float(sums[0] + n_buckets)) / ((s + 1.0) * F.lit(float(sums[1] + n_buckets)))
    every = documents.sparkSession.range(n_buckets).select(F.col("id").cast("int").alias("bucket"))
    found = every.join(both, "bucket", "left").select("bucket", F.floor(F.log(ratio) * 1000.0).alias("gain")).collect()
    result = np.zeros(n_buckets, np.int64)
    for bucket, gain in found:
        result[bucket] = gain
    return result


def resampled(
    docs: DataFrame,
    target: DataFrame,
    longest: int = 1,
    n_buckets: int = 10_000,
    seed: str = "2024",
    percent: int = 10,
    least_words: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """``id, n_features, weight, score, rank`` for each row; rank is null where a document is not drawn.

    Features are all runs of 1 to ``longest`` words, repeats counted. Of the rows with at least
    ``least_words`` words, ``percent`` in a hundred are drawn by the highest scores, ties to
    smaller ids (null last), then fewer features and lower weights. Null and empty texts have no
    features and weight 0; a null id has the noise of an empty one; repeated rows are rows of
    their own. Texts of any length are read whole, in one task each. An empty table gives no
    rows, an empty target only zero counts. Other columns are not read.
    """
    short_batches(docs.sparkSession)
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    if longest > 1:
        base = stored(base)  # row numbers of two readings must agree
    counted = stored(line_counts(base, longest, n_buckets))
    aim = target.select(text_of(target_col).alias("text"))
    totals, aims = _totals(counted, n_buckets), _totals(line_counts(aim, longest, n_buckets), n_buckets)
    if longest > 1:
        over = _counting(crossing_features, longest, n_buckets)
        as_bytes = F.col("text").cast("binary").alias("text")
        crossing = stored(base.select("row", F.lit(1).cast("long").alias("times"), as_bytes).mapInArrow(over, f"row long, times long, {COUNTS}"))
        aim_crossing = aim.select(F.lit(1).cast("long").alias("times"), as_bytes).mapInArrow(over, f"times long, {COUNTS}")
        both = lambda a, b: a.unionByName(b).groupBy("bucket").agg(F.sum("total").alias("total"))
        totals, aims = both(totals, _totals(crossing, n_buckets)), both(aims, _totals(aim_crossing, n_buckets))
    gain = gains(stored(totals), stored(aims), n_buckets)

    lines = stored(_gained(counted, gain))
    places = stored(_lines(base).select("row", "id", *_digests()))
    parts = join_hot(places, lines, ["h1", "h2"], places.count()).select("row", "id", "words", "n", "gain")
    if longest > 1:
        parts = parts.unionByName(_gained(crossing, gain).select("row", F.lit(None).cast(docs.schema[id_col].dataType).alias("id"), "words", "n", "gain"))
    sums = parts.groupBy("row").agg(F.max("id").alias("id"), *(F.sum(c).alias(c) for c in ("words", "n", "gain")))
    weight = F.when(F.col("n") > 0, F.expr("gain div n - if(gain % n < 0, 1, 0)")).otherwise(F.lit(0))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    noise = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    scored = pinned_scores(sums, weight, F.floor(F.log(-F.log(noise)) * -1000.0))
    return drawn(stored(scored), percent, least_words).withColumnRenamed("id", id_col)


def pinned_scores(sums: DataFrame, weight, noise) -> DataFrame:
    rows = sums.select("id", "words", F.col("n").alias("n_features"), weight.cast("long").alias("weight"), noise.cast("long").alias("noise"))
    return rows.select("id", "words", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"))


def drawn(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``id, n_features, weight, score, rank`` of a stored table of scores.

    Scores are whole numbers in a fixed range (logarithms of counts and of 32 bits, in
    thousandths), so the table of rows per score is small at every size.
    """
    able = scored.where(F.col("words") >= least_words)
    per_score = able.groupBy("score").agg(F.count("*").alias("rows"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    per_score = per_score.select("score", F.coalesce(F.sum("rows").over(above), F.lit(0)).alias("before"))
    wanted = percent * able.count() // 100
    reached = stored(per_score.where(F.col("before") < wanted))
    out = ["id", "n_features", "weight", "score"]
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("id"), "n_features", "weight")
    top = able.join(F.broadcast(reached), "score").withColumn("place", F.col("before") + F.row_number().over(order))
    top = top.select(*out, F.when(F.col("place") <= wanted, F.col("place")).cast("long").alias("rank"))
    rest = scored.join(F.broadcast(reached), (F.col("words") >= least_words) & (scored["score"] == reached["score"]), "left_anti")
    return top.unionByName(rest.select(*out, F.lit(None).cast("long").alias("rank")))
