"""How five quality filters interact: what each removes in every order of them.

The corpus becomes a sparse document-term matrix. Each shard of documents first gets a
dictionary of its own; all shards' dictionaries meet in a global one with dense numbers, by
which the shards' columns are renumbered. The row sums of the matrix are the documents' words
and its nonzero counts their different words; they decide the filters A and B. Flags C and D
come from the characters, E from a digest of the text and the least id that has it. What is
left of a document is the set of filters it fails, one of 32; counts per part and set give all
results for all orders.

A word is shuffled once for each shard that holds it, not for each document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import count, filterfalse, permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billgrain.llm.common import join_hot, short_batches, stored, text_of

#: Bytes of text after which a shard is closed.
SHARD_BYTES = 8 << 20
#: Ranges of digests in which the words of the global dictionary are numbered.
RANGES = 1 << 14
FILTERS = "ABCDE"
MARKS = np.isin(np.arange(256), np.frombuffer(b"#$%&*|", np.uint8))
CAPITAL = (np.arange(256) >= 65) & (np.arange(256) <= 90)
#: Bytes that begin a code point.
LEADS = (np.arange(256) & 0xC0) != 0x80


class _Shard:
    """Documents of one shard with a dictionary of its own."""

    def __init__(self):
        self.local, self.docs, self.ends, self.indices, self.data, self.size = {}, [], [0], [], [], 0

    def add(self, batch: pa.RecordBatch, at: int, text: bytes) -> None:
        counts = Counter(text.split())  # of bytes: at ASCII white space only
        self.local.update(zip(filterfalse(self.local.__contains__, counts), count(len(self.local))))
        self.indices.append(np.fromiter(map(self.local.__getitem__, counts), np.int32, len(counts)))
        self.data.append(np.fromiter(counts.values(), np.int32, len(counts)))
        self.ends.append(self.ends[-1] + len(counts))
        chars = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        fails_c = 100 * int(chars[CAPITAL].sum()) > 10 * int(chars[LEADS].sum())
        self.docs.append((batch, at, fails_c, bool(chars[MARKS].any())))
        self.size += len(text)

    def row(self, shard: int, kept: list[str]) -> pa.RecordBatch:
        def listed(values) -> pa.Array:
            values = values if isinstance(values, pa.Array) else pa.array(values)
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        attributes = [pa.concat_arrays([b.column(k).slice(i, 1) for b, i, _, _ in self.docs]) for k in kept]
        flags = [pa.array([d[i] for d in self.docs], pa.bool_()) for i in (2, 3)]
        matrix = [pa.array(self.ends, pa.int64()), pa.array(np.concatenate(self.indices)), pa.array(np.concatenate(self.data)), pa.array(list(self.local), pa.binary())]
        names = ["shard", *kept, "fails_c", "fails_d", "indptr", "indices", "data", "words"]
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *map(listed, [*attributes, *flags, *matrix])], names)


def local_shards(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """A row per shard: its documents' attributes and flags, its dictionary and the matrix in numbers of that dictionary."""
    text = text_of(text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    kept = ["id", "part", "b1", "b2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, shard = TaskContext.get().partitionId(), 0, _Shard()
        for batch in batches:
            for i, value in enumerate(batch.column("text")):
                shard.add(batch, i, value.as_buffer().to_pybytes())
                if shard.size >= SHARD_BYTES:
                    yield shard.row((task << 32) + made, kept)
                    made, shard = made + 1, _Shard()
        if shard.docs:
            yield shard.row((task << 32) + made, kept)

    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.xxhash64(text).alias("b1"),
        F.xxhash64(F.lit(1), text).alias("b2"),
        text.cast("binary").alias("text"),
    )
    columns = f"id array<{kind}>, part array<string>, b1 array<long>, b2 array<long>, fails_c array<boolean>, fails_d array<boolean>"
    return rows.mapInArrow(run, f"shard long, {columns}, indptr array<long>, indices array<int>, data array<int>, words array<binary>")


def dictionary(shards: DataFrame) -> DataFrame:
    """``shard, local, number``: the global number of each word of each shard's dictionary.

    Numbers are dense from 0, in the order of digest ranges and words. A word has one row per
    shard at most, a small part of a shard's dictionary, so no range is crowded by a frequent word.
    """
    entries = shards.select("shard", F.posexplode("words").alias("local", "word"))
    entries = entries.withColumn("range", F.pmod(F.xxhash64("word"), F.lit(RANGES)).cast("int"))
    inside = Window.partitionBy("range").orderBy("word")
    ranked = stored(entries.select("shard", "local", "range", F.dense_rank().over(inside).alias("rank")))
    starts = ranked.groupBy("range").agg(F.max("rank").alias("n"))  # at most RANGES rows
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return ranked.join(F.broadcast(starts), "range").select("shard", "local", (F.col("start") + F.col("rank") - 1).alias("number"))


def dictionary_words(shards: DataFrame, numbers: DataFrame) -> DataFrame:
    """``number, word``: the global dictionary."""
    words = shards.select("shard", F.posexplode("words").alias("local", "word"))
    return words.join(numbers, ["shard", "local"]).groupBy("number").agg(F.first("word").alias("word"))


def document_term_matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """CSR shards whose ``indices`` are numbers of the global dictionary, and that dictionary (``number, word``)."""
    short_batches(docs.sparkSession)
    shards = stored(local_shards(docs, id_col, text_col, part_col))
    known = dictionary(shards)
    # a shard's dictionary is no larger than its text
    mapping = known.groupBy("shard").agg(F.transform(F.sort_array(F.collect_list(F.struct("local", "number"))), lambda e: e["number"]).alias("numbers"))
    renumbered = F.coalesce(F.expr("transform(indices, i -> numbers[i])"), F.array().cast("array<long>"))
    csr = shards.drop("words").join(mapping, "shard", "left").withColumn("indices", renumbered).drop("numbers")
    return csr, dictionary_words(shards, known)


def row_counts(csr: DataFrame) -> DataFrame:
    """``id, part, b1, b2, fails_c, fails_d, n_words, n_distinct`` of each document: row sums and nonzero counts."""
    kept = ["id", "part", "b1", "b2", "fails_c", "fails_d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                ends = one.column("indptr").flatten().to_numpy()
                upto = np.r_[0, np.cumsum(one.column("data").flatten().to_numpy(zero_copy_only=False).astype(np.int64))]
                values = [one.column(k).flatten() for k in kept]
                yield pa.RecordBatch.from_arrays([*values, pa.array(upto[ends[1:]] - upto[ends[:-1]]), pa.array(np.diff(ends))], [*kept, "n_words", "n_distinct"])

    columns = ", ".join(f"{k} {csr.schema[k].dataType.elementType.simpleString()}" for k in kept)
    return csr.select(*kept, "indptr", "data").mapInArrow(run, f"{columns}, n_words long, n_distinct long")


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``id, part, n_words, n_distinct, fails``: bit ``i`` of fails is set if the document fails the ``i``-th filter."""
    csr, _ = document_term_matrix(docs, id_col, text_col, part_col)
    rows = stored(row_counts(csr))
    firsts = stored(rows.groupBy("b1", "b2").agg(F.min("id").alias("first"), F.count("*").alias("times")))
    rows = join_hot(rows, firsts, ["b1", "b2"], rows.count())
    conditions = [
        F.col("n_words") < 100,
        F.col("n_distinct") * 100 < F.col("n_words") * 80,
        F.col("fails_c"),
        F.col("fails_d"),
        F.coalesce(F.col("id") > F.col("first"), F.lit(False)),
    ]
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)]
    return rows.select("id", "part", "n_words", "n_distinct", sum(bits[1:], bits[0]).alias("fails"))


def failure_sets(found: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``part, fails, n, good, toxic``: documents per set of failed filters, at most 32 sets a part."""
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    marks = marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"))
    rows = found.select("id", "part", "fails")
    # rows without an id have no labels and would all meet in one task
    known = rows.where(F.col("id").isNotNull()).join(marks, "id", "left").select("part", "fails", "is_good", "is_toxic")
    nameless = rows.where(F.col("id").isNull()).select("part", "fails", F.lit(False).alias("is_good"), F.lit(False).alias("is_toxic"))
    one = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long"))
    return known.unionByName(nameless).groupBy("part", "fails").agg(F.count("*").alias("n"), one("is_good").alias("good"), one("is_toxic").alias("toxic"))


def filter_interactions(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """For each part, order of the filters and step in it: what the step keeps and removes.

    ``kept, removed`` count documents after and at the step; ``redundant`` those that fail its
    filter but went earlier; ``unique_fails`` those that fail no other filter; ``good_lost,
    toxic_lost`` the removed ones so labelled (any of a document's labels counts); ``shapley``
    the filter's removed, added up over all 120 orders.

    Null and empty texts are empty: they fail A alone, and E if a smaller id has one. A null id
    is never a repeat and has no labels; rows equal in id and text repeat each other in
    neither direction. A null part is the empty one. Texts of any length are one row of the
    matrix, held by one task. An empty table has no parts, so no rows. Other columns are not read.
    """
    sets = stored(failure_sets(stored(failures(docs, id_col, text_col, part_col)), labels, id_col))
    parts = sets.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sets"))
    orders = " ".join("".join(o) for o in permutations(FILTERS))
    steps = parts.withColumn("filter_order", F.explode(F.split(F.lit(orders), " "))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = f"shiftleft(1, instr('{FILTERS}', substring(filter_order, {{}}, 1)) - 1)"
    steps = steps.withColumn("own", F.expr(bit.format("step")))
    steps = steps.withColumn("earlier", F.expr(f"aggregate(sequence(0, step - 1), 0, (m, i) -> m | if(i = 0, 0, {bit.format('i')}))"))

    def total(condition: str, value: str = "n"):
        return F.expr(f"aggregate(sets, 0L, (t, s) -> t + if({condition}, s.{value}, 0L))")

    removed = "s.fails & own != 0 AND s.fails & earlier = 0"
    every = len(list(permutations(FILTERS)))
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("s.fails & (earlier | own) = 0").alias("kept"),
        total(removed).alias("removed"),
        total("s.fails & own != 0 AND s.fails & earlier != 0").alias("redundant"),
        total("s.fails = own").alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
        # of the filters a document fails, each comes first in an equal share of the orders
        F.expr(f"aggregate(sets, 0L, (t, s) -> t + if(s.fails & own != 0, s.n * ({every} div bit_count(s.fails)), 0L))").alias("shapley"),
    )
