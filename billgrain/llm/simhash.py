"""Near duplicates by SimHash fingerprints and a Gray-order hierarchical index.

Fingerprints that differ in at most three bits agree in one of four blocks of 16 bits. For
each block the fingerprints are rotated so that it leads; its value is the index's upper node,
where every member shares those bits. Below it the members stand in the order of their Gray
rank, in which neighbours differ in few bits, and are cut into leaves. A leaf keeps the bits
that all its members share; two leaves whose shared bits already differ too often are skipped
with all their pairs. Large nodes are cut into chunks, and each pair of chunks is a group of
its own. A task hands on the links of its groups as stars, so that a group of alike
fingerprints costs as many rows as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billgrain.llm.common import short_batches, stored, text_of
from billgrain.llm.components import components

BLOCKS, BLOCK_BITS = 4, 16
#: Fingerprints in a leaf.
LEAF = 32
#: Members of a node that one group holds; larger nodes are cut into chunks.
CHUNK = 2048
#: Hashes whose bits are counted at once.
HASHES = 1 << 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The SimHash of a UTF-8 text over its word shingles, repeats included."""
    words = text.lower().split()  # of bytes: A-Z only, at ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
    ends = (ends - 1)[shingle - 1 :].tolist()
    digest, total, count = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for i in range(0, count, HASHES):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[i : i + HASHES], ends[i : i + HASHES])], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id, body, fingerprint`` (a signed long) of each row; body is a digest of the text."""
    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = text_of(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_buffer().to_pybytes(), shingle) for t in batch.column("text")), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("body"), pa.array(prints.view(np.int64))], ["id", "body", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("body"), text.cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, body long, fingerprint long")


def gray_rank(code: Column) -> Column:
    """The place of a 64-bit code in the Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def _leaves(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of at most ``LEAF`` rows that do not cross groups."""
    heads = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[heads, len(groups)])
    counts = -(-sizes // LEAF)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(heads, counts) + inner * LEAF
    return starts, np.minimum(starts + LEAF, np.repeat(heads + sizes, counts))


def links(codes: np.ndarray, groups: np.ndarray, sides: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of one group that differ in at most ``most`` bits.

    ``codes`` stand in Gray order within runs of equal ``groups``. ``sides``: 0 for all members
    of a group whose pairs all count; 1 and 2 where only pairs across the sides do.
    """
    starts, ends = _leaves(groups)
    shared_and = np.bitwise_and.reduceat(codes, starts)
    mask = ~(np.bitwise_or.reduceat(codes, starts) ^ shared_and)  # bits in which a leaf agrees
    owner = groups[starts]
    left, right = [], []
    for step in range(len(starts)):
        i = np.flatnonzero(owner[step:] == owner[: len(owner) - step])
        if not len(i):
            break
        j = i + step
        apart = np.bitwise_count((shared_and[i] ^ shared_and[j]) & mask[i] & mask[j])
        i, j = i[apart <= most], j[apart <= most]
        for block in range(0, len(i), 4096):
            a, b = i[block : block + 4096], j[block : block + 4096]
            for shift in range(LEAF):  # each member of one leaf against the other leaf, turned
                x = starts[a][:, None] + np.arange(LEAF)[None]
                y = starts[b][:, None] + ((np.arange(LEAF) + shift) % LEAF)[None]
                good = (x < ends[a][:, None]) & (y < ends[b][:, None])
                if step == 0:
                    good &= x < y
                x, y = x[good], y[good]
                near = np.bitwise_count(codes[x] ^ codes[y]) <= most
                near &= (sides[x] != sides[y]) | (sides[x] == 0)
                left.append(x[near])
                right.append(y[near])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def stars(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least position that each position is linked with, directly or not."""
    root = np.arange(n)
    while True:
        a, b = root[left], root[right]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _near(most: int):
    def settle(part: pa.Table) -> pa.RecordBatch:
        column = lambda name: part.column(name).to_numpy()
        codes = column("code").view(np.uint64)
        key = np.stack([column("node"), column("pair")])
        groups = np.cumsum(np.r_[False, (key[:, 1:] != key[:, :-1]).any(axis=0)])
        root = stars(len(codes), *links(codes, groups, column("side"), most))
        moved = np.flatnonzero(root != np.arange(len(root)))
        prints = column("fingerprint")
        return pa.RecordBatch.from_arrays([pa.array(prints[moved]), pa.array(prints[root[moved]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            node, pair = held.column("node").to_numpy(), held.column("pair").to_numpy()
            done = int(np.flatnonzero((node != node[-1]) | (pair != pair[-1]))[-1]) + 1 if (node[0], pair[0]) != (node[-1], pair[-1]) else 0
            if done:  # the last group may go on in the next batch
                yield settle(held.slice(0, done))
                held = held.slice(done).combine_chunks()
        if held is not None and len(held):
            yield settle(held)

    return run


def near_edges(prints: DataFrame, most: int = 3) -> DataFrame:
    """Edges ``u, v`` between different fingerprints that connect whatever is linked.

    ``prints`` holds different signed longs ``fingerprint``. Exact for ``most`` up to 3.
    """
    if not 0 <= most < BLOCKS:
        raise ValueError("the blocks find up to three differing bits")
    code = F.col("fingerprint")
    turned = F.array(*[F.shiftleft(code, BLOCK_BITS * t).bitwiseOR(F.shiftrightunsigned(code, 64 - BLOCK_BITS * t)) if t else code for t in range(BLOCKS)])
    rows = prints.select("fingerprint", F.posexplode(turned).alias("block", "code"))
    rows = rows.withColumn("node", F.col("block") * (1 << BLOCK_BITS) + F.shiftrightunsigned("code", 64 - BLOCK_BITS).cast("int"))
    sizes = rows.groupBy("node").agg(F.count("*").alias("size"))  # at most 4 * 65,536 rows
    sizes = sizes.where("size > 1").select("node", F.ceil(F.col("size") / F.lit(CHUNK)).cast("int").alias("chunks"))
    rows = rows.join(F.broadcast(sizes), "node").withColumn("chunk", F.pmod(F.xxhash64("fingerprint"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    rows = rows.select("fingerprint", "code", "node", "chunk", "chunks", other.alias("other")).select(
        "fingerprint",
        "code",
        "node",
        (F.least("chunk", "other") * F.col("chunks") + F.greatest("chunk", "other")).cast("long").alias("pair"),
        F.when(F.col("chunk") == F.col("other"), 0).when(F.col("chunk") < F.col("other"), 1).otherwise(2).alias("side"),
        gray_rank(F.col("code")).alias("rank"),
    )
    # ranks are unsigned: the sign bit turned, signed order is theirs
    rows = rows.withColumn("rank", F.col("rank").bitwiseXOR(F.lit(-(1 << 63))))
    grouped = rows.repartition("node", "pair").sortWithinPartitions("node", "pair", "rank")
    return grouped.select("fingerprint", "code", "node", "pair", "side").mapInArrow(_near(most), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """``id, body, fingerprint, component_id`` of each row.

    Rows are linked if their fingerprints differ in at most ``most`` bits; ``component_id`` is
    the smallest id reachable. Null and empty texts have fingerprint 0 and are linked like any
    other; a null id is reached like others but is never the smallest, so a component of null
    ids alone has a null one. Repeated rows have equal results. Other columns are not read.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle))
    prints = stored(rows.groupBy("fingerprint").agg(F.min("id").alias("least")))
    joined = components(near_edges(prints.select("fingerprint"), most))
    known = prints.join(joined, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(least, "root").select("fingerprint", "component_id")
    return rows.join(known, "fingerprint").select(F.col("id").alias(id_col), "body", "fingerprint", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """One row of each component, that with the smallest id (null last) and digest of the text."""
    found = near_duplicates(docs, id_col, text_col, shingle, most)
    # components without any id: one for each fingerprint is kept
    group = F.struct(F.col("component_id").alias("c"), F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("f"))
    first = found.groupBy(group.alias("g")).agg(F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("body").alias("b"))).alias("m"))
    first = first.select(F.coalesce("m.i", F.lit(0)).alias("_i"), F.col("m.n").alias("_n"), F.col("m.b").alias("_b"))
    keyed = docs.withColumns({"_i": F.coalesce(F.col(id_col), F.lit(0)), "_n": F.col(id_col).isNull(), "_b": F.xxhash64(text_of(text_col))})
    keys = ["_i", "_n", "_b"]
    once = keyed.join(first, keys, "left_semi").withColumn("_no", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))))
    return once.where("_no = 1").select(*docs.columns)
