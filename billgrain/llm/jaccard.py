"""Texts with nearly the same set of word runs, joined in size-banded tiles of bitmap signatures.

A set's shingles stand in one global order, those in rarely hit hash buckets first. Two sets
with the wanted similarity share one of the first shingles of both (their prefixes), so sets
meet in the group of a prefix shingle. Inside it they form tiles by size: a band holds sizes
within the ratio that the threshold allows, so partners stand in the same or the next band.
In a tile, signatures are compared: a bitmap of two to four bits for each member of the set, in which
each shingle turns one bit over. The bits in which two of them differ are at most the shingles
that only one set has, which bounds the overlap from above. Pairs that pass are settled by the
exact intersection of their sorted hashes.

Links are found in two rounds. In the first, every set meets only one set of each of its
groups, that which shares most, which joins groups of alike texts at linear cost. In the second,
tiles that are not already one component are searched whole, but only for pairs across
components; groups with the same members are searched once. Copies count once throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from billgrain.llm.common import join_hot, short_batches, stored, text_of
from billgrain.llm.components import components
from billgrain.llm.words import remembered

#: Buckets of hashes whose frequencies set the order of shingles: one row each, at every size.
ORDER_BITS = 16
#: A bucket with so many times the mean, and so large a part of all sets, may hold a hot shingle.
HOT_MEANS, HOT_PART = 4, 50
#: Bits of a signature: from one word to this many, by the size of the set.
LEAST_BITS, MOST_BITS = 64, 1 << 15
#: Sets that one side of a tile holds; larger tiles are cut into chunks that meet pair by pair.
CHUNK = 2048
#: Words of 64 bits in the filter of sets whose hashes are wanted: 2 MiB.
FILTER_BITS = 24
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of texts whose words are digested at once.
AT_ONCE = 1 << 18
IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _byte_values() -> np.ndarray:
    """A fixed odd 64-bit number for each byte; capital letters have those of small ones, white space has 0."""
    values = np.random.default_rng(12).integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
    values[65:91] = values[97:123]
    values[IS_SPACE] = 0
    return values


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd base modulo 2^64 and of its inverse."""
    base = 0xD6E8FEB86659FD93
    size = AT_ONCE << max(0, (n - 1).bit_length() - AT_ONCE.bit_length() + 1)

    def made():
        both = []
        for number in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, number, np.uint64)
            row[0] = 1
            both.append(np.multiply.accumulate(row))
        return tuple(both)

    return remembered(f"powers {size}", made) if size == AT_ONCE else made()


def word_digests(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The places and 64-bit digests of the words of ASCII-lower-cased bytes, by differences of prefix sums."""
    data = np.frombuffer(raw, np.uint8)
    space = IS_SPACE[data]
    edges = np.flatnonzero(np.diff(np.r_[True, space, True].astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(remembered("byte values", _byte_values)[data] * up[: len(data)], out=sums[1:])
    digests = (sums[ends] - sums[starts]) * down[starts]
    digests ^= digests >> np.uint64(32)
    digests *= MULTIPLIER
    return starts, digests ^ (digests >> np.uint64(29))


def _runs(digests: np.ndarray, length: int) -> np.ndarray:
    hashes = np.full(max(len(digests) - length + 1, 0), length, np.uint64)
    for i in range(length):
        hashes = (hashes ^ digests[i : i + len(hashes)]) * MULTIPLIER
        hashes ^= hashes >> np.uint64(29)
    return hashes


def shingle_sets(texts: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """For each text the sorted different 64-bit hashes of its word runs; a shorter text is one run."""
    starts, digests = word_digests(b" ".join(texts))
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)])).tolist()
    runs = _runs(digests, shingle)
    for low, high in zip(bounds, bounds[1:]):
        if high - low >= shingle:
            hashes = np.sort(runs[low : high - shingle + 1])
            yield hashes[np.r_[True, hashes[1:] != hashes[:-1]]]
        else:
            yield _runs(digests[low:high], high - low) if high > low else np.zeros(0, np.uint64)


def _sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    held, size = [], 0
    for text in texts:
        held.append(text.as_buffer().to_pybytes())
        size += len(held[-1])
        if size >= AT_ONCE:
            yield from shingle_sets(held, shingle)
            held, size = [], 0
    if held:
        yield from shingle_sets(held, shingle)


def signature(hashes: np.ndarray) -> bytes:
    """A bitmap of a power of two of bits, at least twice the size of the set; each hash turns one over."""
    bits = LEAST_BITS
    while bits < 2 * len(hashes) and bits < MOST_BITS:
        bits *= 2
    turned = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(turned.astype(np.uint8), bitorder="little").tobytes()


def prefix(hashes: np.ndarray, ranks: np.ndarray, percent: int) -> np.ndarray:
    """The first hashes in the global order, with the rank of their bucket in its place: sets with the wanted similarity share one."""
    n = len(hashes)
    low = np.uint64((1 << (64 - ORDER_BITS)) - 1)
    keys = (ranks[(hashes >> np.uint64(64 - ORDER_BITS)).astype(np.int64)] << np.uint64(64 - ORDER_BITS)) | (hashes & low)
    wanted = n - -(-percent * n // 100) + 1
    return np.partition(keys, wanted - 1)[:wanted] if wanted < n else keys


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def _digest(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes()) if len(hashes) else 0


def _scan(docs: DataFrame, run, columns: str, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text")).mapInArrow(run, columns)


def signed_sets(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> tuple[DataFrame, np.ndarray]:
    """``id, s, n, bits`` of each row (digest, size and signature of its set), and the buckets' frequencies."""
    kind = docs.schema[id_col].dataType
    arrow_ids = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, often = ["id", "s", "n", "bits", "often"], np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            arrow_ids["type"] = batch.column("id").type
            s, n, bits = [], [], []
            for hashes in _sets(batch.column("text"), shingle):
                np.add.at(often, (hashes >> np.uint64(64 - ORDER_BITS)).astype(np.int64), 1)
                s.append(_digest(hashes))
                n.append(len(hashes))
                bits.append(signature(hashes))
            yield pa.RecordBatch.from_arrays([batch.column("id"), _signed(s), pa.array(n, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(len(n), pa.list_(pa.int64()))], names)
        if arrow_ids:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, arrow_ids["type"]), pa.array([0]), pa.array([-1]), pa.array([b""], pa.binary()), pa.array([often], pa.list_(pa.int64()))], names)

    rows = stored(_scan(docs, run, f"id {kind.simpleString()}, s long, n long, bits binary, often array<long>", id_col, text_col))
    order = np.zeros(1 << ORDER_BITS, np.int64)
    counts = rows.where("n = -1").select(F.posexplode("often").alias("bucket", "count")).groupBy("bucket").agg(F.sum("count").alias("count"))
    for bucket, count in counts.collect():  # a row per bucket
        order[bucket] = count
    return rows.where("n >= 0").drop("often"), order


def bucket_ranks(often: np.ndarray) -> np.ndarray:
    """The place of each bucket when rarely hit ones come first."""
    ranks = np.empty(len(often), np.uint64)
    ranks[np.argsort(often, kind="stable")] = np.arange(len(often), dtype=np.uint64)
    return ranks


def prefix_rows(docs: DataFrame, often: np.ndarray, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``key, s, n`` for each shingle of each set's prefix; copies in one batch once."""
    ranks = bucket_ranks(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, keys, s, sizes, n = set(), [], [], [], []
            for hashes in _sets(batch.column("text"), shingle):
                if len(hashes) and (digest := _digest(hashes)) not in seen:
                    seen.add(digest)
                    keys.append(prefix(hashes, ranks, percent))
                    s.append(digest)
                    n.append(len(hashes))
                    sizes.append(len(keys[-1]))
            if keys:
                columns = [_signed(np.concatenate(keys)), _signed(np.repeat(np.array(s, np.uint64), sizes)), pa.array(np.repeat(np.array(n, np.int64), sizes))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "s", "n"])

    return _scan(docs, run, "key long, s long, n long", id_col, text_col)


def shared_keys(rows: DataFrame, often: np.ndarray, n_sets: int) -> DataFrame:
    """``key, s, n, times``: the rows of keys that different sets have, each once, with the rows of the key.

    Keys in buckets that may hold a hot one are taken as shared unseen, so that no window
    holds the rows of a hot key; their ``times`` is the limit from which a bucket is hot.
    """
    limit = max(HOT_MEANS * float(often.mean()), n_sets / HOT_PART)
    first_hot = int((often <= limit).sum())  # ranks follow the frequencies
    hot = F.shiftrightunsigned("key", 64 - ORDER_BITS) >= first_hot
    group = Window.partitionBy("key", "alone")
    marked = rows.withColumn("alone", F.when(hot, F.col("s")))  # hot keys: a window for each set
    marked = marked.withColumns({"low": F.min("s").over(group), "high": F.max("s").over(group), "times": F.count("s").over(group)})
    found = marked.where(F.col("alone").isNotNull() | (F.col("low") != F.col("high"))).dropDuplicates(["key", "s"])
    return found.select("key", "s", "n", F.when(F.col("alone").isNull(), F.col("times")).otherwise(int(limit) + 1).alias("times"))


def _near_size(a: str, b: str, percent: int):
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def _possible(percent: int):
    """Rows ``a, b`` whose signatures leave the wanted overlap possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            for i, (x, y) in enumerate(zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist())):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                width = min(len(x), len(y))
                x, y = (np.bitwise_xor.reduce(v.reshape(-1, width), axis=0) for v in (x, y))
                good.append(_overlap_enough((na[i] + nb[i] - int(np.bitwise_count(x ^ y).sum())) // 2, na[i], nb[i], percent))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _overlap_enough(overlap, na, nb, percent: int):
    return 100 * overlap >= percent * (na + nb - overlap)


def _band(n, percent: int):
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")


def _tile_pairs(percent: int):
    """Pairs ``a, b`` of each tile (equal ``band, key, pair``), across components, that signatures leave possible."""

    def settle(part: pa.Table) -> Iterator[pa.RecordBatch]:
        band = part.column("band").to_numpy()
        cuts = np.r_[0, np.flatnonzero(np.diff(band)) + 1, len(band)].tolist()
        for low, high in zip(cuts, cuts[1:]):  # one width of signatures for a band
            yield from compare(part.slice(low, high - low))

    def compare(part: pa.Table) -> Iterator[pa.RecordBatch]:
        column = lambda name: part.column(name).to_numpy()
        raw = part.column("bits").to_pylist()
        width = min(map(len, raw)) // 8
        bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(r, "<u8").reshape(-1, width), axis=0) for r in raw])
        key = np.stack([column("key"), column("pair")])
        owner = np.cumsum(np.r_[False, (key[:, 1:] != key[:, :-1]).any(axis=0)])
        s, n, label, chunk, above = (column(c) for c in ("s", "n", "label", "side", "above"))
        size = int(np.bincount(owner).max())
        live = np.arange(len(owner))
        for step in range(1, size):
            live = live[live + step < len(owner)]
            live = live[owner[live] == owner[live + step]]  # a tile once passed is passed for all larger steps
            i, j = live, live + step
            fits = (label[i] != label[j]) & ((chunk[i] != chunk[j]) | (chunk[i] == 0)) & ~(above[i] & above[j])
            fits &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            i, j = i[fits], j[fits]
            found_a, found_b = [], []
            for at in range(0, len(i), 8192):
                x, y = i[at : at + 8192], j[at : at + 8192]
                apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
                good = _overlap_enough((n[x] + n[y] - apart) // 2, n[x], n[y], percent)
                found_a.append(s[x[good]])
                found_b.append(s[y[good]])
            if found_a:
                a, b = np.concatenate(found_a), np.concatenate(found_b)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            last = [held.column(c).to_numpy() for c in ("band", "key", "pair")]
            differs = np.flatnonzero(np.any([c != c[-1] for c in last], axis=0))
            if len(differs):  # the last tile may go on in the next batch
                done = int(differs[-1]) + 1
                yield from settle(held.slice(0, done))
                held = held.slice(done).combine_chunks()
        if held is not None and len(held):
            yield from settle(held)

    return run


def tile_pairs(rows: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs of sets across components that can be near, from stored ``key, s, n, label``."""
    members = [F.bit_xor(F.xxhash64("s")).alias("m1"), F.bit_xor(F.xxhash64(F.lit(1), "s")).alias("m2")]
    groups = rows.groupBy("key").agg(F.count("*").alias("times"), F.min("label").alias("low"), F.max("label").alias("high"), *members).where("low != high")
    groups = stored(groups.groupBy("times", "m1", "m2").agg(F.min("key").alias("key")).select("key", "times"))
    tiled = join_hot(rows, groups, ["key"], rows.count()).withColumn("own", _band(F.col("n"), percent))
    tiled = tiled.withColumn("above", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("band", F.col("own") - F.col("above").cast("int"))
    tiled = stored(tiled.select("key", "band", "above", "s", "n", "label"))
    sizes = tiled.groupBy("band", "key").agg(F.count("*").alias("times"), F.min("above").alias("alone"), F.min("label").alias("low"), F.max("label").alias("high"))
    # a tile needs a member of its own band and two components
    sizes = stored(sizes.where("NOT alone AND low != high").select("band", "key", "times", F.ceil(F.col("times") / CHUNK).cast("int").alias("chunks")))
    # signatures join only what is left in tiles
    cut = join_hot(tiled, sizes, ["band", "key"], tiled.count()).join(signatures.select("s", "bits"), "s").withColumn("chunk", F.pmod(F.xxhash64("s"), F.col("chunks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "band",
        "key",
        (F.least("chunk", "other") * F.col("chunks") + F.greatest("chunk", "other")).cast("long").alias("pair"),
        F.when(F.col("chunk") == F.col("other"), 0).when(F.col("chunk") < F.col("other"), 1).otherwise(2).alias("side"),
        "above",
        "s",
        "n",
        "label",
        "bits",
    )
    dealt = cut.repartition("band", "key", "pair").sortWithinPartitions("band", "key", "pair")
    return dealt.mapInArrow(_tile_pairs(percent), "a long, b long").distinct()


def _wanted(spark: SparkSession, pairs: DataFrame) -> np.ndarray:
    """A bit filter of the sets of ``pairs``: 2 MiB, whatever their number."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("s"))
    place = F.shiftrightunsigned("s", 64 - FILTER_BITS)
    words = ends.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(s, {64 - FILTER_BITS}) & 63 AS int))").alias("bit"))
    found = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for word, bits in words.groupBy("word").agg(F.bit_or("bit")).collect():
        found[word] = np.uint64(bits & 0xFFFFFFFFFFFFFFFF)
    return found


def near_pairs(docs: DataFrame, pairs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The stored ``pairs`` whose sorted hash arrays intersect enough."""
    wanted = _wanted(docs.sparkSession, pairs)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, kept = [], []
            for hashes in _sets(batch.column("text"), shingle):
                digest = _digest(hashes)
                place = digest >> (64 - FILTER_BITS)
                if len(hashes) and int(wanted[place >> 6]) >> (place & 63) & 1 and digest not in s[-64:]:
                    s.append(digest)
                    kept.append(hashes.tobytes())
            yield pa.RecordBatch.from_arrays([_signed(s), pa.array(kept, pa.binary())], ["s", "hashes"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("ha"), batch.column("hb")):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.searchsorted(large, small)
                overlap = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                good.append(_overlap_enough(overlap, len(x), len(y), percent))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    sets = stored(_scan(docs, hashed, "s long, hashes binary", id_col, text_col).dropDuplicates(["s"]))
    both = pairs.join(sets.selectExpr("s AS a", "hashes AS ha"), "a").join(sets.selectExpr("s AS b", "hashes AS hb"), "b")
    return both.select("a", "b", "ha", "hb").mapInArrow(met, "a long, b long")


def near_sets(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` of each row.

    A row's set holds the different runs of ``shingle`` words of its text, or the whole
    sequence if it has fewer. Rows are linked if their sets' Jaccard similarity is at least
    ``percent`` in a hundred; ``component_id`` is the smallest id reachable. Null and empty
    texts have empty sets and are linked with nothing. A null id is reached like others but is
    never the smallest, so a component of null ids alone has a null one. Repeated rows have
    equal results. Shingles and sets are told apart by 64-bit digests. Texts of any length are
    read whole, in one task each. Other columns are not read.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows, often = signed_sets(docs, shingle, id_col, text_col)
    facts = stored(rows.where("n > 0").groupBy("s", "n").agg(F.min("id").alias("least"), F.count("*").alias("times"), F.min("bits").alias("bits")))
    keys = stored(shared_keys(prefix_rows(docs, often, shingle, percent, id_col, text_col), often, facts.count()))

    # round 1: the set of each group that shares most of its keys with most others, as the original of many copies does
    spread = keys.groupBy("s").agg(F.sum("times").alias("spread"))
    ranked = keys.select("key", "s", "n").join(spread, "s")
    ends = ranked.groupBy("key").agg(F.max(F.struct("spread", "s", "n")).alias("o"), F.count("*").alias("times"))
    met = join_hot(keys.select("key", "s", "n"), stored(ends), ["key"], keys.count())
    met = met.where(F.col("s") != F.col("o.s")).where(_near_size("n", "o.n", percent))
    met = met.select(F.least("s", "o.s").alias("a"), F.greatest("s", "o.s").alias("b")).distinct()
    known = facts.select("s", "n", "bits")
    known_a, known_b = known.toDF("a", "na", "xa"), known.toDF("b", "nb", "xb")
    possible = stored(met.join(known_a, "a").join(known_b, "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(_possible(percent), "a long, b long"))
    first = stored(near_pairs(docs, possible, shingle, percent, id_col, text_col).toDF("u", "v"))

    # round 2: whole tiles, across components
    labels = components(first)
    labelled = keys.join(labels, F.col("s") == F.col("node"), "left").select("key", "s", "n", F.coalesce("root", "s").alias("label"))
    further = stored(tile_pairs(stored(labelled), facts, percent))
    second = near_pairs(docs, further, shingle, percent, id_col, text_col).toDF("u", "v")

    joined = components(stored(first.union(second)))
    roots = facts.join(joined, F.col("s") == F.col("node"), "left").select("s", "times", "least", F.coalesce("root", "s").alias("root"))
    roots = stored(roots)
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    known = stored(roots.join(least, "root").select("s", "times", "component_id"))
    filled, empty = rows.where("n > 0").select("id", "n", "s"), rows.where("n = 0")
    found = join_hot(filled, known, ["s"], rows.count()).select("id", "n", "component_id")
    found = found.unionByName(empty.select("id", "n", F.col("id").alias("component_id")))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
