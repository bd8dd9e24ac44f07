"""Approximate nearest neighbours: a graph by NN-descent, and greedy search on it.

Rows with equal vectors are one node. A first graph comes from cells around pivot vectors, cut
into blocks in which all pairs are compared. Then neighbours of neighbours meet: each node is a
hub where its neighbours, and some nodes that it is a neighbour of, come together with their
vectors, and pairs that have not met before improve each other's lists. A search keeps for each
query the nearest nodes found, and in each round joins the best of them that it has not opened
yet with their neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billgrain.llm.common import short_batches, stored

#: Neighbours of a node in the graph, and reverse neighbours that take part beside them.
DEGREE, REVERSE = 24, 24
#: Layouts of cells, and vectors around which a layout's cells are laid: a sample by digest of
#: the id, sent to all tasks. One layout alone would never bring nodes of two cells together.
LAYOUTS, PIVOTS = 4, 128
#: Vectors of a block in which all pairs are compared.
BLOCK = 256
#: Rounds of NN-descent end when this share of the neighbours, or less, has changed.
SETTLED = 0.02
#: A search: nodes kept for each query, nodes opened in a round, pivots to start from.
BEAM, OPENED, ENTRIES = 320, 80, 16
#: Hubs compared at once.
HUBS = 64


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of two (stacks of) matrices."""
    products = a @ np.swapaxes(b, -1, -2)
    return np.maximum((a * a).sum(-1)[..., :, None] + (b * b).sum(-1)[..., None, :] - 2 * products, 0)


def _first_graph(nodes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``id, other, d``: neighbours inside blocks of cells around the pivots."""
    rows = nodes.sparkSession.sparkContext.broadcast(pivots)  # LAYOUTS * PIVOTS vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                far = _square(_matrix(batch.column("vector")), rows.value)
                for layout in range(min(LAYOUTS, far.shape[1])):
                    near = np.argsort(far[:, layout::LAYOUTS], axis=1)[:, :2].astype(np.int32)
                    number = pa.array(np.full(len(batch), layout, np.int32))
                    columns = [batch.column("id"), batch.column("vector"), number, pa.array(near[:, 0]), pa.array(near[:, -1])]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "vector", "layout", "cell", "second"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                # the last block of a batch reaches back, so that none is small
                some = batch.slice(max(0, min(at, len(batch) - BLOCK)), BLOCK)
                ids, x = some.column("id").to_numpy(), _matrix(some.column("vector"))
                d = _square(x, x)
                np.fill_diagonal(d, np.inf)
                k = min(DEGREE, len(ids) - 1)
                if k:
                    near = np.argpartition(d, k - 1, axis=1)[:, :k]
                    owner = np.repeat(np.arange(len(ids)), k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(ids[near.ravel()]), pa.array(d[owner, near.ravel()])], ["id", "other", "d"])

    kind = nodes.schema["vector"].dataType.simpleString()
    cells = nodes.mapInArrow(assign, f"id long, vector {kind}, layout int, cell int, second int")
    place = ["layout", "cell", "second", "id"]
    blocks = cells.repartitionByRange(*place).sortWithinPartitions(*place)
    return blocks.select("id", "vector").mapInArrow(compare, "id long, other long, d double").distinct()


def _best(edges: DataFrame) -> DataFrame:
    """The ``DEGREE`` nearest different neighbours of each node; ``fresh`` if it was none before."""
    each = edges.groupBy("id", "other").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))
    return each.withColumn("rank", rank).where(F.col("rank") <= DEGREE).drop("rank")


def _reverse(edges: DataFrame, seed: int) -> DataFrame:
    """``id, other``: nodes that have ``id`` as a neighbour, ``REVERSE`` of them by a seeded digest."""
    turn = F.row_number().over(Window.partitionBy("other").orderBy(F.xxhash64("id", "other", F.lit(seed)), "id"))
    turned = edges.withColumn("turn", turn).where(F.col("turn") <= REVERSE)
    return turned.select(F.col("other").alias("id"), F.col("id").alias("other"))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbours of one hub that come near enough for the list of either."""
    for batch in batches:
        for at in range(0, len(batch), HUBS):
            lists = batch.column("near").slice(at, HUBS)
            sizes = lists.value_lengths().to_numpy()
            flat = lists.flatten()
            ids, worst = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("other", "worst"))
            x = _matrix(flat.field("vector"))
            most, hub = int(sizes.max()), np.repeat(np.arange(len(sizes)), sizes)
            slot = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            place = np.full((len(sizes), most), -1)
            place[hub, slot] = np.arange(len(ids))
            wide = np.zeros((len(sizes), most, x.shape[1]))
            wide[hub, slot] = x
            d = _square(wide, wide)
            h, i, j = np.nonzero(np.triu(np.ones((most, most), bool), 1)[None] & (place[:, :, None] >= 0) & (place[:, None, :] >= 0))
            a, b, far = place[h, i], place[h, j], d[h, i, j]
            left, right = far < worst[a], far < worst[b]
            owner, other = np.r_[ids[a[left]], ids[b[right]]], np.r_[ids[b[left]], ids[a[right]]]
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(other), pa.array(np.r_[far[left], far[right]])], ["id", "other", "d"])


def _pivots(nodes: DataFrame) -> tuple[list[int], np.ndarray]:
    rows = nodes.orderBy(F.xxhash64("id"), "id").limit(LAYOUTS * PIVOTS).collect()
    return [r["id"] for r in rows], np.array([r["vector"] for r in rows], np.float64)


def graph(nodes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``id, other, d, fresh``: the ``DEGREE`` nearest neighbours of each node that NN-descent finds.

    ``nodes``: different vectors of one length by ``id``; ``d`` is the squared distance. Lists only
    get nearer, so that rounds end.
    """
    edges = stored(_best(_first_graph(nodes, pivots).withColumn("fresh", F.lit(1))))
    total = edges.count()
    for turn in count():
        # a node's list takes nothing beyond its last entry, once it is full
        worst = edges.groupBy("id").agg(F.when(F.count("*") >= DEGREE, F.max("d")).otherwise(F.lit(float("inf"))).alias("worst"))
        members = edges.select("id", "other").unionByName(_reverse(edges, turn)).distinct().withColumnRenamed("id", "hub")
        with_vectors = nodes.join(worst, "id", "left").select(F.col("id").alias("other"), "vector", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
        hubs = members.join(with_vectors, "other").groupBy("hub").agg(F.collect_list(F.struct("other", "worst", "vector")).alias("near"))
        found = hubs.where("size(near) > 1").select("near").mapInArrow(_meet, "id long, other long, d double")
        known = edges.withColumn("fresh", F.lit(0))
        edges = stored(_best(known.unionByName(found.distinct().withColumn("fresh", F.lit(1)))))
        sizes = edges.agg(F.count("*").alias("n"), F.sum("fresh").alias("fresh")).first()
        if (sizes["fresh"] or 0) <= SETTLED * max(total, 1):
            break
        total = sizes["n"]
    return edges


def search(nodes: DataFrame, edges: DataFrame, queries: DataFrame, entries: tuple[list[int], np.ndarray], keep: int) -> DataFrame:
    """``query, node, distance``: the ``keep`` nearest nodes that greedy search finds for each query.

    ``queries``: ``query, vector``. Every round opens for each query up to ``OPENED`` of its
    ``BEAM`` nearest nodes so far; a query is done when all of them are open. Every node stands
    around its nearest neighbour, also where that has more than ``REVERSE`` reverse neighbours.
    """
    ids, vectors = entries
    nearest_link = edges.groupBy("id").agg(F.min_by("other", F.struct("d", "other")).alias("other")).select(F.col("other").alias("id"), F.col("id").alias("other"))
    around = edges.select("id", "other").unionByName(_reverse(edges, 0)).unionByName(nearest_link).groupBy("id").agg(F.collect_set("other").alias("around"))
    around = stored(around)
    places = nodes.sparkSession.sparkContext.broadcast((np.array(ids, np.int64), vectors))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, rows = places.value
        for batch in batches:
            if len(batch):
                k = min(ENTRIES, len(pivots))
                near = np.argsort(_square(_matrix(batch.column("vector")), rows), axis=1)[:, :k]
                owner = np.repeat(np.arange(len(batch)), k)
                yield pa.RecordBatch.from_arrays([batch.column("query").take(pa.array(owner)), pa.array(pivots[near.ravel()])], ["query", "node"])

    measured = lambda pairs: (
        pairs.join(nodes.select(F.col("id").alias("node"), F.col("vector").alias("there")), "node")
        .join(queries, "query")
        .select("query", "node", distance(F.col("there"), F.col("vector")).alias("distance"))
    )
    nearest = Window.partitionBy("query").orderBy("distance", "node")

    def best(pool: DataFrame) -> DataFrame:
        """The nearest ``BEAM`` of each query, and which of them are next."""
        ranked = pool.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= BEAM)
        waiting = F.sum((~F.col("open")).cast("int")).over(nearest.rowsBetween(Window.unboundedPreceding, 0))
        return stored(ranked.withColumn("next", ~F.col("open") & (waiting <= OPENED)))

    pool = best(measured(queries.mapInArrow(enter, "query long, node long")).withColumn("open", F.lit(False)))
    while not (opened := pool.where("next")).isEmpty():
        reached = opened.join(around, F.col("node") == F.col("id")).select("query", F.explode("around").alias("node")).distinct()
        new = measured(reached.join(pool, ["query", "node"], "left_anti")).withColumn("open", F.lit(False))
        pool = best(pool.select("query", "node", "distance", (F.col("open") | F.col("next")).alias("open")).unionByName(new))
    return pool.where(F.col("rank") <= keep).select("query", "node", "distance")


def nearest_rows(rows: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, id, score``: for rows whose id ``every`` divides, the ``k`` nearest other rows found.

    The score is the Euclidean distance in double precision; equal ones go by the smaller id.
    Rows with a null id, and vectors that are null, zero, or hold a null or a non-finite component, take
    no part. Only vectors of one length can be compared: those of the most frequent length (of equally
    frequent ones, the longest) take part. Ids are whole numbers of any width. Repeated rows of one id and vector count once. A table
    without usable rows, or with one alone, gives no rows; other columns are not read.
    """
    short_batches(rows.sparkSession)
    valid = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    valid = stored(valid.distinct())
    lengths = valid.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(2).collect()
    if len(lengths) > 1:
        valid = valid.where(F.size("vector") == lengths[0]["n"])
    named = stored(valid.groupBy("vector").agg(F.min("id").alias("node")))
    nodes = named.select(F.col("node").alias("id"), "vector")
    # of rows with equal vectors a query can only get the first ones, besides itself
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    twins = valid.join(named, "vector").select("node", "id")
    for by in ([F.col("node"), salt], [F.col("node")]):
        twins = twins.withColumn("no", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("no") <= k + 1).drop("no")
    twins = stored(twins)
    asked = valid.where(F.col("id") % every == 0).join(named, "vector").select(F.col("id").alias("query_id"), F.col("node").alias("query"))
    entries = _pivots(nodes)
    if len(entries[0]) < 1:
        pairs = twins.select(F.col("node").alias("query"), "node", F.lit(0.0).alias("distance"))
    else:
        edges = graph(nodes, entries[1])
        queries = stored(asked.select("query").distinct().join(nodes, F.col("query") == F.col("id")).select("query", "vector"))
        pairs = search(nodes, edges, queries, entries, k + 1)
    found = asked.join(pairs, "query").join(twins, "node").where(F.col("id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", F.col("id").alias(id_col), F.col("distance").alias("score"))
