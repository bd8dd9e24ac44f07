"""Mixing sources to target weights through a tree of domains, languages and sources.

Weights go down the tree: a node's budget is dealt to its children in proportion to their
weights. A child that cannot hold its share gets what it has, and what it lacks goes to its
siblings; only what all of them together cannot hold reaches the parent's siblings. With the
capacities of whole subtrees known, one pass from the root does that: among siblings with
capacities c and weights w, each gets min(c, level * w), and the level is the largest of
(budget - capacities of those that fill earlier) / (weights from here on), taken in the order
of c / w. A leaf's budget becomes whole epochs and a prefix of one more, in the order of
digests of seed, epoch and id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billgrain.llm.common import n_words, stored, text_of
from billgrain.session import counted_keys

LEVELS = ("domain", "language", "origin")
#: Name of a node whose column is null.
UNNAMED = "(none)"
#: Hex digits of an order key that name its range: at most 4096 per leaf at every size.
RANGE_DIGITS = 3


def _weight(level: str, weights: dict[str, float]) -> Column:
    if not weights:
        return F.lit(1.0)
    named = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in (pair[0], float(pair[1]))])
    return F.coalesce(F.try_element_at(named, F.col(level)), F.lit(1.0))


def _dealt(nodes: DataFrame, parents: tuple[str, ...], name: str, budget: str) -> DataFrame:
    """Adds ``<name>_budget``: the parent's budget dealt by weight, never above the capacity."""
    group = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = group.orderBy("ratio", name)
    full = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    return (
        nodes.withColumn("ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))))
        .withColumn("at_least", F.when(rest > 0, (F.col(budget) - full) / rest))
        .withColumn("level", F.max("at_least").over(group))
        .withColumn(f"{name}_budget", F.least(F.col("capacity").cast("double"), F.col("level") * F.col("weight")))
        .drop("ratio", "at_least", "level", "weight", "capacity")
    )


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], target: Column, epochs: int) -> DataFrame:
    """``domain, language, origin, available, budget`` from leaves with ``available`` tokens.

    ``weights`` gives a level's weights by node name; other nodes weigh 1, a weight of 0 takes
    a node out. ``target`` is a column over ``available``, the tokens of all leaves.
    """
    leaves = leaves.withColumn("can", F.col("available") * epochs)
    total = leaves.agg(F.sum("available").alias("available"), F.sum("can").alias("can"))
    total = total.select(F.least(target.cast("double"), F.col("can").cast("double")).alias("root_budget"))
    nodes, budget = leaves.crossJoin(F.broadcast(total)), "root_budget"  # one row
    for depth, level in enumerate(LEVELS):
        path = LEVELS[: depth + 1]
        here = nodes.groupBy(*path).agg(F.sum("can").alias("capacity"), F.first(budget).alias(budget))
        here = _dealt(here.withColumn("weight", _weight(level, weights.get(level, {}))), path[:-1], level, budget)
        nodes = nodes.drop(budget).join(here.select(*path, f"{level}_budget"), list(path))
        budget = f"{level}_budget"
    return nodes.select(*LEVELS, "available", F.floor(F.col(budget) + F.lit(1e-6)).cast("long").alias("budget"))


def mixed(
    docs: DataFrame,
    domain: Column,
    language: Column,
    origin: Column,
    weights: dict[str, dict[str, float]],
    share: float = 0.5,
    epochs: int = 2,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The documents to read, one row per reading: all columns of ``docs``, the leaf and ``epoch``.

    The target is ``share`` of all tokens (words); no document is read more than ``epochs``
    times. A leaf's prefix ends before the document that would exceed its budget. Null texts
    have no tokens, null level values form nodes of their own, a null id has an order key of
    its own, rows with one id stand at one place and go together. Documents without tokens come
    with every whole epoch, and with a prefix that still has their place. An empty table gives
    no rows. Columns of ``docs`` may have any name but those of the levels and ``epoch``,
    which are replaced.
    """
    named = [F.coalesce(c.cast("string"), F.lit(UNNAMED)).alias(name) for c, name in zip((domain, language, origin), LEVELS, strict=True)]
    narrow = stored(docs.select(*named, F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), n_words(text_of(text_col)).alias("tokens")))
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("available"))
    budgets = leaf_budgets(leaves, weights, F.col("available") * F.lit(share), epochs).select(
        *LEVELS,
        F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(F.lit(0)).cast("int").alias("whole"),
        F.when(F.col("available") > 0, F.col("budget") % F.col("available")).otherwise(F.lit(0)).alias("left"),
    )
    _, budgets = counted_keys(budgets)

    def key(id: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(seed), F.col("whole").cast("string"), id))

    keyed = narrow.join(budgets, list(LEVELS)).withColumn("key", key(F.col("id"))).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    ranges = keyed.groupBy(*LEVELS, "range", "left").agg(F.sum("tokens").alias("tokens"))
    upto = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.withColumn("upto", F.sum("tokens").over(upto)).where(F.col("upto") > F.col("left"))
    # the first range that the prefix does not hold whole
    ends = ranges.groupBy(*LEVELS).agg(F.min(F.struct("range", F.expr("left - (upto - tokens) AS room"))).alias("end")).select(*LEVELS, "end.*")
    _, ends = counted_keys(ends)
    last = keyed.select(*LEVELS, "range", "key", "tokens").join(ends, [*LEVELS, "range"])
    running = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("key").rangeBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("upto", running).where(F.col("upto") <= F.col("room")).groupBy(*LEVELS).agg(F.max("key").alias("last"))
    cuts = budgets.join(ends, list(LEVELS), "left").join(last, list(LEVELS), "left")
    # a leaf without an end has tokens for its whole prefix only if it has none at all
    _, cuts = counted_keys(cuts.select(*LEVELS, "whole", F.coalesce("last", "range", F.lit("g")).alias("cut")))
    readings = F.col("whole") + (key(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) <= F.col("cut")).cast("int")
    kept = [c for c in docs.columns if c not in (*LEVELS, "epoch")]
    return (
        docs.select(*kept, *named)
        .join(cuts, list(LEVELS))
        .withColumn("readings", readings)
        .where("readings > 0")
        .select(*kept, *LEVELS, F.explode(F.sequence(F.lit(0), F.col("readings") - 1)).alias("epoch"))
    )
