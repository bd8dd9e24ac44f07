"""Reuse of earlier results by content hash, with expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billgrain.session import cut_lineage

TTL_HOURS = 24
#: A cell of time has two to this power slots.
CELL_BITS = 12


def first_of_each(documents: DataFrame, *order: str) -> DataFrame:
    """One row per hash: the first document and how many copies there are.

    An aggregate rather than a ranked window, so that copies meet partially summed and
    one content with a third of all rows is no burden on its task. Documents without a
    hash (images) are not known to be copies of anything: each stays as it is.
    """
    known = documents.filter("hash IS NOT NULL").groupBy("hash").agg(
        F.min(F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("n_copies")
    )
    unknown = documents.filter("hash IS NULL").select("hash", *order, F.lit(1).cast("long").alias("n_copies"))
    return known.select("hash", "first.*", "n_copies").unionByName(unknown)


def entries(results: DataFrame, cached_at: Column, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """Rows for the store of processed results: one per hash, latest wins, PDFs only.

    An ``invoice`` is kept as JSON with its NULL fields; of results of one moment the greatest
    text is kept, so every run keeps the same one.
    """
    stamped = results.filter("hash IS NOT NULL").withColumn("cached_at", cached_at)
    kept = ["cached_at"]
    if "invoice" in results.columns:
        stamped = stamped.withColumn("invoice", F.to_json("invoice", {"ignoreNullFields": "false"}))
        kept.append("invoice")
    latest = stamped.groupBy("hash").agg(F.max(F.struct(*kept)).alias("e")).select("hash", "e.*")
    return latest.withColumns(
        {
            "expires_at": F.col("cached_at") + F.expr(f"INTERVAL {ttl_hours} HOURS"),
            "cached_date": F.to_date("cached_at"),
        }
    )


def hits(documents: DataFrame, processed: DataFrame, now: Column) -> DataFrame:
    """Documents answered from the store: the stored ``invoice``, if the store holds one, and a
    perfect validation without errors or warnings, whatever it was.

    ``processed`` has one row per hash, so copies of a document join one to one; adaptive
    execution splits the side that holds many copies.
    """
    kept = [c for c in ("cached_at", "invoice") if c in processed.columns]
    live = processed.filter(now < F.col("expires_at")).select("hash", *kept)
    none = F.array().cast("array<string>")
    return documents.select("doc_id", "hash").join(live, "hash").select(
        "doc_id",
        "hash",
        *kept,
        F.lit("cache_hit").alias("processing_method"),
        F.lit(True).alias("is_valid"),
        none.alias("errors"),
        none.alias("warnings"),
        F.lit(100.0).alias("quality_score"),
    )


def misses(documents: DataFrame, processed: DataFrame, now: Column) -> DataFrame:
    """Documents without a live result; those without a hash are always here."""
    live = processed.filter(now < F.col("expires_at")).select("hash")
    return documents.join(live, "hash", "left_anti")


def invalidate(processed: DataFrame, doomed: DataFrame) -> DataFrame:
    """What is left of the store once the given hashes are taken out."""
    return processed.join(doomed.select("hash"), "hash", "left_anti")


def invalidation_report(processed: DataFrame, doomed: DataFrame) -> DataFrame:
    marked = processed.join(
        doomed.select("hash", F.lit(True).alias("gone")).distinct(), "hash", "left"
    )
    gone = F.coalesce("gone", F.lit(False))
    return marked.agg(
        F.count_if(gone).alias("deleted_count"), F.count_if(~gone).alias("kept_count")
    )


def with_reuse(arrivals: DataFrame, ttl_hours: int = TTL_HOURS, earlier: DataFrame | None = None) -> DataFrame:
    """Add ``is_hit`` to arrivals (hash, ts, arrival_id).

    An arrival is a hit within ``ttl_hours`` of the last miss of its hash. Hits do not
    prolong that time, so the answer needs the whole chain of misses from the start.
    Arrivals without a hash or a time are misses and take no part in any chain. Of arrivals
    at one moment the one with the smallest id comes first; rows equal in hash, time and id
    are one arrival. ``earlier`` (hash, last_miss; one row per hash) continues chains that
    began before these arrivals.

    One way for all sizes: every moment of a hash points to the first moment after its
    expiry, and the chain from the first moment is marked by pointer doubling, in about
    log2(time span / expiry) rounds of joins on (hash, moment).
    """
    placed = F.col("hash").isNotNull() & F.col("ts").isNotNull()
    timed = arrivals.filter(placed).withColumn("_t", F.unix_micros("ts"))
    moments = cut_lineage(timed.groupBy("hash", "_t").agg(F.min("arrival_id").alias("_first")))
    missed = _chain(moments.select("hash", "_t"), ttl_hours * 3_600_000_000, earlier)
    first = moments.join(missed, ["hash", "_t"], "left_semi")
    flagged = timed.join(first, ["hash", "_t"], "left").withColumn(
        "is_hit", F.coalesce(F.col("_first") != F.col("arrival_id"), F.lit(True))
    )
    unplaced = arrivals.filter(~placed).withColumn("is_hit", F.lit(False))
    return flagged.select(*unplaced.columns).unionByName(unplaced)


def _next_moments(moments: DataFrame, micros: int) -> DataFrame:
    """``hash, _t, to``: for each moment the first one of its hash at or after its expiry, if any.

    Time is cut into slots of a 4096th of the expiry and cells of 4096 slots. The answer is
    found within the slot of the expiry, else it is the first moment of the next slot in use,
    else that of the next cell. So no window holds more than a slot's moments, a cell's slots
    or a hash's cells, however many arrivals a hash has.
    """
    width = max(1, micros >> CELL_BITS)
    asked = F.col("_t") + micros
    none = F.lit(None).cast("long")
    rows = moments.select("hash", F.col("_t").alias("at"), F.col("_t").alias("moment"), none.alias("_t")).unionByName(
        moments.select("hash", asked.alias("at"), none.alias("moment"), "_t")
    )
    rows = rows.withColumn("slot", F.expr(f"(at - pmod(at, {width}L)) div {width}L"))
    slots = rows.groupBy("hash", "slot").agg(F.min("moment").alias("first")).withColumn("cell", F.shiftright("slot", CELL_BITS))
    cells = slots.groupBy("hash", "cell").agg(F.min("first").alias("first"))

    def later(*group: str, by: str) -> Column:
        order = Window.partitionBy(*group).orderBy(F.desc(by))
        return F.min("first").over(order.rowsBetween(Window.unboundedPreceding, -1))

    cells = cells.select("hash", "cell", later("hash", by="cell").alias("beyond"))
    slots = slots.select("hash", "cell", "slot", later("hash", "cell", by="slot").alias("next"))
    slots = slots.join(cells, ["hash", "cell"]).select("hash", "slot", F.coalesce("next", "beyond").alias("next"))
    # descending, so that the frame grows by rows; a range, so that equal times see each other
    here = Window.partitionBy("hash", "slot").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("to", F.min("moment").over(here)).filter("_t IS NOT NULL")
    found = found.join(slots, ["hash", "slot"]).select("hash", "_t", F.coalesce("to", "next").alias("to"))
    return found.filter("to IS NOT NULL")


def _chain(moments: DataFrame, micros: int, earlier: DataFrame | None) -> DataFrame:
    """(hash, _t) of all misses: each hash's first open moment and what follows it by expiry."""
    open_moments = moments
    if earlier is not None:
        known = earlier.select("hash", F.unix_micros("last_miss").alias("_last"))
        still = F.col("_last").isNull() | (F.col("_t") >= F.col("_last") + micros)
        open_moments = moments.join(known, "hash", "left").filter(still)
    starts = cut_lineage(open_moments.groupBy("hash").agg(F.min("_t").alias("_t")))
    jumps = [cut_lineage(_next_moments(moments, micros))]
    while not jumps[-1].isEmpty():
        jump = jumps[-1]
        # from here on only starts and moments that a jump reaches can be on a chain
        ends = jump.select("hash", F.col("to").alias("_t")).unionByName(starts.select("hash", "_t")).distinct()
        onward = jump.select("hash", F.col("_t").alias("to"), F.col("to").alias("_next"))
        twice = jump.join(ends, ["hash", "_t"], "left_semi").join(onward, ["hash", "to"])
        jumps.append(cut_lineage(twice.select("hash", "_t", F.col("_next").alias("to"))))
    chain = starts
    for jump in reversed(jumps[:-1]):
        both = F.explode(F.array_compact(F.array("_t", "to")))
        chain = chain.join(jump, ["hash", "_t"], "left").select("hash", both.alias("_t"))
    return chain


def last_misses(flagged: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """``hash, last_miss`` after these arrivals, to continue from (see :func:`with_reuse`)."""
    now = flagged.filter("NOT is_hit AND hash IS NOT NULL AND ts IS NOT NULL").select("hash", F.col("ts").alias("last_miss"))
    known = now if earlier is None else now.unionByName(earlier)
    return known.groupBy("hash").agg(F.max("last_miss").alias("last_miss"))


def statistics(flagged: DataFrame) -> DataFrame:
    """Hits, misses and the share of hits."""
    return flagged.agg(
        F.count_if("is_hit").alias("hits"),
        F.count_if(~F.col("is_hit")).alias("misses"),
        (F.count_if("is_hit").cast("double") / F.count(F.lit(1))).alias("hit_ratio"),
    )
