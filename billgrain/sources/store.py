"""The store of processed invoices: hash, invoice JSON, cached_at, expires_at.

Files are partitioned by day and bucketed by hash. A lookup reads only the days that can still
be alive, and joins bucket by bucket: the wanted hashes are shuffled into the store's buckets,
the store itself stays where it is, however large it has become.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billgrain.operators import reuse
from billgrain.operators.reuse import TTL_HOURS

SCHEMA = "hash string, invoice string, cached_at timestamp, expires_at timestamp, cached_date date"
#: Buckets of a new store; a store keeps the number it was made with in its folder's name.
BUCKETS = 64


def _opened(spark: SparkSession, path: str, buckets: int) -> str:
    """The name under which this session knows the store in ``path``."""
    place = f"{path.rstrip('/')}/by_hash_{buckets}"
    name = f"results_{hashlib.md5(place.encode()).hexdigest()}"
    quoted = place.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({SCHEMA}) USING parquet PARTITIONED BY (cached_date) "
        f"CLUSTERED BY (hash) INTO {buckets} BUCKETS LOCATION '{quoted}'"
    )
    spark.catalog.refreshTable(name)  # other sessions may have added to it
    return name


def append(results: DataFrame, path: str, cached_at: Column, ttl_hours: int = TTL_HOURS, buckets: int = BUCKETS) -> None:
    """Write results (hash, invoice); rows without a hash (images) are not stored.

    A hash that comes twice is stored once, the latest of ``cached_at`` first and then the
    greatest JSON text, so a retried task cannot store another one. Fields that are NULL stay
    in the JSON.
    """
    rows = reuse.entries(results, cached_at, ttl_hours).select("hash", "invoice", "cached_at", "expires_at", "cached_date")
    name = _opened(results.sparkSession, path, buckets)
    # a task holds one bucket, so a day gets one file for each
    rows.repartition(buckets, "hash").write.mode("append").insertInto(name)


def live(spark: SparkSession, path: str, now: Column, ttl_hours: int = TTL_HOURS, buckets: int = BUCKETS) -> DataFrame:
    """Entries that have not expired, latest per hash; a store not yet made has none."""
    entries = spark.table(_opened(spark, path, buckets))
    oldest = F.to_date(now - F.expr(f"INTERVAL {ttl_hours} HOURS"))
    alive = entries.filter((F.col("cached_date") >= oldest) & (F.col("expires_at") > now))
    newest = F.max(F.struct("cached_at", "expires_at", "invoice")).alias("e")
    return alive.groupBy("hash").agg(newest).select("hash", "e.*")


def lookup(documents: DataFrame, path: str, now: Column, ttl_hours: int = TTL_HOURS, buckets: int = BUCKETS) -> DataFrame:
    """The documents (doc_id, hash) that the store answers, with the stored invoice.

    Copies of a document ask once: the store is joined with the different hashes only, and what
    it knows goes back to the documents in a join that adaptive execution can split.
    """
    wanted = documents.filter("hash IS NOT NULL").select("hash").distinct().repartition(buckets, "hash")
    known = live(documents.sparkSession, path, now, ttl_hours, buckets)
    return reuse.hits(documents, wanted.hint("merge").join(known, "hash"), now)


def clear(spark: SparkSession, path: str, buckets: int = BUCKETS) -> int:
    """Empty the store and return how many hashes it held."""
    name = _opened(spark, path, buckets)
    held = spark.table(name).select("hash").distinct().count()
    if held:
        mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
        try:
            spark.createDataFrame([], SCHEMA).write.mode("overwrite").insertInto(name)
        finally:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
        spark.catalog.refreshTable(name)
    return held


def write_responses(envelopes: DataFrame, path: str) -> None:
    """Answers to callers, one JSON object per line."""
    envelopes.select(F.col("response").alias("value")).write.mode("append").text(path)
