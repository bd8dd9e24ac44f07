"""Streaming jobs: result reuse with expiry, watermark de-duplication, validation, counts."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billgrain.operators import reuse
from billgrain.operators.reuse import TTL_HOURS
from billgrain.session import shared_dir

#: Log of misses, by day and batch.
MISSES = "hash string, last_miss timestamp, day date, batch long"
#: What a batch leaves to the next: the time up to which arrivals were released. What waited at the end of a run is half a batch.
MARK = "batch double, released timestamp"


def files(spark: SparkSession, folder: str, name: str, batch_bytes: int = 10 * 1024**3) -> DataFrame:
    """A stream over the Parquet files of a folder that match ``name``, oldest first.

    ``batch_bytes`` bounds a micro-batch.
    """
    schema = spark.read.parquet(f"{folder}/{name}").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", name)
    return source.option("maxBytesPerTrigger", str(batch_bytes)).parquet(folder)


def folder(spark: SparkSession, name: str | None = None) -> str:
    """Where a stream keeps its rows and progress, in the shared folder.

    A job that is started again under the same name goes on where it stopped; without a name
    each start begins anew.
    """
    return f"{shared_dir(spark)}/streams/{name or uuid.uuid4().hex}"


def result(stream: DataFrame, name: str | None = None) -> DataFrame:
    """Process what is there; the rows of all batches so far."""
    spark = stream.sparkSession
    root = folder(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start(f"{root}/rows")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


class _ReuseJob:
    """The folders of a reuse stream and what happens to a micro-batch.

    ``misses``: the log of misses, partitioned by day and batch; a batch adds its own and reads
    the days that its expiry reaches back to, so what it writes grows with the batch and what it
    reads with the expiry, not with the history. ``held`` and ``mark``: arrivals not yet
    released and the time up to which they were; two places by turns, so that a batch that is
    run again finds what its predecessor left.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, ttl_hours: int, delay_hours: float | None):
        self.root, self.schema, self.ttl_hours, self.delay_hours = root, schema, ttl_hours, delay_hours
        self.flagged = T.StructType([*schema.fields, T.StructField("is_hit", T.BooleanType())])
        for place in (0, 1):
            spark.createDataFrame([], MARK).write.mode("ignore").parquet(f"{root}/mark/{place}")
        spark.createDataFrame([], self.flagged).write.mode("ignore").parquet(f"{root}/rows/-1")
        spark.createDataFrame([], MISSES).write.mode("ignore").partitionBy("day", "batch").parquet(f"{root}/misses")

    def last(self, spark: SparkSession, number: float) -> tuple[float | None, int, dt.datetime | None]:
        """Number, place and mark of the batch before ``number``."""
        found = [(r.batch, place, r.released) for place in (0, 1) for r in spark.read.schema(MARK).parquet(f"{self.root}/mark/{place}").collect()]
        return max((f for f in found if f[0] < number), default=(None, 1, None), key=lambda f: f[0])

    def flag(self, batch: DataFrame, number: float, finish: bool = False) -> None:
        spark = batch.sparkSession
        before, place, released = self.last(spark, number)
        rows = batch
        if before is not None and self.delay_hours is not None:
            rows = batch.unionByName(spark.read.schema(self.schema).parquet(f"{self.root}/held/{place}"))
        ready = rows
        if self.delay_hours is not None and not finish:
            newest = rows.agg((F.max("ts") - F.expr(f"INTERVAL '{self.delay_hours * 3600}' SECOND")).alias("t")).first().t
            released = max((t for t in (newest, released) if t is not None), default=None)
            # a moment is released once nothing of it can come any more
            waits = F.col("ts").isNotNull() & F.col("hash").isNotNull() & (F.lit(True) if released is None else F.col("ts") >= F.lit(released))
            rows.filter(waits).write.mode("overwrite").parquet(f"{self.root}/held/{1 - place}")
            ready = rows.filter(~waits)
        elif finish:
            spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(f"{self.root}/held/{1 - place}")
        path = f"{self.root}/rows/{number}"
        reuse.with_reuse(ready, self.ttl_hours, self.earlier(spark, ready, number)).write.mode("overwrite").parquet(path)
        self.log(spark.read.schema(self.flagged).parquet(path), number)
        mark = [(float(number), released)]
        spark.createDataFrame(mark, MARK).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/mark/{1 - place}")

    def earlier(self, spark: SparkSession, ready: DataFrame, number: float) -> DataFrame | None:
        """The last miss, before this batch, of each of its hashes that can still matter to it."""
        oldest = ready.agg((F.min("ts") - F.expr(f"INTERVAL {self.ttl_hours} HOURS")).alias("t")).first().t
        if oldest is None:
            return None
        log = spark.read.schema(MISSES).parquet(f"{self.root}/misses")
        log = log.filter((F.col("day") >= F.lit(oldest.date())) & (F.col("batch") < number))
        wanted = ready.filter("hash IS NOT NULL AND ts IS NOT NULL").select("hash").distinct()
        return log.join(wanted, "hash", "left_semi").groupBy("hash").agg(F.max("last_miss").alias("last_miss"))

    def log(self, flagged: DataFrame, number: float) -> None:
        number = int(number) if number == int(number) else -2 - int(number)
        missed = flagged.filter("NOT is_hit AND hash IS NOT NULL AND ts IS NOT NULL")
        missed = missed.select("hash", F.col("ts").alias("last_miss"), F.to_date("ts").alias("day"), F.lit(number).cast("long").alias("batch"))
        out = missed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch")
        out.parquet(f"{self.root}/misses")


def reuse_rows(
    arrivals: DataFrame, name: str | None = None, ttl_hours: int = TTL_HOURS, delay_hours: float | None = None, finish: bool = True
) -> str:
    """Flag a stream of arrivals (hash, ts, arrival_id) and return the pattern of the folders with the rows.

    Each micro-batch is flagged by the batch operator, which continues the chains from the
    last misses in the log, so a key with very many arrivals is no task's burden. See
    :func:`with_reuse` for ``delay_hours`` and ``finish``.
    """
    spark = arrivals.sparkSession
    root = folder(spark, name)
    job = _ReuseJob(spark, root, arrivals.schema, ttl_hours, delay_hours)
    query = arrivals.writeStream.foreachBatch(job.flag).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    if delay_hours is not None and finish:
        number = job.last(spark, float("inf"))[0]
        if number is not None and number == int(number):
            job.flag(spark.createDataFrame([], arrivals.schema), number + 0.5, finish=True)
    return f"{root}/rows/*"


def with_reuse(
    arrivals: DataFrame, name: str | None = None, ttl_hours: int = TTL_HOURS, delay_hours: float | None = None, finish: bool = True
) -> DataFrame:
    """Hit or miss for every arrival of a stream, by the same rule as the batch operator.

    Without ``delay_hours`` every arrival is answered in its batch, and arrivals have to come in
    time order from batch to batch; within a batch any order will do. With it, arrivals wait
    until the newest one is so much later, and are answered in time order: any split into
    batches and any order in which none comes later than that gives the batch operator's
    result. An arrival that is later still is a hit if a miss of its hash was found in the
    expiry before it or at any time after it, else a miss. ``finish`` answers the arrivals that wait at
    the end of what is there; leave it off for a named stream that will go on, where what comes
    next may belong before them. Arrivals without a hash or a
    time never wait.
    """
    rows = reuse_rows(arrivals, name, ttl_hours, delay_hours, finish)
    return arrivals.sparkSession.read.schema(flagged_schema(arrivals)).parquet(rows)


def flagged_schema(arrivals: DataFrame) -> T.StructType:
    return T.StructType([*arrivals.schema.fields, T.StructField("is_hit", T.BooleanType())])


def without_repeats(arrivals: DataFrame, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """First arrivals by watermark. Cheaper, but only roughly the rule of :func:`with_reuse`."""
    return arrivals.withWatermark("ts", f"{ttl_hours} hours").dropDuplicatesWithinWatermark(["hash"])


def hourly_counts(flagged: DataFrame) -> DataFrame:
    """Hits and misses per hour. Every row counts, however late, so the answer is the same for
    any micro-batches; the state is one row per hour. Run it with :func:`latest`."""
    return (
        flagged.groupBy(F.window("ts", "1 hour").alias("w"))
        .agg(F.count_if("is_hit").alias("hits"), F.count_if(~F.col("is_hit")).alias("misses"))
        .select(F.col("w.start").alias("hour"), "hits", "misses")
    )


def latest(totals: DataFrame, name: str | None = None) -> DataFrame:
    """The rows of a running aggregate once all that is there has been read.

    Each micro-batch writes the whole (small) aggregate anew, so a batch that is run again
    after a failure leaves the same rows.
    """
    spark = totals.sparkSession
    root = folder(spark, name)
    spark.createDataFrame([], totals.schema).write.mode("ignore").parquet(f"{root}/rows")
    query = (
        totals.writeStream.outputMode("complete")
        .foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{root}/rows"))
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(totals.schema).parquet(f"{root}/rows")
