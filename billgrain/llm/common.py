"""Shared by the corpus operators: tables, words, stored intermediate tables, Arrow batches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billgrain.session import shared_dir

#: Words are runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch: texts differ in size, so batches are kept short.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def stored(df: DataFrame) -> DataFrame:
    """The rows written as a table in the shared folder and read again.

    Every executor can reach that folder, so a lost executor costs no recomputation of
    what stands before. Nothing is kept in memory.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and bytes (runtime SQL settings)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: A key with this part of all rows or more is hot: there are at most so many of them.
HOT_KEYS = 1000


def join_hot(rows: DataFrame, facts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row per key and in ``times`` the rows of that key.

    Keys with at least one in ``HOT_KEYS`` of all ``total`` rows, so at most ``HOT_KEYS`` of them,
    are broadcast and their rows stay where they are; only the other rows are shuffled. Both
    tables should be stored ones, as they are read more than once; keys must not be null.
    """
    hot = F.col("times") * HOT_KEYS >= total
    often, rarely = facts.where(hot), facts.where(~hot)
    stay = rows.join(F.broadcast(often), keys)
    move = rows.join(F.broadcast(often.select(*keys)), keys, "left_anti").join(rarely, keys)
    return stay.unionByName(move)
