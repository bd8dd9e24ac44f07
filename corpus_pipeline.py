"""From documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept; all
but the last return the columns of ``documents``. ``run`` writes each stage's rows to the shared
folder and reads them again, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billgrain.llm import linededup, packing, queries, simhash, toxicity
from billgrain.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field does not score as toxic."""
    scored = toxicity.toxic_spans(docs.select(*COLUMNS), queries.learnt(spark, sf_dir, docs))
    return scored.where(F.col("score") < queries.TOXIC).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; of lines that repeat, exactly or within an edit, only the first stays; lines under 20 characters repeat exactly."""
    return linededup.without_repeated_lines(docs.select(*COLUMNS), short=True).withColumn("n_chars", F.char_length("text").cast("long"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near fingerprints."""
    return simhash.one_of_each(docs.select(*COLUMNS))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights have them read."""
    return queries.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 2048 tokens."""
    return packing.packed_documents(docs, public_tokenizers.path(queries.WORD_BPE))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", without_near_copies),
    ("source_mix", mixed_sources),
    ("best_fit_packing", packed_sequences),
]

#: A fitted model decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
