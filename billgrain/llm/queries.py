"""Registered queries of the corpus operators, each on its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billgrain.llm import fertility, filteraudit, jaccard, licenses, linededup, mixing, neighbours, packing, resampling, sharding, simhash, toxicity, warc
from billgrain.llm.common import n_words, table, text_of
from billgrain.session import shared_dir

#: A document counts as toxic from this score on.
TOXIC = 0.7
#: Tokenisers are public files; their places are parameters of the operators.
WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"
#: Weights of the mix. The tables know no domains: a source's number stands for one.
MIX = {"domain": {"d0": 4, "d1": 2, "d2": 1, "d3": 1}, "language": {"en": 1, "de": 1, "fr": 1, "es": 2}}


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label may be learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def learnt(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    return toxicity.fitted(docs, table(spark, sf_dir, "labels").where(~held_out()))


def domain() -> Column:
    return F.concat(F.lit("d"), F.pmod(F.regexp_extract("source", r"(\d+)$", 1).try_cast("int"), F.lit(4)))


def mix(docs: DataFrame) -> DataFrame:
    return mixing.mixed(docs, domain(), F.col("lang"), F.col("source"), MIX, share=0.5, epochs=2, seed="mix")


def op1_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.toxic_spans(docs, learnt(spark, sf_dir, docs))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "spans")


def op2_line_edit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_classes(table(spark, sf_dir, "documents")).drop("body")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *mixing.LEVELS, n_words(text_of()).alias("tokens"), "epoch")


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}")


def op5_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fertility.fertility_verdicts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "byte_share", "evenness", "reasons")


def op6_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op7_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_rows(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op8_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op10_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.byte_shards(table(spark, sf_dir, "documents"), shards=16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_jaccard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_sets(table(spark, sf_dir, "documents"), shingle=5, percent=80)


def op13_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), longest=1, n_buckets=10_000, percent=10)


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxic_crf,
        op2_line_edit_dedup,
        op3_source_mix,
        op4_warc_index,
        op5_fertility_rules,
        op6_slack_packing,
        op7_graph_search,
        op8_simhash_classes,
        op9_license_scan,
        op10_byte_shards,
        op11_filter_audit,
        op12_jaccard_tiles,
        op13_importance_draw,
    )
}
