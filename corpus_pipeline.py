"""Corpus pipeline: five stages over `documents`, each one operator of
wearcast.llm.  A stage takes (spark, docs, sf_dir), works on all rows that its
predecessor kept, and returns the columns of documents (the last one returns
the encoded texts).

1. quality       documents scored below the acceptance limit go.
2. near_dedup    one document of each group of near-duplicates stays (5 words, 0.8).
3. decontaminate documents that hold a benchmark window go.
4. secrets       secret spans are replaced in the text; n_chars follows it.
5. encode        doc_id, n_tokens and ids of each text.

Null texts are empty.  Rows that share a doc_id are one document and stay or go
together; rows without doc_id are one document where their texts are equal, and
of a group of near-duplicates a document with doc_id stays before one without.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearcast.llm import bpe_codec, decontam, minhash, quality_gbt, secret_scan
from wearcast.llm.common import Scratch, table

ORACLE_SQL = None  # trees, hashing and BPE are beyond SQL; tests/llm compares the stages with brute force


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with `_key`: doc_id, or a number made from the text, above usual ids, where there is none."""
    made = F.lit(1 << 61) + F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << 60) - 1))
    return docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), made))


def _plain(keyed: DataFrame) -> DataFrame:
    return keyed.select(F.col("_key").alias("doc_id"), "text")


def _without(keyed: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of keyed docs whose key is not in ids."""
    return keyed.join(ids.select(F.col("doc_id").alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_gbt.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_gbt.with_score(docs, model, "_quality_score")
    return scored.where(F.col("_quality_score") >= quality_gbt.ACCEPT).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    found = minhash.near_duplicates(_plain(keyed), width=5, percent=80)
    return _without(keyed, found.where(~F.col("kept"))).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _keyed(docs)
    found = decontam.find_contamination(_plain(keyed), table(spark, sf_dir, "benchmark"))
    return _without(keyed, found.where(F.size("items") > 0)).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact(docs, secret_scan.train(docs))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_codec.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("secrets", secrets), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages; each stage's rows are written to the shared folder."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs
