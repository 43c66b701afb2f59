"""From raw documents to packed training sequences, in five stages.

Each stage reads what its predecessor kept, as a written table, and all but the last return
the columns they were given. Documents are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, harmonic, langid, raking, setsketch
from graphloom.llm.common import materialize, table

TOKENIZER = "word_bpe_49k.json"
MIX_BUDGET, MIX_POWERS = 0.9, {"source": 0.9, "lang": 0.9, "topic": 0.9}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in no language: without letters, or better explained by noise
    or by no language in particular. The column lang counts as declared, source as host."""
    model = langid.fit(docs)
    key = F.xxhash64("text", "lang", "source")
    rows = docs.select("doc_id", key.alias("_key"), "text", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.lit(None).cast("string").alias("domain"), F.col("source").alias("host"))
    rejected = materialize(langid.identify(rows, model).filter("not accepted").select(F.col("doc_id").alias("_id"), "_key").distinct(), "rejected")
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["_id"]) & (key == rejected["_key"]), "left_anti")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, that with the largest doc_id."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id."""
    dropped = materialize(setsketch.near_duplicates(docs).filter("not kept").select("doc_id").distinct(), "dropped")
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens by source, language and topic meet tempered targets."""
    return raking.sample(docs, MIX_BUDGET, MIX_POWERS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return harmonic.harmonic_pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mixture", mixture), ("packing", packing)]

#: Tokenisation can't be written in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
