"""Exact deduplication that one huge group of copies doesn't slow.

Native expressions only. Copies meet three times, each time compared by digest and whole
content: within a task (Spark's partial aggregation, as the salt is the task's own), within
a salt of the digest's group, and among the winners of the salts. So a group of any size
sends at most one row from a task and then one from a salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

SALTS = 32


def _norm(text: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text), F.lit("")))


def _keyed(norm: str) -> list[Column]:
    return [F.sha2(F.col(norm).cast("binary"), 256).alias("_sha"), F.xxhash64(norm).alias("_h"), F.octet_length(norm).alias("_n")]


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row for each different text: _sha, _h, _n (digest, second hash and length), keep_id, group_size.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest
    id stays (null only if the group has no other). An empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("_id"), _norm(text).alias("_norm"))
    local = rows.groupBy(F.sha2(F.col("_norm").cast("binary"), 256).alias("_sha"), "_norm", (F.spark_partition_id() % salts).alias("_salt")).agg(F.max("_id").alias("_id"), F.count(F.lit(1)).alias("_size"))
    best = local.groupBy("_sha", "_norm").agg(F.max("_id").alias("keep_id"), F.sum("_size").alias("group_size"))
    return best.select("_sha", F.xxhash64("_norm").alias("_h"), F.octet_length("_norm").alias("_n"), "keep_id", "group_size")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows that share id and text share the verdict. The large side of the last join carries
    no texts; its copies lie on one key, which adaptive execution splits.
    """
    groups = duplicate_groups(docs, doc_id, text, salts)
    rows = docs.select(F.col(doc_id).alias("_id"), _norm(text).alias("_norm")).select("_id", *_keyed("_norm"))
    return rows.join(groups, ["_sha", "_h", "_n"]).select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256")
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns unchanged.

    Where several rows share the winning id, the one with the largest other columns stays.
    """
    key = ["_sha", "_h", "_n", "_none", "_some"]  # equality that holds between nulls, in columns that join and aggregation share
    of = lambda c: [F.col(c).isNull().alias("_none"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("_some")]
    groups = duplicate_groups(docs, doc_id, text, salts).select("_sha", "_h", "_n", *of("keep_id"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(F.col(doc_id).alias("_id"), _norm(text).alias("_norm"), row).select("_row", *_keyed("_norm"), *of("_id"))
    return rows.join(groups, key).groupBy(*key).agg(F.max("_row").alias("_row")).select("_row.*")
