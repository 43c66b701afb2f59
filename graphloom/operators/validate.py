"""Validation of extraction records: messages, never a rejection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CONFIDENCES, FILE_TYPES


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, record, message) for every fault: missing fields, unknown file types and
    confidences, edges whose endpoint is no node. Null and empty count as missing."""
    missing = lambda c: F.col(c).isNull() | (F.col(c) == "")
    node = F.concat(F.lit("node "), F.coalesce("id", F.lit("")))
    checks = [F.when(missing(c), F.struct(F.lit("node_missing").alias("kind"), F.lit(c).alias("message"))) for c in ("id", "label", "file_type")]
    bad_type = ~missing("file_type") & ~F.col("file_type").isin(*FILE_TYPES)
    checks.append(F.when(bad_type, F.struct(F.lit("node_bad_file_type").alias("kind"), F.col("file_type").alias("message"))))
    of_nodes = nodes.select(node.alias("record"), F.explode(F.array_compact(F.array(*checks))).alias("e")).select("e.kind", "record", "e.message")

    ids = nodes.select(F.col("id").alias("_id")).filter("_id is not null").distinct()
    ends = edges.withColumn("_row", F.monotonically_increasing_id())
    for end in ("source", "target"):
        ends = ends.join(ids.select(F.col("_id").alias(f"_{end}")), F.col(end) == F.col(f"_{end}"), "left")
    edge = F.concat(F.lit("edge "), F.coalesce("source", F.lit("")), F.lit(" -> "), F.coalesce("target", F.lit("")))
    checks = [F.when(missing(c), F.struct(F.lit("edge_missing").alias("kind"), F.lit(c).alias("message"))) for c in ("source", "target", "relation", "confidence", "source_file")]
    bad = ~missing("confidence") & ~F.col("confidence").isin(*CONFIDENCES)
    checks.append(F.when(bad, F.struct(F.lit("edge_bad_confidence").alias("kind"), F.col("confidence").alias("message"))))
    checks += [F.when(~missing(c) & F.col(f"_{c}").isNull(), F.struct(F.lit(f"dangling_{c}").alias("kind"), F.col(c).alias("message"))) for c in ("source", "target")]
    of_edges = ends.select(edge.alias("record"), F.explode(F.array_compact(F.array(*checks))).alias("e")).select("e.kind", "record", "e.message")
    return of_nodes.unionByName(of_edges)
