"""From a source tree to a graph: listing, filtering, extraction, construction and checks in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import compare, validate
from .operators.graph import PropertyGraph
from .operators.rounds import cut
from .sources import archives, detect, extract, files
from .sources.incremental import FactStore


@dataclass
class Built:
    """``graph``; ``files`` as detected (path, file_type, words, skipped); ``faults`` of records; ``version`` of the store, if one is used."""

    graph: PropertyGraph
    files: DataFrame
    faults: DataFrame
    version: int | None = None


def detected(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Files of a tree or an archive (path, text) and what they are (path, file_type, words, skipped). Ignore files within and above
    the root hold."""
    if files.is_archive(root):
        found, above = archives.read_archive(spark, root), None
    else:
        found, above = detect.read_tree(spark, root), detect.rules_above(spark, root)
    found = cut(found.select("path", "text"))
    rules = detect.ignore_rules(found)
    return found, cut(detect.detect(found, rules.unionByName(above) if above is not None else rules))


def code_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of the files that are extracted: code that no rule leaves out and no sign of a secret marks."""
    found, kinds = detected(spark, root)
    return found.join(kinds.filter("file_type = 'code' AND NOT skipped").select("path"), "path", "left_semi")


def graph_of(nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
    return PropertyGraph.build(nodes, edges).stored()


def build(spark: SparkSession, root: str, store: FactStore | None = None) -> Built:
    """The graph of the code under ``root``, a folder or an archive. With a ``store`` only files that changed since its last version are extracted."""
    found, kinds = detected(spark, root)
    code = found.join(kinds.filter("file_type = 'code' AND NOT skipped").select("path"), "path", "left_semi")
    version = store.update(code)[0] if store else None
    nodes, edges, _ = store.graph(version) if store else extract.extract(code)
    nodes, edges = cut(nodes), cut(edges)
    return Built(graph_of(nodes, edges), kinds, validate.validate(nodes, edges), version)


def compare_versions(store: FactStore, before: int, after: int, options: compare.Options | None = None) -> dict[str, DataFrame]:
    """Sections of ``compare`` for two versions of a store."""
    a, b = (graph_of(*store.graph(v)[:2]) for v in (before, after))
    return compare.compare(a, b, options)


def sizes(a: PropertyGraph, b: PropertyGraph, sections: dict[str, DataFrame]) -> DataFrame:
    """One row of counts: nodes and edges of both graphs, what was added, removed and modified, distance and composite."""
    by = lambda part: sections[part].agg(*[F.count(F.when(F.col("status") == s, 1)).alias(f"{part}_{s}") for s in ("added", "removed", "modified")])
    named = lambda g, k: g.counts().select(F.col("node_count").alias(f"nodes_{k}"), F.col("edge_count").alias(f"edges_{k}"))
    out = named(a, "a").crossJoin(named(b, "b"))
    for part in (by("nodes"), by("edges"), sections["distance"], sections["composite"]):
        out = out.crossJoin(part)  # single rows
    return out
