"""Hubs, unexpected links, questions, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import is_file_label
from .graph import PropertyGraph


def god_nodes(graph: PropertyGraph, top_n: int = 10) -> DataFrame:
    """The nodes of highest degree that don't look like files; ties by id."""
    ranked = graph.degrees().join(graph.nodes.select("id", "label"), "id").filter(~is_file_label("label"))
    return ranked.select("id", "label", "degree").orderBy(F.desc("degree"), "id").limit(top_n)


def surprising_connections(graph: PropertyGraph, communities: DataFrame, top_n: int = 5, skip: tuple[str, ...] = ("imports", "imports_from", "contains", "method")) -> DataFrame:
    """Edges between non-files scored by doubt (AMBIGUOUS 3, INFERRED 2, else 1), by crossing
    files (2) and by crossing communities (1)."""
    side = graph.nodes.join(communities.select(F.col("node_id").alias("id"), "community_id"), "id", "left").select("id", "label", "source_file", "community_id")
    a, b = (side.select(*[F.col(c).alias(f"{p}_{c}") for c in side.columns]) for p in "ab")
    joined = graph.edges.filter(~F.coalesce(F.col("relation").isin(*skip), F.lit(False))).join(a, F.col("source") == F.col("a_id")).join(b, F.col("target") == F.col("b_id"))
    kept = joined.filter(~is_file_label("a_label") & ~is_file_label("b_label"))
    files = (F.coalesce("a_source_file", F.lit("")) != "") & (F.coalesce("b_source_file", F.lit("")) != "") & (F.col("a_source_file") != F.col("b_source_file"))
    apart = F.coalesce(F.col("a_community_id") != F.col("b_community_id"), F.lit(False))
    doubt = F.when(F.col("confidence") == "AMBIGUOUS", 3).when(F.col("confidence") == "INFERRED", 2).otherwise(1)
    # fixed values: the reasons' wording, part of the output
    why = F.array_compact(
        F.array(
            F.when(F.col("confidence") == "AMBIGUOUS", "tagged AMBIGUOUS").when(F.col("confidence") == "INFERRED", "inferred connection"),
            F.when(files, "crosses files"),
            F.when(apart, "bridges separate communities"),
        )
    )
    scored = kept.select(
        "source", "target", F.coalesce("a_label", "source").alias("source_label"), F.coalesce("b_label", "target").alias("target_label"), "relation", "confidence", (doubt + F.when(files, 2).otherwise(0) + F.when(apart, 1).otherwise(0)).alias("score"), F.array_join(why, "; ").alias("why")
    )
    return scored.orderBy(F.desc("score"), "source", "target").limit(top_n)


# The questions' wording, part of the output.
DOUBT_QUESTION = "What is the exact relationship between %s and %s?"
DOUBT_WHY = ("Edge tagged AMBIGUOUS (relation: ", ") - confidence is low.")
LONE_QUESTION = "Why are these entities disconnected: %s?"
LONE_WHY = "Isolated nodes may indicate missing relationships or dead code."


def suggest_questions(graph: PropertyGraph, top_n: int = 5) -> DataFrame:
    """(kind, question, why): one for each AMBIGUOUS edge in pair order, then one about isolated nodes."""
    names = graph.nodes.select("id", F.coalesce("label", "id").alias("name"))
    a, b = names.select(F.col("id").alias("a_id"), F.col("name").alias("a")), names.select(F.col("id").alias("b_id"), F.col("name").alias("b"))
    doubtful = graph.edges.filter("confidence = 'AMBIGUOUS'").join(a, F.col("source") == F.col("a_id")).join(b, F.col("target") == F.col("b_id"))
    why = F.concat(F.lit(DOUBT_WHY[0]), F.coalesce("relation", F.lit("")), F.lit(DOUBT_WHY[1]))
    asked = doubtful.select(F.lit("ambiguous_edge").alias("kind"), F.format_string(DOUBT_QUESTION, "a", "b").alias("question"), why.alias("why"), F.lit(0).alias("part"), "lo", "hi").orderBy("lo", "hi").limit(top_n)
    touched = graph.edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    first = names.join(touched, "id", "left_anti").orderBy("id").limit(3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "name"))), lambda x: x["name"]), ", ").alias("some"))
    asked_lone = first.filter("some != ''").select(
        F.lit("isolated_nodes").alias("kind"),
        F.format_string(LONE_QUESTION, "some").alias("question"),
        F.lit(LONE_WHY).alias("why"),
        F.lit(1).alias("part"),
        F.lit("").alias("lo"),
        F.lit("").alias("hi"),
    )
    return asked.unionByName(asked_lone).orderBy("part", "lo", "hi").limit(top_n).select("kind", "question", "why")


def graph_stats(graph: PropertyGraph, communities: DataFrame | None = None) -> dict[str, DataFrame]:
    """counts, confidence, relation, tag (exploded) and, if given, communities."""
    out = {"counts": graph.counts()}
    for c in ("confidence", "relation"):
        out[c] = graph.edges.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    out["tag"] = graph.nodes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    if communities is not None:
        out["communities"] = communities.agg(F.countDistinct("community_id").alias("n"))
    return out


def hub_nodes(nodes: DataFrame, edges: DataFrame, top_n: int = 10) -> DataFrame:
    """Degree over raw records, every edge counted and a loop twice; ties by id."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    return nodes.select("id", "label").join(ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")), "id").orderBy(F.desc("degree"), "id").limit(top_n)


def file_counts(nodes: DataFrame) -> DataFrame:
    return nodes.filter("source_file != ''").groupBy("source_file").agg(F.count(F.lit(1)).alias("n")).orderBy("source_file")


def core_and_unique(graphs: dict[str, PropertyGraph]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that all graphs have (kind, n); and by graph, those that it alone has,
    with the edges that touch one of its own nodes."""
    tagged = lambda pick: reduce(DataFrame.unionByName, [pick(g).withColumn("graph", F.lit(name)) for name, g in graphs.items()])
    has = {name: f"has_{i}" for i, name in enumerate(graphs)}
    held = [F.max(F.col("graph") == name).alias(c) for name, c in has.items()]
    by_node = tagged(lambda g: g.nodes.select("id")).groupBy("id").agg(*held, F.countDistinct("graph").alias("n"), F.min("graph").alias("graph"))
    by_edge = tagged(lambda g: g.edges.select("lo", "hi", "relation")).groupBy("lo", "hi", "relation").agg(*held)
    in_all = reduce(Column.__and__, [F.col(c) for c in has.values()])
    core = by_node.filter(in_all).agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("kind"), "n")
    core = core.unionByName(by_edge.filter(in_all).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("kind"), "n"))
    own = by_node.filter("n = 1").select("id", "graph")
    # each edge once, with the graphs that alone have its ends
    end = lambda c: own.select(F.col("id").alias(c), F.col("graph").alias(f"{c}_graph"))
    ended = by_edge.drop("relation").join(end("lo"), "lo", "left").join(end("hi"), "hi", "left").filter("lo_graph IS NOT NULL OR hi_graph IS NOT NULL")
    touching = ended.agg(*[F.count_if(F.col(c) & (F.col("lo_graph").eqNullSafe(name) | F.col("hi_graph").eqNullSafe(name))).alias(c) for name, c in has.items()])
    edges = touching.select(F.inline(F.array(*[F.struct(F.lit(name).alias("graph"), F.col(c).alias("edges")) for name, c in has.items()])))
    unique = own.groupBy("graph").agg(F.count(F.lit(1)).alias("nodes")).join(edges, "graph", "left")
    return core, unique.select("graph", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))
