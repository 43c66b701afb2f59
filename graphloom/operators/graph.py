"""The property graph: construction, lookups, projections, set operators."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import normalize_id
from ..schema import CONTAINMENT, EDGE, NODE
from .rounds import cut


def with_columns_of(df: DataFrame, schema) -> DataFrame:
    """``df`` with every column of the schema; those it lacks are null."""
    have = set(df.columns)
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in have})


def upsert_nodes(records: DataFrame, ordinal: str = "ord") -> DataFrame:
    """One row for each id; each attribute is its last non-null value by ordinal, so that a
    later record without it doesn't erase it. All attributes take one shuffle and one sort."""
    columns = [c for c in records.columns if c not in ("id", ordinal)]
    latest = Window.partitionBy("id").orderBy(F.desc(ordinal))
    whole = latest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = [F.first(F.when(F.col(ordinal).isNotNull(), F.col(c)), ignorenulls=True).over(whole).alias(c) for c in columns]
    return records.filter("id is not null").select("id", *last, F.row_number().over(latest).alias("_n")).filter("_n = 1").drop("_n")


def overwrite_edges(records: DataFrame, ordinal: str = "ord", directed: bool = False) -> DataFrame:
    """One row for each pair, the last record by ordinal: in an undirected graph a pair is
    unordered and the relation is no part of it. Adds lo and hi; source and target keep the direction."""
    pair = [F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")]
    keyed = records.select("*", *pair)
    keys = ["source", "target"] if directed else ["lo", "hi"]
    rest = [c for c in keyed.columns if c not in (*keys, ordinal)]
    # of each pair only the last leaves a task before the shuffle
    latest = Window.partitionBy(*keys).orderBy(F.desc(ordinal))
    return keyed.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").select(*keys, *rest)


def resolve_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with endpoints that are nodes, by id or else by normalised id (of several nodes,
    the largest id); edges with an unknown endpoint are dropped."""
    ids = nodes.select("id")
    by_norm = ids.groupBy(normalize_id("id").alias("_norm")).agg(F.max("id").alias("_by_norm"))
    for end in ("source", "target"):
        known = ids.withColumnRenamed("id", "_known")
        edges = edges.join(known, edges[end] == known["_known"], "left").withColumn("_n", normalize_id(end)).join(by_norm, F.col("_n") == F.col("_norm"), "left")
        edges = edges.withColumn(end, F.coalesce("_known", "_by_norm")).filter(F.col(end).isNotNull()).drop("_known", "_norm", "_n", "_by_norm")
    return edges


@dataclass
class PropertyGraph:
    """``nodes`` (id, …) and ``edges`` (source, target, lo, hi, relation, …), at most one edge for a pair."""

    nodes: DataFrame
    edges: DataFrame
    directed: bool = False
    metadata: dict = field(default_factory=dict)

    @classmethod
    def build(cls, nodes: DataFrame, edges: DataFrame, directed: bool = False, ordinal: str = "ord") -> PropertyGraph:
        """From extraction records: upsert nodes, resolve endpoints, drop dangling edges, let later edges overwrite."""
        merged = upsert_nodes(nodes, ordinal)
        return cls(merged, overwrite_edges(resolve_endpoints(edges, merged), ordinal, directed), directed)

    @classmethod
    def union(cls, parts: list[tuple[DataFrame, DataFrame]], directed: bool = False) -> PropertyGraph:
        """From several extractions in order; a later one overwrites."""
        tagged = [[df.withColumn("ord", F.struct(F.lit(i).alias("part"), F.col("ord").alias("ord"))) for df in part] for i, part in enumerate(parts)]
        nodes, edges = (reduce(DataFrame.unionByName, [t[k] for t in tagged]) for k in (0, 1))
        return cls.build(nodes, edges, directed)

    def stored(self) -> PropertyGraph:
        """The same graph as written tables, so that it is built once for all that is asked of it."""
        return PropertyGraph(cut(self.nodes), cut(self.edges), self.directed, self.metadata)

    def add_nodes(self, records: DataFrame) -> PropertyGraph:
        old = with_columns_of(self.nodes, records.drop("ord").schema).withColumn("ord", F.lit(-1).cast("long"))
        new = with_columns_of(records.withColumn("ord", F.col("ord").cast("long")), self.nodes.schema)
        return PropertyGraph(upsert_nodes(old.unionByName(new)), self.edges, self.directed, self.metadata)

    def add_edges(self, records: DataFrame) -> PropertyGraph:
        """Endpoints that are no nodes become nodes without attributes."""
        old = with_columns_of(self.edges.drop("lo", "hi"), records.drop("ord").schema).withColumn("ord", F.lit(-1).cast("long"))
        new = with_columns_of(records.withColumn("ord", F.col("ord").cast("long")), self.edges.drop("lo", "hi").schema)
        ends = records.select(F.explode(F.array("source", "target")).alias("id")).distinct().join(self.nodes, "id", "left_anti")
        nodes = self.nodes.unionByName(with_columns_of(ends, self.nodes.schema))
        return PropertyGraph(nodes, overwrite_edges(old.unionByName(new), directed=self.directed), self.directed, self.metadata)

    def remove_node(self, node: str) -> PropertyGraph:
        away = (F.col("source") != node) & (F.col("target") != node)
        return PropertyGraph(self.nodes.filter(F.col("id") != node), self.edges.filter(away), self.directed, self.metadata)

    def subgraph(self, ids: DataFrame) -> PropertyGraph:
        """Induced by the nodes among ``ids`` (column id); unknown ids are ignored."""
        nodes = self.nodes.join(ids.select("id").distinct(), "id", "left_semi")
        keep = nodes.select("id")
        edges = self.edges.join(keep, self.edges["source"] == keep["id"], "left_semi").join(keep, F.col("target") == keep["id"], "left_semi")
        return PropertyGraph(nodes, edges, self.directed, self.metadata)

    def to_undirected(self) -> PropertyGraph:
        """Of opposite arcs, the one with the larger (source, target) stays."""
        edges = overwrite_edges(self.edges.drop("lo", "hi").withColumn("ord", F.struct("source", "target")))
        return PropertyGraph(self.nodes, edges, False, dict(self.metadata))

    def rekey(self, mapping: DataFrame) -> PropertyGraph:
        """Ids renamed by ``mapping`` (id_b, id_a); others stay."""
        to = lambda c: mapping.select(F.col("id_b").alias(c), F.col("id_a").alias("_new"))
        nodes = self.nodes.join(to("id"), "id", "left").withColumn("id", F.coalesce("_new", "id")).drop("_new")
        edges = self.edges.drop("lo", "hi")
        for end in ("source", "target"):
            edges = edges.join(to(end), end, "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
        edges = edges.withColumns({"lo": F.least("source", "target"), "hi": F.greatest("source", "target")})
        return PropertyGraph(nodes, edges, self.directed, self.metadata)

    def has_node(self, node: str) -> bool:
        return not self.nodes.filter(F.col("id") == node).isEmpty()

    def edge(self, a: str, b: str) -> DataFrame:
        return self.edges.filter((F.col("source") == a) & (F.col("target") == b) if self.directed else (F.col("lo") == min(a, b)) & (F.col("hi") == max(a, b)))

    def sorted_nodes(self) -> DataFrame:
        return self.nodes.orderBy("id")

    def sorted_edges(self) -> DataFrame:
        return self.edges.orderBy("source", "target") if self.directed else self.edges.orderBy("lo", "hi")

    def adjacency(self) -> DataFrame:
        """(id, peer) for every neighbour; both ways in an undirected graph, a loop once."""
        ends = self.edges.select("source", "target")
        if self.directed:
            return ends.select(F.col("source").alias("id"), F.col("target").alias("peer"))
        ways = F.array_distinct(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("peer")), F.struct(F.col("target").alias("id"), F.col("source").alias("peer"))))
        return ends.select(F.inline(ways))

    def neighbors(self, node: str) -> DataFrame:
        return self.adjacency().filter(F.col("id") == node).select("peer").orderBy("peer")

    def degrees(self) -> DataFrame:
        """id, degree for every node; out-degree in a directed graph. A loop counts once."""
        counts = self.adjacency().groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
        return self.nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def counts(self) -> DataFrame:
        """node_count, edge_count, and edge_count_halved: half the adjacency entries, rounded
        down, in which a loop is half an edge."""
        loop = (F.col("source") == F.col("target")).cast("long")
        edges = self.edges.agg(F.count(F.lit(1)).alias("edge_count"), F.coalesce(F.sum(2 - loop), F.lit(0)).alias("_entries"))
        halved = F.col("edge_count") if self.directed else F.floor(F.col("_entries") / 2)
        return self.nodes.agg(F.count(F.lit(1)).alias("node_count")).crossJoin(edges).select("node_count", "edge_count", halved.alias("edge_count_halved"))

    def containment(self) -> DataFrame:
        """(parent, child) over contains and method edges."""
        return self.edges.filter(F.col("relation").isin(*CONTAINMENT)).select(F.col("source").alias("parent"), F.col("target").alias("child")).distinct()


def merge_semantic(ast: DataFrame, semantic: DataFrame) -> DataFrame:
    """Nodes of the syntax tree, each replaced whole by the semantic node of the same id if
    there is one (the last), followed by semantic nodes of new ids. Repeats within ``ast`` stay."""
    columns = [c for c in ast.columns if c not in ("id", "ord")]
    last = with_columns_of(semantic, ast.schema).groupBy("id").agg(F.max_by(F.struct(*columns), "ord").alias("_s"), F.min("ord").alias("_ord"))
    joined = ast.join(last, "id", "left").select("id", *[F.when(F.col("_s").isNotNull(), F.col(f"_s.{c}")).otherwise(F.col(c)).alias(c) for c in columns], F.struct(F.lit(0).alias("part"), F.col("ord").cast("long").alias("ord")).alias("ord"))
    new = last.join(ast.select("id").distinct(), "id", "left_anti").select("id", *[F.col(f"_s.{c}").alias(c) for c in columns], F.struct(F.lit(1).alias("part"), F.col("_ord").cast("long").alias("ord")).alias("ord"))
    return joined.unionByName(new)


def records(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with every column of the model."""
    return with_columns_of(nodes, NODE), with_columns_of(edges, EDGE)


def has_tag(tag: str | Column) -> Column:
    return F.coalesce(F.array_contains("tags", tag), F.lit(False))
