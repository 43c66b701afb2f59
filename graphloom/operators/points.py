"""Point queries: one question of a graph each, as a small DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import analyze, community, search, traverse
from .graph import PropertyGraph, has_tag

LEAVES, NODES = 100, 50


class GraphTools:
    """The questions over one graph and, if given, its communities (node_id, community_id) and vectors (id, vec)."""

    def __init__(self, graph: PropertyGraph, communities: DataFrame | None = None, vectors: DataFrame | None = None):
        self.graph, self.communities, self.vectors = graph, communities, vectors
        self.tree = graph.containment()

    def _id(self, label: str) -> str | None:
        found = search.find_node(self.graph.nodes, label).head()
        return found["id"] if found else None

    def _none(self, *columns: str) -> DataFrame:
        return self.graph.nodes.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in columns))

    def graph_stats(self) -> dict[str, DataFrame]:
        return analyze.graph_stats(self.graph, self.communities)

    def get_node(self, label: str) -> DataFrame:
        """The node's attributes, its parents and its number of children."""
        i = self._id(label)
        if i is None:
            return self.graph.nodes.limit(0)
        parents = self.tree.filter(F.col("child") == i).agg(F.array_sort(F.collect_set("parent")).alias("parents"))
        children = self.tree.filter(F.col("parent") == i).agg(F.count(F.lit(1)).alias("children"))
        return self.graph.nodes.filter(F.col("id") == i).crossJoin(parents).crossJoin(children)

    def get_neighbors(self, label: str, relation: str | None = None) -> DataFrame:
        i = self._id(label)
        if i is None:
            return self._none("peer", "relation", "confidence")
        touching = self.graph.edges.filter((F.col("source") == i) | (F.col("target") == i))
        touching = touching.filter(F.col("relation") == relation) if relation else touching
        return touching.select(F.when(F.col("source") == i, F.col("target")).otherwise(F.col("source")).alias("peer"), "relation", "confidence").orderBy("peer")

    def get_children(self, label: str) -> DataFrame:
        i = self._id(label)
        if i is None:
            return self._none("id", "label")
        return self.graph.nodes.join(self.tree.filter(F.col("parent") == i).select(F.col("child").alias("id")), "id", "left_semi").select("id", "label", "tags").orderBy("id")

    def shortest_path(self, source: str, target: str, max_hops: int = 0) -> list[str] | None:
        a, b = self._id(source), self._id(target)
        return None if a is None or b is None else traverse.shortest_path(self.graph.adjacency(), a, b, max_hops)

    def list_roots(self) -> DataFrame:
        return self.tree.select(F.col("parent").alias("id")).distinct().join(self.tree.select(F.col("child").alias("id")), "id", "left_anti").orderBy("id")

    def list_leaves(self, tag: str | None = None, limit: int = LEAVES) -> DataFrame:
        leaves = self.tree.select(F.col("child").alias("id")).distinct().join(self.tree.select(F.col("parent").alias("id")), "id", "left_anti")
        nodes = self.graph.nodes.filter(has_tag(tag)) if tag else self.graph.nodes
        return nodes.join(leaves, "id", "left_semi").select("id", "label").orderBy("id").limit(limit)

    def list_nodes(self, source_file: str | None = None, tag: str | None = None, file_type: str | None = None, limit: int = NODES) -> DataFrame:
        nodes = self.graph.nodes
        for column, value in (("source_file", source_file), ("file_type", file_type)):
            nodes = nodes.filter(F.col(column) == value) if value else nodes
        return (nodes.filter(has_tag(tag)) if tag else nodes).orderBy("id").limit(limit)

    def search(self, query: str, limit: int = 10) -> DataFrame:
        return search.score_nodes(self.graph, query).limit(limit)

    def semantic_search(self, query: list[float], limit: int = 10) -> DataFrame:
        if self.vectors is None:
            raise ValueError("no vectors are loaded")
        return search.rank_by_embedding(self.vectors, query, limit)

    def get_subgraph(self, labels: list[str], depth: int = 1) -> PropertyGraph:
        ids = [(i,) for i in map(self._id, labels) if i]
        starts = self.graph.nodes.sparkSession.createDataFrame(ids, "id string")
        return self.graph.subgraph(traverse.bfs(self.graph, starts, depth)[0])

    def query(self, text: str, depth: int = 2, top: int = 10, vector: list[float] | None = None) -> DataFrame:
        """The neighbourhood (id, dist) of the best hits, by vector if one is given."""
        hits = self.semantic_search(vector, top) if vector else self.search(text, top)
        return traverse.bfs(self.graph, hits.select("id"), depth)[0]

    def god_nodes(self, top_n: int = 10) -> DataFrame:
        return analyze.god_nodes(self.graph, top_n)

    def surprising_connections(self, top_n: int = 5) -> DataFrame:
        return analyze.surprising_connections(self.graph, self.communities, top_n)

    def suggest_questions(self, top_n: int = 5) -> DataFrame:
        return analyze.suggest_questions(self.graph, top_n)

    def community_info(self, community_id: int | None = None) -> DataFrame:
        """Cohesion of all communities, or of one; 0 is a community like any other."""
        scores = community.cohesion(self.graph, self.communities)
        return scores.orderBy("community_id") if community_id is None else scores.filter(F.col("community_id") == community_id)

    def trace_calls(self, tag: str, max_depth: int = 10, max_results: int = 20) -> DataFrame:
        return traverse.trace_tag(self.graph, tag, max_depth, max_results)


class RecordTools:
    """Questions over raw extraction records, where edges are directed and pairs may repeat."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    def node_detail(self, node: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == node)

    def neighbors(self, node: str) -> DataFrame:
        touching = self.edges.filter((F.col("source") == node) | (F.col("target") == node))
        return touching.select(F.when(F.col("source") == node, "out").otherwise("in").alias("way"), F.when(F.col("source") == node, F.col("target")).otherwise(F.col("source")).alias("peer"), "relation").orderBy("way", "peer")

    def file_nodes(self, source_file: str) -> DataFrame:
        return self.nodes.filter(F.col("source_file") == source_file).orderBy("id")

    def by_tag(self, tag: str) -> DataFrame:
        return self.nodes.filter(has_tag(tag)).orderBy("id")

    def callers(self, node: str) -> DataFrame:
        return self.edges.filter((F.col("relation") == "calls") & (F.col("target") == node)).select(F.col("source").alias("id")).distinct().orderBy("id")

    def callees(self, node: str) -> DataFrame:
        return self.edges.filter((F.col("relation") == "calls") & (F.col("source") == node)).select(F.col("target").alias("id")).distinct().orderBy("id")

    def files(self, part: str = "") -> DataFrame:
        return analyze.file_counts(self.nodes.filter(F.lower("source_file").contains(part.lower())))

    def roots(self) -> DataFrame:
        """Nodes without incoming edges."""
        return self.nodes.join(self.edges.select(F.col("target").alias("id")), "id", "left_anti").select("id", "label").orderBy("id")

    def leaves(self) -> DataFrame:
        """Nodes without outgoing edges."""
        return self.nodes.join(self.edges.select(F.col("source").alias("id")), "id", "left_anti").select("id", "label").orderBy("id")

    def path(self, source: str, target: str, max_hops: int = 10) -> list[tuple[str, str]] | None:
        """(node, relation that led to it) along a shortest path, edges taken either way."""
        found = traverse.shortest_path(traverse.raw_adjacency(self.edges), source, target, max_hops)
        if found is None:
            return None
        steps = self.nodes.sparkSession.createDataFrame([(i, *sorted(p)) for i, p in enumerate(zip(found, found[1:]))] or [], "i int, lo string, hi string")
        keyed = self.edges.select(F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi"), "relation")
        named = {r["i"]: r["relation"] for r in steps.join(keyed, ["lo", "hi"]).groupBy("i").agg(F.min("relation").alias("relation")).collect()}  # one row for each step
        return [(found[0], "")] + [(n, named.get(i, "")) for i, n in enumerate(found[1:])]

    def subgraph(self, node: str, depth: int = 2) -> DataFrame:
        """Different edges (source, relation, target) of nodes within ``depth`` steps."""
        starts = self.nodes.sparkSession.createDataFrame([("", node)], "origin string, id string")
        near = traverse.distances(traverse.raw_adjacency(self.edges), starts, depth).select(F.col("id").alias("n"))
        inside = self.edges.join(near, F.col("source") == F.col("n"), "left_semi").join(near, F.col("target") == F.col("n"), "left_semi")
        return inside.select("source", "relation", "target").distinct().orderBy("source", "target", "relation")

    def walk_chain(self, start: str, relation: str, direction: str = "out", max_depth: int = 5) -> DataFrame:
        return traverse.walk_chain(self.edges, start, relation, direction, max_depth)

    def hubs(self, top_n: int = 10) -> DataFrame:
        return analyze.hub_nodes(self.nodes, self.edges, top_n)

    def search_nodes(self, query: str, top: int = 10) -> DataFrame:
        return search.search_tokens(self.nodes, query, top)

    def search_comments(self, keyword: str, limit: int = 10) -> DataFrame:
        return search.search_comments(self.nodes, keyword, limit)

    def similar_nodes(self, text: str, top: int = 5, threshold: float = 0.05) -> DataFrame:
        docs = self.nodes.select(F.col("id").alias("doc_id"), search.node_document().alias("text"))
        idf, weights = search.term_weights(docs)
        asked = self.nodes.sparkSession.createDataFrame([("", text)], "doc_id string, text string")
        return search.top_matches(search.similar_pairs(search.query_weights(asked, idf), weights, threshold) if threshold > 0 else search.sparse_cosine(search.query_weights(asked, idf), weights), top, threshold).select(F.col("doc_b").alias("id"), "score").orderBy(F.desc("score"), "id")
