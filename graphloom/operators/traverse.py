"""Traversals as frontier joins. Each level is one join, one aggregation and one checkpoint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import PropertyGraph, has_tag
from .rounds import cut


def distances(adjacency: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(origin, id, dist) of all nodes within ``depth`` steps of each origin; ``starts`` has origin and id.
    None goes on until nothing new is found. Shared by single- and multi-source searches."""
    frontier = cut(starts.select("origin", "id").distinct())
    levels, step = [frontier.withColumn("dist", F.lit(0))], 0
    while depth is None or step < depth:
        step += 1
        reached = frontier.join(adjacency, "id").select("origin", F.col("peer").alias("id")).distinct()
        # a node's neighbours lie on its own level, the one before or the one after, but arcs can lead further back
        seen = reduce(DataFrame.unionByName, [x.select("origin", "id") for x in levels])
        frontier = cut(reached.join(seen, ["origin", "id"], "left_anti"))
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("dist", F.lit(step)))
    return reduce(DataFrame.unionByName, levels)


def bfs(graph: PropertyGraph, starts: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Visited (id, dist) in id order, and the edges at nodes that were expanded (nearer than
    ``depth``), each once. Starts that are no nodes are ignored."""
    known = starts.select("id").join(graph.nodes.select("id"), "id", "left_semi")
    found = distances(graph.adjacency(), known.select(F.lit("").alias("origin"), "id"), depth)
    visited = found.select("id", "dist")
    expanded = visited.filter(F.col("dist") < depth).select(F.col("id").alias("_x"))
    ends = F.col("source") == F.col("_x") if graph.directed else (F.col("source") == F.col("_x")) | (F.col("target") == F.col("_x"))
    if graph.directed:
        edges = graph.edges.join(expanded, ends, "left_semi")
    else:  # two equi-joins rather than one with an OR, which would be a nested loop
        hit = [graph.edges.join(expanded, graph.edges[c] == F.col("_x"), "left_semi") for c in ("source", "target")]
        edges = hit[0].unionByName(hit[1]).dropDuplicates(["lo", "hi"])
    return visited.orderBy("id"), edges.orderBy("source", "target")


def shortest_path(adjacency: DataFrame, source: str, target: str, max_hops: int = 0) -> list[str] | None:
    """The shortest path, of several the smallest sequence of ids; None beyond ``max_hops`` (0: no
    limit). A node reaches itself even if it is none of the graph's.

    Levels hold each node once, with no path. The path is then walked: back from the target to
    the nodes of each level that lead to it, and forward by the smallest of these.
    """
    if source == target:
        return [source]
    frontier = adjacency.sparkSession.createDataFrame([(source,)], "id string")
    levels = [frontier]
    while not max_hops or len(levels) <= max_hops:
        seen = reduce(DataFrame.unionByName, levels)
        frontier = cut(frontier.join(adjacency, "id").select(F.col("peer").alias("id")).distinct().join(seen, "id", "left_anti"))
        found = frontier.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("id") == target).alias("hit")).first()
        if found["hit"]:
            break
        if not found["n"]:
            return None
        levels.append(frontier)
    else:
        return None
    onward = [adjacency.sparkSession.createDataFrame([(target,)], "peer string")]
    for level in reversed(levels[1:]):
        into = adjacency.join(onward[-1], "peer", "left_semi").join(level, "id", "left_semi")
        onward.append(cut(into.select(F.col("id").alias("peer")).distinct()))
    path = [source]
    for ahead in reversed(onward):
        path.append(adjacency.filter(F.col("id") == path[-1]).join(ahead, "peer", "left_semi").agg(F.min("peer")).first()[0])
    return path


def walk_chain(edges: DataFrame, start: str, relation: str, direction: str = "out", max_depth: int = 5) -> DataFrame:
    """(id, depth): nodes reached from ``start`` along one relation, each once, at its least depth."""
    a, b = ("source", "target") if direction == "out" else ("target", "source")
    adjacency = edges.filter(F.col("relation") == relation).select(F.col(a).alias("id"), F.col(b).alias("peer")).distinct()
    starts = edges.sparkSession.createDataFrame([("", start)], "origin string, id string")
    return distances(adjacency, starts, max_depth).select("id", F.col("dist").alias("depth")).orderBy("depth", "id")


def raw_adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of raw records, repeats removed."""
    return edges.select(F.inline(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("peer")), F.struct(F.col("target").alias("id"), F.col("source").alias("peer"))))).distinct()


def impact(graph: PropertyGraph, changed: DataFrame, depth: int = 3, top_k: int = 20, shown: int = 10) -> DataFrame:
    """(id, affected, ids): for each changed node that reaches any the number of others within ``depth``
    steps of it (either way along edges) and the first few ids; largest first."""
    starts = changed.select(F.col("id").alias("origin"), "id").distinct()
    near = distances(graph.adjacency(), starts, depth).filter("id != origin")
    top = near.groupBy("origin").agg(F.count(F.lit(1)).alias("affected")).orderBy(F.desc("affected"), "origin").limit(top_k)
    ids = near.join(F.broadcast(top.select("origin")), "origin", "left_semi").withColumn("n", F.row_number().over(_first("origin", "id"))).filter(F.col("n") <= shown).groupBy("origin").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return top.join(ids, "origin").select(F.col("origin").alias("id"), "affected", "ids").orderBy(F.desc("affected"), "id")


def ranked_impact(a: PropertyGraph, b: PropertyGraph, changes: DataFrame, depth: int = 3, top_k: int = 20) -> DataFrame:
    """(id, change, affected, ids) for the nodes of ``changes`` (id, status): removed ones by their reach
    in ``a``, the others in ``b``; largest first, ties by id."""
    now = impact(b, changes.filter("status != 'removed'"), depth, top_k)
    gone = impact(a, changes.filter("status = 'removed'"), depth, top_k)
    both = now.unionByName(gone).join(changes.select("id", F.col("status").alias("change")), "id")
    return both.select("id", "change", "affected", "ids").orderBy(F.desc("affected"), "id").limit(top_k)


def _first(group: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(group).orderBy(order)


def reverse_calls(graph: PropertyGraph) -> DataFrame:
    """(id, peer): callee and caller."""
    return graph.edges.filter("relation = 'calls'").select(F.col("target").alias("id"), F.col("source").alias("peer")).distinct()


def trace_tag(graph: PropertyGraph, tag: str, max_depth: int = 10, max_results: int = 20) -> DataFrame:
    """(target, path): call chains that end in nodes with the tag, root first.

    From every tagged node callers are searched breadth first, each node visited once per
    target, under the path of its earliest finder. A path is given where the search can't go
    on (no callers, or only visited ones) and at the depth limit; a node alone is none.
    The first ``max_results`` by target and path stay.
    """
    calls = cut(reverse_calls(graph))
    frontier = cut(graph.nodes.filter(has_tag(tag)).select(F.col("id").alias("target"), "id", F.array("id").alias("path")))
    seen, ends, depth = frontier.select("target", "id"), [], 0
    while not frontier.isEmpty():
        if depth >= max_depth:
            ends.append(frontier.select("target", "path"))
            break
        stepped = frontier.join(calls, "id").select("target", F.col("id").alias("from"), F.col("peer").alias("id"), F.concat("path", F.array("peer")).alias("path"))
        grown = cut(stepped.join(seen, ["target", "id"], "left_anti").groupBy("target", "id").agg(F.min("path").alias("path")))
        on = grown.select("target", F.element_at("path", -2).alias("id")).distinct()
        ends.append(frontier.join(on, ["target", "id"], "left_anti").select("target", "path"))
        seen, frontier, depth = seen.unionByName(grown.select("target", "id")), grown.select("target", "id", "path"), depth + 1
    if not ends:
        return frontier.select("target", "path").limit(0)
    chains = reduce(DataFrame.unionByName, ends).filter(F.size("path") > 1)
    return chains.select("target", F.reverse("path").alias("path")).orderBy("target", F.size("path"), "path").limit(max_results)


def names_of(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Paths with (id, label) for each step."""
    steps = paths.withColumn("row", F.monotonically_increasing_id()).select("row", "target", F.posexplode("path").alias("pos", "id"))
    named = steps.join(nodes.select("id", "label"), "id", "left").groupBy("row", "target").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "label"))).alias("s"))
    return named.select("target", F.transform("s", lambda x: F.struct(x["id"].alias("id"), x["label"].alias("label"))).alias("path"))


def label_of(c: str) -> Column:
    return F.coalesce(F.col(c), F.col("id"))
