"""Exports: node-link JSON, GraphML, Cypher, Mermaid, Obsidian notes, report, view rows.

Row formats are text DataFrames that Spark writes in parts; documents meant for people
(Mermaid, reports) hold a bounded number of rows and are put together on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import cypher_escape, safe_name, xml_escape
from ..operators import analyze, community
from ..operators.graph import PropertyGraph
from ..operators.rounds import ranked

MERMAID_NODES = 200
# The order of behaviours; the first that a node has styles it. The colours are free.
STYLES = {
    "throws": "#ffcccc", "exec": "#ffd9b3", "unsafe": "#ff9999", "net": "#cce5ff",
    "fs": "#d9f2d9", "logs": "#f2f2cc", "async": "#e6ccff", "test": "#e0e0e0",
}


def node_link_json(graph: PropertyGraph) -> DataFrame:
    """(part, value): one JSON text for each node and link, in id order; null attributes are left out."""
    nodes = graph.nodes.select(F.lit("nodes").alias("part"), F.col("id").alias("k"), F.to_json(F.struct(*graph.nodes.columns)).alias("value"))
    columns = [c for c in graph.edges.columns if c not in ("lo", "hi")]
    links = graph.edges.select(F.lit("links").alias("part"), F.concat_ws("\x00", "source", "target").alias("k"), F.to_json(F.struct(*columns)).alias("value"))
    return nodes.unionByName(links).orderBy(F.desc("part"), "k").select("part", "value")


def write_node_link(graph: PropertyGraph, path: str) -> None:
    """Folders ``nodes`` and ``links`` of JSON lines, in many parts."""
    graph.sorted_nodes().write.mode("overwrite").json(f"{path}/nodes")
    graph.sorted_edges().drop("lo", "hi").write.mode("overwrite").json(f"{path}/links")


def _attribute(key: str, value) -> object:
    return F.when(value.isNotNull(), F.concat(F.lit(f'<data key="{key}">'), xml_escape(value.cast("string")), F.lit("</data>"))).otherwise("")


def graphml(graph: PropertyGraph, communities: DataFrame) -> DataFrame:
    """Lines of a GraphML document (value), in order; community 0 where a node has none."""
    keys = [("label", "node", "string"), ("file_type", "node", "string"), ("source_file", "node", "string"), ("community", "node", "int"), ("relation", "edge", "string"), ("confidence", "edge", "string"), ("weight", "edge", "double"), ("confidence_score", "edge", "double")]
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f'<key id="{k}" for="{f}" attr.name="{k}" attr.type="{t}"/>' for k, f, t in keys] + [f'<graph edgedefault="{"directed" if graph.directed else "undirected"}">']
    spark = graph.nodes.sparkSession
    fixed = lambda lines, part: spark.createDataFrame([(part, f"{i:03}", x) for i, x in enumerate(lines)], "part int, k string, value string")
    nodes = graph.nodes.join(communities.select(F.col("node_id").alias("id"), "community_id"), "id", "left").withColumn("community", F.coalesce("community_id", F.lit(0)))
    of = lambda df, kind: [_attribute(k, F.col(k)) for k, f, _ in keys if f == kind and k in df.columns]
    node_rows = nodes.select(F.lit(1).alias("part"), F.col("id").alias("k"), F.concat(F.lit('<node id="'), xml_escape(F.col("id")), F.lit('">'), *of(nodes, "node"), F.lit("</node>")).alias("value"))
    edge_rows = graph.edges.select(F.lit(2).alias("part"), F.concat_ws("\x00", "source", "target").alias("k"), F.concat(F.lit('<edge source="'), xml_escape(F.col("source")), F.lit('" target="'), xml_escape(F.col("target")), F.lit('">'), *of(graph.edges, "edge"), F.lit("</edge>")).alias("value"))
    return fixed(head, 0).unionByName(node_rows).unionByName(edge_rows).unionByName(fixed(["</graph>", "</graphml>"], 3)).orderBy("part", "k").select("value")


def cypher(graph: PropertyGraph) -> DataFrame:
    """Statements (value): a MERGE for each node, then a MATCH … MERGE for each edge."""
    q = lambda c: F.concat(F.lit("'"), cypher_escape(F.coalesce(F.col(c), F.lit(""))), F.lit("'"))
    nodes = graph.nodes.select(F.lit(0).alias("part"), F.col("id").alias("k"), F.concat(F.lit("MERGE (n:Entity {id: "), q("id"), F.lit("}) SET n.label = "), q("label"), F.lit(", n.file_type = "), q("file_type"), F.lit(", n.source_file = "), q("source_file"), F.lit(";")).alias("value"))
    relation = F.regexp_replace(F.upper(F.coalesce("relation", F.lit("related"))), "[^A-Z0-9_]", "_")
    edges = graph.edges.select(F.lit(1).alias("part"), F.concat_ws("\x00", "source", "target").alias("k"), F.concat(F.lit("MATCH (a:Entity {id: "), q("source"), F.lit("}), (b:Entity {id: "), q("target"), F.lit("}) MERGE (a)-[:"), relation, F.lit(" {confidence: "), q("confidence"), F.lit("}]->(b);")).alias("value"))
    return nodes.unionByName(edges).orderBy("part", "k").select("value")


def call_flow(graph: PropertyGraph, most: int = MERMAID_NODES) -> PropertyGraph:
    """Call edges among the ``most`` nodes of highest call degree, ties by id."""
    calls = graph.edges.filter("relation = 'calls'")
    degree = calls.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return PropertyGraph(graph.nodes, calls).subgraph(degree.orderBy(F.desc("degree"), "id").limit(most).select("id"))


def mermaid(graph: PropertyGraph, communities: DataFrame | None = None, labels: DataFrame | None = None, direction: str = "TD", most: int = MERMAID_NODES) -> str:
    """A flow chart of the calls, grouped by community, nodes styled by behaviour."""
    flow = call_flow(graph, most)
    nodes = flow.nodes.join(communities.select(F.col("node_id").alias("id"), "community_id"), "id", "left") if communities is not None else flow.nodes.withColumn("community_id", F.lit(None).cast("int"))
    names = {r["community_id"]: r["label"] for r in labels.orderBy("community_id").collect()} if labels is not None else {}
    escape = lambda s: (s or "").replace('"', "#quot;").replace("<", "&lt;").replace(">", "&gt;")
    name = lambda s: "n_" + "".join(c if c.isalnum() and c.isascii() else "_" for c in s)
    lines, used, group = [f"flowchart {direction}"], set(), object()
    rows = nodes.select("id", "label", "tags", "community_id").orderBy(F.asc_nulls_last("community_id"), "id").collect()  # at most ``most``
    for r in rows:
        if r["community_id"] != group:
            if group is not None and len(lines) > 1:
                lines.append("  end")
            group = r["community_id"]
            if group is not None:
                lines.append(f'  subgraph c{group}["{escape(names.get(group, f"Community {group}"))}"]')
        style = next((t for t in STYLES if t in (r["tags"] or [])), None)
        used.add(style)
        lines.append(f'    {name(r["id"])}["{escape(r["label"] or r["id"])}"]' + (f":::{style}" if style else ""))
    if group is not None and rows:
        lines.append("  end")
    lines += [f"  {name(r['source'])} --> {name(r['target'])}" for r in flow.edges.orderBy("source", "target").collect()]
    return "\n".join(lines + [f"  classDef {t} fill:{c}" for t, c in STYLES.items() if t in used]) + "\n"


def obsidian(graph: PropertyGraph, communities: DataFrame) -> DataFrame:
    """(name, value): a note for each node, linking its neighbours, and one for each community. Names
    that are equal in any case get a number."""
    base = F.when(F.trim(safe_name(F.coalesce("label", "id"))) == "", F.col("id")).otherwise(F.trim(safe_name(F.coalesce("label", "id"))))
    # a name that many nodes share is numbered by ranges as well
    placed = ranked(graph.nodes.withColumn("base", base).withColumn("low", F.lower("base")), "place", "low", "id")
    named = placed.join(placed.groupBy("low").agg(F.min("place").alias("first")), "low").withColumn("n", F.col("place") - F.col("first") + 1)
    named = named.withColumn("name", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("n").cast("string"))))
    links = graph.adjacency().join(named.select(F.col("id").alias("peer"), F.col("name").alias("to")), "peer").groupBy("id").agg(F.array_sort(F.collect_set("to")).alias("links"))
    joined = named.join(links, "id", "left").join(communities.select(F.col("node_id").alias("id"), "community_id"), "id", "left")
    body = F.concat_ws(
        "\n", F.concat(F.lit("# "), F.coalesce("label", "id")), F.concat(F.lit("type: "), "file_type"), F.concat(F.lit("file: "), "source_file"), F.concat(F.lit("community: [[_community_"), F.col("community_id").cast("string"), F.lit("]]")), F.array_join(F.transform(F.coalesce("links", F.array().cast("array<string>")), lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))), "\n")
    )
    notes = joined.select("name", body.alias("value"))
    scores = community.cohesion(graph, communities)
    members = communities.join(named.select(F.col("id").alias("node_id"), "name"), "node_id").groupBy("community_id").agg(F.array_sort(F.collect_list("name")).alias("names"))
    word = F.when(F.col("cohesion") >= 0.7, "tightly connected").when(F.col("cohesion") >= 0.4, "moderately connected").otherwise("loosely connected")
    groups = members.join(scores, "community_id").select(F.concat(F.lit("_community_"), F.col("community_id").cast("string")).alias("name"), F.concat_ws("\n", F.format_string("# Community %d", "community_id"), F.concat(F.lit("cohesion: "), F.col("cohesion").cast("string"), F.lit(" ("), word, F.lit(")")), F.array_join(F.transform("names", lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))), "\n")).alias("value"))
    return notes.unionByName(groups)


def view_rows(graph: PropertyGraph, communities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and legend for a browser view: sizes 10 to 40 by degree, labels for degrees of at
    least 15 % of the largest, dashes for all but EXTRACTED edges."""
    degrees = graph.degrees()
    most = degrees.agg(F.greatest(F.max("degree"), F.lit(1)).alias("most"))
    share = F.col("degree") / F.col("most")
    nodes = graph.nodes.join(degrees, "id").crossJoin(F.broadcast(most)).join(communities.select(F.col("node_id").alias("id"), "community_id"), "id", "left")
    vis = nodes.select("id", F.coalesce("label", "id").alias("label"), F.coalesce("community_id", F.lit(0)).alias("community"), (F.floor((10 + 30 * share) * 10 + 0.5) / 10).alias("size"), F.when(share >= 0.15, 12).otherwise(0).alias("font"), "degree")
    edges = graph.edges.select(F.col("source").alias("from"), F.col("target").alias("to"), "relation", "confidence", (F.coalesce("confidence", F.lit("")) != "EXTRACTED").alias("dashes"))
    return vis, edges, community.community_labels(graph, communities).orderBy("community_id")


def report(graph: PropertyGraph, communities: DataFrame, title: str = "Graph report", top: int = 10, shown: int = 20) -> str:
    """Markdown: counts, confidence, hubs, unexpected links, questions, and the largest communities with their first members."""
    from pyspark.sql import Window

    counts = graph.counts().first()
    lines = [f"# {title}", "", f"- {counts['node_count']} nodes, {counts['edge_count']} edges", ""]
    lines += ["## Confidence", ""] + [f"- {r['confidence']}: {r['n']} ({100 * r['n'] // max(counts['edge_count'], 1)} %)" for r in analyze.graph_stats(graph)["confidence"].orderBy("confidence").collect()]
    lines += ["", "## Hubs", ""] + [f"{i}. {r['label']} - {r['degree']} edges" for i, r in enumerate(analyze.god_nodes(graph, top).collect(), 1)]
    lines += ["", "## Surprising connections", ""] + [f"- {r['source_label']} --{r['relation']}--> {r['target_label']}: {r['why']}" for r in analyze.surprising_connections(graph, communities).collect()]
    lines += ["", "## Questions", ""] + [f"- {r['question']}" for r in analyze.suggest_questions(graph, 7).collect()]
    members = communities.join(graph.degrees(), F.col("node_id") == F.col("id")).drop("id").join(graph.nodes.select("id", F.coalesce("label", "id").alias("name")), F.col("node_id") == F.col("id"))
    rank = F.row_number().over(Window.partitionBy("community_id").orderBy(F.desc("degree"), "id"))
    first = members.filter(F.col("community_id") < shown).withColumn("n", rank).filter(F.col("n") <= top).groupBy("community_id").agg(F.array_sort(F.collect_list(F.struct("n", "name"))).alias("m"))
    scored = community.cohesion(graph, communities).join(first, "community_id").orderBy("community_id")
    lines += ["", "## Communities", ""] + [f"- {r['community_id']}: {r['n']} nodes, cohesion {r['cohesion']}: {', '.join(x['name'] for x in r['m'])}" for r in scored.collect()]
    return "\n".join(lines) + "\n"


def comparison_report(sections: dict[str, DataFrame], label_a: str, label_b: str, shown: int = 20) -> str:
    """Markdown from the sections of ``compare``."""
    from ..operators.compare import interpret

    score = sections["composite"].first()["composite"]
    lines = [f"# {label_a} against {label_b}", "", f"Composite similarity {score:.3f}: {interpret(score)}.", "", "## Scores", ""]
    lines += [f"- {r['metric']}: {r['score']:.3f}" for r in sections["scores"].orderBy("metric").collect() if r["score"] is not None]
    for part in ("nodes", "edges"):
        lines += ["", f"## {part.capitalize()}", ""] + [f"- {r['status']}: {r['n']}" for r in sections[part].groupBy("status").agg(F.count(F.lit(1)).alias("n")).orderBy("status").collect()]
    lines += ["", "## Likely renames", ""] + [f"- {r['id_a']} -> {r['id_b']} ({r['confidence']:.2f})" for r in sections["renames"].limit(shown).collect()]
    lines += ["", "## Impact", ""] + [f"- {r['id']}: {r['affected']} nodes" for r in sections["impact"].limit(shown).collect()]
    lines += ["", "## Import drift", ""] + [f"- {r['file']}: +{len(r['added'])} -{len(r['removed'])}" for r in sections["drift"].limit(shown).collect()]
    return "\n".join(lines) + "\n"


def comparison_json(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, value): each row of each section of a comparison as JSON, nulls kept."""
    from functools import reduce

    rows = [df.select(F.lit(name).alias("section"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")) for name, df in sections.items()]
    return reduce(DataFrame.unionByName, rows)


def write_comparison(sections: dict[str, DataFrame], path: str) -> None:
    """A folder of JSON lines for each section under ``path``, in as many parts as tasks wrote."""
    comparison_json(sections).write.mode("overwrite").partitionBy("section").text(path)


def n_way_report(graphs: dict, options=None, estimate_only: bool = False, shown: int = 20) -> str:
    """Markdown on several graphs: the heatmap, the nearest and the farthest pair, estimates next to what was compared, what all
    share, and what each has alone."""
    from ..operators import compare

    names = list(graphs)
    heatmap, scores = compare.compare_n(graphs, options, estimate_only)
    at = {(r["label_a"], r["label_b"]): r["score"] for r in heatmap.collect()}  # as many rows as pairs of graphs
    cell = lambda x, y: f"{at[x, y]:.3f}" if at.get((x, y)) is not None else "-"
    lines = ["# Comparison of " + ", ".join(names), "", "| | " + " | ".join(names) + " |", "|-" * (len(names) + 1) + "|"]
    lines += [f"| {x} | " + " | ".join(cell(x, y) for y in names) + " |" for x in names]
    pairs = sorted((s, x, y) for (x, y), s in at.items() if x < y and s is not None)
    if pairs:
        lines += ["", f"Nearest: {pairs[-1][1]} and {pairs[-1][2]}, {pairs[-1][0]:.3f}, {compare.interpret(pairs[-1][0])}.", f"Farthest: {pairs[0][1]} and {pairs[0][2]}, {pairs[0][0]:.3f}, {compare.interpret(pairs[0][0])}."]
    bounds = compare.estimate(scores).orderBy("label_a", "label_b").limit(shown).collect() if estimate_only else []
    if bounds:
        lines += ["", "## Estimates", ""] + [f"- {r['label_a']} and {r['label_b']}: {r['lower']:.3f} to {r['upper']:.3f}" for r in bounds]
    core, unique = analyze.core_and_unique(graphs)
    shared = core.first()
    lines += ["", "## Core", "", "- " + ", ".join(f"{c}: {shared[c]}" for c in core.columns) if shared else "- nothing", "", "## Unique", ""]
    lines += [f"- {r['graph']}: {r['nodes']} nodes, {r['edges']} edges" for r in unique.orderBy("graph").collect()]
    return "\n".join(lines) + "\n"
