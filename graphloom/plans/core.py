"""Queries over the projected graph, with their SQL: construction, lookups, statistics, diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analyze, community, diff, traverse
from ..operators.graph import PropertyGraph, has_tag, resolve_endpoints, upsert_nodes
from ..operators.validate import validate
from . import projection as p

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str, recursive: bool = False):
    """Registers a query under its function's name, with its SQL after the projection's."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([p.SQL, *ctes])} {sql}"
        return f

    return add


FILE = p.FILE_LABEL_SQL.format("label")


@query(f"SELECT n.id, n.label, d.degree FROM degrees d JOIN nodes n USING (id) WHERE NOT {FILE} ORDER BY d.degree DESC, n.id LIMIT 10")
def god_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return analyze.god_nodes(p.graph(spark, sf))


@query("SELECT id, degree FROM degrees")
def degree_all(spark, sf):
    return p.graph(spark, sf).degrees()


@query(
    """SELECT 'customer_' || o_custkey AS id,
         arg_max(o_orderpriority, o_orderkey) FILTER (WHERE o_totalprice > 100000) AS label,
         arg_max(o_orderstatus, o_orderkey) AS file_type
       FROM orders GROUP BY o_custkey"""
)
def node_upsert_last(spark, sf):
    orders = p.read(spark, sf, "orders")
    records = orders.select(F.concat(F.lit("customer_"), F.col("o_custkey").cast("string")).alias("id"), F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority")).alias("label"), F.col("o_orderstatus").alias("file_type"), F.col("o_orderkey").alias("ord"))
    return upsert_nodes(records)


@query("SELECT lo, hi, relation, confidence, weight FROM edges")
def edge_overwrite(spark, sf):
    return p.graph(spark, sf).edges.select("lo", "hi", "relation", "confidence", "weight")


@query("SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count, (SELECT count(*) FROM edges) AS edge_count_halved")
def graph_counts(spark, sf):
    return p.graph(spark, sf).counts()


@query("SELECT source, target FROM edges WHERE relation = 'imports' AND target LIKE '%0'")
def dangling_edges(spark, sf):
    known = p.nodes(spark, sf).filter(~F.col("id").rlike("^part_.*0$"))
    edges = p.graph(spark, sf).edges
    kept = resolve_endpoints(edges, known).select("source", "target")
    return edges.select("source", "target").join(kept, ["source", "target"], "left_anti")


@query(
    """, bad_nodes AS (SELECT CASE WHEN id LIKE 'region%' THEN NULL ELSE id END AS id, CASE WHEN id LIKE 'nation%' THEN '' ELSE label END AS label,
          CASE WHEN id LIKE 'supplier%' THEN 'video' ELSE file_type END AS file_type FROM nodes),
       ends AS (SELECT e.*, s.id AS sid, t.id AS tid FROM edges e LEFT JOIN bad_nodes s ON s.id = e.source LEFT JOIN bad_nodes t ON t.id = e.target)
       SELECT kind, count(*) AS n FROM (
         SELECT 'node_missing' AS kind FROM bad_nodes WHERE id IS NULL
         UNION ALL SELECT 'node_missing' FROM bad_nodes WHERE label = ''
         UNION ALL SELECT 'node_bad_file_type' FROM bad_nodes WHERE file_type = 'video'
         UNION ALL SELECT 'edge_missing' FROM edges
         UNION ALL SELECT 'edge_bad_confidence' FROM edges WHERE confidence = 'AMBIGUOUS'
         UNION ALL SELECT 'dangling_source' FROM ends WHERE sid IS NULL
         UNION ALL SELECT 'dangling_target' FROM ends WHERE tid IS NULL) GROUP BY kind"""
)
def validate_errors(spark, sf):
    g = p.graph(spark, sf)
    kind = lambda k: F.col("id").startswith(k)
    nodes = g.nodes.select(
        F.when(~kind("region"), F.col("id")).alias("id"), F.when(kind("nation"), "").otherwise(F.col("label")).alias("label"), F.when(kind("supplier"), "video").otherwise(F.col("file_type")).alias("file_type")
    )
    edges = g.edges.withColumn("confidence", F.when(F.col("confidence") == "AMBIGUOUS", "MAYBE").otherwise(F.col("confidence"))).withColumn("source_file", F.lit(""))
    return validate(nodes, edges).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT peer FROM adj WHERE id = 'nation_0'")
def neighbors(spark, sf):
    return p.graph(spark, sf).neighbors("nation_0")


@query("SELECT child AS id, n.label, n.tags[1] AS tag FROM tree JOIN nodes n ON n.id = child WHERE parent = 'nation_3'")
def children(spark, sf):
    g = p.graph(spark, sf)
    mine = g.containment().filter("parent = 'nation_3'").select(F.col("child").alias("id"))
    return g.nodes.join(mine, "id", "left_semi").select("id", "label", F.try_element_at("tags", F.lit(1)).alias("tag"))


@query("SELECT DISTINCT parent AS id FROM tree WHERE parent NOT IN (SELECT child FROM tree)")
def list_roots(spark, sf):
    tree = p.graph(spark, sf).containment()
    return tree.select(F.col("parent").alias("id")).distinct().join(tree.select(F.col("child").alias("id")), "id", "left_anti")


@query("SELECT t.child AS id FROM tree t JOIN nodes n ON n.id = t.child WHERE t.child NOT IN (SELECT parent FROM tree) AND list_contains(n.tags, 'building') ORDER BY 1 LIMIT 100")
def list_leaves(spark, sf):
    g = p.graph(spark, sf)
    tree = g.containment()
    leaves = tree.select(F.col("child").alias("id")).distinct().join(tree.select(F.col("parent").alias("id")), "id", "left_anti")
    return g.nodes.filter(has_tag("building")).join(leaves, "id", "left_semi").select("id").orderBy("id").limit(100)


@query("SELECT id, label FROM nodes WHERE source_file = 'Brand#11' AND file_type = 'code' ORDER BY id LIMIT 50")
def list_nodes(spark, sf):
    return p.nodes(spark, sf).filter("source_file = 'Brand#11' AND file_type = 'code'").select("id", "label").orderBy("id").limit(50)


@query(", near AS (SELECT 'nation_0' AS id UNION SELECT peer FROM adj WHERE id = 'nation_0') SELECT lo, hi, relation FROM edges WHERE source IN (SELECT id FROM near) AND target IN (SELECT id FROM near)")
def subgraph(spark, sf):
    g = p.graph(spark, sf)
    ids = g.neighbors("nation_0").select(F.col("peer").alias("id")).unionByName(spark.createDataFrame([("nation_0",)], "id string"))
    return g.subgraph(ids).edges.select("lo", "hi", "relation")


@query("SELECT confidence, count(*) AS n FROM edges GROUP BY confidence")
def graph_stats_confidence(spark, sf):
    return analyze.graph_stats(p.graph(spark, sf))["confidence"]


@query("SELECT relation, count(*) AS n FROM edges GROUP BY relation")
def graph_stats_relation(spark, sf):
    return analyze.graph_stats(p.graph(spark, sf))["relation"]


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM nodes) GROUP BY tag")
def graph_stats_tag(spark, sf):
    return analyze.graph_stats(p.graph(spark, sf))["tag"]


@query(
    """, side AS (SELECT n.id, n.label, n.source_file, c.community_id FROM nodes n LEFT JOIN fine c ON c.node_id = n.id)
       SELECT e.source, e.target, e.confidence,
         CASE e.confidence WHEN 'AMBIGUOUS' THEN 3 WHEN 'INFERRED' THEN 2 ELSE 1 END + CASE WHEN a.source_file <> b.source_file THEN 2 ELSE 0 END
           + CASE WHEN a.community_id <> b.community_id THEN 1 ELSE 0 END AS score,
         array_to_string(list_filter([CASE e.confidence WHEN 'AMBIGUOUS' THEN 'tagged AMBIGUOUS' WHEN 'INFERRED' THEN 'inferred connection' END,
           CASE WHEN a.source_file <> b.source_file THEN 'crosses files' END, CASE WHEN a.community_id <> b.community_id THEN 'bridges separate communities' END], lambda x: x IS NOT NULL), '; ') AS why
       FROM edges e JOIN side a ON a.id = e.source JOIN side b ON b.id = e.target
       WHERE e.relation = 'imports' AND NOT """
    + p.FILE_LABEL_SQL.format("a.label")
    + " AND NOT "
    + p.FILE_LABEL_SQL.format("b.label")
    + " ORDER BY score DESC, e.source, e.target LIMIT 200",
    p.PARTITION_SQL,
)
def surprising_connections(spark, sf):
    found = analyze.surprising_connections(p.graph(spark, sf), p.by_nation(spark, sf), 200, skip=("contains", "method", "calls"))
    return found.select("source", "target", "confidence", "score", "why")


@query(
    """SELECT 'ambiguous_edge' AS kind, 'What is the exact relationship between ' || a.label || ' and ' || b.label || '?' AS question
       FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE e.confidence = 'AMBIGUOUS' ORDER BY e.lo, e.hi LIMIT 25"""
)
def suggest_questions(spark, sf):
    return analyze.suggest_questions(p.graph(spark, sf), 25).select("kind", "question")


@query("SELECT n.id, n.label, count(*) AS degree FROM (SELECT source AS id FROM raw UNION ALL SELECT target FROM raw) e JOIN nodes n USING (id) GROUP BY n.id, n.label ORDER BY degree DESC, n.id LIMIT 10")
def hub_nodes(spark, sf):
    return analyze.hub_nodes(p.nodes(spark, sf), p.raw_edges(spark, sf))


@query("SELECT source_file, count(*) AS n FROM nodes WHERE source_file <> '' GROUP BY source_file")
def file_counts(spark, sf):
    return analyze.file_counts(p.nodes(spark, sf))


@query(
    """, hood AS (SELECT 'nation_0' AS id, 0 AS dist UNION SELECT a.peer, h.dist + 1 FROM hood h JOIN adj a ON a.id = h.id WHERE h.dist < 2)
       SELECT id, min(dist) AS dist FROM hood GROUP BY id""",
    recursive=True,
)
def bfs_depth2(spark, sf):
    return traverse.bfs(p.graph(spark, sf), spark.createDataFrame([("nation_0",)], "id string"), 2)[0]


@query(
    """, x AS (SELECT id FROM (SELECT 'nation_0' AS id UNION SELECT peer FROM adj WHERE id = 'nation_0'))
       SELECT DISTINCT lo, hi FROM edges WHERE source IN (SELECT id FROM x) OR target IN (SELECT id FROM x)"""
)
def bfs_edges_depth2(spark, sf):
    return traverse.bfs(p.graph(spark, sf), spark.createDataFrame([("nation_0",)], "id string"), 2)[1].select("lo", "hi")


@query(
    """, hood AS (SELECT 'nation_0' AS id, 0 AS dist UNION SELECT a.peer, h.dist + 1 FROM hood h JOIN adj a ON a.id = h.id WHERE h.dist < 10),
       best AS (SELECT id, min(dist) AS dist FROM hood GROUP BY id),
       back AS (SELECT id, dist FROM best WHERE id = 'nation_1' UNION SELECT x.id, x.dist FROM back b JOIN adj a ON a.id = b.id JOIN best x ON x.id = a.peer AND x.dist = b.dist - 1),
       walk AS (SELECT 'nation_0' AS id, ['nation_0'] AS path UNION ALL
         SELECT b.id, min(list_append(w.path, b.id)) FROM walk w JOIN adj a ON a.id = w.id JOIN back b ON b.id = a.peer AND b.dist = len(w.path) GROUP BY b.id)
       SELECT array_to_string(path, ' > ') AS path FROM walk WHERE id = 'nation_1'""",
    recursive=True,
)
def shortest_path(spark, sf):
    found = traverse.shortest_path(p.graph(spark, sf).adjacency(), "nation_0", "nation_1", 10)
    return spark.createDataFrame([(" > ".join(found),)] if found else [], "path string")


@query(
    """, walk AS (SELECT 'region_1' AS id, 0 AS depth UNION SELECT e.target, w.depth + 1 FROM walk w JOIN raw e ON e.source = w.id AND e.relation = 'contains' WHERE w.depth < 5)
       SELECT id, min(depth) AS depth FROM walk GROUP BY id""",
    recursive=True,
)
def walk_chain(spark, sf):
    return traverse.walk_chain(p.raw_edges(spark, sf), "region_1", "contains")


@query(
    """, flow AS (SELECT DISTINCT source, target FROM edges WHERE relation IN ('contains', 'calls')),
       chain AS (SELECT id AS target, id, [id] AS path FROM nodes WHERE list_contains(tags, '1-urgent')
         UNION ALL SELECT c.target, f.source, list_prepend(f.source, c.path) FROM chain c JOIN flow f ON f.target = c.id)
       SELECT target, array_to_string(path, ' > ') AS path FROM chain c WHERE len(path) > 1 AND NOT EXISTS (SELECT 1 FROM flow f WHERE f.target = c.id) ORDER BY target LIMIT 200""",
    recursive=True,
)
def trace_calls(spark, sf):
    """Chains from region over nation and customer to urgent orders; containment counts as a call, since
    customers call orders only."""
    g = p.graph(spark, sf)
    flow = g.edges.filter("relation IN ('contains', 'calls')").withColumn("relation", F.lit("calls"))
    return traverse.trace_tag(PropertyGraph(g.nodes, flow), "1-urgent", 10, 200).select("target", F.array_join("path", " > ").alias("path"))


@query(
    """, u AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed'
           WHEN da.degree <> db.degree OR a.label <> b.label OR a.tags <> b.tags OR a.source_file <> b.source_file THEN 'modified' END AS change
         FROM a_nodes a FULL JOIN nodes b ON a.id = b.id LEFT JOIN a_degrees da ON da.id = a.id LEFT JOIN degrees db ON db.id = b.id),
       near AS (SELECT id AS origin, peer AS id FROM u JOIN adj USING (id) WHERE change <> 'removed' UNION ALL SELECT id, peer FROM u JOIN a_adj USING (id) WHERE change = 'removed')
       SELECT origin AS id, change, count(DISTINCT near.id) AS affected FROM near JOIN u ON u.id = origin WHERE near.id <> origin GROUP BY origin, change ORDER BY affected DESC, origin LIMIT 20""",
    p.EARLIER_SQL,
)
def multi_source_impact(spark, sf):
    """Every node that the later version adds or changes, and in the earlier one every node that goes,
    with the nodes next to it."""
    a, b = p.earlier(spark, sf), p.graph(spark, sf)
    return traverse.ranked_impact(a, b, diff.diff_nodes(a, b), 1).select("id", "change", "affected")


# ---- two versions ---------------------------------------------------------------------------


@query(
    """SELECT id, status FROM (
         SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed'
           WHEN da.degree <> db.degree OR a.label <> b.label OR a.tags <> b.tags OR a.source_file <> b.source_file THEN 'modified' END AS status
         FROM a_nodes a FULL JOIN nodes b ON a.id = b.id LEFT JOIN a_degrees da ON da.id = a.id LEFT JOIN degrees db ON db.id = b.id) WHERE status IS NOT NULL""",
    p.EARLIER_SQL,
)
def node_diff(spark, sf):
    return diff.diff_nodes(p.earlier(spark, sf), p.graph(spark, sf)).select("id", "status")


@query(
    """SELECT coalesce(a.lo, b.lo) AS lo, coalesce(a.hi, b.hi) AS hi, coalesce(a.relation, b.relation) AS relation, CASE WHEN a.lo IS NULL THEN 'added' ELSE 'removed' END AS status
       FROM old a FULL JOIN new b ON a.lo = b.lo AND a.hi = b.hi AND a.relation = b.relation WHERE a.lo IS NULL OR b.lo IS NULL""",
    p.EARLIER_SQL,
    "old AS MATERIALIZED (SELECT lo, hi, relation FROM a_edges)",
    "new AS MATERIALIZED (SELECT lo, hi, relation FROM edges)",
)
def edge_diff(spark, sf):
    return diff.diff_edges(p.earlier(spark, sf), p.graph(spark, sf)).select("lo", "hi", "relation", "status")


@query("SELECT (SELECT count(*) FROM (SELECT id FROM a_nodes INTERSECT SELECT id FROM nodes)) / (SELECT count(*) FROM (SELECT id FROM a_nodes UNION SELECT id FROM nodes))::DOUBLE AS jaccard", p.EARLIER_SQL)
def jaccard_nodes(spark, sf):
    return diff.jaccard_nodes(p.earlier(spark, sf), p.graph(spark, sf))


@query(
    "SELECT (SELECT count(*) FROM (SELECT lo, hi, relation FROM a_edges INTERSECT SELECT lo, hi, relation FROM edges)) / (SELECT count(*) FROM (SELECT lo, hi, relation FROM a_edges UNION SELECT lo, hi, relation FROM edges))::DOUBLE AS jaccard",
    p.EARLIER_SQL,
)
def jaccard_edges(spark, sf):
    return diff.jaccard_edges(p.earlier(spark, sf), p.graph(spark, sf))


@query(
    """, pa AS (SELECT degree, count(*) / sum(count(*)) OVER () AS p FROM a_degrees GROUP BY degree), pb AS (SELECT degree, count(*) / sum(count(*)) OVER () AS q FROM degrees GROUP BY degree),
       m AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q, (coalesce(p, 0) + coalesce(q, 0)) / 2 AS m FROM pa FULL JOIN pb USING (degree))
       SELECT round(sum((CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END) / 2), 9) AS jsd FROM m""",
    p.EARLIER_SQL,
)
def degree_jsd(spark, sf):
    return diff.degree_jsd(p.earlier(spark, sf), p.graph(spark, sf)).select(F.round("jsd", 9).alias("jsd"))


@query(
    """, t AS (SELECT f.community_id AS ca, c.community_id AS cb, count(*)::DOUBLE AS n FROM fine f JOIN coarse c USING (node_id) GROUP BY ALL),
       r AS (SELECT ca, sum(n) AS na FROM t GROUP BY ca), k AS (SELECT cb, sum(n) AS nb FROM t GROUP BY cb), s AS (SELECT sum(n) AS al FROM t)
       SELECT round((SELECT sum(n / al * log2(n * al / (na * nb))) FROM t JOIN r USING (ca) JOIN k USING (cb), s)
         / (((SELECT -sum(na / al * log2(na / al)) FROM r, s) + (SELECT -sum(nb / al * log2(nb / al)) FROM k, s)) / 2), 9) AS nmi""",
    p.PARTITION_SQL,
)
def nmi_fixed_partition(spark, sf):
    return community.nmi(p.by_nation(spark, sf), p.by_region(spark, sf)).select(F.round("nmi", 9).alias("nmi"))


@query(
    """, w AS (SELECT a.community_id, count(*) AS e FROM edges JOIN fine a ON a.node_id = source JOIN fine b ON b.node_id = target WHERE a.community_id = b.community_id GROUP BY 1),
       s AS (SELECT community_id, count(*) AS n FROM fine GROUP BY 1)
       SELECT community_id, n, coalesce(e, 0) AS edges, CASE WHEN n <= 1 THEN 1.0 ELSE floor(coalesce(e, 0) / (n * (n - 1) / 2.0::DOUBLE) * 100 + 0.5) / 100 END AS cohesion FROM s LEFT JOIN w USING (community_id)""",
    p.PARTITION_SQL,
)
def cohesion_fixed_partition(spark, sf):
    return community.cohesion(p.graph(spark, sf), p.by_nation(spark, sf))


@query(
    """, t AS (SELECT f.community_id AS ca, c.community_id AS cb, count(*) AS n FROM fine f JOIN coarse c USING (node_id) GROUP BY ALL)
       SELECT cb AS community_id, count(*) AS parts, array_to_string(list(ca ORDER BY ca), ',') AS members FROM t WHERE n >= 2 GROUP BY cb HAVING count(*) >= 2""",
    p.PARTITION_SQL,
)
def splits_merges_fixed_partition(spark, sf):
    merges = community.splits_and_merges(p.by_nation(spark, sf), p.by_region(spark, sf))[1]
    return merges.select(F.col("cb").alias("community_id"), F.size("parts").alias("parts"), F.array_join(F.col("parts").cast("array<string>"), ",").alias("members"))


@query(
    """, gone AS (SELECT * FROM a_nodes WHERE id NOT IN (SELECT id FROM nodes)), come AS (SELECT * FROM nodes WHERE id NOT IN (SELECT id FROM a_nodes)),
       na AS (SELECT a.id, list_distinct(list(n.label)) AS s FROM a_adj a JOIN a_nodes n ON n.id = a.peer GROUP BY a.id),
       nb AS (SELECT a.id, list_distinct(list(n.label)) AS s FROM adj a JOIN nodes n ON n.id = a.peer GROUP BY a.id),
       near AS (SELECT g.id AS id_a, c.id AS id_b, 1 - levenshtein(lower(g.label), lower(c.label)) / greatest(length(g.label), length(c.label))::DOUBLE AS l FROM gone g JOIN come c USING (file_type))
       SELECT id_a, id_b, round(0.6 * l + 0.4 * len(list_intersect(na.s, nb.s)) / len(list_distinct(list_concat(na.s, nb.s)))::DOUBLE, 9) AS confidence
       FROM near JOIN na ON na.id = id_a JOIN nb ON nb.id = id_b WHERE l >= 0.3
         AND 0.6 * l + 0.4 * len(list_intersect(na.s, nb.s)) / len(list_distinct(list_concat(na.s, nb.s)))::DOUBLE >= 0.6 ORDER BY confidence DESC, id_a, id_b LIMIT 20""",
    p.EARLIER_SQL,
)
def rename_candidates(spark, sf):
    return diff.rename_candidates(p.earlier(spark, sf), p.graph(spark, sf)).select("id_a", "id_b", F.round("confidence", 9).alias("confidence"))


@query(
    """, old AS (SELECT id, CASE WHEN id LIKE 'customer%7' OR id LIKE 'part%7' THEN label || ' (old)' ELSE label END AS label, source_file FROM nodes),
       ia AS (SELECT DISTINCT s.source_file AS file, t.label AS name FROM edges e JOIN old s ON s.id = e.source JOIN old t ON t.id = e.target WHERE relation IN ('imports', 'contains')),
       ib AS (SELECT DISTINCT s.source_file AS file, t.label AS name FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target WHERE relation IN ('imports', 'contains'))
       SELECT file, count(*) FILTER (WHERE side = 'b') AS added, count(*) FILTER (WHERE side = 'a') AS removed FROM (
         (SELECT 'b' AS side, * FROM (SELECT * FROM ib EXCEPT SELECT * FROM ia)) UNION ALL (SELECT 'a', * FROM (SELECT * FROM ia EXCEPT SELECT * FROM ib))) GROUP BY file"""
)
def import_drift(spark, sf):
    """Against a version in which customers and parts with a key that ends in 7 were called otherwise."""
    now = p.graph(spark, sf)
    label = F.when(F.col("id").rlike("^(customer|part)_[0-9]*7$"), F.concat("label", F.lit(" (old)"))).otherwise(F.col("label"))
    found = diff.import_drift(PropertyGraph(now.nodes.withColumn("label", label), now.edges), now, ("imports", "contains"))
    return found.select("file", F.size("added").cast("long").alias("added"), F.size("removed").cast("long").alias("removed"))


@query(
    """, u AS (SELECT id, count(*) AS c, min(g) AS g FROM (SELECT id, 'a' AS g FROM a_nodes UNION ALL SELECT id, 'b' FROM nodes) GROUP BY id),
       e AS (SELECT lo, hi, relation, 'a' AS g FROM a_edges UNION ALL SELECT lo, hi, relation, 'b' FROM edges)
       SELECT 'core' AS part, 'nodes' AS kind, count(*) AS n FROM u WHERE c = 2
       UNION ALL SELECT 'core', 'edges', count(*) FROM (SELECT 1 FROM e GROUP BY lo, hi, relation HAVING count(*) = 2)
       UNION ALL SELECT g, 'nodes', count(*) FROM u WHERE c = 1 GROUP BY g
       UNION ALL SELECT e.g, 'edges', count(*) FROM e WHERE EXISTS (SELECT 1 FROM u WHERE u.c = 1 AND u.g = e.g AND (u.id = e.lo OR u.id = e.hi)) GROUP BY e.g""",
    p.EARLIER_SQL,
)
def core_unique(spark, sf):
    core, unique = analyze.core_and_unique({"a": p.earlier(spark, sf), "b": p.graph(spark, sf)})
    own = unique.select(F.col("graph").alias("part"), F.inline(F.array(F.struct(F.lit("nodes").alias("kind"), F.col("nodes").alias("n")), F.struct(F.lit("edges").alias("kind"), F.col("edges").alias("n")))))
    return core.select(F.lit("core").alias("part"), "kind", "n").unionByName(own)
