"""Queries for single parts: files, ids, extraction, model answers, graph changes, records, views, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import canonical_tokens, file_stem, make_id, multiset_jaccard
from ..operators import community, diff, extract_calls, search, semantic
from ..operators.graph import PropertyGraph, merge_semantic
from ..operators.points import GraphTools, RecordTools
from ..sinks import export
from ..sources import detect, extract
from . import projection as p
from .core import query

_NORM = "lower(trim(regexp_replace({}, '[^a-zA-Z0-9]+', '_', 'g'), '_'))"


def _id(kind: str, key: Column | str) -> Column:
    return F.concat(F.lit(f"{kind}_"), (F.col(key) if isinstance(key, str) else key).cast("string"))


# ---- files and ids ---------------------------------------------------------------------------


@query(
    """, f AS (SELECT doc_id, 'docs/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.py' END AS path, coalesce(text, '') AS text FROM documents),
       h AS (SELECT doc_id, path, sha256(path || chr(0) || CASE WHEN doc_id % 2 = 1 AND doc_id % 5 = 0 THEN '---' || chr(10) || 'a: b' || chr(10) || '---' || chr(10) || text ELSE text END) AS hash FROM f)
       SELECT path, hash FROM h WHERE doc_id % 3 <> 0"""
)
def uncached_files(spark, sf):
    """Every fifth document has front matter, which counts in code and not in Markdown; a third is in the cache."""
    docs = p.read(spark, sf, "documents")
    front = F.when(F.col("doc_id") % 5 == 0, "---\na: b\n---\n").otherwise("")
    files = docs.select("doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".py")).alias("path"), F.concat(front, F.coalesce("text", F.lit(""))).alias("text"))
    cache = files.filter("doc_id % 3 = 0").select(detect.content_hash(F.col("path"), F.col("text")).alias("hash"))
    return detect.not_cached(files, cache).select("path", "hash")


@query(
    """, f AS (SELECT p_partkey, p_brand, p_name, 'src/' || replace(p_type, ' ', '/') || '/' || replace(p_name, ' ', '-') || '.v1.py' AS path FROM part),
       s AS (SELECT *, string_split(path, '/')[-2] AS parent FROM f)
       SELECT p_partkey, """
    + _NORM.format("trim(parent || '.' || replace(p_name, ' ', '-') || '.v1', '_.') || '_' || trim(p_brand, '_.') || '_' || trim(p_name, '_.')")
    + """ AS id, parent || '.' || replace(p_name, ' ', '-') || '.v1' AS stem FROM s"""
)
def ids_of_parts(spark, sf):
    path = F.concat(F.lit("src/"), F.replace("p_type", F.lit(" "), F.lit("/")), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".v1.py"))
    rows = p.read(spark, sf, "part").select("p_partkey", "p_brand", "p_name", file_stem(path).alias("stem"))
    return rows.select("p_partkey", make_id("stem", F.lit("_."), "p_brand", "p_name").alias("id"), "stem")


#: Endings given to the documents in turn and the languages that they mean.
PATHS = {".py": "python", ".tsx": "javascript", ".h": "c", ".HPP": "cpp", ".rs": "rust", ".blade.php": "blade", ".php": "php", ".kts": "kotlin", ".sv": "verilog", ".txt": None, ".go": "go"}


@query(f"SELECT nullif(lang, '') AS lang, count(*) AS files FROM (SELECT {[v or '' for v in PATHS.values()]}[doc_id % {len(PATHS)} + 1] AS lang FROM documents) GROUP BY lang")
def languages_of_paths(spark, sf):
    ending = F.element_at(F.array(*[F.lit(e) for e in PATHS]), (F.col("doc_id") % len(PATHS) + 1).cast("int"))
    return p.read(spark, sf, "documents").select(extract.language(F.concat(F.lit("a/b"), ending)).alias("lang")).groupBy("lang").agg(F.count(F.lit(1)).alias("files"))


@query("SELECT p_partkey, array_to_string(list_sort(list_filter(regexp_split_to_array(lower(p_name || ' ' || replace(p_type, ' ', '')), '[^a-z0-9]+'), lambda x: length(x) >= 2)), ',') AS words FROM part")
def canonical_labels(spark, sf):
    label = F.concat(F.lit("."), "p_name", F.lit(" "), F.replace("p_type", F.lit(" "), F.lit("")), F.lit("()"))
    return p.read(spark, sf, "part").select("p_partkey", F.array_join(canonical_tokens(label), ",").alias("words"))


@query(
    """, l AS (SELECT p_partkey, 'a' AS side, unnest(string_split(p_name, '')) AS c FROM part UNION ALL SELECT p_partkey, 'b', unnest(string_split(p_type, '')) FROM part),
       n AS (SELECT p_partkey, c, count(*) FILTER (WHERE side = 'a') AS a, count(*) FILTER (WHERE side = 'b') AS b FROM l GROUP BY ALL)
       SELECT p_partkey, round(sum(least(a, b)) / sum(greatest(a, b))::DOUBLE, 9) AS score FROM n GROUP BY p_partkey"""
)
def multiset_scores(spark, sf):
    """Letters of name and type as multisets."""
    letters = lambda c: F.split(c, "")
    return p.read(spark, sf, "part").select("p_partkey", F.round(multiset_jaccard(letters("p_name"), letters("p_type")), 9).alias("score"))


# ---- extraction ------------------------------------------------------------------------------

_FILES = "'n/nation_' || s_nationkey || '.py'"


def _sources(spark, sf) -> DataFrame:
    """A Python file for each nation with suppliers: a class, whose methods are the suppliers, each calling a function."""
    method = F.concat(F.lit("    def supplier_"), F.col("s_suppkey").cast("string"), F.lit("(self):\n        return total_"), F.col("s_nationkey").cast("string"), F.lit("(self)\n"))
    bodies = p.read(spark, sf, "supplier").groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list(method)), "").alias("methods"))
    key = F.col("s_nationkey").cast("string")
    text = F.concat(F.lit("import geo\n\n\n# adds up\ndef total_"), key, F.lit("(x):\n    return x\n\n\nclass Nation"), key, F.lit("(Place):\n"), "methods")
    return bodies.select(F.concat(F.lit("n/nation_"), key, F.lit(".py")).alias("path"), text.alias("text"))


@query(
    f""", s AS (SELECT DISTINCT s_nationkey AS k, {_FILES} AS path FROM supplier)
       SELECT 'n_nation_' || k || '_py' AS id, 'nation_' || k || '.py' AS label, path AS source_file, '' AS tags FROM s
       UNION ALL SELECT 'n_nation_' || k || '_total_' || k, 'total_' || k || '()', path, 'comment' FROM s
       UNION ALL SELECT 'n_nation_' || k || '_nation' || k, 'Nation' || k, path, '' FROM s
       UNION ALL SELECT 'n_nation_' || k || '_place', 'Place', '', '' FROM s
       UNION ALL SELECT 'n_nation_' || s_nationkey || '_nation' || s_nationkey || '_supplier_' || s_suppkey, '.supplier_' || s_suppkey || '()', {_FILES}, '' FROM supplier"""
)
def extracted_nodes(spark, sf):
    return extract.extract(_sources(spark, sf))[0].select("id", "label", "source_file", F.array_join("tags", ",").alias("tags"))


@query(
    """, s AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
       SELECT 'n_nation_' || k || '_py' AS source, 'n_nation_' || k || '_total_' || k AS target, 'contains' AS relation FROM s
       UNION ALL SELECT 'n_nation_' || k || '_py', 'n_nation_' || k || '_nation' || k, 'contains' FROM s
       UNION ALL SELECT 'n_nation_' || k || '_py', 'geo', 'imports' FROM s
       UNION ALL SELECT 'n_nation_' || k || '_nation' || k, 'n_nation_' || k || '_place', 'inherits' FROM s
       UNION ALL SELECT 'n_nation_' || s_nationkey || '_nation' || s_nationkey, 'n_nation_' || s_nationkey || '_nation' || s_nationkey || '_supplier_' || s_suppkey, 'method' FROM supplier
       UNION ALL SELECT 'n_nation_' || s_nationkey || '_nation' || s_nationkey || '_supplier_' || s_suppkey, 'n_nation_' || s_nationkey || '_total_' || s_nationkey, 'calls' FROM supplier"""
)
def extracted_edges(spark, sf):
    return extract.extract(_sources(spark, sf))[1].select("source", "target", "relation")


@query(
    """, calls AS (SELECT 'customer_' || o_custkey AS caller, c_mktsegment || '.tbl' AS file, 'customer#' || lpad((1 + o_orderkey % 1500)::VARCHAR, 9, '0') AS callee FROM orders JOIN customer ON c_custkey = o_custkey)
       SELECT DISTINCT caller AS source, id AS target FROM calls JOIN nodes ON source_file = file AND lower(label) = callee WHERE id <> caller"""
)
def calls_within_files(spark, sf):
    """Orders as calls of a customer, answered only by one of the same market segment."""
    customers = p.read(spark, sf, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit(".tbl")).alias("source_file"))
    number = F.lpad((1 + F.col("o_orderkey") % 1500).cast("string"), 9, "0")
    calls = p.read(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(_id("customer", "o_custkey").alias("caller_nid"), F.concat(F.lit("CUSTOMER#"), number).alias("callee"), "source_file", F.lit("").alias("source_location"))
    return extract_calls.resolve_within_files(calls, p.nodes(spark, sf).withColumn("ord", F.col("id")))[0].select("source", "target")


# ---- texts and model answers -------------------------------------------------------------------


@query(
    f"""SELECT {_NORM.format("doc_id || '_doc'")} AS id, doc_id || '.md' AS label, CASE WHEN length(text) > {semantic.CONTENT_LIMIT} THEN left(text, {semantic.CONTENT_LIMIT}) || '…' ELSE text END AS content FROM documents WHERE doc_id % 4 <> 0"""
)
def document_nodes(spark, sf):
    docs = p.read(spark, sf, "documents")
    kind = F.when(F.col("doc_id") % 4 == 0, "code").when(F.col("doc_id") % 4 == 1, "paper").otherwise("document")
    return semantic.document_nodes(docs.select(F.concat(F.lit("a/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), kind.alias("file_type"), "text")).select("id", "label", "content")


_SAID = "CASE o_orderstatus WHEN 'F' THEN 'EXTRACTED' WHEN 'P' THEN 'AMBIGUOUS' ELSE 'sure' END"


def _answers(spark, sf) -> DataFrame:
    """An answer for each order: long or short form, some thought about or fenced, one in eleven broken."""
    short = F.format_string('{"n": [{"id": "order_%s", "l": "o", "t": "code", "f": "x"}], "e": [{"s": "customer_%s", "g": "order_%s", "r": "calls", "c": "%s", "cs": %s, "w": %s}]}', "k", "o_custkey", "k", "said", "score", "weight")
    full = F.format_string('{"nodes": [{"id": "order_%s", "label": "o", "file_type": "code", "source_file": "x"}], "edges": [{"source": "customer_%s", "target": "order_%s", "relation": "calls", "confidence": "%s", "confidence_score": %s, "weight": %s}]}', "k", "o_custkey", "k", "said", "score", "weight")
    rows = p.read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_custkey").cast("string").alias("o_custkey"), F.expr(_SAID).alias("said"), F.expr("cast((o_orderkey % 13) / 10.0 as string)").alias("score"), F.expr("cast(o_orderkey % 3 - 1 as string)").alias("weight"), F.col("o_orderkey").alias("n"))
    text = F.when(F.col("n") % 2 == 0, short).otherwise(full)
    wrapped = F.when(F.col("n") % 11 == 0, F.substring(text, 1, 20)).when(F.col("n") % 5 == 0, F.concat(F.lit("<think>so {\n</think>\n"), text)).when(F.col("n") % 7 == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).otherwise(text)
    return rows.select(wrapped.alias("answer"))


@query(
    f"""SELECT 'customer_' || o_custkey AS source, 'order_' || o_orderkey AS target, CASE WHEN {_SAID} = 'sure' THEN 'INFERRED' ELSE {_SAID} END AS confidence,
         CASE WHEN o_orderkey % 13 BETWEEN 1 AND 10 THEN (o_orderkey % 13) / 10.0 ELSE 0.8 END::DOUBLE AS confidence_score, 1.0::DOUBLE AS weight FROM orders WHERE o_orderkey % 11 <> 0"""
)
def answered_edges(spark, sf):
    return semantic.parse_answers(_answers(spark, sf))[1].select("source", "target", "confidence", "confidence_score", "weight")


@query("SELECT 'order_' || o_orderkey AS id, 'o' AS label, 'code' AS file_type FROM orders WHERE o_orderkey % 11 <> 0")
def answered_nodes(spark, sf):
    return semantic.parse_answers(_answers(spark, sf))[0].select("id", "label", "file_type")


@query("SELECT doc_id, length(text)::DOUBLE AS length, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS letters FROM documents WHERE regexp_matches(text, '[^\\s]')")
def embedded_documents(spark, sf):
    """With a client whose vector holds the text's length and its letters e."""
    made = semantic.embed(p.read(spark, sf, "documents").select("doc_id", "text"), lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts])
    return made.select("doc_id", F.col("vec")[0].cast("double").alias("length"), F.col("vec")[1].cast("double").alias("letters"))


@query(
    """, s AS (SELECT 'customer_' || (o_custkey + CASE WHEN o_orderkey % 10 = 0 THEN 1000000 ELSE 0 END) AS id, arg_max(o_orderstatus, o_orderkey) AS label, arg_max(o_orderpriority, o_orderkey) AS source_file FROM orders GROUP BY 1)
       SELECT c.id, coalesce(s.label, c.label) AS label, coalesce(s.source_file, c.source_file) AS source_file FROM (FROM nodes WHERE id LIKE 'customer%') c LEFT JOIN s USING (id)
       UNION ALL SELECT id, label, source_file FROM s WHERE id NOT IN (SELECT id FROM nodes)"""
)
def merged_records(spark, sf):
    """Customers replaced whole by their last order's node; some orders name customers that are none."""
    ast = p.nodes(spark, sf).filter("id LIKE 'customer%'").select("id", "label", "source_file").withColumn("ord", F.lit(0).cast("long"))
    key = F.col("o_custkey") + F.when(F.col("o_orderkey") % 10 == 0, 1000000).otherwise(0)
    said = p.read(spark, sf, "orders").select(_id("customer", key).alias("id"), F.col("o_orderstatus").alias("label"), F.col("o_orderpriority").alias("source_file"), F.col("o_orderkey").cast("long").alias("ord"))
    return merge_semantic(ast, said).select("id", "label", "source_file")


@query(
    """, d AS (SELECT 'doc_' || doc_id AS id, text, doc_id % 3 AS k FROM documents WHERE contains(lower(text), 'ing'))
       SELECT id, ['comment', 'log', 'throw'][k + 1] AS found_in, text FROM d"""
)
def comments_found(spark, sf):
    """Texts as comments, second log messages or throw messages; all hits."""
    docs, none = p.read(spark, sf, "documents"), F.lit(None)
    third = lambda k, x: F.when(F.col("doc_id") % 3 == k, x)
    nodes = docs.select(_id("doc", "doc_id").alias("id"), third(0, F.col("text")).alias("comment"), third(1, F.array(F.lit("-"), F.col("text"))).alias("log_messages"), third(2, F.array("text")).otherwise(none).alias("throw_messages"))
    return search.search_comments(nodes.withColumns({c: F.filter(c, lambda m: m.isNotNull()) for c in ("log_messages", "throw_messages")}), "Ing", 2**31 - 1)


@query(
    """, t AS (SELECT id, label, list_filter(regexp_split_to_array(lower(label), '[^a-z0-9]+'), lambda x: length(x) >= 3) AS w FROM nodes),
       q AS (SELECT unnest(['supplier', '000000012', '00000001']) AS a),
       s AS (SELECT id, label, sum(CASE WHEN list_contains(w, a) THEN 3 WHEN len(list_filter(w, lambda x: starts_with(x, a) OR starts_with(a, x))) > 0 THEN 1 ELSE 0 END + CASE WHEN contains(id, a) THEN 2 ELSE 0 END)::INTEGER AS score FROM t, q GROUP BY ALL)
       SELECT id, label, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 50"""
)
def token_search(spark, sf):
    return search.search_tokens(p.nodes(spark, sf), "Supplier 000000012 with 00000001", 50)


# ---- building and changing graphs --------------------------------------------------------------


@query(
    """SELECT 'nation_' || c_nationkey AS source, 'customer_' || c_custkey AS target, CASE WHEN c_custkey % 4 = 0 THEN 'imports' ELSE 'contains' END AS relation FROM customer
       UNION ALL SELECT 'nation_' || s_nationkey, 'supplier_' || s_suppkey, 'contains' FROM supplier WHERE s_suppkey % 5 <> 0"""
)
def united_edges(spark, sf):
    """Two extractions: ids in other spelling, later edges over earlier ones, and endpoints that are no nodes."""
    nodes = p.nodes(spark, sf).withColumn("ord", F.lit(0))
    take = lambda kinds: nodes.filter(F.col("id").rlike(f"^({kinds})_"))
    record = lambda df, source, target, relation, key: df.select(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), F.col(key).cast("long").alias("ord"))
    customers, suppliers = p.read(spark, sf, "customer"), p.read(spark, sf, "supplier")
    spelt = F.concat(F.lit("Nation-"), F.col("c_nationkey").cast("string"), F.lit("."))
    first = record(customers, spelt, _id("customer", "c_custkey"), "contains", "c_custkey")
    gone = F.when(F.col("s_suppkey") % 5 == 0, F.lit("nation_99")).otherwise(_id("nation", "s_nationkey"))
    second = record(suppliers, gone, _id("supplier", "s_suppkey"), "contains", "s_suppkey").unionByName(record(customers.filter("c_custkey % 4 = 0"), _id("nation", "c_nationkey"), _id("customer", "c_custkey"), "imports", "c_custkey"))
    return PropertyGraph.union([(take("nation|customer"), first), (take("nation|supplier"), second)]).edges.select("source", "target", "relation")


@query(
    """, e AS (SELECT source AS a, target AS b FROM edges UNION SELECT 'order_' || o_orderkey, 'clerk_' || (o_orderkey % 50) FROM orders),
       x AS (SELECT a AS id, b AS peer FROM e UNION SELECT b, a FROM e)
       SELECT id, count(*) AS degree FROM x WHERE id LIKE 'clerk%' OR id LIKE 'order%' GROUP BY id"""
)
def added_edges(spark, sf):
    """An edge from each order to a clerk, who is no node before."""
    g = p.graph(spark, sf)
    orders = p.read(spark, sf, "orders").select(_id("order", "o_orderkey").alias("source"), _id("clerk", F.col("o_orderkey") % 50).alias("target"), F.lit("calls").alias("relation"), F.col("o_orderkey").alias("ord"))
    return g.add_edges(orders).degrees().filter("id LIKE 'clerk%' OR id LIKE 'order%'")


@query("SELECT n.id, count(a.peer) AS degree FROM nodes n LEFT JOIN adj a ON a.id = n.id AND a.peer <> 'nation_3' WHERE n.id LIKE 'customer%' OR n.id LIKE 'nation%' GROUP BY n.id HAVING n.id <> 'nation_3'")
def without_node(spark, sf):
    return p.graph(spark, sf).remove_node("nation_3").degrees().filter("id LIKE 'customer%' OR id LIKE 'nation%'")


@query("SELECT least(source, t) AS lo, greatest(source, t) AS hi, relation FROM (SELECT source, CASE WHEN regexp_matches(target, '^part_[0-9]*7$') THEN 'gone_' || target ELSE target END AS t, relation FROM edges)")
def rekeyed_edges(spark, sf):
    g = p.graph(spark, sf)
    mapping = g.nodes.filter(F.col("id").rlike("^part_[0-9]*7$")).select(F.col("id").alias("id_b"), F.concat(F.lit("gone_"), "id").alias("id_a"))
    return g.rekey(mapping).edges.select("lo", "hi", "relation")


@query(
    """, arcs AS (SELECT 'nation_' || c_nationkey AS source, 'customer_' || c_custkey AS target, 'contains' AS relation FROM customer UNION ALL SELECT 'customer_' || c_custkey, 'nation_' || c_nationkey, 'calls' FROM customer WHERE c_custkey % 3 = 0)
       SELECT max(struct_pack(source, target, relation)).source AS source, max(struct_pack(source, target, relation)).target AS target, max(struct_pack(source, target, relation)).relation AS relation FROM arcs GROUP BY least(source, target), greatest(source, target)"""
)
def undirected_edges(spark, sf):
    customers = p.read(spark, sf, "customer")
    down = customers.select(_id("nation", "c_nationkey").alias("source"), _id("customer", "c_custkey").alias("target"), F.lit("contains").alias("relation"))
    up = customers.filter("c_custkey % 3 = 0").select(_id("customer", "c_custkey").alias("source"), _id("nation", "c_nationkey").alias("target"), F.lit("calls").alias("relation"))
    arcs = down.unionByName(up).withColumns({"lo": F.least("source", "target"), "hi": F.greatest("source", "target")})
    return PropertyGraph(p.nodes(spark, sf), arcs, True).to_undirected().edges.select("source", "target", "relation")


@query(
    """, n AS (SELECT count(*) AS c FROM a_nodes a FULL JOIN nodes b ON a.id = b.id LEFT JOIN a_degrees da ON da.id = a.id LEFT JOIN degrees db ON db.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR da.degree <> db.degree),
       e AS (SELECT count(*) AS c FROM (SELECT lo, hi, relation FROM a_edges) a FULL JOIN (SELECT lo, hi, relation FROM edges) b ON a.lo = b.lo AND a.hi = b.hi AND a.relation = b.relation WHERE a.lo IS NULL OR b.lo IS NULL)
       SELECT n.c + e.c AS distance FROM n, e""",
    p.EARLIER_SQL,
)
def change_count(spark, sf):
    a, b = p.earlier(spark, sf), p.graph(spark, sf)
    return diff.approximate_edit_distance(diff.diff_nodes(a, b), diff.diff_edges(a, b))


@query("SELECT community_id, first(label ORDER BY degree DESC, id) AS label, count(*) AS n FROM fine JOIN degrees ON id = node_id JOIN nodes USING (id) GROUP BY community_id", p.PARTITION_SQL)
def community_names(spark, sf):
    return community.community_labels(p.graph(spark, sf), p.by_nation(spark, sf))


# ---- questions and views -----------------------------------------------------------------------


def _records(spark, sf) -> RecordTools:
    """Over the raw edges, in which a pair may repeat."""
    return RecordTools(p.nodes(spark, sf), p.raw_edges(spark, sf))


@query("SELECT CASE WHEN source = 'supplier_7' THEN 'out' ELSE 'in' END AS way, CASE WHEN source = 'supplier_7' THEN target ELSE source END AS peer, relation FROM raw WHERE source = 'supplier_7' OR target = 'supplier_7'")
def record_neighbors(spark, sf):
    return _records(spark, sf).neighbors("supplier_7")


@query("SELECT id, label FROM nodes WHERE id NOT IN (SELECT target FROM raw)")
def record_roots(spark, sf):
    return _records(spark, sf).roots()


@query("SELECT id, label FROM nodes WHERE id NOT IN (SELECT source FROM raw)")
def record_leaves(spark, sf):
    return _records(spark, sf).leaves()


@query("SELECT DISTINCT target AS id FROM raw WHERE relation = 'calls' AND source = 'customer_1'")
def record_callees(spark, sf):
    return _records(spark, sf).callees("customer_1")


@query("SELECT DISTINCT source AS id FROM raw WHERE relation = 'calls' AND target = (SELECT 'order_' || min(o_orderkey) FROM orders)")
def record_callers(spark, sf):
    order = p.read(spark, sf, "orders").agg(F.min("o_orderkey")).head()[0]
    return _records(spark, sf).callers(f"order_{order}")


@query("SELECT id, label FROM nodes WHERE source_file = 'BUILDING.tbl'")
def record_file_nodes(spark, sf):
    return _records(spark, sf).file_nodes("BUILDING.tbl").select("id", "label")


@query("SELECT id, label FROM nodes WHERE list_contains(tags, 'machinery')")
def record_by_tag(spark, sf):
    return _records(spark, sf).by_tag("machinery").select("id", "label")


@query(
    """, near AS (SELECT 'region_1' AS id UNION SELECT target FROM raw WHERE source = 'region_1' UNION SELECT source FROM raw WHERE target = 'region_1'),
       wide AS (SELECT id FROM near UNION SELECT target FROM raw WHERE source IN (FROM near) UNION SELECT source FROM raw WHERE target IN (FROM near))
       SELECT DISTINCT source, relation, target FROM raw WHERE source IN (FROM wide) AND target IN (FROM wide)"""
)
def record_subgraph(spark, sf):
    return _records(spark, sf).subgraph("region_1", 2)


@query("SELECT n.id, n.label, (SELECT string_agg(parent, ',' ORDER BY parent) FROM tree WHERE child = n.id) AS parents, (SELECT count(*) FROM tree WHERE parent = n.id) AS children FROM nodes n WHERE n.id = 'nation_6'")
def node_detail(spark, sf):
    name = p.read(spark, sf, "nation").filter("n_nationkey = 6").head()["n_name"]
    return GraphTools(p.graph(spark, sf)).get_node(name.lower()).select("id", "label", F.array_join("parents", ",").alias("parents"), "children")


@query(
    """, m AS (SELECT greatest(max(degree), 1) AS most FROM degrees)
       SELECT id, label, coalesce(community_id, 0) AS community, floor((10 + 30 * (degree / most::DOUBLE)) * 10 + 0.5) / 10 AS size, CASE WHEN degree / most::DOUBLE >= 0.15 THEN 12 ELSE 0 END AS font, degree
       FROM nodes JOIN degrees USING (id) LEFT JOIN fine ON node_id = id, m""",
    p.PARTITION_SQL,
)
def view_nodes(spark, sf):
    return export.view_rows(p.graph(spark, sf), p.by_nation(spark, sf))[0]


@query("""SELECT source AS "from", target AS "to", relation, confidence, confidence <> 'EXTRACTED' AS dashes FROM edges""")
def view_edges(spark, sf):
    return export.view_rows(p.graph(spark, sf), p.by_nation(spark, sf))[1]


@query(
    """SELECT 'nodes' AS part, '{"id":"' || id || '","label":"' || label || '","file_type":"' || file_type || '","source_file":"' || source_file || '","tags":[' || coalesce('"' || tags[1] || '"', '') || ']}' AS value FROM nodes
       UNION ALL SELECT 'links', '{"source":"' || source || '","target":"' || target || '","relation":"' || relation || '","confidence":"' || confidence || '","weight":' || weight || '}' FROM edges"""
)
def export_node_link(spark, sf):
    return export.node_link_json(p.graph(spark, sf))


@query(
    """, b AS (SELECT *, regexp_replace(label, '[()#]', '_', 'g') AS base FROM nodes), n AS (SELECT *, row_number() OVER (PARTITION BY lower(base) ORDER BY id) AS k FROM b),
       m AS (SELECT *, CASE WHEN k = 1 THEN base ELSE base || '_' || k END AS name FROM n),
       l AS (SELECT a.id, list_sort(list(DISTINCT name)) AS names FROM adj a JOIN m ON m.id = a.peer GROUP BY a.id)
       SELECT name, concat_ws(chr(10), '# ' || label, 'type: ' || file_type, 'file: ' || source_file, 'community: [[_community_' || community_id || ']]', coalesce(array_to_string(list_transform(names, lambda x: '- [[' || x || ']]'), chr(10)), '')) AS value
       FROM m LEFT JOIN l USING (id) LEFT JOIN fine ON node_id = id""",
    p.PARTITION_SQL,
)
def export_notes(spark, sf):
    """The notes of nodes; all orders of a status share a label, so their notes are numbered."""
    notes = export.obsidian(p.graph(spark, sf), p.by_nation(spark, sf))
    return notes.filter("NOT startswith(name, '_community_')")
