"""Queries for text, vectors, signatures, trees, estimates and streams, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import STOP_WORDS, SUFFIXES, tokenize
from ..operators import align, compare, extract_calls, search, trees
from ..operators.graph import PropertyGraph
from ..sinks import export
from ..sources import detect
from . import projection as p
from .core import query

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_STEM = "CASE " + " ".join(f"WHEN suffix(w, '{s}') AND strlen(w) > {n}{' AND NOT suffix(w, $$ss$$)' if s == 's' else ''} THEN left(w, -{cut}) || '{add}'" for s, n, cut, add in SUFFIXES) + " ELSE w END"


def tokens_sql(name: str, source: str, key: str, text: str) -> str:
    """CTE with one row (key, w) for each token."""
    spaced = rf"regexp_replace(regexp_replace({text}, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')"
    return f"""{name} AS (
      SELECT {key}, w FROM (SELECT {key}, {_STEM} AS w FROM (
        SELECT {key}, unnest(regexp_split_to_array(lower({spaced}), '[^\\p{{L}}\\p{{Nd}}]+')) AS w FROM {source}) WHERE strlen(w) >= 3 AND w NOT IN ({_STOP})) WHERE strlen(w) >= 3)"""


DOCS = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"


def _documents(spark, sf):
    return p.read(spark, sf, "documents").select("doc_id", "text")


@query(", " + tokens_sql("toks", DOCS, "doc_id", "text") + " SELECT doc_id, count(*) AS n, count(DISTINCT w) AS terms FROM toks GROUP BY doc_id")
def tokenize_documents(spark, sf):
    tokens = _documents(spark, sf).select("doc_id", tokenize("text").alias("t")).filter("size(t) > 0")
    return tokens.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("terms"))


_TFIDF = tokens_sql("toks", DOCS, "doc_id", "text") + f""",
  cnt AS (SELECT doc_id, w, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS len FROM toks GROUP BY doc_id, w),
  idf AS (SELECT w, ln((SELECT count(*) FROM {DOCS})::DOUBLE / (1 + count(*))) AS idf FROM cnt GROUP BY w),
  wt AS (SELECT doc_id, w, n / len::DOUBLE * idf AS x FROM cnt JOIN idf USING (w))"""


@query(", " + _TFIDF + " SELECT doc_id, w AS term, round(x, 9) AS weight FROM wt QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(x, 9) DESC, w) <= 3")
def tfidf_top_terms(spark, sf):
    from pyspark.sql import Window

    weights = search.term_weights(_documents(spark, sf))[1].select("doc_id", "term", F.round("w", 9).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term"))
    return weights.withColumn("n", rank).filter("n <= 3").drop("n")


@query(
    ", "
    + _TFIDF
    + ", "
    + tokens_sql("btoks", "benchmark", "item_id", "text")
    + """, bcnt AS (SELECT item_id, w, count(*) AS n, sum(count(*)) OVER (PARTITION BY item_id) AS len FROM btoks GROUP BY item_id, w),
       bw AS (SELECT item_id, w, n / len::DOUBLE * idf AS x FROM bcnt JOIN idf USING (w)),
       sc AS (SELECT b.item_id, d.doc_id, sum(b.x * d.x) AS dot FROM bw b JOIN wt d USING (w) GROUP BY ALL),
       bn AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM bw GROUP BY 1), dn AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM wt GROUP BY 1)
       SELECT item_id, doc_id, round(dot / (bn.n * dn.n), 6) AS score FROM sc JOIN bn USING (item_id) JOIN dn USING (doc_id)
       WHERE dot / (bn.n * dn.n) >= 0.25 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY dot / (bn.n * dn.n) DESC, doc_id) <= 5"""
)
def tfidf_links(spark, sf):
    items = p.read(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    idf, weights = search.term_weights(_documents(spark, sf))
    found = search.top_matches(search.similar_pairs(search.query_weights(items, idf), weights, 0.25), 5, 0.25)
    return found.select(F.col("doc_a").alias("item_id"), F.col("doc_b").alias("doc_id"), F.round("score", 6).alias("score"))


@query(
    ", "
    + _TFIDF
    + ", "
    + tokens_sql("btoks", "benchmark", "item_id", "text")
    + """, bcnt AS (SELECT item_id, w, count(*) AS n, sum(count(*)) OVER (PARTITION BY item_id) AS len FROM btoks GROUP BY item_id, w),
       bw AS (SELECT item_id, w, n / len::DOUBLE * idf AS x FROM bcnt JOIN idf USING (w)),
       sc AS (SELECT b.item_id, d.doc_id, sum(b.x * d.x) AS dot FROM bw b JOIN wt d USING (w) GROUP BY ALL),
       bn AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM bw GROUP BY 1), dn AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM wt GROUP BY 1),
       top AS (SELECT item_id, doc_id, dot / (bn.n * dn.n) AS score FROM sc JOIN bn USING (item_id) JOIN dn USING (doc_id)
         WHERE score >= 0.25 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, 'doc_' || doc_id) <= 5)
       SELECT 'item_' || item_id AS source, 'doc_' || doc_id AS target, CASE WHEN score >= 0.5 THEN 'references' ELSE 'conceptually_related_to' END AS relation, round(score, 6) AS score
       FROM top WHERE doc_id % 50 <> item_id % 50"""
)
def text_code_links(spark, sf):
    """Links from benchmark texts to documents; pairs whose keys agree modulo 50 are linked before."""
    named = lambda df, kind, key: df.select(F.concat(F.lit(f"{kind}_"), F.col(key).cast("string")).alias("doc_id"), "text", F.col(key).alias("k"))
    items, docs = named(p.read(spark, sf, "benchmark"), "item", "item_id"), named(p.read(spark, sf, "documents"), "doc", "doc_id")
    known = docs.join(items.select(F.col("doc_id").alias("item"), F.col("k").alias("i")), F.col("k") % 50 == F.col("i") % 50).select(F.col("doc_id").alias("source"), F.col("item").alias("target"))
    found = search.link_text_to_code(items.drop("k"), docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), known)
    return found.select("source", "target", "relation", F.round("confidence_score", 6).alias("score"))


@query(
    """, s AS (SELECT n.id, n.label, regexp_replace(regexp_replace(lower(n.label), '[()]+$', ''), '^[.]+', '') AS c, lower(n.label) AS l, lower(n.source_file) AS f, d.degree FROM nodes n JOIN degrees d USING (id)),
       x AS (SELECT id, label, CASE WHEN c = 'france' THEN 10 WHEN starts_with(c, 'france') THEN 5 WHEN contains(l, 'france') THEN 2
           WHEN len(list_filter(regexp_split_to_array(c, '[_./-]'), lambda w: w <> '' AND levenshtein(w, 'france') <= 2)) > 0 OR (length(c) <= 20 AND levenshtein(c, 'france') <= 2) THEN 1 ELSE 0 END + CASE WHEN contains(f, 'france') THEN 1 ELSE 0 END
         + CASE WHEN c = 'geo' THEN 10 WHEN starts_with(c, 'geo') THEN 5 WHEN contains(l, 'geo') THEN 2
           WHEN len(list_filter(regexp_split_to_array(c, '[_./-]'), lambda w: w <> '' AND levenshtein(w, 'geo') <= 2)) > 0 OR (length(c) <= 20 AND levenshtein(c, 'geo') <= 2) THEN 1 ELSE 0 END + CASE WHEN contains(f, 'geo') THEN 1 ELSE 0 END AS s, degree FROM s)
       SELECT id, round(s + degree / (SELECT max(degree) FROM degrees)::DOUBLE, 9) AS score FROM x WHERE s > 0"""
)
def fuzzy_search(spark, sf):
    return search.score_nodes(p.graph(spark, sf), "france geo").select("id", F.round("score", 9).alias("score"))


#: By id, by label in another case, with diacritics, with two letters wrong, and not at all.
PROBES = ["part_3", "nAtIoN_7()", "Ámérïcä", "Midlle Eest", "no such label anywhere"]


@query(
    f""", probes AS (SELECT unnest({PROBES}) AS probe), n AS (SELECT id, lower(label) AS low, strip_accents(lower(label)) AS norm FROM nodes),
       s AS (SELECT probe, id, CASE WHEN id = probe THEN 0 WHEN low = lower(probe) THEN 1 WHEN norm = strip_accents(lower(probe)) THEN 2 WHEN levenshtein(norm, strip_accents(lower(probe))) <= {search.EDITS} THEN 3 END AS stage,
         levenshtein(norm, strip_accents(lower(probe))) AS d FROM n, probes)
       SELECT probe, id, stage FROM s WHERE stage IS NOT NULL QUALIFY row_number() OVER (PARTITION BY probe ORDER BY stage, CASE stage WHEN 3 THEN d ELSE 0 END, id) = 1"""
)
def find_node(spark, sf):
    nodes = p.graph(spark, sf).nodes
    found = [search.find_node(nodes, probe).select(F.lit(probe).alias("probe"), "id", "stage") for probe in PROBES]
    return reduce(DataFrame.unionByName, found)


@query(
    """SELECT vec_id AS id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * q[i]::DOUBLE))
         / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE)))), 9) AS score
       FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) ORDER BY score DESC, id LIMIT 10"""
)
def cosine_topk(spark, sf):
    vectors = p.read(spark, sf, "embeddings")
    asked = [float(x) for x in vectors.filter("vec_id = 0").first()["embedding"]]
    return search.rank_by_embedding(vectors, asked, 10, "vec_id", "embedding").select("id", F.round("score", 9).alias("score"))


@query("SELECT id, label || chr(10) || 'type: ' || file_type || chr(10) || 'file: ' || source_file || CASE WHEN len(tags) > 0 THEN chr(10) || 'tags: ' || array_to_string(tags, ', ') ELSE '' END AS text FROM nodes WHERE label <> ''")
def embed_text(spark, sf):
    from ..operators.graph import records

    nodes, _ = records(p.nodes(spark, sf).filter("label != ''"), p.raw_edges(spark, sf))
    return nodes.select("id", search.embedding_text().alias("text"))


TYPES_SQL = """
i AS (SELECT target AS id, bool_or(relation = 'contains') AS ci, bool_or(relation = 'imports') AS ii FROM edges GROUP BY 1),
o AS (SELECT source AS id, bool_or(relation = 'contains') AS co, bool_or(relation = 'imports') AS io FROM edges GROUP BY 1),
types AS (SELECT n.id, n.label, n.tags, CASE WHEN co AND (coalesce(io, false) OR NOT coalesce(ci, false)) THEN 'file' WHEN ci AND starts_with(label, '.') AND suffix(label, '()') THEN 'method'
    WHEN suffix(label, '()') THEN 'function' WHEN ii THEN 'import' ELSE 'entity' END AS t,
  CASE WHEN suffix(label, '()') THEN 'function' WHEN ii THEN 'import' ELSE 'entity' END AS bare FROM nodes n LEFT JOIN i USING (id) LEFT JOIN o USING (id))
"""
SIG_SQL = (
    TYPES_SQL
    + """,
ends AS (SELECT source AS id, target AS peer, 'out' AS way, relation FROM edges UNION ALL SELECT target, source, 'in', relation FROM edges),
prof AS (SELECT e.id, list_sort(list(way || ':' || relation || ':' || t.t)) AS profile, count(*) FILTER (WHERE way = 'out' AND relation = 'calls') AS arity FROM ends e JOIN types t ON t.id = e.peer GROUP BY e.id),
deg AS (SELECT id, list_sort(list(k || ':' || n)) AS d FROM (SELECT id, way || ':' || relation AS k, count(*) AS n FROM ends GROUP BY ALL) GROUP BY id),
up AS (SELECT target AS id, source AS up FROM edges WHERE relation = 'contains'),
chains AS (SELECT n.id, CASE WHEN u2.up IS NOT NULL THEN t2.bare || ',' || t1.bare WHEN u1.up IS NOT NULL THEN t1.bare ELSE '' END AS chain
  FROM nodes n LEFT JOIN up u1 ON u1.id = n.id LEFT JOIN types t1 ON t1.id = u1.up LEFT JOIN up u2 ON u2.id = u1.up LEFT JOIN types t2 ON t2.id = u2.up),
sigs AS (SELECT t.id, t.t AS node_type, left(sha256('type:' || t.t || chr(10) || 'containers:' || chain || chr(10) || 'tags:' || array_to_string(list_sort(t.tags), ',') || chr(10)
  || 'profile:' || coalesce(array_to_string(profile, ','), '') || chr(10) || 'arity:' || coalesce(arity, 0) || chr(10) || 'degrees:' || coalesce(array_to_string(d, ','), '') || chr(10)), 16) AS hash
  FROM types t JOIN chains USING (id) LEFT JOIN prof USING (id) LEFT JOIN deg USING (id))
"""
)


@query(", " + TYPES_SQL + " SELECT id, t AS node_type FROM types")
def node_types(spark, sf):
    return align.node_types(p.graph(spark, sf))


@query(", " + SIG_SQL + " SELECT id, node_type, hash FROM sigs")
def signatures(spark, sf):
    return align.signatures(p.graph(spark, sf)).select("id", "node_type", "hash")


@query(", " + TYPES_SQL + ", w AS (SELECT a.id, array_to_string(list_sort(list(t.t)), '|') AS around FROM adj a JOIN types t ON t.id = a.peer GROUP BY a.id) SELECT t.id, left(sha256(t.t || '|' || coalesce(around, '')), 16) AS hash FROM types t LEFT JOIN w USING (id)")
def wl_round1(spark, sf):
    g = p.graph(spark, sf)
    return align.refine(g, align.node_types(g).withColumnRenamed("node_type", "hash"), 1)


@query("SELECT n.id, t.parent, CASE WHEN t.parent IS NULL THEN 0 WHEN t.parent LIKE 'region%' THEN 1 ELSE 2 END AS depth FROM nodes n LEFT JOIN tree t ON t.child = n.id")
def containment_tree(spark, sf):
    return trees.containment_tree(p.graph(spark, sf)).select("id", "parent", "depth")


_AHU = """ahu2 AS (SELECT parent AS id, md5(count(*)::VARCHAR) AS h, count(*) + 1 AS size FROM tree WHERE parent LIKE 'nation%' GROUP BY parent),
  ahu1 AS (SELECT t.parent AS id, md5(string_agg(coalesce(a.h, ''), ',' ORDER BY coalesce(a.h, ''))) AS h, sum(coalesce(a.size, 1)) + 1 AS size FROM tree t LEFT JOIN ahu2 a ON a.id = t.child WHERE t.parent LIKE 'region%' GROUP BY t.parent),
  ahu AS (SELECT n.id, coalesce(x.h, y.h, '') AS h, coalesce(x.size, y.size, 1)::BIGINT AS size FROM nodes n LEFT JOIN ahu1 x ON x.id = n.id LEFT JOIN ahu2 y ON y.id = n.id)"""


@query(", " + _AHU + " SELECT sub_size, shapes, sum(nodes)::BIGINT AS nodes FROM (SELECT size AS sub_size, count(*) AS nodes, count(DISTINCT h) AS shapes FROM ahu GROUP BY size) GROUP BY ALL")
def ahu_histogram(spark, sf):
    h = trees.subtree_hashes(trees.containment_tree(p.graph(spark, sf)))
    return h.groupBy("sub_size").agg(F.countDistinct("ahu").alias("shapes"), F.count(F.lit(1)).alias("nodes"))


def _role_sql(prefix: str) -> str:
    t = TYPES_SQL
    for name in ("types", "i", "o"):
        t = t.replace(f"\n{name} AS", f"\n{prefix}{name} AS").replace(f"JOIN {name} USING", f"JOIN {prefix}{name} USING")
    nodes, edges = (f"{prefix}_nodes", f"{prefix}_edges") if prefix == "a" else ("nodes", "edges")
    t = t.replace("FROM edges", f"FROM {edges}").replace("FROM nodes n", f"FROM {nodes} n").replace(f"{prefix}types", f"{prefix}_types")
    return (
        t
        + f""", {prefix}_calls AS (SELECT source AS id, count(*) AS arity FROM {edges} WHERE relation = 'calls' GROUP BY 1),
    {prefix}_roles AS (SELECT t || ':' || CASE WHEN len(tags) > 0 THEN array_to_string(list_sort(tags), '+') ELSE 'none' END || ':a' || CASE WHEN coalesce(arity, 0) = 0 THEN '0' WHEN arity <= 2 THEN '1-2' WHEN arity <= 5 THEN '3-5' ELSE '6+' END AS role, count(*)::DOUBLE AS n
      FROM {prefix}_types LEFT JOIN {prefix}_calls USING (id) GROUP BY 1)"""
    )


@query(
    ", " + _role_sql("a").strip() + ", " + _role_sql("b").strip()
    + " SELECT round((SELECT sum(a.n * b.n) FROM a_roles a JOIN b_roles b USING (role)) / (sqrt((SELECT sum(n * n) FROM a_roles)) * sqrt((SELECT sum(n * n) FROM b_roles))), 9) AS cosine",
    p.EARLIER_SQL,
)
def role_similarity(spark, sf):
    a, b = (trees.containment_tree(g) for g in (p.earlier(spark, sf), p.graph(spark, sf)))
    return trees.role_similarity(a, b).select(F.round("cosine", 9).alias("cosine"))


#: Shapes of containment trees in both versions, as text, by the depth at which they are cut. Trees here have three levels,
#: so a cut at three shows all.
_SHAPES = """versions AS (SELECT 'a' AS v, id FROM a_nodes UNION ALL SELECT 'b', id FROM nodes),
  kids AS (SELECT 'a' AS v, source AS parent, target AS child FROM a_edges WHERE relation IN ('contains', 'method') AND NOT regexp_matches(target, '^customer_[0-9]*3$') UNION ALL SELECT 'b', parent, child FROM tree),
  c0 AS (SELECT v, id, '.' AS shape FROM versions),
""" + ",\n".join(
    f"""  c{d} AS MATERIALIZED (SELECT b.v, b.id, coalesce(k.shape, '.') AS shape FROM versions b LEFT JOIN (
    SELECT kids.v, parent, '(' || md5(string_agg(shape, '' ORDER BY shape)) || ')' AS shape FROM kids JOIN c{d - 1} c ON c.v = kids.v AND c.id = child GROUP BY kids.v, parent) k ON k.v = b.v AND k.parent = b.id)"""
    for d in range(1, 5)
)


def _thinned(spark, sf) -> PropertyGraph:
    """The earlier version, in which no nation holds the customers whose key ends in 3."""
    g = p.earlier(spark, sf)
    return PropertyGraph(g.nodes, g.edges.filter("relation != 'contains' OR target NOT RLIKE '^customer_[0-9]*3$'"))


@query(
    """SELECT round(sum(x * y) / sqrt(sum(x * x)) / sqrt(sum(y * y)), 9) AS cosine FROM (
         SELECT shape, count(*) FILTER (v = 'a')::DOUBLE AS x, count(*) FILTER (v = 'b')::DOUBLE AS y FROM (FROM c1 UNION ALL FROM c2 UNION ALL FROM c3 UNION ALL FROM c4) GROUP BY shape)""",
    p.EARLIER_SQL,
    _SHAPES,
)
def subtree_freq(spark, sf):
    a, b = (trees.containment_tree(g) for g in (_thinned(spark, sf), p.graph(spark, sf)))
    return trees.subtree_frequency(a, b).select(F.round("cosine", 9).alias("cosine"))


@query(
    """SELECT round(ab, 5) AS ln_ab, round(aa, 5) AS ln_aa, round(bb, 5) AS ln_bb, round(exp(ab - (aa + bb) / 2), 9) AS score
       FROM (SELECT max(CASE WHEN o = 'ab' THEN l END) AS ab, max(CASE WHEN o = 'aa' THEN l END) AS aa, max(CASE WHEN o = 'bb' THEN l END) AS bb FROM logs)""",
    p.EARLIER_SQL,
    _SHAPES,
    # ln of each subtree's kernel with itself, from the leaves up; then ln of the three sums over pairs of equal shapes
    "k0 AS (SELECT v, id, ln(0.5) AS k FROM versions WHERE (v, id) NOT IN (SELECT (v, parent) FROM kids))",
    *[
        f"""k{h} AS MATERIALIZED (SELECT kids.v, parent AS id, ln(0.5) + sum(greatest(k, 0) + ln(1 + exp(-abs(k)))) AS k FROM kids JOIN (SELECT * FROM {" UNION ALL SELECT * FROM ".join(f"k{x}" for x in range(h))}) below ON below.v = kids.v AND below.id = child
          GROUP BY kids.v, parent HAVING count(*) = (SELECT count(*) FROM kids o WHERE o.v = kids.v AND o.parent = kids.parent) AND (kids.v, kids.parent) NOT IN (SELECT (v, id) FROM k{h - 1}{"" if h < 2 else " UNION ALL SELECT (v, id) FROM k1"}))"""
        for h in (1, 2)
    ],
    "every AS (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2)",
    "shapes AS (SELECT shape, max(k) AS k, count(*) FILTER (c.v = 'a')::DOUBLE AS x, count(*) FILTER (c.v = 'b')::DOUBLE AS y FROM c4 c JOIN every e ON e.v = c.v AND e.id = c.id GROUP BY shape)",
    """terms AS (SELECT o, ln(m) + CASE WHEN base THEN ln(0.5) ELSE k + ln(1 - exp(ln(0.5) - k)) END AS l FROM (
         SELECT o, CASE o WHEN 'ab' THEN x * y WHEN 'aa' THEN x * x ELSE y * y END AS m, k, false AS base FROM shapes, (VALUES ('ab'), ('aa'), ('bb')) t(o) WHERE k > ln(0.5) + 1e-12
         UNION ALL SELECT o, CASE o WHEN 'ab' THEN sum(x) * sum(y) WHEN 'aa' THEN sum(x) * sum(x) ELSE sum(y) * sum(y) END, 0, true FROM shapes, (VALUES ('ab'), ('aa'), ('bb')) t(o) GROUP BY o) WHERE m > 0)""",
    "logs AS (SELECT o, most + ln(sum(exp(l - most))) AS l FROM (SELECT o, l, max(l) OVER (PARTITION BY o) AS most FROM terms) GROUP BY o, most)",
)
def tree_kernel(spark, sf):
    a, b = (trees.containment_tree(g) for g in (_thinned(spark, sf), p.graph(spark, sf)))
    return trees.kernel_logs(a, b).select(*[F.round(c, 5).alias(c) for c in ("ln_ab", "ln_aa", "ln_bb")], F.round(trees.kernel_score(), 9).alias("score"))


_METRICS = ", ".join(f"('{m}', {w[0]}::DOUBLE, {w[2]}::DOUBLE, {w[3]}, {k})" for k, (m, w) in enumerate(compare.METRICS.items()))
#: Scores of g1 with each other graph: shares of orders by priority, status and key; one metric of g3 has none.
_SCORED = f"""w AS (SELECT * FROM (VALUES {_METRICS}) AS v(m, w0, w, is_metric, k)),
  s AS (SELECT 'g1' AS a, b, m, CASE WHEN b = 'g3' AND k = 3 THEN -1.0 ELSE round(sum(CASE WHEN (o_orderkey * (k + 3)) % 101 < 20 * g + 5 * k THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) END AS s
    FROM orders, w, (SELECT 'g' || i AS b, 6 - i AS g FROM range(2, 6) t(i)) GROUP BY b, m, k)"""


def _scores(spark, sf):
    orders = p.read(spark, sf, "orders").select("o_orderkey")
    metrics = spark.createDataFrame([(m, k) for k, m in enumerate(compare.METRICS)], "metric string, k int")
    others = spark.createDataFrame([(f"g{i}", 6 - i) for i in range(2, 6)], "label_b string, g int")
    hit = (F.col("o_orderkey") * (F.col("k") + 3)) % 101 < 20 * F.col("g") + 5 * F.col("k")
    shares = orders.crossJoin(F.broadcast(metrics.crossJoin(others))).groupBy("label_b", "metric", "k").agg(F.round(F.sum(hit.cast("long")) / F.count(F.lit(1)), 6).alias("score"))
    none = (F.col("label_b") == "g3") & (F.col("k") == 3)
    return shares.select(F.lit("g1").alias("label_a"), "label_b", "metric", F.when(none, -1.0).otherwise(F.col("score")).alias("score"))


@query(
    f""", {_SCORED},
     x AS (SELECT p.b AS label_a, q.b AS label_b, w, CASE WHEN is_metric THEN 1 - ((1 - p.s) + (1 - q.s)) ELSE least(p.s, q.s) - 0.1 END AS lo, CASE WHEN is_metric THEN 1 - abs(p.s - q.s) ELSE greatest(p.s, q.s) + 0.05 END AS hi
       FROM s p JOIN s q ON q.m = p.m AND p.b < q.b AND p.s >= 0 AND q.s >= 0 JOIN w ON w.m = p.m),
     y AS (SELECT label_a, label_b, sum(w * greatest(0, least(1, lo))) / sum(w) AS lo, sum(w * greatest(0, least(1, hi))) / sum(w) AS hi FROM x GROUP BY ALL)
     SELECT label_a, label_b, floor(least(lo, hi) * 1000 + 0.5) / 1000 AS lower, floor(greatest(lo, hi) * 1000 + 0.5) / 1000 AS upper, floor((lo + hi) / 2 * 1000 + 0.5) / 1000 AS mid FROM y"""
)
def estimate_bounds(spark, sf):
    return compare.estimate(_scores(spark, sf))


@query(f", {_SCORED} SELECT b AS label_b, round(sum(w0 * s) / sum(w0), 9) AS composite FROM s JOIN w USING (m) WHERE w0 > 0 AND s >= 0 GROUP BY b")
def composite_score(spark, sf):
    weights = compare.weights_table(spark, {m: w[0] for m, w in compare.METRICS.items()})
    scores = _scores(spark, sf)
    each = [compare.composite(scores.filter(F.col("label_b") == b), weights).select(F.lit(b).alias("label_b"), F.round("composite", 9).alias("composite")) for b in ("g2", "g3", "g4", "g5")]
    return reduce(DataFrame.unionByName, each)


@query(
    """, c AS (SELECT source, target FROM edges WHERE relation = 'imports'), d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM c UNION ALL SELECT target FROM c) GROUP BY id),
       top AS (SELECT id FROM d ORDER BY degree DESC, id LIMIT 200) SELECT source, target FROM c WHERE source IN (FROM top) AND target IN (FROM top)"""
)
def call_top200(spark, sf):
    g = p.graph(spark, sf)  # calls here go from customers to orders of degree 1, so imports stand in for them
    flow = PropertyGraph(g.nodes, g.edges.filter("relation = 'imports'").withColumn("relation", F.lit("calls")))
    return export.call_flow(flow).edges.select("source", "target")


@query(
    """, calls AS (SELECT 'customer_' || o_custkey AS caller, 'SUPPLIER#' || (o_orderkey % 150) AS callee, o_orderkey AS ord FROM orders),
       idx AS (SELECT lower(regexp_replace(regexp_replace(label, '[()]+$', ''), '^[.]+', '')) AS l, max(id) AS id FROM nodes GROUP BY 1)
       SELECT DISTINCT caller AS source, id AS target FROM (SELECT caller, 'supplier#' || lpad(split_part(callee, '#', 2), 9, '0') AS l FROM calls) JOIN idx USING (l)
       EXCEPT SELECT 'customer_' || o_custkey, 'supplier_' || (o_orderkey % 150) FROM orders WHERE o_orderstatus = 'F'"""
)
def cross_file_calls(spark, sf):
    orders = p.read(spark, sf, "orders")
    n = F.lpad((F.col("o_orderkey") % 150).cast("string"), 9, "0")
    calls = orders.select(F.concat(F.lit("customer_"), F.col("o_custkey").cast("string")).alias("caller_nid"), F.concat(F.lit("SUPPLIER#"), n).alias("callee"), F.lit(False).alias("is_member_call"), F.lit("").alias("source_file"), F.lit("").alias("source_location"))
    nodes = p.nodes(spark, sf).withColumn("ord", F.col("id"))
    known = orders.filter("o_orderstatus = 'F'").select(F.concat(F.lit("customer_"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("supplier_"), (F.col("o_orderkey") % 150).cast("string")).alias("target"))
    return extract_calls.resolve_across_files(calls, nodes, known).select("source", "target")


@query(
    """, e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 SECOND THEN 0 ELSE 1 END AS fresh FROM events),
       s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
       SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) GROUP BY user_id"""
)
def debounce_sessions(spark, sf):
    from ..streaming.watch import debounce

    return debounce(p.read(spark, sf, "events"), "3 seconds", "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("events").alias("events"))


@query(
    """SELECT 'MERGE (n:Entity {id: $' || id || '$}) SET n.label = $' || label || '$, n.file_type = $' || file_type || '$, n.source_file = $' || source_file || '$;' AS value FROM nodes
       UNION ALL SELECT 'MATCH (a:Entity {id: $' || source || '$}), (b:Entity {id: $' || target || '$}) MERGE (a)-[:' || upper(relation) || ' {confidence: $' || confidence || '$}]->(b);' FROM edges"""
    .replace("$", "''")
)
def export_cypher(spark, sf):
    """No label here holds a quote, so this says nothing of escaping."""
    return export.cypher(p.graph(spark, sf))


@query(
    """SELECT '<node id="' || id || '"><data key="label">' || label || '</data><data key="file_type">' || file_type || '</data><data key="source_file">' || source_file || '</data><data key="community">' || coalesce(community_id, 0) || '</data></node>' AS value
         FROM nodes LEFT JOIN fine ON node_id = id
       UNION ALL SELECT '<edge source="' || source || '" target="' || target || '"><data key="relation">' || relation || '</data><data key="confidence">' || confidence || '</data><data key="weight">' || weight || '</data></edge>' FROM edges""",
    p.PARTITION_SQL,
)
def export_graphml(spark, sf):
    """Without the lines of the head and the end, which hold no data."""
    lines = export.graphml(p.graph(spark, sf), p.by_nation(spark, sf))
    return lines.filter("value LIKE '<node %' OR value LIKE '<edge %'")


#: Endings given to the documents in turn, as if they were files.
ENDINGS = [".py", ".md", ".txt", ".pdf", ".png", ".mp4", ".docx", ".bin", ".go", "_token.py"]
_SIGNS = " + ".join(f"regexp_matches(head, $${sign}$$)::INTEGER" for sign in detect.PAPER_SIGNS)


@query(
    f""", f AS (SELECT doc_id, {ENDINGS}[doc_id % 10 + 1] AS ending, coalesce(text, '') AS text, left(coalesce(text, ''), {detect.PAPER_BYTES}) AS head FROM documents WHERE doc_id % 7 <> 3),
       t AS (SELECT doc_id, ending = '_token.py' AS skipped, CASE WHEN ending IN ('.py', '.go', '_token.py') THEN 'code' WHEN ending = '.pdf' THEN 'paper' WHEN ending = '.png' THEN 'image' WHEN ending = '.mp4' THEN 'video' WHEN ending = '.docx' THEN 'document'
           WHEN ending IN ('.md', '.txt') THEN CASE WHEN {_SIGNS} >= {detect.PAPER_LEAST} THEN 'paper' ELSE 'document' END END AS file_type,
         len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS words FROM f)
       SELECT file_type, skipped, count(*) AS files, sum(CASE WHEN skipped THEN 0 ELSE words END)::BIGINT AS words FROM t WHERE file_type IS NOT NULL GROUP BY ALL"""
)
def detect_files(spark, sf):
    """The documents as files of ten kinds, a seventh of them in a folder that an ignore file names."""
    docs = p.read(spark, sf, "documents")
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("doc_id") % 10 + 1).cast("int"))
    folder = F.when(F.col("doc_id") % 7 == 3, "old/").otherwise("src/")
    rules = spark.createDataFrame([(".gitignore", "old/\n")], "path string, text string")
    found = detect.detect(docs.select(F.concat(folder, F.lit("f"), F.col("doc_id").cast("string"), ending).alias("path"), "text").unionByName(rules), detect.ignore_rules(rules))
    return found.groupBy("file_type", "skipped").agg(F.count(F.lit(1)).alias("files"), F.sum("words").alias("words"))


def graph_alignment(spark, sf):
    """The earlier version against the later, renamed parts to be found again by structure."""
    return align.align(p.earlier(spark, sf), p.graph(spark, sf))


def communities(spark, sf):
    from ..operators import community

    return community.cluster(p.graph(spark, sf))


EXTRA = {f.__name__: f for f in (graph_alignment, communities)}
