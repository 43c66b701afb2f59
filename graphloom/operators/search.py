"""Fuzzy search, lookup by label, vectors, TF-IDF, links from text to code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import cosine, normalize_label, tokenize
from .graph import PropertyGraph
from .rounds import cut

EDITS = 2


def _near(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, EDITS) >= 0


def _near_to(term: Column):
    return lambda word: _near(word, term)


def score_nodes(graph: PropertyGraph, query: str) -> DataFrame:
    """(id, label, score), best first: for each term of the query 10 for the whole label, else 5
    for its start, 2 for a part of it, 1 for a word within two edits; 1 more if the file name
    holds the term. Nodes over 0 gain their share of the largest degree. Distances count
    characters (bytes, on ASCII)."""
    spark = graph.nodes.sparkSession
    terms = spark.range(1).select(F.explode(F.split(F.trim(normalize_label(F.lit(query))), r"\s+")).alias("term"), F.lit(1).alias("_one")).filter("term != ''").drop("_one")
    terms = [r["term"] for r in terms.collect()]  # the words of one query
    if not terms:
        return graph.nodes.select("id", "label", F.lit(0.0).alias("score")).limit(0)
    degrees = graph.degrees()
    most = degrees.agg(F.greatest(F.max("degree"), F.lit(1)).alias("most"))
    norm = normalize_label(F.coalesce("label", F.lit("")))
    rows = graph.nodes.select("id", "label", F.lower(F.coalesce("source_file", F.lit(""))).alias("file"), F.coalesce(norm, F.lit("")).alias("norm"))
    rows = rows.withColumn("clean", F.regexp_replace(F.regexp_replace("norm", r"[()]+$", ""), r"^[.]+", ""))
    score = F.lit(0)
    for t in terms:
        term = F.lit(t)
        word = F.exists(F.filter(F.split("clean", "[_./-]"), lambda w: w != ""), _near_to(term))
        fuzzy = word | ((F.octet_length("clean") <= 20) & _near(F.col("clean"), term))
        by_label = F.when(F.col("clean") == term, 10).when(F.col("clean").startswith(term), 5).when(F.col("norm").contains(term), 2).when(fuzzy, 1).otherwise(0)
        score = score + by_label + F.col("file").contains(term).cast("int")
    hits = rows.withColumn("score", score).filter("score > 0")
    scored = hits.join(degrees, "id").crossJoin(F.broadcast(most))
    return scored.select("id", "label", (F.col("score") + F.col("degree") / F.col("most")).alias("score")).orderBy(F.desc("score"), "id")


def find_node(nodes: DataFrame, label: str) -> DataFrame:
    """(id, stage) of the node meant: by id, else label in any case, else without diacritics,
    else nearest within two edits; ties by id. No row if nothing fits."""
    low, norm = F.lower("label"), normalize_label(F.coalesce("label", F.lit("")))
    wanted = normalize_label(F.lit(label))
    distance = F.levenshtein(norm, wanted, EDITS)
    stage = F.when(F.col("id") == label, 0).when(low == label.lower(), 1).when(norm == wanted, 2).when(distance >= 0, 3)
    return nodes.select("id", stage.alias("stage"), F.when(stage == 3, distance).otherwise(0).alias("distance")).filter("stage is not null").orderBy("stage", "distance", "id").limit(1).select("id", "stage")


def rank_by_embedding(store: DataFrame, query: list[float], top_n: int = 10, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """(id, score) over 0, best first; ``top_n`` of 0 or less gives all."""
    scored = store.select(F.col(id_col).alias("id"), cosine(F.col(vec), F.array(*[F.lit(float(x)) for x in query])).alias("score")).filter("score > 0").orderBy(F.desc("score"), "id")
    return scored.limit(top_n) if top_n > 0 else scored


def node_document(label="label", comment="comment", logs="log_messages", throws="throw_messages") -> Column:
    """Text of a node for matching: label, comment, log and throw messages."""
    return F.concat_ws(" ", F.col(label), F.col(comment), F.col(logs), F.col(throws))


def embedding_text() -> Column:
    """What is embedded of a node: label, type, file, up to 800 characters of comment and 2000 of content, tags."""
    cut = lambda c, n: F.when(F.col(c) != "", F.concat(F.lit("doc: " if c == "comment" else ""), F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(F.col(c))))
    named = lambda name, c: F.when(F.col(c) != "", F.concat(F.lit(f"{name}: "), F.col(c)))
    tags = F.when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0, F.concat(F.lit("tags: "), F.array_join("tags", ", ")))
    return F.concat_ws("\n", F.when(F.col("label") != "", F.col("label")), named("type", "file_type"), named("file", "source_file"), cut("comment", 800), cut("content", 2000), tags)


def term_weights(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``docs`` (doc_id, text): idf (term, idf = ln(N / (1 + df)), negative for terms in every
    document) and weights (doc_id, term, w = share of the document's tokens times idf)."""
    tokens = docs.select("doc_id", tokenize("text").alias("tokens"))
    counts = cut(tokens.select("doc_id", F.size("tokens").alias("len"), F.explode("tokens").alias("term")).groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("n")))
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    idf = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(total)).select("term", F.log(F.col("total") / (1 + F.col("df"))).alias("idf"))
    return idf, counts.join(idf, "term").select("doc_id", "term", (F.col("n") / F.col("len") * F.col("idf")).alias("w"))


def query_weights(docs: DataFrame, idf: DataFrame) -> DataFrame:
    """Weights of other texts by a given idf; terms it lacks drop out but count in the length."""
    tokens = docs.select("doc_id", tokenize("text").alias("tokens"))
    counts = tokens.select("doc_id", F.size("tokens").alias("len"), F.explode("tokens").alias("term")).groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(idf, "term").select("doc_id", "term", (F.col("n") / F.col("len") * F.col("idf")).alias("w"))


def _total(x: Column) -> Column:
    """The sum of a group by size, so that equal terms give an equal sum whatever order rows come in: copies then tie."""
    return F.aggregate(F.array_sort(F.collect_list(x)), F.lit(0.0), lambda s, v: s + v)


def sparse_cosine(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_a, doc_b, score) of every pair that shares a term: an inverted-index join. Terms in
    nearly all documents weigh about 0; those of weight 0 take no part."""
    norms = lambda x, k: x.groupBy("doc_id").agg(F.sqrt(_total(F.col("w") * F.col("w"))).alias(f"n_{k}")).withColumnRenamed("doc_id", f"doc_{k}")
    side = lambda x, k: x.filter("w != 0").select(F.col("doc_id").alias(f"doc_{k}"), "term", F.col("w").alias(f"w_{k}"))
    dots = side(a, "a").join(side(b, "b"), "term").groupBy("doc_a", "doc_b").agg(_total(F.col("w_a") * F.col("w_b")).alias("dot"))
    return dots.join(norms(a, "a"), "doc_a").join(norms(b, "b"), "doc_b").select("doc_a", "doc_b", (F.col("dot") / (F.col("n_a") * F.col("n_b"))).alias("score"))


def similar_pairs(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """(doc_a, doc_b, score) of the pairs of sparse_cosine that reach ``threshold``, a number over 0.

    Terms are taken in order from rare to frequent. The first terms of a document of ``b`` are indexed, until what is left of
    its norm is under the threshold: a pair that shares none of these can't reach it. So frequent terms, which
    come last and weigh little, pair nothing. Candidates are then scored in full.
    """
    a, b = cut(a.filter("w != 0")), cut(b.filter("w != 0"))
    size = lambda x: x.groupBy("doc_id").agg(F.sqrt(_total(F.col("w") * F.col("w"))).alias("norm"))
    norms_a, norms_b = size(a), size(b)
    holders = b.groupBy("term").agg(F.count(F.lit(1)).alias("holders"))
    rare_first = Window.partitionBy("doc_id").orderBy("holders", "term").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("w") * F.col("w")).over(rare_first), F.lit(0.0))
    left = F.col("norm") * F.col("norm") - before
    indexed = b.join(holders, "term").join(norms_b, "doc_id").withColumn("left", left).filter(F.col("left") >= (threshold * F.col("norm")) ** 2 * (1 - 1e-9)).select("term", F.col("doc_id").alias("doc_b"))
    pairs = cut(a.select("term", F.col("doc_id").alias("doc_a")).join(indexed, "term").select("doc_a", "doc_b").distinct())
    terms = pairs.join(a.select(F.col("doc_id").alias("doc_a"), "term", F.col("w").alias("w_a")), "doc_a")
    dots = terms.join(b.select(F.col("doc_id").alias("doc_b"), "term", F.col("w").alias("w_b")), ["doc_b", "term"]).groupBy("doc_a", "doc_b").agg(_total(F.col("w_a") * F.col("w_b")).alias("dot"))
    named = lambda x, k: x.select(F.col("doc_id").alias(f"doc_{k}"), F.col("norm").alias(f"n_{k}"))
    scored = dots.join(named(norms_a, "a"), "doc_a").join(named(norms_b, "b"), "doc_b")
    return scored.select("doc_a", "doc_b", (F.col("dot") / (F.col("n_a") * F.col("n_b"))).alias("score")).filter(F.col("score") >= threshold)


def top_matches(scores: DataFrame, k: int, threshold: float) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("doc_a").orderBy(F.desc("score"), "doc_b"))
    return scores.filter(F.col("score") >= threshold).withColumn("rank", rank).filter(F.col("rank") <= k)


def link_text_to_code(semantic: DataFrame, code: DataFrame, edges: DataFrame, k: int = 5, threshold: float = 0.25, strong: float = 0.5) -> DataFrame:
    """New edges from each text node (doc_id, text) to its nearest code nodes: ``references`` from
    ``strong`` on, else ``conceptually_related_to``. Pairs already linked, either way, are left
    out after the cut to k, so fewer than k may remain."""
    idf, weights = term_weights(code)
    found = top_matches(similar_pairs(query_weights(semantic, idf), weights, threshold), k, threshold).filter("doc_a != doc_b")
    pairs = edges.select(F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")).distinct()
    keyed = found.withColumns({"lo": F.least("doc_a", "doc_b"), "hi": F.greatest("doc_a", "doc_b")}).join(pairs, ["lo", "hi"], "left_anti")
    first = keyed.withColumn("n", F.row_number().over(Window.partitionBy("lo", "hi").orderBy("doc_a"))).filter("n = 1")
    return first.select(F.col("doc_a").alias("source"), F.col("doc_b").alias("target"), F.when(F.col("score") >= strong, "references").otherwise("conceptually_related_to").alias("relation"), F.lit("INFERRED").alias("confidence"), F.col("score").alias("confidence_score"), F.lit(1.0).alias("weight"))


def resolve_dangling(edges: DataFrame, nodes: DataFrame, code: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Edges whose unknown endpoints are replaced by the best code node for their id's words, where one reaches the threshold."""
    idf, weights = term_weights(code)
    unknown = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    best = top_matches(similar_pairs(query_weights(unknown.select(F.col("id").alias("doc_id"), F.col("id").alias("text")), idf), weights, threshold), 1, threshold).select(F.col("doc_a").alias("_from"), F.col("doc_b").alias("_to"))
    for end in ("source", "target"):
        edges = edges.join(best, edges[end] == best["_from"], "left").withColumn(end, F.coalesce("_to", end)).drop("_from", "_to")
    return edges


def search_tokens(nodes: DataFrame, query: str, top: int = 10) -> DataFrame:
    """(id, label, score): for each query token 3 for an equal label token, 1 if one starts with the
    other, 2 if the id holds it; best first."""
    asked = F.array_distinct(tokenize(F.lit(query)))
    mine = tokenize("label")
    score = F.aggregate(
        asked,
        F.lit(0),
        lambda s, t: s + F.when(F.array_contains(mine, t), 3).when(F.exists(mine, lambda w: w.startswith(t) | t.startswith(w)), 1).otherwise(0) + F.when(F.lower("id").contains(t), 2).otherwise(0),
    )
    return nodes.select("id", "label", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(top)


def search_comments(nodes: DataFrame, keyword: str, limit: int = 10) -> DataFrame:
    """(id, found_in, text): comment, else first log message, else first throw message that holds the keyword."""
    word = keyword.lower()
    comment = F.when(F.lower("comment").contains(word), F.col("comment"))
    logs, throws = F.try_element_at(F.filter(F.coalesce("log_messages", F.array().cast("array<string>")), lambda m: F.lower(m).contains(word)), F.lit(1)), F.try_element_at(F.filter(F.coalesce("throw_messages", F.array().cast("array<string>")), lambda m: F.lower(m).contains(word)), F.lit(1))
    where = F.when(comment.isNotNull(), "comment").when(logs.isNotNull(), "log").when(throws.isNotNull(), "throw")
    return nodes.select("id", where.alias("found_in"), F.coalesce(comment, logs, throws).alias("text")).filter("found_in is not null").orderBy("id").limit(limit)
