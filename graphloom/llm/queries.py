"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup as exact
from . import annular_codes, collision_ann, compact_windows, cross_tokens, harmonic, hilbert, langid, nra_topk, raking, setsketch, sst, url_filter
from .common import scratch, table

TOKENIZER = "word_bpe_49k.json"


def op1_sst_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "sst")
    sst.write_shards(table(spark, sf_dir, "documents"), "doc_id", "text", path, public_tokenizers.path(TOKENIZER))
    return sst.read_digests(spark, path).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32", "shard")


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    dims = [hilbert.hash_level(F.col("lang")), hilbert.hash_level(F.col("source")), hilbert.log_level(F.col("size"))]
    cut = hilbert.hilbert_shards(docs, dims, 8, ["doc_id", "size", "text_crc32"])
    return cut.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op4_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), width=4, threshold=0.8)


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM words),
grams AS (SELECT doc_id, hash(unnest(s)) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sets sa ON sa.doc_id = a.doc_id JOIN sets sb ON sb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, len(sa.s), len(sb.s)
  HAVING 100 * count(*) >= 80 * (len(sa.s) + len(sb.s) - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.y) AS component_id, s.doc_id = min(r.y) AS kept
FROM sets s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.s)
"""


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic.harmonic_pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = collision_ann.collision_search(vectors, vectors.filter("vec_id % 50 = 0"), k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]
SEEDS = ["adult", "ads", "bets", "casino", "pills", "spam", "porn", "viagra"]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.url_filter(pages, RULES, url_filter.word_counts(pages, "html"), SEEDS)


MIX_BUDGET, MIX_POWERS = 0.6, {"source": 0.7, "lang": 0.7, "topic": 0.9}


def op7_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.mix(table(spark, sf_dir, "documents"), MIX_BUDGET, MIX_POWERS)


def _op7_sql() -> str:
    """The same fit as a chain of steps, one for each dimension and pass."""
    topic = " ".join(f"WHEN {' OR '.join(f'contains(lower(t), \'{p}\')' for p in phrases)} THEN '{name}'" for name, phrases in raking.TOPICS)
    out = [
        f"""docs AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE {topic} ELSE 'general' END AS topic,
          greatest(strlen(t) // 4, 1)::BIGINT AS tokens FROM (SELECT *, coalesce(text, '') AS t FROM documents))""",
        "cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL)",
    ]
    for dim, power in MIX_POWERS.items():
        out.append(f"t_{dim} AS (SELECT {dim}, pow(t, {power}) / sum(pow(t, {power})) OVER () * sum(t) OVER () * {MIX_BUDGET} AS target FROM (SELECT {dim}, sum(tokens) AS t FROM cells GROUP BY {dim}))")
    out.append("w0 AS (SELECT *, 1.0::DOUBLE AS weight FROM cells)")
    steps = [d for _ in range(raking.PASSES) for d in MIX_POWERS]
    for i, dim in enumerate(steps):
        out.append(f"w{i + 1} AS (SELECT source, lang, topic, tokens, weight * (target / sum(tokens * weight) OVER (PARTITION BY {dim})) AS weight FROM w{i} JOIN t_{dim} USING ({dim}))")
    return f"""WITH {", ".join(out)} SELECT doc_id, source, lang, topic, d.tokens, round(weight, 6) AS weight, round(least(weight, 1), 6) AS probability,
      ('0x' || left(md5('mix:' || coalesce(doc_id::VARCHAR, chr(0)) || ':' || d.tokens), 13))::BIGINT / 4503599627370496::DOUBLE < least(weight, 1) AS kept
      FROM docs d JOIN w{len(steps)} w USING (source, lang, topic)"""


def op8_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.repeated_passages(table(spark, sf_dir, "documents"))


def op10_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.fit(table(spark, sf_dir, "documents"))
    host = url_filter.host_of(F.col("url"))
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = table(spark, sf_dir, "pages").select(
        "page_id",
        langid.visible_text(html).alias("text"),
        langid.declared_language(html).alias("declared"),
        F.element_at(F.split(host, "[.]"), -1).alias("suffix"),
        F.array_join(F.slice(F.split(host, "[.]"), F.greatest(F.size(F.split(host, "[.]")) - 1, F.lit(1)), F.lit(2)), ".").alias("domain"),
        host.alias("host"),
    )
    return langid.identify(pages, model)


def op11_annular_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = annular_codes.train_and_encode(table(spark, sf_dir, "embeddings"))
    digest = F.lit(None).cast("string")
    for dim, book in books.items():
        digest = F.when(F.col("dim") == dim, F.sha2(F.lit(annular_codes.said(book)), 256)).otherwise(digest)
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    out = annular_codes.with_label_error(coded)
    return out.select("vec_id", code.alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def _op11_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Each round as two steps, whose tables are computed once."""
    nearest = """SELECT v.vec_id, v.p, min(list_sum([(v.x[i] - b.x[i]) * (v.x[i] - b.x[i]) FOR i IN range(1, len(v.x) + 1)])::HUGEINT * 256 + b.e) AS best
      FROM parts v JOIN {book} b USING (p) GROUP BY v.vec_id, v.p"""
    out = [
        "kept AS MATERIALIZED (SELECT vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)",
        f"parts AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) r(p))",
        f"b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))",
    ]
    for i in range(rounds):
        out.append(f"a{i} AS MATERIALIZED ({nearest.format(book=f'b{i}')})")
        out.append(f"""b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN (
          SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM (
            SELECT p, (best % 256)::BIGINT AS e, j, sum(x[j])::HUGEINT AS s, count(*) AS n FROM a{i} JOIN parts USING (vec_id, p), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS j) GROUP BY ALL)
          GROUP BY p, e) m USING (p, e))""")
    return f"""WITH {", ".join(out)}, last AS MATERIALIZED ({nearest.format(book=f"b{rounds}")}),
      said AS (SELECT sha256(string_agg(x[j]::VARCHAR, ',' ORDER BY p, e, j)) AS s FROM b{rounds}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS j)),
      coded AS (SELECT vec_id, string_agg(printf('%02x', (best % 256)::INT), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM last GROUP BY vec_id)
      SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT s FROM said) AS codebooks_sha256 FROM coded JOIN kept USING (vec_id)"""


def op12_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = nra_topk.top_products(vectors, vectors.filter("vec_id % 50 = 0"), k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP12_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""


def op13_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokens.align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sst_shards,
        op2_hilbert_shards,
        op3_collision_ann,
        op4_setsketch_dedup,
        op5_url_filter,
        op6_exact_dedup,
        op7_raked_mixture,
        op8_compact_windows,
        op9_harmonic_packing,
        op10_language_fusion,
        op11_annular_codes,
        op12_nra_topk,
        op13_cross_tokens,
    )
}
ORACLES = {"op4_setsketch_dedup": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op7_raked_mixture": _op7_sql(), "op11_annular_codes": _op11_sql(), "op12_nra_topk": OP12_SQL}
