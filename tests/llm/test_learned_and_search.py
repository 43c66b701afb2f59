"""Nearest neighbours, URL filter, mixture, passages, languages and the pipeline against brute
force, planted cases and closed forms."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import collision_ann, compact_windows, langid, queries, raking, url_filter
from test_setsketch import brute as near_groups

SF = "/root/testdata/sf0.001"


def nearest(ids, v, queries_, k):
    u = v / np.linalg.norm(v, axis=1)[:, None]
    out = {}
    for q in queries_:
        s = u @ u[list(ids).index(q)]
        order = sorted((-x, i) for x, i in zip(s, ids, strict=True) if i != q)
        out[q] = [i for _, i in order[:k]]
    return out


def test_op3_recall_and_scores(spark):
    got = queries.op3_collision_ann(spark, SF).toPandas()
    t = pd.read_parquet(f"{SF}/embeddings.parquet")
    v = np.array(t["embedding"].tolist(), dtype=np.float64)
    true = nearest(t["vec_id"], v, [i for i in t["vec_id"] if i % 50 == 0], 5)
    found = got.groupby("query_id")["vec_id"].apply(set)
    assert np.mean([len(found[q] & set(ids)) / 5 for q, ids in true.items()]) >= 0.9
    at = dict(zip(t["vec_id"], v, strict=True))
    for r in got.itertuples():
        a, b = at[r.query_id], at[r.vec_id]
        assert abs(r.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12 and r.query_id != r.vec_id


def test_search_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(collision_ann, "BLOCK", 4)
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [0.0, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, [float("inf"), 1.0]), (10, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, id string, block int")
    got = collision_ann.collision_search(df, df.filter("vec_id in (0, 3, 4)"), 10).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 7), (0, 4, 10)]
    assert collision_ann.collision_search(df.limit(0), df.limit(0)).count() == 0
    assert collision_ann.collision_search(df, df.limit(0)).count() == 0


def test_search_over_many_blocks_and_scales(spark, monkeypatch):
    """The first block bounds the others; sizes of vectors from 1e-200 to 1e200 change no cosine."""
    monkeypatch.setattr(collision_ann, "BLOCK", 60)
    monkeypatch.setattr(collision_ann, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(5)
    v = rng.standard_normal((900, 24)) + 2 * rng.standard_normal((30, 24))[rng.integers(0, 30, 900)]
    size = 10.0 ** rng.integers(-200, 200, 900)
    df = spark.createDataFrame([(i, (x * k).tolist()) for i, (x, k) in enumerate(zip(v, size, strict=True))], "vec_id long, embedding array<double>")
    got = collision_ann.collision_search(df, df.filter("vec_id % 50 = 0"), 5).toPandas()
    true = nearest(range(900), v, range(0, 900, 50), 5)
    found = got.groupby("query_id")["id"].apply(set)
    assert np.mean([len(found[q] & set(ids)) / 5 for q, ids in true.items()]) >= 0.95
    u = v / np.linalg.norm(v, axis=1)[:, None]
    assert all(abs(r.score - u[r.query_id] @ u[r.id]) < 1e-12 for r in got.itertuples())


def test_rare_labels_and_clashing_keys(spark):
    texts = [("en", "the house and the garden of the king"), ("fr", "la maison et le jardin du roi")]
    docs = spark.createDataFrame([(t, k) for k, t in texts for _ in range(60)] + [("xyz xyz", "zz")], "text string, lang string")
    model = langid.fit(docs, support=0.05)
    assert model.languages == ["en", "fr"]
    none = F.lit(None).cast("string")
    clash = ["n", "best", "belief", "w", "most", "total", "prior", "top", "keys", "size", "a.b", "lang"]
    rows = spark.createDataFrame([(7, t, *[str(i)] * len(clash)) for i, (_, t) in enumerate(texts * 2)] + [(8, "word " * 200_000, *["9"] * len(clash))], "k long, text string, " + ", ".join(f"`{c}` string" for c in clash))
    full = rows.withColumns({"declared": none, "suffix": none, "domain": none, "host": F.lit("h")})
    got = langid.identify(full, model)
    assert got.columns == ["k", *[c for c in clash if c not in ("n", "lang")], "lang", "confidence", "text_lang", "n", "accepted"]
    said = {(r.best, r["a.b"], r.lang) for r in got.collect() if r.k == 7}
    assert said == {("0", "0", "en"), ("1", "1", "fr"), ("2", "2", "en"), ("3", "3", "fr")} and got.count() == 5
    assert langid.identify(full.drop("k", *[c for c in clash if c != "a.b"]).drop("`a.b`").drop("a.b"), model).count() == 5


def test_url_parts_and_rules(spark):
    urls = ["HTTP://WWW.Example.ORG/es/1?x#y", "a://b://c/d", "no scheme", None, "http://h?q", "http://EXAMPLE.org/en/12", "https://x.com/fr/a", "https://com/de/", "https://xcom/fr/", "http://a.org", ""]
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    counts = spark.createDataFrame([("x", 1)], "word string, n long")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(rows, queries.RULES, counts, queries.SEEDS).collect()}
    assert got[0] == ("www.example.org", "/es/1", "example.org/es/", "block") and got[1][:2] == ("b:", "//c/d") and got[2][:3] == ("", "", None) and got[3][:3] == ("", "", None)
    assert got[4][:2] == ("h", "") and got[5][2:] == ("example.org/en/1", "block") and got[6][2:] == ("com/fr/", "allow") and got[7][2:] == ("com/de/", "block")
    assert got[8][2] is None and got[9][2] is None and got[10][:2] == ("", "")
    assert url_filter.url_filter(rows.limit(0), queries.RULES, counts, []).count() == 0


def test_viterbi_and_segments(spark):
    counts = spark.createDataFrame([("cheap", 50), ("pills", 40), ("the", 900), ("rapist", 1), ("therapist", 30), ("pill", 30)], "word string, n long")
    labels = spark.createDataFrame([("cheappills",), ("therapist",), ("zzq",), ("",)], "label string")
    got = {r.label: r.words for r in url_filter.segment(labels, counts).collect()}
    assert got["cheappills"] == ["cheap", "pills"] and got["therapist"] == ["therapist"] and "".join(got["zzq"]) == "zzq" and "" not in got


def test_long_urls_repeats_and_clashing_names(spark):
    long = "http://" + "gardenhouse" * 2000 + ".example.net/" + "x/" * 3000
    rows = spark.createDataFrame([(1, long, "h", 7), (2, long, "h", 7), (3, None, None, 8), (4, "http://gardenhouse.example.net/", "h", 9)], "page_id long, url string, host string, `row` int").repartition(2)
    counts = spark.createDataFrame([("garden", 50), ("house", 40), ("a", 9)], "word string, n long")
    got = {r.page_id: r for r in url_filter.url_filter(rows, queries.RULES, counts, [], keep=("page_id", "host", "row")).collect()}
    assert len(got) == 4 and got[1].host == long[7:].split("/")[0] and got[1].row == 7 and got[3].host == "" and got[1][1:] == got[2][1:]
    labels = spark.createDataFrame([("gardenhouse" * 2000,), ("house",), ("zgardenz",)], "label string")
    words = {r.label: r.words for r in url_filter.segment(labels, counts).collect()}
    assert words["gardenhouse" * 2000] == ["garden", "house"] * 2000 and words["house"] == ["house"] and "garden" in words["zgardenz"]


def test_url_filter_on_held_out_hosts(spark):
    pages = [(i, f"http://{'casino' if i % 2 else 'garden'}{w}.example.net/{'win' if i % 2 else 'grow'}/{i}") for i, w in enumerate(["club", "house", "king", "world"] * 20)]
    rows = spark.createDataFrame(pages, "page_id long, url string")
    counts = spark.createDataFrame([(w, 50) for w in ("casino", "garden", "club", "house", "king", "world")], "word string, n long")
    rules = [url_filter.Rule("block", "casinohouse.example.net", "/"), url_filter.Rule("allow", "gardenclub.example.net", "/")]
    got = url_filter.url_filter(rows, rules, counts, []).collect()
    assert all((r.verdict == "block") == (r.page_id % 2 == 1) for r in got) and any(r.rule is None for r in got)


def test_raking_meets_targets(spark):
    cells = spark.createDataFrame([("a", "x", 100), ("a", "y", 300), ("b", "x", 200), ("b", "y", 50), ("c", "x", 10)], "s string, l string, tokens long")
    targets = {"s": spark.createDataFrame([("a", 200.0), ("b", 100.0)], "s string, target double"), "l": spark.createDataFrame([("x", 150.0), ("y", 150.0)], "l string, target double")}
    rows = raking.rake(cells, targets, 20).toPandas()
    rows["t"] = rows.tokens * rows.weight
    assert np.allclose(rows.groupby("l").t.sum(), [150, 150]) and np.allclose(rows.groupby("s").t.sum(), [200, 100, 0], atol=1e-4)


def test_mix_of_odd_rows(spark):
    rows = [(1, None, None, None, "x"), (2, "", "en", "a", "x"), (3, "Licensed under X", "en", "a", "x"), (3, "Licensed under X", "en", "a", "x"), (None, "t" * 90000, "fr", "b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, weight string")
    got = raking.mix(df, 1.0, {"source": 1.0, "lang": 1.0, "topic": 1.0}).collect()
    assert len(got) == 5 and all(abs(r.weight - 1) < 1e-5 and r.kept for r in got) and {r.topic for r in got} == {"general", "licence"}
    assert raking.sample(df, 1.0, {"source": 1.0, "lang": 1.0, "topic": 1.0}).columns == df.columns
    assert raking.mix(df.limit(0), 0.5, {"source": 0.5}).count() == 0


def test_windows_equal_brute_force():
    rng = np.random.default_rng(5)
    for n, least in ((30, 5), (60, 11), (4, 5), (50, 1)):
        v = rng.permutation(n).astype(np.uint64)
        got = {}
        for lo, c, hi in compact_windows.windows(v, least):
            for i in range(lo, c + 1):
                for j in range(c, hi + 1):
                    assert (i, j) not in got
                    got[i, j] = c
        want = {(i, j): i + int(v[i : j + 1].argmin()) for i in range(n) for j in range(i + least - 1, n)}
        assert {k: got[k] for k in want} == want


def words(rng, n):
    return ["w%d" % k for k in rng.integers(0, 10**6, n)]


def test_planted_passages(spark):
    rng = np.random.default_rng(11)
    passage, near = words(rng, 60), words(rng, 120)
    edited = list(near)
    edited[60] = "edit"
    loop = "again and " * 400
    texts = {
        1: words(rng, 100) + passage + words(rng, 30), 2: passage + words(rng, 200), 3: words(rng, 40) + passage, 4: words(rng, 300), 5: words(rng, 90) + near + words(rng, 50),
        6: words(rng, 20) + edited + words(rng, 10), 7: words(rng, 30) + passage[:40] + words(rng, 30), 8: loop.split(), 9: loop.split() + words(rng, 5),
    }
    rows = [(i, " ".join(t).upper() if i == 2 else " ".join(t), "k") for i, t in texts.items()] + [(10, None, "k"), (11, "", "k"), (None, " ".join(passage), "k"), (4, " ".join(texts[4]), "k")]
    got = compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string, key string")).collect()
    spans = {(r.doc_id, r.start_word, r.end_word) for r in got} | {(r.other_id, r.other_start, r.other_end) for r in got}
    assert {(1, 100, 160), (2, 0, 60), (3, 40, 100)} <= spans
    assert any(i == 5 and a <= 90 and b >= 210 for i, a, b in spans) and any(i == 6 and a <= 20 and b >= 140 for i, a, b in spans)
    assert not {4, 7, 10, 11} & {i for i, _, _ in spans} and all(r.similarity >= 0.8 and r.end_word - r.start_word >= 50 for r in got)
    assert compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string, key string").limit(0)).count() == 0


def test_language_evidence(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = langid.fit(docs.filter(~held))
    none = F.lit(None).cast("string")
    rows = docs.filter(held & F.col("text").rlike(r"(\p{L}+\W+){20}")).select("doc_id", F.col("lang").alias("truth"), "text", none.alias("declared"), none.alias("suffix"), none.alias("domain"), F.col("source").alias("host"))
    got = langid.identify(rows, model).toPandas()
    assert (got.lang == got.truth).mean() > 0.97 and got.accepted.mean() > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 $$$ --"), (4, "la"), (4, "la")], "k long, text string").select("k", "text", F.lit("fr").alias("declared"), none.alias("suffix"), none.alias("domain"), none.alias("host"))
    rows = sorted((r.k, r.lang, r.accepted) for r in langid.identify(odd, model).collect())
    assert rows == [(1, "und", False), (2, "und", False), (3, "und", False), (4, "fr", True), (4, "fr", True)]
    assert langid.identify(odd.limit(0), model).count() == 0
    page = spark.range(1).select(F.lit('<html lang="fr-CA"><script>x</script><p>a&amp;b</p>').alias("h")).select(langid.declared_language(F.col("h")).alias("d"), langid.visible_text(F.col("h")).alias("t")).first()
    assert page.d == "fr" and page.t.split() == ["a", "b"]


def test_a_host_prior_settles_a_doubtful_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    es = [r.text for r in docs.filter("lang = 'es'").limit(20).collect()]
    none = F.lit(None).cast("string")
    rows = spark.createDataFrame([(i, t, "h.es.example") for i, t in enumerate(es)] + [(99, "la", "h.es.example"), (98, "la", "other")], "k long, text string, host string")
    got = {r.k: r.lang for r in langid.identify(rows.select("k", "text", none.alias("declared"), none.alias("suffix"), F.col("host").alias("domain"), "host"), model).collect()}
    assert got[99] == "es"


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(0).unionByName(spark.createDataFrame([(10**6, "12 34 %%", "en", "src0", 8), (10**6 + 1, None, None, None, None)], docs.schema))
    docs = docs.unionByName(extra)
    frames = docs.toPandas()
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.toPandas(), docs.schema) if out.count() else out
            kept[name] = set(docs.toPandas().doc_id)
    text = dict(zip(frames.doc_id, frames.text, strict=True))
    assert not {10**6, 10**6 + 1} & kept["language_id"]
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    best = {}
    for i in kept["language_id"]:
        best[low(text[i])] = max(best.get(low(text[i]), -1), i)
    assert kept["exact_dedup"] == set(best.values())
    assert kept["near_dedup"] == {i for i, (_, _, keep) in near_groups([(i, text[i]) for i in kept["exact_dedup"]], 5).items() if keep}
    assert kept["mixture"] <= kept["near_dedup"] and len(kept["mixture"]) > 0.5 * len(kept["near_dedup"])
    assert set(out.toPandas().doc_id) == kept["mixture"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()} <= set(frames.doc_id)
