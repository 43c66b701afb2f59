import functools
import random

import pandas as pd
from pyspark.sql import functions as F

from graphloom.functions import strings as S
from graphloom.operators import align, community, compare, diff, search, semantic, traverse, trees
from graphs import communities, edges_of, server, small


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_tokens(spark):
    cases = {
        "validateToken": ["validate", "token"], "AuthService": ["auth", "service"], "auth_service": ["auth", "service"], "HTMLParser": ["html", "parser"],
        "the authentication for this service": ["authentic", "service"], "a go db authentication": ["authentic"], "auth.service-token_validate": ["auth", "service", "token", "validate"],
        "credentials credential": ["credential", "credential"], "authentication validation": ["authentic", "valid"], "": [],
    }
    for text, tokens in cases.items():
        assert one(spark, S.tokenize(F.lit(text))) == tokens, text
    assert one(spark, S.canonical_tokens(F.lit(".processRequest()"))) == ["process", "request"] and one(spark, S.canonical_tokens(F.lit("MY_CONST"))) == ["const", "my"]


def test_strings(spark):
    for a, b, d in (("", "", 0), ("abc", "abd", 1), ("kitten", "sitting", 3), ("", "hello", 5), ("é", "e", 2)):
        assert one(spark, S.byte_levenshtein(F.lit(a), F.lit(b))) == d
    assert one(spark, S.make_id(F.lit("_a."), F.lit(""), F.lit("B c"))) == "a_b_c" and one(spark, S.normalize_id(F.lit("A--b."))) == "a_b"
    assert one(spark, S.file_stem(F.lit("x/dir/file.tar.gz"))) == "dir.file.tar" and one(spark, S.file_stem(F.lit("f.py"))) == "f"
    files = [one(spark, S.is_file_label(F.lit(x))) for x in ("main.go", "x.swift", "run()", "Foo.Bar", "a.b()", "plain")]
    assert files == [True, False, False, True, False, False]
    assert one(spark, S.normalize_label(F.lit("Café"))) == "cafe"
    vec = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, S.cosine(vec(1, 0), vec(2, 0))) == 1 and one(spark, S.cosine(vec(1, 0), vec(1, 0, 0))) == 0 and one(spark, S.cosine(vec(0, 0), vec(1, 0))) == 0
    assert one(spark, S.half_up(F.lit(0.285), 2)) == 0.28
    words = lambda *x: F.array(*[F.lit(v) for v in x])
    assert one(spark, S.multiset_jaccard(words("a", "a", "b"), words("a", "b", "c"))) == 0.5 and one(spark, S.set_jaccard(words("a", "a"), words("a"))) == 1


def test_links(spark):
    code = spark.createDataFrame([("c1", "validate token session"), ("c2", "render template page"), ("c3", "parse request body"), ("c4", "open database pool")], "doc_id string, text string")
    doc = spark.createDataFrame([("d1", "how to validate a token session"), ("d2", "nothing here matches")], "doc_id string, text string")
    rows = search.link_text_to_code(doc, code, edges_of(spark, [("x", "y", "r")])).collect()
    assert [(r["source"], r["target"], r["relation"]) for r in rows] == [("d1", "c1", "references")]
    assert search.link_text_to_code(doc, code, edges_of(spark, [("c1", "d1", "r")])).count() == 0
    fixed = search.resolve_dangling(edges_of(spark, [("validate_token", "c2", "r")]), spark.createDataFrame([("c1",), ("c2",)], "id string"), code)
    assert fixed.first()["source"] == "c1"


def test_diffs(spark):
    a = small(spark, [("a", "b", "calls"), ("a", "c", "calls"), ("p", "u", "calls")], {"p": "processRequest"})
    b = small(spark, [("a", "b", "calls"), ("a", "d", "calls"), ("h", "u", "calls")], {"h": "handleRequest", "b": "B"})
    status = {r["id"]: r["status"] for r in diff.diff_nodes(a, b).collect()}
    assert status == {"b": "modified", "c": "removed", "d": "added", "p": "removed", "h": "added"}
    assert {(r["hi"], r["status"]) for r in diff.diff_edges(a, b).collect()} == {("c", "removed"), ("d", "added"), ("u", "removed"), ("u", "added")}
    changes = {r["id"]: r["changes"] for r in diff.diff_nodes(a, b).collect()}
    assert changes["b"]["label"]["old"] == "b" and changes["b"]["label"]["new"] == "B"
    renames = diff.rename_candidates(a, b, 0.5).collect()
    assert ("p", "h") in {(r["id_a"], r["id_b"]) for r in renames}
    assert diff.jaccard_nodes(a, a).first()[0] == 1 and diff.jaccard_edges(a, b).first()[0] == 1 / 5
    assert diff.degree_jsd(a, a).first()[0] == 0
    lone = small(spark, [], extra=["x"])
    assert diff.degree_jsd(lone, lone).first()[0] == 0 and diff.jaccard_edges(lone, lone).first()[0] == 1


def test_signatures_and_alignment(spark):
    a = server(spark)
    names = {r["id"]: "renamed_" + r["id"] for r in a.nodes.collect()}
    b = a.rekey(spark.createDataFrame(list(names.items()), "id_b string, id_a string"))
    types = dict(align.node_types(a).collect())
    assert types["main_go"] == "file" and types["main_server_start"] == "method" and types["main_main"] == "function" and types["go_pkg_fmt"] == "import" and types["main_server"] == "class"
    found = {r["id_a"]: r["id_b"] for r in align.align(a, b).collect()}
    assert found == names
    h = lambda g: sorted(r["hash"] for r in align.signatures(g).collect())
    assert h(a) == h(b)
    r1 = align.refine(a, align.node_types(a).withColumnRenamed("node_type", "hash"))
    assert r1.count() == 9 and r1.select("hash").distinct().count() > 4
    pairs = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.85), ("b", "y", 0.1), ("c", "y", 0.1)], "id_a string, id_b string, score double")
    assert {(r["id_a"], r["id_b"]) for r in align.greedy_matching(pairs).collect()} == {("a", "x"), ("b", "y")}


def tree(spark, edges, extra=()):
    return trees.containment_tree(small(spark, [(p, c, "contains") for p, c in edges], extra=extra))


def test_trees(spark):
    t = tree(spark, [("f", "a"), ("f", "b"), ("a", "c")])
    assert {r["id"]: (r["parent"], r["depth"]) for r in t.collect()} == {"f": (None, 0), "a": ("f", 1), "b": ("f", 1), "c": ("a", 2)}
    h = trees.subtree_hashes(t)
    assert {r["id"]: r["sub_size"] for r in h.collect()} == {"f": 4, "a": 2, "b": 1, "c": 1}
    u = tree(spark, [("F", "A"), ("F", "B"), ("B", "C")])
    hu = trees.subtree_hashes(u)
    value = lambda df, c: df.first()[c]
    assert value(trees.subtree_match(h, hu), "score") == 1 and abs(value(trees.tree_kernel(t, u), "score") - 1) < 1e-12
    assert abs(value(trees.subtree_frequency(t, u), "cosine") - 1) < 1e-12 and abs(value(trees.role_similarity(t, t), "cosine") - 1) < 1e-12
    assert value(trees.common_subtrees(t, u, h, hu), "score") == 1 and value(trees.anti_unification(t, u, h, hu), "score") == 1
    bigger = tree(spark, [("f", "a"), ("f", "b"), ("a", "c"), ("a", "d")])
    hb = trees.subtree_hashes(bigger)
    assert trees.edit_distance(t, bigger).first().asDict() == {"distance": 1, "similarity": 1 - 1 / 9, "exact": True}
    rooted, forest = tree(spark, [("r", "x"), ("r", "y")]), tree(spark, [], extra=["x", "y"])
    assert trees.edit_distance(rooted, forest).first()["distance"] == 0  # only a forest gets a root above it
    assert trees.edit_distance(t, t, True).first()["distance"] == 0
    assert value(trees.common_subtrees(t, bigger, h, hb), "score") == 2 / 5  # b, and c or d
    assert value(trees.anti_unification(t, bigger, h, hb), "score") == 4 / 5
    assert 0 < value(trees.tree_kernel(t, bigger), "score") < 1


def test_edit_distance_equals_the_recursion():
    rng = random.Random(3)

    def random_tree(n):
        parents = [None] + [f"{rng.randrange(i):02d}" if rng.random() < 0.8 else None for i in range(1, n)]
        return pd.DataFrame({"id": [f"{i:02d}" for i in range(n)], "parent": parents, "kind": [rng.choice("ab") for _ in range(n)]})

    def nested(t):
        below = lambda i: (t["kind"][int(i)], tuple(map(below, t["id"][t["parent"] == i])))
        roots = tuple(map(below, t["id"][t["parent"].isna()]))
        return roots if len(roots) == 1 else (("virtual", roots),)

    size = functools.cache(lambda f: sum(1 + size(k) for _, k in f))

    @functools.cache
    def distance(f, g, semantic):
        if not f or not g:
            return size(f) + size(g)
        (x, a), (y, b) = f[-1], g[-1]
        both = distance(f[:-1], g[:-1], semantic) + distance(a, b, semantic) + (semantic and x != y)
        return min(distance(f[:-1] + a, g, semantic) + 1, distance(f, g[:-1] + b, semantic) + 1, both)

    for _ in range(150):
        a, b = random_tree(rng.randint(1, 8)), random_tree(rng.randint(1, 8))
        for semantic in (False, True):
            assert trees._ordered_distance(a, b, semantic) == distance(nested(a), nested(b), semantic)


def test_unlike_children_pair_by_nearest_size():
    table = lambda a, b: pd.DataFrame([("p", "q", "a", *x) for x in a] + [("p", "q", "b", *x) for x in b], columns=["id_a", "id_b", "side", "sub_size", "n"])
    dealt = lambda a, b: [tuple(r)[2:] for r in trees._by_nearest_size(table(a, b)).itertuples(index=False)]
    assert dealt([(9, 1), (5, 2)], [(6, 1), (4, 1), (2, 3)]) == [(9, 0, 6, 0, 1), (5, 0, 4, 0, 1), (5, 1, 2, 0, 1)]
    assert dealt([(5, 3)], [(6, 1), (4, 1)]) == [(5, 0, 6, 0, 1), (5, 1, 4, 0, 1)]
    assert dealt([], [(3, 1)]) == []


def test_impact_ranks_removed_nodes_on_the_old_graph(spark):
    a, b = small(spark, [("hub", x, "calls") for x in "abc"]), small(spark, [("new", "a", "calls")], extra=["b", "c", "lone"])
    got = [(r["id"], r["change"], r["affected"]) for r in traverse.ranked_impact(a, b, diff.diff_nodes(a, b), 1).collect()]
    assert got == [("hub", "removed", 3), ("new", "added", 1)]


def test_a_containment_cycle_is_opened(spark):
    t = tree(spark, [("b", "a"), ("c", "b"), ("a", "c"), ("c", "z")])
    assert {r["id"]: r["depth"] for r in t.collect()} == {"a": 0, "c": 1, "b": 2, "z": 2}


def test_kernel_closed_form_equals_pairs(spark):
    import itertools
    import math

    def brute(a, b):
        def kids(t):
            out = {}
            for p, c in t:
                out.setdefault(p, []).append(c)
                out.setdefault(c, [])
            return out

        ka, kb = kids(a), kids(b)
        shape = lambda k, n: tuple(sorted(shape(k, c) for c in k[n]))

        def value(k, n):
            return 0.5 * math.prod(1 + value(k, c) for c in k[n])

        def total(k, m):
            return sum(value(k, x) if shape(k, x) == shape(m, y) else 0.5 for x, y in itertools.product(k, m))

        return total(ka, kb) / math.sqrt(total(ka, ka) * total(kb, kb))

    a, b = [("r", "a"), ("r", "b"), ("a", "c"), ("a", "d"), ("b", "e")], [("R", "A"), ("R", "B"), ("A", "C"), ("B", "D"), ("B", "E"), ("E", "F")]
    assert abs(trees.tree_kernel(tree(spark, a), tree(spark, b)).first()["score"] - brute(a, b)) < 1e-9


def test_compare_and_estimate(spark):
    g = server(spark)
    same = compare.compare(g, g)
    assert same["composite"].first()["composite"] == 1 and same["distance"].first()["distance"] == 0
    scores = {r["metric"]: r["score"] for r in same["scores"].collect()}
    assert all(abs(s - 1) < 1e-9 for m, s in scores.items() if m != "CommunityNMI")
    assert compare.interpret(0.97) == "nearly identical" and compare.interpret(0.1) == "different"
    stars = {"g1": "abc", "g2": "abcd", "g3": "abxy"}
    graphs = {k: small(spark, [("a", x, "calls") for x in v[1:]]) for k, v in stars.items()}
    table = None
    for x, y in (("g1", "g2"), ("g1", "g3")):
        part = compare.graph_scores(graphs[x], graphs[y], communities(spark, {0: ["a"]}), communities(spark, {0: ["a"]})).filter("metric != 'CommunityNMI'").select(F.lit(x).alias("label_a"), F.lit(y).alias("label_b"), "metric", "score")
        table = part if table is None else table.unionByName(part)
    r = compare.estimate(table).first()
    actual = [x["score"] for x in compare.graph_scores(graphs["g2"], graphs["g3"], communities(spark), communities(spark)).filter("metric != 'CommunityNMI'").collect()]
    assert (r["label_a"], r["label_b"]) == ("g2", "g3") and r["lower"] - 0.15 <= sum(actual) / 3 <= r["upper"] + 0.15


def test_model_answers(spark):
    answers = ['<think>hm</think>```json\n{"n":[{"id":"a","l":"A","t":"concept","f":"x.md"}],"e":[{"s":"a","g":"b","r":"cites","c":"SURE","cs":3,"f":"x.md","w":0}]}\n```', '{"nodes":[{"id":"z","label":"Z","file_type":"concept","source_file":"y"}],"edges":[]}', "not json"]
    nodes, edges = semantic.parse_answers(spark.createDataFrame([(x,) for x in answers], "answer string"))
    assert sorted((r["id"], r["label"]) for r in nodes.collect()) == [("a", "A"), ("z", "Z")]
    assert edges.first().asDict() == {"source": "a", "target": "b", "relation": "cites", "confidence": "INFERRED", "confidence_score": 0.8, "source_file": "x.md", "weight": 1.0}
    files = spark.createDataFrame([("docs/a.md", "document", "body")], "path string, file_type string, text string")
    assert semantic.document_nodes(files).first()["id"] == "a_doc"
    assert semantic.ask(files, lambda path, text: text.upper()).first()["answer"] == "BODY"
    made = semantic.embed(spark.createDataFrame([("x",), (" ",), ("yy",)], "text string"), lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert sorted(r["vec"] for r in made.collect()) == [[1.0, 1.0], [2.0, 1.0]]
