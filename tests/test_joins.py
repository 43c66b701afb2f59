"""Joins that leave out what can't count, against all pairs."""

import random

import pytest

from graphloom.operators import analyze, diff, search
from graphloom.operators.graph import PropertyGraph


@pytest.mark.parametrize("threshold", [0.05, 0.4, 0.9])
def test_similar_pairs_are_those_of_all_pairs(spark, threshold):
    rng = random.Random(7)
    side = lambda n, k: spark.createDataFrame([(f"{k}{d}", f"t{int(rng.paretovariate(0.6)) % 60}", round(rng.uniform(-0.2, 1), 3)) for d in range(n) for _ in range(rng.randrange(1, 9))], "doc_id string, term string, w double").groupBy("doc_id", "term").agg({"w": "max"}).withColumnRenamed("max(w)", "w")
    a, b = side(40, "a").cache(), side(60, "b").cache()
    want = {(r["doc_a"], r["doc_b"]): round(r["score"], 12) for r in search.sparse_cosine(a, b).filter(f"score >= {threshold}").collect()}
    assert {(r["doc_a"], r["doc_b"]): round(r["score"], 12) for r in search.similar_pairs(a, b, threshold).collect()} == want and want


def test_copies_tie_whatever_order_their_terms_come_in(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [(f"d{i:02}", t, rng.uniform(0.001, 1)) for i in range(30) for t in rng.sample(words, 40)]
    one = [(t, rng.uniform(0.001, 1)) for t in words[:120]]
    copies = [(f"c{i:02}", t, w) for i in range(40) for t, w in rng.sample(one, len(one))]
    rng.shuffle(rows := texts + copies)
    b = spark.createDataFrame(rows, "doc_id string, term string, w double").repartition(7)
    a = spark.createDataFrame([("q", t, rng.uniform(0.001, 1)) for t in words[:90]], "doc_id string, term string, w double")
    for found in (search.similar_pairs(a, b, 0.05), search.sparse_cosine(a, b)):
        assert len({r["score"] for r in found.filter("doc_b LIKE 'c%'").collect()}) == 1
        assert [r["doc_b"] for r in search.top_matches(found.filter("doc_b LIKE 'c%'"), 5, 0.05).orderBy("rank").collect()] == [f"c{i:02}" for i in range(5)]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("threshold", [0.6, 0.75, 0.4])
def test_renames_are_those_of_all_pairs(spark, threshold):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abC") for _ in range(rng.randrange(0, 7)))

    def made(k):
        nodes = [("hub1", "hub", "code"), ("hub2", "other", "code")] + [(f"{k}{i}", word(), rng.choice(["code", "document"])) for i in range(35)]
        edges = {tuple(sorted((f"{k}{i}", rng.choice(["hub1", "hub2", f"{k}{rng.randrange(35)}"])))) for i in range(35) for _ in range(rng.randrange(0, 3))}
        return nodes, {(x, y) for x, y in edges if x != y}

    (na, ea), (nb, eb) = made("a"), made("b")

    def graph(nodes, edges):
        rows = [(x, y, x, y, "calls") for x, y in sorted(edges)]
        return PropertyGraph(spark.createDataFrame(nodes, "id string, label string, file_type string"), spark.createDataFrame(rows, "source string, target string, lo string, hi string, relation string"))

    def around(nodes, edges, i):
        label = {n[0]: n[1] for n in nodes}
        return {label[y if x == i else x] for x, y in edges if i in (x, y)}

    want = []
    for i, la, ta in na[2:]:
        for j, lb, tb in nb[2:]:
            if ta != tb:
                continue
            longest = max(len(la), len(lb))
            labels = 1 - levenshtein(la.lower(), lb.lower()) / longest if longest else 1.0
            p, q = around(na, ea, i), around(nb, eb, j)
            score = 0.6 * labels + 0.4 * (len(p & q) / len(p | q) if p | q else 1.0)
            if labels >= 0.3 and score >= threshold:
                want.append((-round(score, 9), i, j))
    got = diff.rename_candidates(graph(na, ea), graph(nb, eb), threshold, 12).collect()
    assert [(-round(r["confidence"], 9), r["id_a"], r["id_b"]) for r in got] == sorted(want)[:12] and len(want) > 3


def _graph(spark, nodes, edges):
    return PropertyGraph(spark.createDataFrame([(n, n, t) for n, t in nodes], "id string, label string, file_type string"), spark.createDataFrame([(x, y, min(x, y), max(x, y), r) for x, y, r in edges], "source string, target string, lo string, hi string, relation string"))


def test_classes_of_changes_are_of_types_that_changed_on_both_sides(spark):
    a = _graph(spark, [("old", "code"), ("hub", "code")], [("hub", "old", "calls")])
    b = _graph(spark, [("new", "code"), ("hub", "code"), ("page", "document")], [("hub", "new", "calls"), ("hub", "page", "calls")])
    assert [r["label"] for r in diff._change_classes(b, a, 20).collect()] == ["new"]
    assert [r["label"] for r in diff._change_classes(a, b, 20).collect()] == ["old"]


def test_core_and_unique_of_three_graphs_move_each_edge_few_times(spark):
    rng, made = random.Random(4), {}
    for name in ("x", "y", "z"):
        nodes = {f"n{rng.randrange(14)}" for _ in range(10)}
        made[name] = nodes, {(*sorted(rng.choices([f"n{i}" for i in range(14)], k=2)), rng.choice(["calls", "imports"])) for _ in range(25)}
    core, unique = analyze.core_and_unique({k: _graph(spark, [(n, "code") for n in ns], es) for k, (ns, es) in made.items()})
    assert sum(x._jdf.queryExecution().executedPlan().toString().count("Exchange") for x in (core, unique)) <= 16
    assert {r["kind"]: r["n"] for r in core.collect()} == {"nodes": len(set.intersection(*(ns for ns, _ in made.values()))), "edges": len(set.intersection(*(es for _, es in made.values())))}
    own = {k: ns - set().union(*(m for j, (m, _) in made.items() if j != k)) for k, (ns, _) in made.items()}
    want = {k: (len(own[k]), sum(x in own[k] or y in own[k] for x, y, _ in es)) for k, (_, es) in made.items() if own[k]}
    assert {r["graph"]: (r["nodes"], r["edges"]) for r in unique.collect()} == want and want
