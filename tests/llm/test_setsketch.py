"""Near duplicates against brute force over full sets; sketches and components by property."""

import re

import numpy as np

from graphloom.llm import setsketch
from graphloom.llm.components import connected_components
from graphloom.llm.shingles import shingle_set, word_hashes


def brute(rows, width, threshold=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus():
    rng = np.random.default_rng(7)
    word = lambda: "w%d" % rng.integers(0, 5000)
    rows, n = [], 0
    for _ in range(60):
        base = [word() for _ in range(rng.integers(5, 300))]
        for edits in rng.integers(0, 8, rng.integers(1, 6)):
            text = list(base)
            for _ in range(edits):
                text[rng.integers(0, len(text))] = word()
            rows.append((n, " ".join(text).upper() if n % 3 else "\n".join(text)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "a b\x0bc"), (n + 6, "É x y z"), (n + 7, "é x y z"), (n + 8, "long " * 50000)]


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, key int").repartition(5)
    for width in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in setsketch.near_duplicates(docs, width=width).collect()}
        assert got == brute(rows, width)


def test_hot_group_of_near_copies(spark):
    rng = np.random.default_rng(3)
    base = ["w%d" % k for k in range(120)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.integers(0, 6)):
            text[rng.integers(0, 120)] = "x%d" % rng.integers(0, 99999)
        rows.append((i, " ".join(text)))
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute(rows, 4)


def test_prefixes_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "COUNTERS", 64)
    rng = np.random.default_rng(5)
    base, sets = rng.integers(0, 1 << 62, 60, dtype=np.uint64), {}
    for i in range(120):
        own = rng.integers(0, 1 << 62, rng.integers(0, 9), dtype=np.uint64)
        sets[i] = np.unique(np.concatenate([base[rng.random(60) < 0.94], own, base[:1]]))
    sets |= {200 + i: np.unique(rng.integers(0, 6, rng.integers(1, 7), dtype=np.uint64)) for i in range(60)}
    near = set()
    for a in sets:
        for b in sets:
            both = len(np.intersect1d(sets[a], sets[b]))
            if a < b and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                near.add((a, b))
    table = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "node long, shingles binary").repartition(3)
    for labels in ({}, {i: 0 for i in range(50)} | {200 + i: 200 + i % 3 for i in range(20)}):
        named = spark.createDataFrame(list(labels.items()), "node long, component long")
        got = {tuple(r) for r in setsketch._across(table, named, 80).collect()}
        of = lambda x, labels=labels: labels.get(x, x)
        assert {(a, b) for a, b in near if of(a) != of(b)} <= got
        assert all(of(a) != of(b) for a, b in got)


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text.upper()), (None, text), (3, None), (4, "a b c d"), (1, "a b c d")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.component_id, r.kept) for r in setsketch.near_duplicates(docs).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 1, False)]
    assert setsketch.near_duplicates(docs.limit(0)).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        x = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
        k = int(2000 * share)
        y = np.concatenate([x[:k], rng.integers(0, 1 << 63, 2000 - k, dtype=np.uint64)])
        a, b = setsketch.registers(x), setsketch.registers(y)
        assert (setsketch.merge(a, b) == setsketch.registers(np.union1d(x, y))).all()
        true = k / (4000 - k)
        got = setsketch.estimate(np.array([(a > b).sum()]), np.array([(a < b).sum()]), np.array([2000.0]), np.array([2000.0]))[0]
        assert abs(got - true) < 5 * (true * (1 - true) / setsketch.M) ** 0.5 + 0.02


def test_shingles():
    assert (word_hashes("A b\tA  é") == word_hashes("a b a é")).all() and len(word_hashes("a b a é")) == 4
    assert len(set(word_hashes("a b c ab ba aa").tolist())) == 6
    assert len(shingle_set("a b c a b c a b c", 3)) == 3 and len(shingle_set("a b", 3)) == 1 and len(shingle_set(None, 3)) == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (200, 300), (300, 200)]
    got = dict(connected_components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100, 200: 200, 300: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
