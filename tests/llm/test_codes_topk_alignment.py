"""Operators 11 to 13 against brute force written without them."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest

from graphloom.llm import annular_codes, cross_tokens, nra_topk, queries

SF = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def same_as_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    cols = ", ".join(sorted(got.columns))
    want = c.sql(queries.ORACLES[name])
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.selectExpr(*cols.split(", ")).collect())) == sorted(want.project(cols).fetchall())


@pytest.mark.parametrize("name", ["op11_annular_codes", "op12_nra_topk"])
def test_queries_equal_sql(spark, name):
    same_as_sql(spark, name)


# ---- 11 ----
def test_annulus_finds_what_full_search_finds():
    rng = np.random.default_rng(5)
    for entries, dim, spread in ((1, 3, 9), (16, 8, 5), (40, 2, 2), (16, 1, 3), (64, 16, 4000)):
        x, book = rng.integers(-spread, spread + 1, (300, dim)), rng.integers(-spread, spread + 1, (entries, dim))
        book[entries // 2] = book[0]
        far = ((x[:, None] - book) ** 2).sum(axis=2)
        who, best, tried = annular_codes.nearest(x, book)
        assert (who == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()
        assert tried <= far.size
    spread_out = np.arange(64)[:, None] * np.ones(4, int) * 100
    assert annular_codes.nearest(spread_out + 1, spread_out)[2] < 64 * 4  # few of 64 * 64


def brute_codes(rows, parts, entries, rounds):
    """(vec_id, label, components) in Python's own numbers."""
    whole = [(i, lab, [math.floor(4096 * x) if abs(x) < 2**40 else int(x) * 4096 for x in v]) for i, lab, v in rows]
    n = len(whole[0][2]) // parts
    cut = [[v[p * n : p * n + n] for p in range(parts)] for _, _, v in whole]
    first = sorted(range(len(whole)), key=lambda r: whole[r][0])[:entries]
    books = [[cut[r][p] for r in first] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for c in cut:
                own[best(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(col) // len(own[k]) for col in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    out = [(i, [best(c[p], books[p])[1] for p in range(parts)], sum(best(c[p], books[p])[0] for p in range(parts))) for (i, _, _), c in zip(whole, cut, strict=True)]
    return out, books


def vectors_table(spark, rows, kind="array<double>"):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, label int, embedding {kind}, codes string, v int").repartition(3)


def test_codes_equal_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(int(i), int(i % 3) if i % 7 else None, [float(x) for x in rng.normal(size=16) * 10.0 ** rng.integers(-3, 3)]) for i in rng.permutation(90)]
    odd = [(900, 1, None), (901, 1, [math.nan] * 16), (902, 1, [math.inf] * 16), (903, 2, [None] + [0.5] * 15)]
    coded, books = annular_codes.train_and_encode(vectors_table(spark, good + odd + [(904, 0, good[0][2])]))
    want, wanted = brute_codes(good + [(904, 0, good[0][2])], 8, 16, 6)
    got = {r.vec_id: (r.codes, r.error) for r in coded.collect()}
    assert got == {i: (c, e) for i, c, e in want}
    assert [[list(map(int, e)) for e in b] for b in books[16]] == wanted
    label = {i: lab for i, lab, _ in good} | {904: 0}
    sums = Counter()
    for i, _, e in want:
        sums[label[i]] += e
    assert {r.vec_id: r.label_error for r in annular_codes.with_label_error(coded).collect()} == {i: sums[label[i]] for i in label}


def test_codes_of_huge_short_few_and_no_vectors(spark):
    huge = [(i, 0, [1e30 * (i + 1), -1e30, 1.0, 0.1 * i]) for i in range(5)]
    coded, books = annular_codes.train_and_encode(vectors_table(spark, huge), parts=2, entries=3, rounds=2)
    want, wanted = brute_codes(huge, 2, 3, 2)
    assert {r.vec_id: (r.codes, r.error) for r in coded.collect()} == {i: (c, e if e < 2**63 else None) for i, c, e in want}
    assert [[list(map(int, e)) for e in b] for b in books[4]] == wanted
    assert {r.label_error for r in annular_codes.with_label_error(coded).collect()} == {None}
    mixed = [(1, 0, [0.5, 0.25, 0.125]), (2, 0, [1.0] * 8), (3, None, []), (3, None, [])]
    got = annular_codes.with_label_error(annular_codes.train_and_encode(vectors_table(spark, mixed))[0]).collect()
    assert sorted((r.vec_id, r.error, r.label_error, r.codes) for r in got) == [(1, 0, 0, [0] * 8), (2, 0, 0, [0] * 8), (3, 0, 0, [0] * 8), (3, 0, 0, [0] * 8)]
    coded, books = annular_codes.train_and_encode(vectors_table(spark, []))
    assert coded.count() == 0 and books == {} and annular_codes.with_label_error(coded).count() == 0


# ---- 12 ----
def brute_products(rows, asked, k):
    whole = {}
    usable = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in usable]
    out = []
    for qid in sorted({i for i, _ in whole if asked(i)}):
        q = max(v for i, v in whole if i == qid)
        scores = [(-min(max(sum(a * b for a, b in zip(q, v, strict=True)), -(2**63)), 2**63 - 1), i) for i, v in whole if i != qid and len(v) == len(q)]
        out += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


def products(spark, rows, k=5, every=5):
    t = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, id string, v int").repartition(3)
    return sorted((r.query_id, r.rank, r.id, r.score) for r in nra_topk.top_products(t, t.filter(f"vec_id % {every} = 0"), k).collect())


def test_products_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nra_topk, "BLOCK", 150)  # several blocks, each with bounds from others
    monkeypatch.setattr(nra_topk, "GROUP", 40)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=12).tolist()) for i in range(600)] + [(1000 + i, rng.integers(-1, 2, 12).astype(float).tolist()) for i in range(200)]
    rows += [(3, rows[3][1]), (5, rows[7][1]), (2000, [0.0] * 12), (2005, None), (2010, [math.nan] * 12), (None, [1.0] * 12), (2015, [1.0, 2.0]), (2020, [None] * 12), (2025, [3.0, -1.0]), (2030, [])]
    assert products(spark, rows) == brute_products(rows, lambda i: i % 5 == 0, 5)


def test_products_huge_few_and_none(spark):
    huge = [(i, [1e12 * (i - 2), 0.1 * i, -1e9]) for i in range(8)] + [(20, [1e30, 0.0, 0.0]), (25, [1e30, 1.0, 0.0])]
    assert products(spark, huge, 3) == brute_products(huge, lambda i: i % 5 == 0, 3)
    assert products(spark, [(0, [1.0]), (1, [0.3])]) == [(0, 1, 1, 256 * 76)]
    assert products(spark, [(0, [1.0])]) == [] and products(spark, []) == []


def test_reading_stops_before_the_lists_end():
    """One axis decides: few vectors stay open after half of the lists."""
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(2000, 4)) * [1000, 1, 1, 1])
    block = nra_topk.Lists(np.arange(2000), v)
    low, high = block.bounds(v[:3], 1000)
    exact = v[:3] @ v.T
    assert (low <= exact).all() and (exact <= high).all()
    kth = np.partition(low, 1995, axis=1)[:, 1995]
    assert ((high >= kth[:, None]).sum(axis=1) < 100).all()


# ---- 13 ----
def brute_alignment(texts):
    """Whole texts, one by one, by the libraries' own calls."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok, b_tok = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in shown)}
    rows, holders = [], Counter()
    for t in texts:
        a = a_tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_tok.encode(t) if t else []
        a_bytes = [bytes(byte_of[c] for c in a_tok.id_to_token(k)) for k in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_tok.IsByte(k) else p.replace("▁", " ").encode() for k in b for p in [b_tok.IdToPiece(k)]]
        if not t or not b"".join(a_bytes) == (" " + t).encode() == b"".join(b_bytes):
            rows.append((0, 0, [], Counter()))
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes])
        groups, links, at_a, at_b = [], Counter(), 0, 0
        for end in sorted({*a_ends.tolist()} & {*b_ends.tolist()}):
            to_a, to_b = np.searchsorted(a_ends, end) + 1, np.searchsorted(b_ends, end) + 1
            groups.append((a[at_a:to_a], b[at_b:to_b]))
            links.update((x, y) for x in a[at_a:to_a] for y in b[at_b:to_b])
            at_a, at_b = to_a, to_b
        rows.append((len(a), len(b), groups, links))
        holders.update(set(links))
    most_a, most_b = Counter(), Counter()
    for (x, y), n in holders.items():
        most_a[x], most_b[y] = max(most_a[x], n), max(most_b[y], n)
    out = []
    for n_a, n_b, groups, links in rows:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = [sum(n for p, n in links.items() if holders[p] == most[p[k]]) for k, most in ((0, most_a), (1, most_b))]
        out.append((n_a, n_b, len(groups), sum(links.values()), best[0], sum(n * holders[p] for p, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if groups else "", best[1]))
    return out, holders, most_a, most_b


def odd_texts():
    rng = random.Random(1)
    bits = ["a", "b", "foo", "The", "é", "漢", "字", "\n", "\t", " ", "  ", " ", "　", "▁", "1", "23", "!", "'s", "😀", "́", "ß", "<s>", "<|endoftext|>", "<0x0A>", "\x00", "\r\n", " ", "\u0085", "Ġ", " the"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(1500)]
    return [*out, None, "", " ", "  ", " a", "a ", "\n", "a\n", "x" * 3000, " " * 500, "ab " * 20000, "漢" * 2000, *out[:50]]


def test_alignment_equals_brute_force_on_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(cross_tokens, "SLICE_BYTES", 5000)
    texts = odd_texts()
    t = spark.createDataFrame([(i, x, 1, "y") for i, x in enumerate(texts)] + [(None, "foo", 1, "y")], "doc_id long, text string, slice int, code string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in cross_tokens.align_tokens(t, A, B).collect()}
    want, holders, most_a, most_b = brute_alignment([*texts, "foo"])
    assert [got[i] for i in [*range(len(texts)), None]] == want
    pairs = {(r.a, r.b): (r["count"], r.best_a, r.best_b) for r in cross_tokens.id_pairs(t, A, B).collect()}
    assert pairs == {p: (n, n == most_a[p[0]], n == most_b[p[1]]) for p, n in holders.items()}
    assert cross_tokens.align_tokens(t.limit(0), A, B).count() == 0


def test_alignment_query_equals_brute_force(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").sort_by("doc_id")
    want = brute_alignment(docs.column("text").to_pylist())[0]
    rows = sorted(queries.op13_cross_tokens(spark, SF).collect())
    assert [r.doc_id for r in rows] == docs.column("doc_id").to_pylist() and [tuple(r)[1:] for r in rows] == want


def test_wide_groups_count_as_others_do(monkeypatch):
    toks = cross_tokens.tokenizers(A, B)
    import pyarrow as pa

    texts = [x or "" for x in odd_texts()]
    plain = list(cross_tokens.slices(pa.array(range(len(texts))), pa.array(texts), toks))
    monkeypatch.setattr(cross_tokens, "WIDE", 1)
    for one, other in zip(plain, cross_tokens.slices(pa.array(range(len(texts))), pa.array(texts), toks), strict=True):
        assert one[2] == other[2] and all((x == y).all() for x, y in zip(one[3], other[3], strict=True)) and (one[5] == other[5]).all()
