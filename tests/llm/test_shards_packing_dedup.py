"""Token shards, Hilbert shards, packing and exact dedup against brute force, with nulls,
empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import exact_dedup, harmonic, hilbert, queries, sst, tokens
from graphloom.llm.common import scratch
from graphloom.llm.tokens import WordEncoder

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, content string, ids string, k string, part int"
ODD = [
    (5, "Same Text", "en", "a", 9, "x", "x", "x", 1),
    (7, "same text", "en", "a", 9, "x", "x", "x", 1),
    (7, "same text", "en", "a", 9, "x", "x", "x", 1),
    (1, None, None, None, None, None, None, None, None),
    (2, "", "fr", "b", 0, "x", "x", "x", 1),
    (None, "no id", "fr", "b", 5, "x", "x", "x", 1),
    (3, "É é <|endoftext|> ^ ^^ a^b   x́ 'll don't\t\n tab " + "x" * 100, "fr", "b", 5, "x", "x", "x", 1),
    (4, "word " * 60000, "en", "b", 300000, "x", "x", "x", 1),
]


TOK = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOK.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def encoded(enc, texts):
    return [ids[lo:hi].tolist() for ids, bounds in enc.encode(pa.array(texts, pa.string())) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]


def test_encoder_equals_library(docs, monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_BYTES", 20_000)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3000)
    enc = WordEncoder(PATH)
    assert enc.by_word
    rng = random.Random(7)
    marks = [*"abXYz09'!.,-<|>\n\t /", "É", "é", "e\u0301", "\u0301", "\u0338", "=", "ß", "İ", "K", "日", "😀", "\x85", "'s", "'LL", "<|endoftext|>", "<|EndOfText|>"]
    texts = [r[1] for r in ODD] + ["".join(rng.choices(marks, k=rng.randint(0, 40))) for _ in range(3000)] + docs["text"].tolist()
    for _ in range(2):
        assert encoded(enc, texts) == [ids_of(t) for t in texts]


def test_encoder_of_a_tokenizer_that_keeps_space():
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, tok = WordEncoder(path), Tokenizer.from_file(path)
    assert not enc.by_word
    assert encoded(enc, ["two  words\n", None]) == [tok.encode("two  words\n", add_special_tokens=False).ids + [2], [2]]


def test_op1_equals_brute_force(spark, docs):
    got = queries.op1_sst_shards(spark, SF).toPandas().sort_values("doc_id")
    start, want = 0, []
    for r in docs.sort_values("doc_id").itertuples():
        ids = ids_of(r.text)
        want.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert list(got[["doc_id", "start", "n_tokens", "ids_crc32"]].itertuples(index=False, name=None)) == want


def test_shards_of_odd_rows_and_lookup(spark, odd):
    path = scratch(spark, "t")
    sst.write_shards(odd, "doc_id", "text", path, PATH, shard_bytes=4000)
    rows = sst.read_shards(spark, path).orderBy("shard", "row").collect()
    assert [r.key for r in rows] == [None, 1, 2, 3, 4, 5, 7, 7]
    text = {r[0]: r[1] for r in ODD}
    assert all(r.ids == ids_of(text[r.key]) for r in rows)
    found = sst.lookup(spark, path, [7, 99, None, 4]).collect()
    assert Counter(r.wanted for r in found) == {0: 2, 2: 1, 3: 1}
    assert all(r.ids == ids_of("same text") for r in found if r.wanted == 0)
    empty = scratch(spark, "t")
    sst.write_shards(odd.limit(0), "doc_id", "text", empty, PATH)
    assert sst.read_digests(spark, empty).count() == 0


def test_shards_with_string_keys(spark):
    path = scratch(spark, "t")
    keys = [f"k/{i:05d}/é" for i in range(3000)]
    sst.write_shards(spark.createDataFrame([(k, f"text of {k}") for k in keys], "id string, body string"), "id", "body", path, PATH, shard_bytes=40000)
    rows = sst.read_shards(spark, path, "string").orderBy("shard", "row").collect()
    assert [r.key for r in rows] == keys
    assert rows[77].ids == ids_of(f"text of {keys[77]}")
    assert [r.wanted for r in sst.lookup(spark, path, [keys[1234], "nothing"]).collect()] == [0]


def test_blocks_share_prefixes_and_a_broken_file_is_refused():
    w = sst.ShardWriter(2)
    parts = [p for i in range(20000) if (p := w.add(b"prefix%06d" % i, b"ab"))] + list(w.finish())
    data = b"".join(p + b"\n" for p in parts)
    shard = sst.Shard(data)
    assert len(shard.blocks) > 1 and len(data) < 20000 * 9 + 30000
    assert [k for k, _ in shard] == [b"prefix%06d" % i for i in range(20000)]
    assert shard.get(b"prefix004321") == [b"ab"] and shard.get(b"prefiy") == []
    assert sum(shard.may_hold(b"other%d" % i) for i in range(1000)) < 50
    with pytest.raises(ValueError):
        sst.Shard(data[:-1])


def test_hilbert_index_is_a_curve(spark):
    for n, bits in ((2, 1), (2, 4), (3, 3)):
        side = 1 << bits
        cells = spark.range(side**n).select(*[(F.floor(F.col("id") / side**i) % side).cast("int").alias(f"x{i}") for i in range(n)])
        got = cells.withColumn("h", hilbert.hilbert_index([F.col(f"x{i}") for i in range(n)], bits)).orderBy("h").collect()
        assert [r.h for r in got] == list(range(side**n))
        assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in zip(got, got[1:]))


def test_op2_law_and_slots(spark, docs):
    got = queries.op2_hilbert_shards(spark, SF).toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    counts = got.groupby("shard").size()
    assert len(counts) == 8 and counts.max() - counts.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
        assert g.sort_values("slot").curve.is_monotonic_increasing
    tops = got.groupby("shard").curve.agg(["min", "max"])
    assert all(tops["max"].iloc[i] <= tops["min"].iloc[i + 1] for i in range(7))
    text = dict(zip(docs.doc_id, docs.text, strict=True))
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got.itertuples())


def test_hilbert_odd_rows(spark, odd):
    rows = odd.withColumn("size", F.octet_length(F.coalesce("text", F.lit(""))) + 1)
    dims = [hilbert.hash_level(F.col("lang")), hilbert.log_level(F.col("size"))]
    got = hilbert.hilbert_shards(rows, dims, 3, ["doc_id"]).toPandas()
    assert sorted(got.groupby("shard").size()) == [2, 3, 3]
    assert hilbert.hilbert_shards(rows.limit(0), dims, 3, ["doc_id"]).count() == 0
    assert hilbert.hilbert_shards(rows.limit(1), dims, 3, ["doc_id"]).count() == 1
    bounds = hilbert.shard_bounds(hilbert.hilbert_shards(rows, dims, 3, ["doc_id"]), ["size"]).collect()
    assert sum(b.rows for b in bounds) == 8
    path = scratch(spark, "h")
    hilbert.write_shards(hilbert.hilbert_shards(rows, dims, 3, ["doc_id"]), path)
    assert spark.read.parquet(path).count() == 8


def check_packing(got, texts, capacity=4096):
    by_doc = defaultdict(list)
    for r in got.itertuples():
        by_doc[r.doc_id].append(r)
    for doc, rows in by_doc.items():
        ids = ids_of(texts[doc])
        times = sum(r.start == 0 for r in rows)
        seen = Counter()
        for r in rows:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[r.start : r.start + r.length])
            seen.update(range(r.start, r.start + r.length))
        assert seen == Counter({i: times for i in range(len(ids))})
    padded = tokens = 0
    for _, g in got.groupby("sequence_id"):
        at = 0
        for r in g.sort_values("offset").itertuples():
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
        tokens += at
        padded += 0 if at & (at - 1) == 0 else capacity - at
    return padded, tokens


def test_op9_equals_brute_force(spark, docs):
    got = queries.op9_harmonic_packing(spark, SF).toPandas()
    padded, tokens = check_packing(got, dict(zip(docs.doc_id, docs.text, strict=True)))
    assert set(got.doc_id) == set(docs.doc_id)
    assert padded <= 0.01 * tokens + 4096


def test_packing_odd_rows(spark, odd):
    rows = odd.filter("doc_id is not null")
    got = harmonic.harmonic_pack(rows, PATH).toPandas()
    check_packing(got, {r[0]: r[1] for r in ODD})
    assert (got[got.doc_id == 7].start == 0).sum() == 2
    assert harmonic.harmonic_pack(odd.filter("doc_id is null"), PATH).count() == 1
    assert harmonic.harmonic_pack(odd.limit(0), PATH).count() == 0


def test_cut_lengths():
    for n in (1, 63, 64, 4095, 4096, 4097, 10000):
        assert sum(harmonic.cut_lengths(n)) == n and all(4096 % k == 0 or k < 64 for k in harmonic.cut_lengths(n))


def test_exact_dedup_odd_rows(spark, odd):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(odd, salts=2).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (5, 7, 3, False, sha("same text")) in got and (7, 7, 3, True, sha("same text")) in got
    assert (1, 2, 2, False, sha("")) in got and (2, 2, 2, True, sha("")) in got
    assert (None, None, 1, True, sha("no id")) in got
    assert exact_dedup.exact_dedup(odd).count() == 8 and exact_dedup.exact_dedup(odd.limit(0)).count() == 0
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 3, 4, 7]
    assert exact_dedup.keep_one(odd.limit(0)).count() == 0


def test_only_ascii_letters_fold(spark):
    rows = spark.createDataFrame([(1, "É"), (2, "é"), (3, "A"), (4, "a")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(rows).collect()} == {1: 1, 2: 2, 3: 4, 4: 4}
