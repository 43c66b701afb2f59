"""Near-duplicate documents by SetSketch registers (Ertl 2021).

A document's sketch holds, for each register, the truncated negative logarithm of the
smallest of its shingles' exponential values: registers of a union are the maxima of its
parts' (``merge``), and two sets agree in a register with about their Jaccard similarity.
Runs of registers are banded; documents that share a band are candidates; the similarity of
a candidate pair is estimated by maximum likelihood from the numbers of registers in which
either is larger and the known set sizes; what passes is verified on the full sets.

No pair of a large bucket needs to be written. Members are first compared with the centre of
their buckets that they share most bands with, then, components contracted, with the other
centres that are still in other components. What may be left between components is found by
prefixes: with shingles in one order, rare ones first, two sets of similarity t share one
of the first shingles of both, far enough from the end of either. Copies of one component
need not be compared there, so pairs are few, and none is lost that the bands have found.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import connected_components, contracted
from .shingles import shingle_set

#: Registers, rows of a band, base, rate, largest register value. A pair of similarity 0.8
#: shares no band with probability (1 - 0.8**6)**40 = 5e-6.
M, ROWS, BASE, RATE, TOP = 240, 6, 1.001, 20.0, 65535
BANDS = M // ROWS
CENTRES = 4
#: Counters of the sketch of shingle counts by which shingles are put in order.
COUNTERS = 1 << 18
#: Standard errors of the estimate by which a pair may fall short and still be verified.
SLACK = 4.0

_rng = np.random.default_rng(20210107)
_A = _rng.integers(0, 1 << 63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, M, dtype=np.uint64)


def registers(shingles: np.ndarray) -> np.ndarray:
    """Registers of a non-empty set of 64-bit hashes."""
    least = np.full(M, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[i : i + 4096, None] * _A + _B).min(axis=0))
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def _bands() -> Column:
    """A key for each run of ROWS registers and its place."""
    wide = 2 * ROWS
    return F.explode(F.array(*[F.xxhash64(F.lit(b), F.substring("regs", wide * b + 1, wide)) for b in range(BANDS)]))


def _p(x: np.ndarray) -> np.ndarray:
    """Probability that one sketch's register is larger, for the share x of the union outside the other."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def estimate(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities from the numbers of registers in which the first
    set's is larger or smaller, and the set sizes."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def fit(j):
        p, q = _p(u - v * j), _p(v - u * j)
        tiny = 1e-12
        return larger * np.log(p + tiny) + smaller * np.log(q + tiny) + (M - larger - smaller) * np.log(np.maximum(1 - p - q, tiny))

    g = (5**0.5 - 1) / 2
    for _ in range(24):
        a, b = high - g * (high - low), low + g * (high - low)
        up = fit(a) < fit(b)
        low, high = np.where(up, a, low), np.where(up, high, b)
    return (low + high) / 2


def estimates(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Estimates of the pairs (rows of registers) that may reach the threshold, 0 for others. Where
    even the share of equal registers falls short by one error more, nothing is fitted."""
    error = (threshold * (1 - threshold) / M) ** 0.5
    out = np.zeros(len(regs_a))
    near = np.flatnonzero((regs_a == regs_b).mean(axis=1) >= threshold - (SLACK + 1) * error)
    if len(near):
        a, b = regs_a[near], regs_b[near]
        j = estimate((a > b).sum(axis=1), (a < b).sum(axis=1), n_a[near].astype(float), n_b[near].astype(float))
        out[near] = np.where(j >= threshold - SLACK * error, j, 0.0)
    return out


def sketch(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the shingle set), regs; null where there are no shingles."""
    import pyarrow as pa

    names = ["doc_id", "n_shingles", "set_key", "regs"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def rows(batches):
        for b in batches:
            out = []
            for doc, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingle_set(body.as_py(), width)
                if len(s):
                    regs = registers(s)
                    out.append((doc, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), regs.tobytes()))
                else:
                    out.append((doc, 0, None, None))
                if len(out) == 2000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, "doc_id long, n_shingles long, set_key binary, regs binary")


def _full_sets(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame, width: int) -> DataFrame:
    """node and full shingle set (sorted 64-bit hashes as bytes) of the wanted documents."""
    import pyarrow as pa

    def rows(batches):
        for b in batches:
            sets = [shingle_set(t.as_py(), width).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    rows_ = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text"))
    return rows_.join(wanted, "node", "left_semi").mapInArrow(rows, "node long, shingles binary")


def _estimated(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that the joint estimate leaves."""
    import pyarrow as pa

    def rows(batches):
        for t in batches:
            if not t.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(t.column(k).to_pylist()), np.uint16).reshape(-1, M) for k in (3, 5))
            ok = pa.array(estimates(ra, rb, t.column(2).to_numpy(), t.column(4).to_numpy(), threshold) > 0)
            yield pa.RecordBatch.from_arrays([t.column(0).filter(ok), t.column(1).filter(ok)], ["a", "b"])

    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("regs").alias(f"regs_{k}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "regs_a", "n_b", "regs_b")
    return joined.mapInArrow(rows, "a long, b long")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of different components."""
    side = lambda k: labels.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}"))
    named = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return named.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold, in exact integer arithmetic (hundredths)."""
    import pyarrow as pa

    def rows(batches):
        for t in batches:
            ok = []
            for x, y in zip(t.column(2), t.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(0).filter(ok), t.column(1).filter(ok)], ["a", "b"])

    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    return joined.select("a", "b", "set_a", "set_b").mapInArrow(rows, "a long, b long")


def _counters(sets: DataFrame) -> np.ndarray:
    """How many sets hold the shingles of each of COUNTERS classes."""
    import pyarrow as pa

    def rows(batches):
        counts = np.zeros(COUNTERS, np.int64)
        for t in batches:
            for s in t.column(0):
                counts += np.bincount(np.frombuffer(s.as_buffer(), np.uint64) % np.uint64(COUNTERS), minlength=COUNTERS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], ["slot", "n"])

    # at most COUNTERS rows
    found = sets.select("shingles").mapInArrow(rows, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def _prefixes(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """token, pos, node, n, component, first: the shingles of each set of which a similar set has
    one; ``first`` are those that the smaller set of a pair is known to share one of."""
    import pyarrow as pa

    order = sets.sparkSession.sparkContext.broadcast(_counters(sets))
    names = ["token", "pos", "node", "n", "component", "first"]

    def rows(batches):
        counts = order.value
        for t in batches:
            out = []
            for node, s, component in zip(t.column(0).to_pylist(), t.column(1), t.column(2).to_pylist(), strict=True):
                s = np.frombuffer(s.as_buffer(), np.uint64)
                n = len(s)
                most, pos = n + percent * n // -100 + 1, np.arange(n)
                s = s[np.lexsort((s, counts[s % np.uint64(COUNTERS)]))[:most]]
                same = np.ones(len(s), np.int64)
                out.append((s.view(np.int64), pos[:most], node * same, n * same, component * same, pos[:most] <= n + 2 * percent * n // -(100 + percent)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)

    named = sets.join(labels, "node", "left").select("node", "shingles", F.coalesce("component", "node").alias("component"))
    return named.mapInArrow(rows, "token long, pos long, node long, n long, component long, first boolean")


def _across(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components whose sets may be similar enough, by prefixes. Of the
    holders of a shingle those of the largest component meet the others only, not each other."""
    prefixes = materialize(_prefixes(sets, labels, percent), "prefixes")
    per = prefixes.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"))
    mixed = per.groupBy("token").agg(F.max_by("component", "c").alias("largest"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    marked = materialize(prefixes.join(mixed, "token").withColumn("other", F.col("component") != F.col("largest")).drop("largest"), "holders")
    side = lambda df, k: df.select("token", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "pos", "n", "component", "first")])
    smaller = F.struct("n_u", "node_u") < F.struct("n_v", "node_v")
    reach = F.least(F.col("n_u") - F.col("pos_u"), F.col("n_v") - F.col("pos_v"))
    fits = (
        (F.col("component_u") != F.col("component_v"))
        & F.when(smaller, F.col("first_u")).otherwise(F.col("first_v"))
        & (100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v"))
        & ((100 + percent) * reach >= percent * (F.col("n_u") + F.col("n_v")))
    )
    met = side(marked.filter("other"), "u").join(side(marked, "v"), "token").filter(fits)
    pairs = met.select(F.least("node_u", "node_v").alias("a"), F.greatest("node_u", "node_v").alias("b")).distinct()
    pairs = materialize(pairs, "prefix-pairs")
    discard(prefixes, marked)
    return pairs


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    A document's set holds its different shingles of ``width`` words (fewer words: the whole
    sequence); documents whose sets have at least ``threshold`` Jaccard similarity are linked
    and ``component_id`` is the smallest doc_id reachable. Documents without words (null,
    empty or blank text) are linked with nothing. Rows with null doc_id take no part: their
    component is null and they are kept. Rows that share a doc_id are one document whose
    texts all count. An empty table gives no rows.
    """
    percent = round(threshold * 100)
    seen = materialize(sketch(docs, doc_id, text, width), "sketches")
    whole = seen.filter("set_key is not null and doc_id is not null")
    classes = materialize(whole.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("most")), "classes")
    # one row for each different set; its id is the smallest document that has it
    nodes = whole.join(classes.select("set_key", F.col("node").alias("doc_id")), ["set_key", "doc_id"]).dropDuplicates(["set_key", "doc_id"]).select(F.col("doc_id").alias("node"), "n_shingles", "regs")
    nodes = materialize(nodes, "nodes")
    banded = nodes.select("node", _bands().alias("key")).repartition("key")
    several = banded.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least != most").select("key")
    shared = materialize(banded.join(several, "key"), "buckets")
    centres = shared.groupBy("key").agg(*[F.min_by("node", F.xxhash64("node", F.lit(k))).alias(f"c{k}") for k in range(CENTRES)])
    near = shared.join(centres, "key").select("node", F.explode(F.array_distinct(F.array(*[f"c{k}" for k in range(CENTRES)]))).alias("centre")).filter("node != centre")
    near = materialize(near.groupBy("node", "centre").agg(F.count(F.lit(1)).alias("bands")), "centres")
    members = materialize(shared.select("node").distinct(), "members")
    sketched = materialize(nodes.join(members, "node", "left_semi"), "sketched")
    sets = materialize(_full_sets(docs, doc_id, text, members, width), "sets")
    discard(nodes, shared)
    pair = lambda df: df.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()

    def linked(pairs: DataFrame) -> DataFrame:
        return _verified(_estimated(pairs, sketched, threshold), sets, percent)

    likeliest = near.groupBy("node").agg(F.max_by("centre", "bands").alias("centre"))
    links = materialize(linked(pair(likeliest)), "links")
    labels = contracted(links)[0]
    links = materialize(links.unionByName(linked(_apart(pair(near), labels))), "links")
    labels = contracted(links)[0]
    # pairs by prefixes are sure not to leave out any, so they are compared in full, without an estimate before
    links = materialize(links.unionByName(_verified(_across(sets, labels, percent), sets, percent)), "links")
    discard(near, members, sketched, sets)
    # copies hang on their class, so only ids that stand for several classes need their rows here
    copies = whole.join(classes.filter("node != most"), "set_key").filter("doc_id != node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    twice = whole.select("doc_id", "set_key").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("a"))
    final = connected_components(links.unionByName(copies.join(twice, "a", "left_semi").select("a", "b")))
    rows = seen.select("doc_id", "n_shingles", "set_key").join(classes.select("set_key", "node"), "set_key", "left").join(final, "node", "left")
    named = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return rows.select("doc_id", "n_shingles", named.alias("component_id"), F.coalesce(F.col("doc_id") == named, F.lit(True)).alias("kept"))
