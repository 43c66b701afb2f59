"""Exact largest inner products by aggregation without random access (NRA, Fagin, Lotem and Naor 2003).

Every component of the vectors is a sorted list. A query reads each list from the end that its own
component favours; after a depth, a vector's score lies between what has been read of it plus the worst
(lower bound) or the last value read (upper bound) of each list where it has not been seen. Reading stops
when few vectors' upper bounds reach the k-th lower bound, since all others can't qualify; then the scores
of those few are resolved from their vectors. Nothing is approximate: what stays open at the last depth
is resolved as well.

Vectors are dealt into blocks with lists of their own. A query is asked in one block first, a different one for
different queries; the k-th score found there bounds what it needs from all other blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .annular_codes import finite
from .common import discard, materialize

#: Vectors of a block, queries of a group, queries worked on together.
BLOCK, GROUP, TOGETHER = 4096, 2048, 128
#: Shares of the lists read before the bounds are compared, and open vectors, times k, at which reading ends.
DEPTHS, FEW = (0.5, 0.75, 0.875), 8
#: Up to this size, sums of products are exact in doubles.
EXACT = 1 << 53
LONG = (-(1 << 63), (1 << 63) - 1)


class Lists:
    """One block: ids, whole-number vectors and, for each component, who comes when in the sorted list."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)
        self.most = float(np.abs(vectors).max(initial=0))
        self._read: dict[tuple, tuple] = {}

    def read(self, depth: int, down: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first ``depth`` entries of all lists, downwards from the largest or upwards from the smallest: the
        values read, by vector (0 where unread), which were read, and the last value of each list."""
        if (depth, down) not in self._read:
            n, d = self.vectors.shape
            part = slice(n - depth, n) if down else slice(0, depth)
            values, seen = np.zeros((n, d)), np.zeros((n, d))
            np.put_along_axis(values, self.order[part], self.sorted[part], axis=0)
            np.put_along_axis(seen, self.order[part], 1.0, axis=0)
            self._read[depth, down] = values, seen, self.sorted[n - depth if down else depth - 1]
        return self._read[depth, down]

    def bounds(self, queries: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of every query's product with every vector at a depth."""
        low, high = 0.0, 0.0
        for down in (True, False):
            q = np.maximum(queries, 0) if down else np.minimum(queries, 0)
            values, seen, last = self.read(depth, down)
            known = q @ values.T
            for side, other in ((0, self.sorted[0 if down else -1]), (1, last)):
                unseen = q * other
                bound = known + unseen.sum(axis=1)[:, None] - unseen @ seen.T
                low, high = (low + bound, high) if side == 0 else (low, high + bound)
        return low, high

    def search(self, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query id, id, score): up to k best in this block with a score of at least ``least``."""
        n, d = self.vectors.shape
        found = []
        if max(1, d) * self.most * float(np.abs(queries).max(initial=0)) * 4 >= EXACT:
            exact = [[int(x) for x in row] for row in self.vectors.tolist()]
            for qid, q, bound in zip(query_ids, queries.tolist(), least, strict=True):
                q = [int(x) for x in q]
                scores = sorted((-min(max(sum(a * b for a, b in zip(q, v, strict=True)), LONG[0]), LONG[1]), int(i)) for i, v in zip(self.ids, exact, strict=True) if i != qid)
                found += [(int(qid), i, -s) for s, i in scores[:k] if -s >= bound]
            return found
        for lo in range(0, len(queries), TOGETHER):
            qids, q, bound = (x[lo : lo + TOGETHER] for x in (query_ids, queries, least))
            own = qids[:, None] == self.ids
            open_q = np.arange(len(q))
            for step, share in enumerate(DEPTHS):
                low, high = self.bounds(q[open_q], max(1, int(n * share)))
                low[own[open_q]], high[own[open_q]] = -np.inf, -np.inf
                if n > k:
                    kth = np.partition(low, n - k, axis=1)[:, n - k]
                    bound[open_q] = np.maximum(bound[open_q], kth)
                reach = high >= bound[open_q, None]
                done = reach.sum(axis=1) <= FEW * k if step + 1 < len(DEPTHS) else np.ones(len(open_q), bool)
                row, who = np.nonzero(reach[done] & ~own[open_q[done]])
                asked = open_q[done][row]
                scores = np.einsum("ij,ij->i", q[asked], self.vectors[who])
                best = np.lexsort((self.ids[who], -scores, asked))
                asked, who, scores = asked[best], who[best], scores[best]
                first = np.searchsorted(asked, asked)
                keep = (np.arange(len(asked)) - first < k) & (scores >= bound[asked])
                found += zip(qids[asked[keep]].tolist(), self.ids[who[keep]].tolist(), scores[keep].astype(np.int64).tolist(), strict=True)
                open_q = open_q[~done]
                if not len(open_q):
                    break
        return found


def _cells(blocks: DataFrame, queries: DataFrame, key: list[str], k: int) -> DataFrame:
    """Each block with each group of queries of its key, a cell at a time."""
    import pyarrow as pa

    def flat(t, name):
        return np.asarray(t.column(name).combine_chunks().flatten().flatten()) if t.num_rows else np.zeros(0)

    def cell(left, right):
        found = []
        if left.num_rows and right.num_rows:
            ids, qids, least = (np.asarray(t.column(c).combine_chunks().flatten()) for t, c in ((left, "ids"), (right, "query_ids"), (right, "least")))
            block = Lists(ids, flat(left, "vectors").reshape(len(ids), -1))
            found = block.search(qids, flat(right, "query_vectors").reshape(len(qids), -1), least.astype(np.float64).copy(), k)
        cols = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.int64())})

    return blocks.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(cell, "query_id long, id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank, id, score: the k rows of largest inner product of each query, over components floor(scale * x).

    ``queries`` are rows in the form of ``vectors``; a row with the query's own id is no candidate. Null
    vectors, such with null or non-finite components and rows without id take no part. A query meets vectors
    of its own length. Rows that repeat are candidates each; a query that repeats is asked once (with the
    largest of its vectors). Ties go to the smaller id. Products beyond a long count as the nearest long.
    Other columns are not read. Empty tables give no rows.
    """
    whole = F.transform(F.col(vec), lambda x: _floor(x.cast("double") * scale))
    of = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), whole.alias("v")).filter(finite(F.col(vec)) & F.col("id").isNotNull())
    rows = materialize(of(vectors).withColumn("m", F.monotonically_increasing_id()), "vectors")
    n = max(1, -(-rows.count() // BLOCK))
    dealt = lambda x, of_n, salt: F.pmod(F.xxhash64(x, F.lit(salt)), F.lit(of_n)).cast("int")
    dim = F.size("v").alias("dim")
    blocks = rows.groupBy(dim, dealt("m", n, 1).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("r"))
    blocks = materialize(blocks.select("dim", "block", F.col("r.id").alias("ids"), F.col("r.v").alias("vectors")), "blocks")
    asked = materialize(of(queries).groupBy("id").agg(F.max("v").alias("v")), "queries")
    groups = max(1, -(-asked.count() // GROUP))

    def grouped(rows: DataFrame, key) -> DataFrame:
        one = rows.groupBy(dim, key).agg(F.collect_list(F.struct("id", "v", "least")).alias("r"))
        return one.withColumns({"query_ids": F.col("r.id"), "query_vectors": F.col("r.v"), "least": F.col("r.least")}).drop("r")

    # a long as double: rounded down, so that nothing at the bound itself is lost
    at_home = grouped(asked.withColumn("least", F.lit(float("-inf"))), dealt("id", n, 2).alias("block"))
    first = _best(_cells(blocks, at_home, ["dim", "block"], k), k)
    least = materialize(first.filter(F.col("rank") == k).select((F.col("score").cast("double") - F.abs(F.col("score").cast("double")) * 1e-15).alias("least"), F.col("query_id").alias("id")), "bounds")
    bound = asked.join(least, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    spread = grouped(bound, dealt("id", groups, 3).alias("part")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    repeated = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = materialize(_cells(repeated, spread, ["dim", "block", "part"], k), "found")
    discard(rows)
    return _best(found, k).select("query_id", "rank", "id", "score")


def _floor(x):
    """Floor as a double, of any size."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)
