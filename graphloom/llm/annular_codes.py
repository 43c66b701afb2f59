"""Product codes of vectors, with nearest codebook entries found by annular norm pruning.

A vector's components become whole numbers and are cut into equal consecutive parts; each part
position has a codebook of its own. An entry at distance r of a part has a norm that differs by at
most r from the part's, so the entries are sorted by norm, the interval of norms that the current
best distance allows is found by binary search, and only entries of that annulus, its edges
included, are evaluated, in whole numbers. Codebooks move as in k-means: tasks add up the parts
of each entry, and only these sums are shuffled and reach the driver (parts x entries of them).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Components below this size are computed with as 64-bit numbers, others as numbers of any size.
SAFE = 1 << 24
#: Labels with more than this share of the rows get their sums by broadcast; there are at most 1000.
HOT_SHARE = 0.001


def finite(vec: Column) -> Column:
    """Not null and without null or non-finite components."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    return vec.isNotNull() & F.coalesce(F.forall(vec, ok), F.lit(False))


def whole_numbers(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, as int64 or, where components are large, as Python's numbers. ``scale`` is a power of two."""
    if not v.size or np.abs(v).max() < SAFE / scale:
        return np.floor(v * scale).astype(np.int64)
    one = lambda x: int(x) * scale if abs(x) >= 1 << 52 else math.floor(x * scale)
    return np.array([[one(x) for x in row] for row in v.tolist()], object).reshape(v.shape)


def small(x: np.ndarray) -> bool:
    return x.dtype != object and (not x.size or int(np.abs(x).max()) < SAFE)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of ``x`` the nearest entry, its squared distance, and how many entries were evaluated in all.

    Ties go to the lower index. Starts at the entry of the nearest norm, then goes outwards on both
    sides as far as the best distance so far allows.
    """
    if not (small(x) and small(entries)):
        x, entries = x.astype(object), entries.astype(object)
        far = [((x - e) ** 2).sum(axis=1) if x.shape[1] else np.zeros(len(x), object) for e in entries]
        best = np.array([min(range(len(far)), key=lambda e: (far[e][i], e)) for i in range(len(x))], np.int64)
        return best, np.array([far[e][i] for i, e in enumerate(best)], object), len(x) * len(entries)
    norms = np.sqrt((entries * entries).sum(axis=1))
    order = np.lexsort((np.arange(len(entries)), norms))
    norms = norms[order]
    own = np.sqrt((x * x).sum(axis=1))

    def distance(rows, at):
        d = x[rows] - entries[order[at]]
        return (d * d).sum(axis=1)

    rows = np.arange(len(x))
    at = np.clip(np.searchsorted(norms, own), 0, len(norms) - 1)
    at -= (at > 0) & (own - norms[np.maximum(at - 1, 0)] < np.abs(norms[at] - own))
    best, who = distance(rows, at), order[at].copy()
    tried = len(x)

    def interval():
        """Norms within the best distance, with room for rounding of the roots."""
        reach = np.sqrt(best) + 1e-9 * (1 + own)
        return np.searchsorted(norms, own - reach, "left"), np.searchsorted(norms, own + reach, "right")

    low, high = interval()
    for step in range(1, len(norms)):
        moved = False
        for to in (at - step, at + step):
            open_rows = np.flatnonzero((to >= low) & (to < high))
            if not len(open_rows):
                continue
            moved = True
            tried += len(open_rows)
            d, e = distance(open_rows, to[open_rows]), order[to[open_rows]]
            nearer = (d < best[open_rows]) | ((d == best[open_rows]) & (e < who[open_rows]))
            best[open_rows[nearer]], who[open_rows[nearer]] = d[nearer], e[nearer]
        if not moved:
            break
        low, high = interval()
    return who, best, tried


def _parts(vectors, parts: int, scale: int):
    """Of an Arrow list array of doubles: by length of vector, which rows have it and their parts."""
    sizes = np.asarray(vectors.value_lengths())
    ends = np.cumsum(sizes)
    flat = np.asarray(vectors.flatten())
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        v = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
        x = whole_numbers(v, scale)
        wide = -(-int(dim) // parts) * parts
        if wide > dim:
            x = np.concatenate([x, np.zeros((len(x), wide - dim), x.dtype)], axis=1)
        yield int(dim), rows, x.reshape(len(rows), parts, wide // parts)


def _first_codebooks(rows: DataFrame, parts: int, entries: int, scale: int) -> dict[int, list[np.ndarray]]:
    """Of each length of vectors, the parts of those with the smallest ids."""
    import pyarrow as pa

    books = {}
    for (dim,) in rows.select(F.size("v").alias("d")).distinct().collect():
        first = rows.filter(F.size("v") == dim).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
        vectors = pa.array([list(r.v) for r in first], pa.list_(pa.float64()))
        for _, _, x in _parts(vectors, parts, scale):
            books[dim] = [x[:, p].copy() for p in range(parts)]
    return books


def _moved(rows: DataFrame, books: dict, parts: int, scale: int) -> dict:
    """The codebooks after one round: each used entry becomes the floor of the mean of its parts."""
    import pyarrow as pa

    def sums(batches):
        total: dict[tuple, list] = {}
        for b in batches:
            for dim, _, x in _parts(b.column(0), parts, scale):
                for p in range(parts):
                    who, _, _ = nearest(x[:, p], books[dim][p])
                    own = np.zeros((len(books[dim][p]), x.shape[2]), x.dtype)
                    np.add.at(own, who, x[:, p])
                    count = np.bincount(who, minlength=len(own))
                    for e in np.flatnonzero(count):
                        at = total.setdefault((dim, p, int(e)), [0, [0] * x.shape[2]])
                        at[0] += int(count[e])
                        at[1] = [s + int(v) for s, v in zip(at[1], own[e], strict=True)]
        cols = [[*k, n, list(map(str, s))] for k, (n, s) in total.items()]
        yield pa.RecordBatch.from_pydict({"dim": [c[0] for c in cols], "part": [c[1] for c in cols], "entry": [c[2] for c in cols], "n": [c[3] for c in cols], "sums": [c[4] for c in cols]}, schema=pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))]))

    def added(key, rows):
        """The tasks' sums of one entry; a sum may take more digits than any type of column has."""
        n, total = 0, []
        for k, s in zip(rows.column("n").to_pylist(), rows.column("sums").to_pylist(), strict=True):
            n, total = n + k, [int(v) + t for v, t in zip(s, total or [0] * len(s), strict=True)]
        one = [[x.as_py()] for x in key] + [[[str(t // n) for t in total]]]
        return pa.table([pa.array(v, t) for v, t in zip(one, (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string())), strict=True)], names=["dim", "part", "entry", "mean"])

    of_tasks = rows.select("v").mapInArrow(sums, "dim int, part int, entry int, n long, sums array<string>")
    means = of_tasks.groupBy("dim", "part", "entry").applyInArrow(added, "dim int, part int, entry int, mean array<string>")
    moved = {dim: [list(book) for book in of_dim] for dim, of_dim in books.items()}
    for r in means.collect():  # parts x entries of them
        moved[r.dim][r.part][r.entry] = [int(x) for x in r.mean]

    def packed(book, like):
        big = any(abs(int(x)) >= SAFE for e in book for x in e)
        return np.array([[int(x) for x in e] for e in book], object if big else np.int64).reshape(like.shape)

    return {dim: [packed(b, like) for b, like in zip(of_dim, books[dim], strict=True)] for dim, of_dim in moved.items()}


def train_and_encode(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label") -> tuple[DataFrame, dict]:
    """(vec_id, label, codes array<int>, error, dim, evaluated) of every kept vector, and the codebooks by length of vector.

    Kept are vectors that aren't null and hold no null or non-finite component. Components become
    floor(scale * x). Codebooks start as the parts of the vectors of smallest id (of equal ids, those of smaller
    components; without id, last) and move ``rounds`` times. Vectors of different lengths have codebooks
    of their own; a length that ``parts`` doesn't divide counts as filled up with zeros. Errors beyond a
    long are null. ``evaluated`` is the number of entries compared. Repeated rows count each. Other
    columns are not read. An empty table gives no rows and no codebooks.
    """
    import pyarrow as pa

    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vec).cast("array<double>").alias("v"))
    rows = materialize(rows.filter(finite(F.col("v"))), "vectors")
    books = _first_codebooks(rows, parts, entries, scale)
    for _ in range(rounds):
        books = _moved(rows, books, parts, scale)

    def encode(batches):
        for b in batches:
            n = b.num_rows
            codes, error, dims, tried = np.zeros((n, parts), np.int32), [0] * n, np.zeros(n, np.int32), np.zeros(n, np.int64)
            for dim, own, x in _parts(b.column(2), parts, scale):
                total = 0
                for p in range(parts):
                    who, d, many = nearest(x[:, p], books[dim][p])
                    codes[own, p], total = who, total + d
                    tried[own] += many // max(1, len(own))
                dims[own] = dim
                for r, t in zip(own, total, strict=True):
                    error[r] = int(t)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * parts, pa.int32()), pa.array(codes.ravel()))
            errors = pa.array([e if e < 1 << 63 else None for e in error], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, errors, pa.array(dims), pa.array(tried)], ["vec_id", "label", "codes", "error", "dim", "evaluated"])

    kind = rows.schema["label"].dataType.simpleString()
    coded = materialize(rows.select("vec_id", "label", "v").mapInArrow(encode, f"vec_id long, label {kind}, codes array<int>, error long, dim int, evaluated long"), "codes")
    discard(rows)
    return coded, books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error: the errors of all rows of equal labels together, nulls being equal. Null if one of them or
    the sum is beyond a long.

    Labels that hold more than a thousandth of the rows, at most 1000, are joined by broadcast, so that a hot
    label stays where it is; others are shuffled.
    """
    sums = materialize(coded.groupBy("label").agg(F.count("*").alias("n"), F.when(F.max(F.col("error").isNull()), None).otherwise(F.try_sum("error")).alias("label_error")), "label-errors")
    least = coded.count() * HOT_SHARE
    hot, rest = sums.filter(F.col("n") > least), sums.filter(F.col("n") <= least)
    hot, rest = (s.select(F.col("label").alias("of"), "label_error") for s in (hot, rest))
    same = F.col("label").eqNullSafe(F.col("of"))
    of_hot = coded.join(F.broadcast(hot), same).drop("of")
    return of_hot.unionByName(coded.join(F.broadcast(hot.select("of")), same, "left_anti").join(rest, same).drop("of"))


def said(books: list[np.ndarray]) -> str:
    """All entries' components in decimal, by part, entry and position."""
    return ",".join(str(int(x)) for book in books for entry in book for x in entry)
