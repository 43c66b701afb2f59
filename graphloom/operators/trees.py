"""Containment trees and their similarities, as level-by-level joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CONTAINMENT
from .align import node_types
from .graph import PropertyGraph
from .rounds import cut

LAMBDA = 0.5


def containment_tree(graph: PropertyGraph) -> DataFrame:
    """(id, parent, depth, node_type, tags, arity, degree): a forest over all nodes. Of several
    parents the last in pair order counts; a cycle is opened above its smallest node."""
    inside = graph.edges.filter(F.col("relation").isin(*CONTAINMENT) & (F.col("source") != F.col("target")))
    parents = inside.groupBy(F.col("target").alias("id")).agg(F.max_by("source", F.struct("lo", "hi")).alias("parent"))
    linked = cut(graph.nodes.select("id").join(parents, "id", "left"))
    level = cut(linked.filter("parent is null").select("id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth")))
    levels, placed = [level], level.count()
    total = linked.count()
    waiting = linked.filter("parent is not null")
    depth = 0
    while placed < total:
        depth += 1
        level = cut(waiting.join(level.select(F.col("id").alias("parent")), "parent").select("id", "parent", F.lit(depth).alias("depth")))
        n = level.count()
        if not n:  # what is left hangs on cycles
            seen = reduce(DataFrame.unionByName, [x.select("id") for x in levels])
            left = cut(waiting.join(seen, "id", "left_anti"))
            level = cut(_cycle_tops(left).select("id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth")))
            waiting, depth, n = left.join(level.select("id"), "id", "left_anti"), 0, level.count()
        levels.append(level)
        placed += n
    tree = reduce(DataFrame.unionByName, levels)
    arity = graph.edges.filter("relation = 'calls'").groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("arity"))
    tags = F.array_sort(F.coalesce("tags", F.array().cast("array<string>"))) if "tags" in graph.nodes.columns else F.array().cast("array<string>")
    full = tree.join(node_types(graph), "id").join(graph.nodes.select("id", tags.alias("tags")), "id").join(arity, "id", "left").join(graph.degrees(), "id")
    return cut(full.select("id", "parent", "depth", "node_type", "tags", F.coalesce("arity", F.lit(0)).alias("arity"), "degree"))


def _cycle_tops(links: DataFrame) -> DataFrame:
    """The smallest node of each cycle among (id, parent), by doubling: a node that is its own
    smallest ancestor lies on a cycle as its smallest."""
    now, steps, n = cut(links.select("id", F.col("parent").alias("far"), F.col("parent").alias("least"))), 1, links.count()
    while steps < n:
        hop = now.select(F.col("id").alias("far"), F.col("far").alias("farther"), F.col("least").alias("least2"))
        now = cut(now.join(hop, "far", "left").select("id", F.coalesce("farther", "far").alias("far"), F.least("least", "least2").alias("least")))
        steps *= 2
    return now.filter("id = least").select("id")


def subtree_hashes(tree: DataFrame, semantic: bool = False) -> DataFrame:
    """(id, depth, ahu, sub_size): canonical hash of each subtree, equal for equal shapes; with
    ``semantic`` also of equal types and tags. Built bottom-up, a join and an aggregation for each level."""
    own = F.xxhash64("node_type", F.array_join("tags", ",")) if semantic else F.lit(0).cast("long")
    base = cut(tree.select("id", "parent", "depth", own.alias("own")))
    deepest = base.agg(F.max("depth")).first()[0]
    if deepest is None:
        return base.select("id", "depth", F.col("own").alias("ahu"), F.lit(1).cast("long").alias("sub_size"))
    done = []
    below = None
    for d in range(deepest, -1, -1):
        level = base.filter(F.col("depth") == d)
        if below is None:
            now = level.select("id", "parent", "depth", F.col("own").alias("ahu"), F.lit(1).cast("long").alias("sub_size"))
        else:
            kids = below.groupBy(F.col("parent").alias("id")).agg(F.array_sort(F.collect_list("ahu")).alias("kids"), F.sum("sub_size").alias("size"))
            now = level.join(kids, "id", "left").select("id", "parent", "depth", F.when(F.col("kids").isNull(), F.col("own")).otherwise(F.xxhash64("own", "kids")).alias("ahu"), (F.coalesce("size", F.lit(0)) + 1).alias("sub_size"))
        below = cut(now)
        done.append(below.drop("parent"))
    return reduce(DataFrame.unionByName, done)


def truncated_hashes(tree: DataFrame, max_depth: int = 4, semantic: bool = False) -> DataFrame:
    """(id, cut, hash): the hash of each subtree cut at depth 1 to ``max_depth``."""
    own = F.xxhash64("node_type", F.array_join("tags", ",")) if semantic else F.lit(0).cast("long")
    base = cut(tree.select("id", "parent", own.alias("own")))
    now, out = base.select("id", F.col("own").alias("h")), []
    for d in range(1, max_depth + 1):
        kids = base.filter("parent is not null").join(now, "id").groupBy(F.col("parent").alias("id")).agg(F.array_sort(F.collect_list("h")).alias("kids"))
        now = cut(base.join(kids, "id", "left").select("id", F.when(F.col("kids").isNull(), F.col("own")).otherwise(F.xxhash64("own", "kids")).alias("h")))
        out.append(now.select("id", F.lit(d).alias("cut"), F.col("h").alias("hash")))
    return reduce(DataFrame.unionByName, out)


def _cosine(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row, ``cosine`` of two count tables (key, n); 0 if either is empty."""
    both = a.select(key, F.col("n").alias("x")).join(b.select(key, F.col("n").alias("y")), key, "full_outer")
    x, y = (F.coalesce(c, F.lit(0)).cast("double") for c in ("x", "y"))
    s = both.agg(F.coalesce(F.sum(x * y), F.lit(0.0)).alias("xy"), F.coalesce(F.sum(x * x), F.lit(0.0)).alias("xx"), F.coalesce(F.sum(y * y), F.lit(0.0)).alias("yy"))
    return s.select(F.when((F.col("xx") == 0) | (F.col("yy") == 0), 0.0).otherwise(F.col("xy") / (F.sqrt("xx") * F.sqrt("yy"))).alias("cosine"))


def _counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def subtree_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, ``score``: multiset Jaccard of subtree hashes; two empty trees are equal."""
    both = _counts(a, "ahu").withColumnRenamed("n", "x").join(_counts(b, "ahu").withColumnRenamed("n", "y"), "ahu", "full_outer")
    x, y = (F.coalesce(c, F.lit(0)) for c in ("x", "y"))
    s = both.agg(F.sum(F.least(x, y)).alias("least"), F.sum(F.greatest(x, y)).alias("most"))
    return s.select(F.when(F.coalesce("most", F.lit(0)) == 0, 1.0).otherwise(F.col("least") / F.col("most")).alias("score"))


def subtree_frequency(a: DataFrame, b: DataFrame, max_depth: int = 4, semantic: bool = False) -> DataFrame:
    return _cosine(*(_counts(truncated_hashes(t, max_depth, semantic), "hash") for t in (a, b)), "hash")


def role_key() -> Column:
    bucket = F.when(F.col("arity") == 0, "0").when(F.col("arity") <= 2, "1-2").when(F.col("arity") <= 5, "3-5").otherwise("6+")
    return F.concat("node_type", F.lit(":"), F.when(F.size("tags") > 0, F.array_join("tags", "+")).otherwise("none"), F.lit(":a"), bucket)


def role_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, ``cosine`` of the shares of roles (type, tags, calls made)."""
    return _cosine(*(_counts(t.select(role_key().alias("role")), "role") for t in (a, b)), "role")


def _kernel_values(tree: DataFrame, hashes: DataFrame) -> DataFrame:
    """(ahu, k): ln of the kernel of a subtree with itself, by hash: lambda times the product of 1 + K over its children."""
    lam = float(LAMBDA)
    one = hashes.groupBy("ahu").agg(F.min("id").alias("id"))
    kids = tree.filter("parent is not null").select(F.col("id").alias("child"), F.col("parent").alias("id")).join(one, "id").join(hashes.select(F.col("id").alias("child"), F.col("ahu").alias("child_ahu")), "child").select("ahu", "child_ahu")
    sizes = hashes.groupBy("ahu").agg(F.max("sub_size").alias("size"), F.max("height").alias("height"))
    now = cut(sizes.filter("height = 0").select("ahu", F.log(F.lit(lam)).alias("k")))
    out, kids, h = [now], cut(kids.join(sizes.select("ahu", "height"), "ahu")), 0
    top = sizes.agg(F.max("height")).first()[0] or 0
    while h < top:
        h += 1
        known = reduce(DataFrame.unionByName, out)
        mine = kids.filter(F.col("height") == h).join(known.select(F.col("ahu").alias("child_ahu"), "k"), "child_ahu")
        one_more = F.greatest(F.col("k"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("k")))  # ln(1 + K), whatever the size of K
        out.append(cut(mine.groupBy("ahu").agg((F.log(F.lit(lam)) + F.sum(one_more)).alias("k"))))
    return reduce(DataFrame.unionByName, out)


def _heights(tree: DataFrame) -> DataFrame:
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    now, below = [], None
    for d in range(deepest, -1, -1):
        level = tree.filter(F.col("depth") == d).select("id", "parent")
        if below is not None:
            level = level.join(below.groupBy(F.col("parent").alias("id")).agg((F.max("height") + 1).alias("height")), "id", "left").select("id", "parent", F.coalesce("height", F.lit(0)).alias("height"))
        else:
            level = level.withColumn("height", F.lit(0))
        below = cut(level)
        now.append(below.select("id", "height"))
    return reduce(DataFrame.unionByName, now)


def kernel_logs(a: DataFrame, b: DataFrame, levels: int | None = None) -> DataFrame:
    """One row, ln_ab, ln_aa, ln_bb: logarithms of the subset-tree kernels of two trees that aren't empty.

    Equal hashes mean that all children match, so the kernel of a pair of subtrees depends on
    their hash alone, and the sum over pairs is lambda nA nB + sum over hashes of cA cB (K - lambda).
    With ``levels`` only nodes of that many levels from the root on count. Values grow exponentially with the
    number of leaves, so sums and the ratio are taken of logarithms.
    """
    parts = []
    for t in (a, b):
        h = cut(subtree_hashes(t).join(_heights(t), "id"))
        k = _kernel_values(t, h)
        near = h if levels is None else h.filter(F.col("depth") < levels)
        parts.append((_counts(near, "ahu"), k))
    (ca, ka), (cb, kb) = parts
    k = ka.unionByName(kb).groupBy("ahu").agg(F.max("k").alias("k"))
    both = ca.withColumnRenamed("n", "x").join(cb.withColumnRenamed("n", "y"), "ahu", "full_outer").join(k, "ahu").select(F.coalesce("x", F.lit(0)).cast("double").alias("x"), F.coalesce("y", F.lit(0)).cast("double").alias("y"), "k")
    both = cut(both)
    # logarithms of the terms of the three sums: of each hash, and of the pairs of nodes
    excess = F.col("k") + F.log1p(-F.exp(F.log(F.lit(float(LAMBDA))) - F.col("k")))
    sums = {"ab": ("x", "y"), "aa": ("x", "x"), "bb": ("y", "y")}
    each = both.filter(F.col("k") > F.log(F.lit(float(LAMBDA))) + 1e-12).select(F.explode(F.array(*[F.struct(F.lit(s).alias("of"), F.when(F.col(p) * F.col(q) > 0, F.log(F.col(p)) + F.log(F.col(q)) + excess).alias("l")) for s, (p, q) in sums.items()])).alias("t")).select("t.*")
    nodes = both.agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    pairs = nodes.select(F.explode(F.array(*[F.struct(F.lit(s).alias("of"), F.when(F.col(p) * F.col(q) > 0, F.log(LAMBDA * F.col(p) * F.col(q))).alias("l")) for s, (p, q) in sums.items()])).alias("t")).select("t.*")
    terms = each.unionByName(pairs).filter("l IS NOT NULL")
    most = terms.groupBy("of").agg(F.max("l").alias("most"))
    logs = terms.join(F.broadcast(most), "of").groupBy("of", "most").agg(F.sum(F.exp(F.col("l") - F.col("most"))).alias("s")).select("of", (F.col("most") + F.log("s")).alias("v"))
    value = lambda s: F.max(F.when(F.col("of") == s, F.col("v")))
    return logs.agg(value("ab").alias("ln_ab"), value("aa").alias("ln_aa"), value("bb").alias("ln_bb"))


def tree_kernel(a: DataFrame, b: DataFrame, levels: int | None = None) -> DataFrame:
    """One row, ``score``: normalised subset-tree kernel of two trees. Two empty trees score 1, an empty one and another 0."""
    size = [t.count() for t in (a, b)]
    if not all(size):
        return a.sparkSession.createDataFrame([(1.0 if not any(size) else 0.0,)], "score double")
    return kernel_logs(a, b, levels).select(kernel_score().alias("score"))


def kernel_score() -> Column:
    """Of a row of kernel_logs: K(a, b) over the root of K(a, a) K(b, b), from 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.exp(F.col("ln_ab") - (F.col("ln_aa") + F.col("ln_bb")) / 2), F.lit(1.0)))


def approximate_edit_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, ``distance`` and ``similarity``: L1 distance of hash counts over leaves and nodes at depth 4 or less."""
    part = lambda t: _counts(subtree_hashes(t).filter("depth <= 4 OR sub_size = 1"), "ahu")
    both = part(a).withColumnRenamed("n", "x").join(part(b).withColumnRenamed("n", "y"), "ahu", "full_outer")
    d = both.agg(F.coalesce(F.sum(F.abs(F.coalesce("x", F.lit(0)) - F.coalesce("y", F.lit(0)))), F.lit(0)).alias("distance"))
    n = a.count() + b.count()
    return d.select("distance", F.greatest(F.lit(0.0), 1 - F.col("distance") / max(n, 1)).alias("similarity"))


def _ancestors(tree: DataFrame) -> DataFrame:
    """(id, up) for every proper ancestor; as many rows as the sum of depths."""
    up = cut(tree.filter("parent is not null").select("id", F.col("parent").alias("up")))
    now, out = up, [up]
    while True:
        now = cut(now.join(up.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")))
        if now.isEmpty():
            return reduce(DataFrame.unionByName, out)
        out.append(now)


def common_subtrees(a: DataFrame, b: DataFrame, hashes_a: DataFrame, hashes_b: DataFrame) -> DataFrame:
    """One row, ``score``: nodes in common subtrees, matched largest first and never twice, over the larger tree.

    In each round all hashes match of which no free node lies below another free common one;
    as an ancestor is always the larger subtree, that is the order of sizes, in at most
    as many rounds as the trees are high. Of equal subtrees those of smallest id match.
    """
    sizes = [a.count(), b.count()]
    if not any(sizes):
        return a.sparkSession.createDataFrame([(1.0,)], "score double")
    free = [cut(h.select("id", "ahu", "sub_size")) for h in (hashes_a, hashes_b)]
    ups = [_ancestors(t) for t in (a, b)]
    total = 0
    while True:
        common = cut(free[0].select("ahu").distinct().join(free[1].select("ahu").distinct(), "ahu"))
        if common.isEmpty():
            break
        some = [f.join(common, "ahu") for f in free]
        below = [s.join(u, "id").join(s.select(F.col("id").alias("up")), "up").select("ahu") for s, u in zip(some, ups, strict=True)]
        ready = common.join(below[0].unionByName(below[1]).distinct(), "ahu", "left_anti")
        placed = [s.join(ready, "ahu").withColumn("n", F.row_number().over(_per("ahu", "id"))) for s in some]
        left, right = placed[0].withColumnRenamed("id", "id_a"), placed[1].select("ahu", "n", F.col("id").alias("id_b"))
        taken = cut(left.join(right, ["ahu", "n"]).select("id_a", "id_b", "sub_size"))
        total += taken.agg(F.sum("sub_size")).first()[0]
        for i, c in enumerate(("id_a", "id_b")):
            roots = taken.select(F.col(c).alias("up"))
            used = roots.select(F.col("up").alias("id")).unionByName(ups[i].join(roots, "up").select("id"))
            free[i] = cut(free[i].join(used, "id", "left_anti"))
    return a.sparkSession.createDataFrame([(total / max(sizes),)], "score double")


def _per(group, *order):
    from pyspark.sql import Window

    return Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order)


def _by_nearest_size(pdf):
    """From (id_a, id_b, side, sub_size, n): which many children of a size go to which size of the
    other side. The largest of side a choose first, each the nearest size left, of two the larger."""
    import numpy as np
    import pandas as pd

    a, b = (pdf[pdf["side"] == k].sort_values("sub_size", ascending=False)[["sub_size", "n"]].to_numpy() for k in "ab")
    left, used, out = b[:, 1].copy(), np.zeros(len(b), np.int64), []
    for size, n in a.tolist():
        first = 0
        while n and left.any():
            open_ = np.flatnonzero(left)
            j = int(open_[np.abs(b[open_, 0] - size).argmin()])
            take = min(n, int(left[j]))
            out.append((pdf["id_a"].iloc[0], pdf["id_b"].iloc[0], size, first, int(b[j, 0]), int(used[j]), take))
            left[j] -= take
            used[j] += take
            n, first = n - take, first + take
    return pd.DataFrame(out, columns=["id_a", "id_b", "size_a", "first_a", "size_b", "first_b", "n"])


def anti_unification(a: DataFrame, b: DataFrame, hashes_a: DataFrame, hashes_b: DataFrame) -> DataFrame:
    """One row, ``score``: matched nodes over the larger tree. Roots are paired, then the children of
    each pair, level by level: equal subtrees first, the others each with the nearest in size.

    Sizes are matched as counts, so that a group holds a row for each different size among the
    children of a pair (in a tree of n nodes under 2 sqrt(n)), not for each child.
    """
    sizes = [a.count(), b.count()]
    spark = a.sparkSession
    if not all(sizes):
        return spark.createDataFrame([(1.0 if not any(sizes) else 0.0,)], "score double")
    full = [cut(t.select("id", F.coalesce("parent", F.lit("")).alias("parent")).join(h.select("id", "ahu", "sub_size"), "id")) for t, h in ((a, hashes_a), (b, hashes_b))]
    pairs = spark.createDataFrame([("", "")], "id_a string, id_b string")
    total = 0
    while True:
        kids = [f.select(F.col("parent").alias(f"id_{k}"), F.col("id").alias(f"kid_{k}"), "ahu", "sub_size") for f, k in zip(full, "ab", strict=True)]
        ca, cb = (cut(pairs.join(kid, f"id_{k}")) for kid, k in zip(kids, "ab", strict=True))
        ranked = lambda df, k, by: df.withColumn("n", F.row_number().over(_per(["id_a", "id_b", by], f"kid_{k}")))
        same = ranked(ca, "a", "ahu").drop("sub_size").join(ranked(cb, "b", "ahu").drop("sub_size"), ["id_a", "id_b", "ahu", "n"]).select("kid_a", "kid_b")
        same = cut(same)
        rest = [cut(ranked(c.join(same.select(f"kid_{k}"), f"kid_{k}", "left_anti"), k, "sub_size").withColumn("n", F.col("n") - 1)) for c, k in ((ca, "a"), (cb, "b"))]
        counts = [r.groupBy("id_a", "id_b", "sub_size").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(k)) for r, k in zip(rest, "ab", strict=True)]
        deals = counts[0].unionByName(counts[1]).groupBy("id_a", "id_b").applyInPandas(_by_nearest_size, "id_a string, id_b string, size_a long, first_a long, size_b long, first_b long, n long")
        dealt = deals.withColumnRenamed("n", "take").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("take") - 1)))
        dealt = dealt.select("id_a", "id_b", "size_a", (F.col("first_a") + F.col("i")).alias("n_a"), "size_b", (F.col("first_b") + F.col("i")).alias("n_b"))
        side = lambda r, k: r.select("id_a", "id_b", F.col("sub_size").alias(f"size_{k}"), F.col("n").cast("long").alias(f"n_{k}"), f"kid_{k}")
        other = dealt.join(side(rest[0], "a"), ["id_a", "id_b", "size_a", "n_a"]).join(side(rest[1], "b"), ["id_a", "id_b", "size_b", "n_b"]).select("kid_a", "kid_b")
        pairs = cut(same.unionByName(other).select(F.col("kid_a").alias("id_a"), F.col("kid_b").alias("id_b")))
        n = pairs.count()
        if not n:
            break
        total += n
    return spark.createDataFrame([(total / max(sizes),)], "score double")


#: Largest product of tree sizes for which the exact edit distance is computed.
EXACT_CELLS = 25_000_000


def _postorder(pdf) -> tuple[list[str], list[int]]:
    """Kinds and leftmost leaves in post-order, from 1 on; children by id. Several roots get one above them."""
    kids: dict[str, list[str]] = {}
    for i, parent in sorted(zip(pdf["id"], pdf["parent"].fillna(""), strict=True)):
        kids.setdefault(parent, []).append(i)
    kind = dict(zip(pdf["id"], pdf["kind"], strict=True)) | {"": "virtual"}
    top = kids[""][0] if len(kids.get("", [])) == 1 else ""
    kinds, left, todo, first = [""], [0], [(top, False)], {}
    while todo:
        node, done = todo.pop()
        if not done:
            todo.append((node, True))
            todo += [(k, False) for k in reversed(kids.get(node, []))]
            continue
        kinds.append(kind[node])
        first[node] = first[kids[node][0]] if node in kids else len(kinds) - 1
        left.append(first[node])
    return kinds, left


def _ordered_distance(a, b, semantic: bool) -> int:
    """Ordered tree edit distance (Zhang and Shasha 1989) with unit costs, a row of the table at a time;
    a rename costs 1 if kinds differ and ``semantic``."""
    import numpy as np

    (ka, la), (kb, lb) = _postorder(a), _postorder(b)
    codes = {k: n for n, k in enumerate(sorted({*ka, *kb}))}
    ka, kb = (np.array([codes[k] for k in ks]) for ks in (ka, kb))
    la, lb = np.array(la), np.array(lb)
    last = lambda left: sorted({int(left[i]): i for i in range(1, len(left))}.values())
    dist = np.zeros((len(ka), len(kb)), np.int32)
    for i in last(la):
        for j in last(lb):
            m, n = i - la[i] + 1, j - lb[j] + 1
            q = np.arange(lb[j], j + 1)
            spine, steps = lb[q] == lb[j], np.arange(n + 1)
            table = np.zeros((m + 1, n + 1), np.int32)
            table[0] = steps
            for x in range(1, m + 1):
                p = la[i] + x - 1
                above = table[x - 1]
                whole = table[la[p] - la[i], lb[q] - lb[j]] + dist[p, q]
                if la[p] == la[i]:
                    renamed = above[:-1] + ((ka[p] != kb[q]) if semantic else 0)
                    whole = np.where(spine, renamed, whole)
                row = np.concatenate([[x], np.minimum(above[1:] + 1, whole)])
                table[x] = np.minimum.accumulate(row - steps) + steps  # insertions from the left
                if la[p] == la[i]:
                    dist[p, q[spine]] = table[x, 1:][spine]
    return int(dist[-1, -1])


def edit_distance(a: DataFrame, b: DataFrame, semantic: bool = False) -> DataFrame:
    """One row, ``distance``, ``similarity``, ``exact``. Exact while the product of the sizes is at
    most EXACT_CELLS, which bounds what the one task of the dynamic programme holds (100 MB); else
    by hash counts. With ``semantic`` nodes of unequal type or tags are unequal."""
    import pandas as pd

    na, nb = a.count(), b.count()
    if na * nb > EXACT_CELLS:
        return approximate_edit_distance(a, b).withColumn("exact", F.lit(False))
    if not na or not nb:
        return a.sparkSession.createDataFrame([(na + nb, 1.0 if not na + nb else 0.0, True)], "distance long, similarity double, exact boolean")
    rows = lambda t, k: t.select("id", "parent", F.concat("node_type", F.lit("\n"), F.array_join("tags", "\n")).alias("kind"), F.lit(k).alias("side"))

    def solve(pdf):
        d = _ordered_distance(pdf[pdf["side"] == 0], pdf[pdf["side"] == 1], semantic)
        return pd.DataFrame({"distance": [d], "similarity": [max(0.0, 1 - d / (na + nb))], "exact": [True]})

    return rows(a, 0).unionByName(rows(b, 1)).groupBy(F.lit(0).alias("_one")).applyInPandas(solve, "distance long, similarity double, exact boolean")
