"""Comparison of graphs: composite score, N-way heatmap, estimates from shared pivots."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, community, diff, traverse, trees
from .graph import PropertyGraph

# Weight by default, between projects, and in estimates; whether one minus the
# score obeys the triangle inequality.
METRICS = {
    "NodeJaccard": (0.05, 0.00, 0.05, True),
    "EdgeJaccard": (0.05, 0.00, 0.05, True),
    "DegreeSim": (0.05, 0.05, 0.05, True),
    "CommunityNMI": (0.05, 0.05, 0.05, False),
    "AHU": (0.15, 0.15, 0.15, True),
    "TED": (0.20, 0.20, 0.20, True),
    "MCS": (0.15, 0.15, 0.15, False),
    "SubtreeFreq": (0.10, 0.10, 0.10, True),
    "TreeKernel": (0.10, 0.10, 0.10, False),
    "AntiUnif": (0.10, 0.10, 0.10, False),
    "RoleDist": (0.00, 0.10, 0.10, False),
}


@dataclass
class Options:
    rename_threshold: float = 0.6
    impact_depth: int = 3
    top_k: int = 20
    normalize: bool = False
    sensitivity: float = 0.5
    relations: tuple[str, ...] = ("imports",)
    weights: dict[str, float] = field(default_factory=dict)

    @property
    def least_match(self) -> float:
        return 0.25 if self.sensitivity > 0.7 else 0.4

    @property
    def semantic(self) -> bool:
        return self.normalize and self.sensitivity >= 0.3

    def metric_weights(self) -> dict[str, float]:
        return self.weights or {m: w[1 if self.semantic else 0] for m, w in METRICS.items()}


def weights_table(spark: SparkSession, weights: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(list(weights.items()), "metric string, weight double")


def composite(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """One row, ``composite``: weighted mean of (metric, score) over metrics with a weight and a score of 0 or more;
    null if the score of a metric with a weight is null, rather than a mean of the others."""
    used = scores.join(weights, "metric").filter("weight > 0 AND (score >= 0 OR score IS NULL)")
    mean = F.coalesce(F.sum(F.col("weight") * F.col("score")) / F.sum("weight"), F.lit(0.0))
    return used.agg(F.when(F.coalesce(F.max(F.col("score").isNull()), F.lit(False)), None).otherwise(mean).alias("composite"))


def tree_scores(a: PropertyGraph, b: PropertyGraph, semantic: bool = False) -> DataFrame:
    """(metric, score) of the containment trees. The edit distance is exact up to trees.EXACT_CELLS."""
    ta, tb = trees.containment_tree(a), trees.containment_tree(b)
    ha, hb = trees.subtree_hashes(ta, semantic), trees.subtree_hashes(tb, semantic)
    named = lambda df, c, metric: df.select(F.lit(metric).alias("metric"), F.col(c).cast("double").alias("score"))
    parts = [
        named(trees.subtree_match(ha, hb), "score", "AHU"),
        named(trees.edit_distance(ta, tb, semantic), "similarity", "TED"),
        named(trees.common_subtrees(ta, tb, ha, hb), "score", "MCS"),
        named(trees.subtree_frequency(ta, tb, semantic=semantic), "cosine", "SubtreeFreq"),
        named(trees.tree_kernel(ta, tb), "score", "TreeKernel"),
        named(trees.anti_unification(ta, tb, ha, hb), "score", "AntiUnif"),
        named(trees.role_similarity(ta, tb), "cosine", "RoleDist"),
    ]
    return reduce(DataFrame.unionByName, parts)


def graph_scores(a: PropertyGraph, b: PropertyGraph, ca: DataFrame | None = None, cb: DataFrame | None = None) -> DataFrame:
    """(metric, score) of the graphs as wholes; communities are found unless given."""
    ca, cb = ca if ca is not None else community.cluster(a), cb if cb is not None else community.cluster(b)
    named = lambda df, c, metric: df.select(F.lit(metric).alias("metric"), F.col(c).cast("double").alias("score"))
    jsd = diff.degree_jsd(a, b).select((1 - F.col("jsd")).alias("s"))
    return named(diff.jaccard_nodes(a, b), "jaccard", "NodeJaccard").unionByName(named(diff.jaccard_edges(a, b), "jaccard", "EdgeJaccard")).unionByName(named(jsd, "s", "DegreeSim")).unionByName(named(community.nmi(ca, cb), "nmi", "CommunityNMI"))


def compare(a: PropertyGraph, b: PropertyGraph, options: Options | None = None) -> dict[str, DataFrame]:
    """Sections: nodes, edges, distance, scores, composite, renames, impact, drift (and alignment,
    when normalising). Graphs without a difference score 1."""
    o = options or Options()
    spark, out = a.nodes.sparkSession, {}
    if o.normalize:
        out["alignment"] = align.align(a, b, o.least_match)
        b = b.rekey(out["alignment"].select("id_a", "id_b"))
    out["nodes"], out["edges"] = diff.diff_nodes(a, b), diff.diff_edges(a, b)
    out["distance"] = diff.approximate_edit_distance(out["nodes"], out["edges"])
    out["scores"] = graph_scores(a, b).unionByName(tree_scores(a, b, o.semantic))
    whole = composite(out["scores"], weights_table(spark, o.metric_weights()))
    out["composite"] = whole.crossJoin(out["distance"]).select(F.when(F.col("distance") == 0, 1.0).otherwise(F.col("composite")).alias("composite"))
    out["renames"] = diff.rename_candidates(a, b, o.rename_threshold, o.top_k)
    out["impact"] = traverse.ranked_impact(a, b, out["nodes"], o.impact_depth, o.top_k)
    out["drift"] = diff.import_drift(a, b, o.relations)
    return out


def compare_n(graphs: dict[str, PropertyGraph], options: Options | None = None, estimate_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """The heatmap (label_a, label_b, score; symmetric, 1 on the diagonal) and the pairs' scores
    (label_a, label_b, metric, score). With ``estimate_only`` pairs without the first graph are estimated."""
    o, names = options or Options(), list(graphs)
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i + 1 :] if not estimate_only or i == 0]
    scores = []
    for x, y in pairs:
        found = graph_scores(graphs[x], graphs[y]).unionByName(tree_scores(graphs[x], graphs[y], o.semantic))
        scores.append(found.select(F.lit(x).alias("label_a"), F.lit(y).alias("label_b"), "metric", "score"))
    table = reduce(DataFrame.unionByName, scores)
    spark = table.sparkSession
    weights = weights_table(spark, o.metric_weights())
    whole = table.join(weights, "metric").filter("weight > 0 AND score >= 0").groupBy("label_a", "label_b").agg((F.sum(F.col("weight") * F.col("score")) / F.sum("weight")).alias("score"))
    if estimate_only:
        whole = whole.unionByName(estimate(table).select("label_a", "label_b", F.col("mid").alias("score")))
    mirrored = whole.unionByName(whole.select(F.col("label_b").alias("label_a"), F.col("label_a").alias("label_b"), "score"))
    return mirrored.unionByName(spark.createDataFrame([(n, n, 1.0) for n in names], "label_a string, label_b string, score double")), table


def estimate(scores: DataFrame) -> DataFrame:
    """(label_a, label_b, lower, upper, mid): similarity of pairs that aren't in ``scores``
    (label_a, label_b, metric, score) from pivots that both are compared with.

    A metric score is bounded by the triangle inequality on 1 - score; others by the smaller
    known score less 0.1 and the larger plus 0.05. The tightest bounds over pivots are clamped to
    [0, 1], weighted over the metrics and rounded to three decimals.
    """
    spark = scores.sparkSession
    metrics = spark.createDataFrame([(m, w[2], w[3]) for m, w in METRICS.items()], "metric string, weight double, is_metric boolean")
    known = scores.select(F.col("label_a").alias("p"), F.col("label_b").alias("x"), "metric", "score")
    known = known.unionByName(scores.select(F.col("label_b").alias("p"), F.col("label_a").alias("x"), "metric", "score")).filter("score >= 0")
    both = known.withColumnRenamed("x", "a").withColumnRenamed("score", "sa").join(known.withColumnRenamed("x", "b").withColumnRenamed("score", "sb"), ["p", "metric"]).filter("a < b")
    direct = scores.select(F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b")).distinct()
    da, db = 1 - F.col("sa"), 1 - F.col("sb")
    low = F.when(F.col("is_metric"), 1 - (da + db)).otherwise(F.least("sa", "sb") - 0.1)
    high = F.when(F.col("is_metric"), 1 - F.abs(da - db)).otherwise(F.greatest("sa", "sb") + 0.05)
    bounds = both.join(direct, ["a", "b"], "left_anti").join(metrics, "metric").groupBy("a", "b", "metric", "weight").agg(F.max(low).alias("low"), F.min(high).alias("high"))
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    mean = lambda c: F.sum(F.col("weight") * clamp(F.col(c))) / F.sum("weight")
    rounded = lambda c: F.floor(c * 1000 + 0.5) / 1000
    whole = bounds.groupBy(F.col("a").alias("label_a"), F.col("b").alias("label_b")).agg(mean("low").alias("lo"), mean("high").alias("hi"))
    whole = whole.select("label_a", "label_b", F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"))
    return whole.select("label_a", "label_b", rounded(F.col("lo")).alias("lower"), rounded(F.col("hi")).alias("upper"), rounded((F.col("lo") + F.col("hi")) / 2).alias("mid"))


def interpret(score: float) -> str:
    """A word for a composite score."""
    # Least score of each band.
    for least, word in ((0.95, "nearly identical"), (0.80, "very similar"), (0.60, "moderately similar"), (0.35, "loosely related")):
        if score >= least:
            return word
    return "different"
