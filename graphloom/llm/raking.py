"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by (source, language, topic) cell; factors of the three dimensions are
raked in turn until the weighted cells meet the target marginals. Cells are a small
table next to the documents, but may be many: each pass is an aggregation and a join,
never a collection on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Passes over the dimensions; each pass ends on the last dimension, whose marginal is then met exactly.
PASSES = 6
#: Of bounded raking: how far from its target a marginal may end, and the most passes.
RESIDUAL, ROUNDS = 0.001, 30
#: Topics by phrases that mark them; the first that a text holds names its topic.
TOPICS = (("licence", ("licensed under", "copyright", "all rights reserved")), ("web", ("http://", "https://", "www.")), ("contact", ("@",)), ("markup", ("<", "{", "}")), ("symbols", ("###", "$$$", "%%%", "&&&", "***")))


def topic_of(text: Column, topics=TOPICS) -> Column:
    """Topic of a whole text; ``general`` if no phrase occurs (also for null)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("general")
    for name, phrases in reversed(topics):
        hit = F.lit(False)
        for p in phrases:
            hit = hit | low.contains(p)
        out = F.when(hit, name).otherwise(out)
    return out


def n_tokens(text: Column) -> Column:
    """Estimate of the tokens of a text: a quarter of its bytes, one at least."""
    return F.greatest(F.floor(F.octet_length(F.coalesce(text, F.lit(""))) / 4), F.lit(1)).cast("long")


def tempered(cells: DataFrame, dim: str, budget: float, power: float) -> DataFrame:
    """Target for each value of a dimension: its token share to ``power``, scaled to ``budget``
    times all tokens. Power 1 keeps the mix, 0 makes it even."""
    each = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("t"))
    total = each.agg(F.sum("t").alias("all"), F.sum(F.pow("t", F.lit(power))).alias("powers"))
    return each.crossJoin(F.broadcast(total)).select(dim, (F.pow("t", F.lit(power)) / F.col("powers") * F.col("all") * F.lit(budget)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], passes: int = PASSES) -> DataFrame:
    """``cells`` (dimensions, tokens) with ``weight``, by which each cell's tokens meet the targets.

    ``targets``: for each dimension a table (dimension, target). Cells whose value has no
    target get weight 0.
    """
    now = cells.withColumn("weight", F.lit(1.0))
    for _ in range(passes):
        for dim, target in targets.items():
            sums = now.groupBy(dim).agg(F.sum(F.col("tokens") * F.col("weight")).alias("sum"))
            factor = target.join(sums, dim).select(dim, F.when(F.col("sum") > 0, F.col("target") / F.col("sum")).otherwise(0.0).alias("factor"))
            now = now.join(factor, dim, "left").withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(0.0))).select(*cells.columns, "weight")
        now = materialize(now, "raked")
    return now


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) fixed by the keys: 52 bits of an MD5 digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("\x00")) for k in keys])), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _dimensions(docs: DataFrame, text: str) -> dict[str, Column]:
    named = {d: F.coalesce(F.col(d), F.lit("")) for d in ("source", "lang")}
    return named | {"topic": topic_of(F.col(text)), "tokens": n_tokens(F.col(text))}


def cell_weights(rows: DataFrame, budget: float, powers: dict[str, float], bounded: bool = False) -> DataFrame:
    """Dimensions and ``weight`` of every cell of ``rows`` (dimensions, tokens)."""
    dims = list(powers)
    cells = materialize(rows.groupBy(*dims).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    targets = {d: materialize(tempered(cells, d, budget, p), "mix-target") for d, p in powers.items()}
    return (rake_bounded if bounded else rake)(cells, targets).drop("tokens")


def _chosen(doc_id: Column, tokens: Column, weight: Column, seed: str) -> Column:
    return uniform(F.lit(seed), doc_id, tokens) < F.least(weight, F.lit(1.0))


def mix(docs: DataFrame, budget: float, powers: dict[str, float], doc_id: str = "doc_id", text: str = "text", seed: str = "mix") -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, lang, topic, tokens, weight, probability, kept.

    Needs columns source and lang; nulls are a value of their own (empty). A document stays
    with probability min(1, weight), decided by a hash of its id and estimated tokens: repeated
    rows share their fate. Weights over 1 mean that a cell is short of its target; all of its
    documents stay. An empty table gives no rows.
    """
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), *[c.alias(n) for n, c in _dimensions(docs, text).items()]), "mix-rows")
    weights = cell_weights(rows, budget, powers)
    p = F.least(F.col("weight"), F.lit(1.0))
    return rows.join(weights, list(powers)).select(
        "doc_id", "source", "lang", "topic", "tokens", F.round("weight", 6).alias("weight"), F.round(p, 6).alias("probability"), _chosen(F.col("doc_id"), F.col("tokens"), F.col("weight"), seed).alias("kept")
    )


def sample(docs: DataFrame, budget: float, powers: dict[str, float], doc_id: str = "doc_id", text: str = "text", seed: str = "mix") -> DataFrame:
    """A sample of ``docs`` by bounded weights, with all their columns unchanged."""
    named = {f"_mix_{n}": c for n, c in _dimensions(docs, text).items()}
    dims = list(powers)
    rows = docs.select(*[c.alias(n) for n, c in _dimensions(docs, text).items()])
    weights = cell_weights(rows, budget, powers, bounded=True).select(*[F.col(d).alias(f"_mix_{d}") for d in dims], F.col("weight").alias("_mix_weight"))
    kept = docs.withColumns(named).join(weights, [f"_mix_{d}" for d in dims]).filter(_chosen(F.col(doc_id), F.col("_mix_tokens"), F.col("_mix_weight"), seed))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def _bounded_step(cells: DataFrame, dim: str, target: DataFrame) -> DataFrame:
    """``u`` scaled by one factor for each value of ``dim``, so that tokens times min(1, u) meet its
    target; where even all tokens don't, all of the value's cells have 1 or more."""
    down = Window.partitionBy(dim).orderBy(F.desc("u"), *[c for c in cells.columns if c not in ("u", "tokens", dim)])
    full = F.coalesce(F.sum("tokens").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    free = F.sum(F.col("tokens") * F.col("u")).over(down.rowsBetween(0, Window.unboundedFollowing))
    tried = cells.join(target, dim, "left").withColumns({"f": (F.col("target") - full) / free, "rank": F.row_number().over(down)})
    fits = F.when((F.col("f") * F.col("u") <= 1) & (F.col("f") >= 0), F.struct("rank", "f"))
    # sums beside the rows, not joined back: a plan that held ``cells`` twice would double with each dimension
    value = Window.partitionBy(dim)
    factor = F.coalesce(F.min(fits).over(value)["f"], 1 / F.min("u").over(value))
    return tried.withColumn("u", F.when(F.col("target").isNull(), 0.0).otherwise(F.col("u") * factor)).select(*cells.columns)


def residuals(cells: DataFrame, targets: dict[str, DataFrame], weight: str = "weight") -> DataFrame:
    """dim, value, tokens, expected, target, feasible: expected tokens of each marginal against what it
    should be; not feasible is a target over all tokens of the value."""
    out = None
    for dim, target in targets.items():
        sums = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("tokens"), F.sum(F.col("tokens") * F.least(F.col(weight), F.lit(1.0))).alias("expected"))
        part = target.join(sums, dim).select(F.lit(dim).alias("dim"), F.col(dim).cast("string").alias("value"), "tokens", "expected", "target", (F.col("target") <= F.col("tokens")).alias("feasible"))
        out = part if out is None else out.unionByName(part)
    return out


def attainable(cells: DataFrame, dim: str, target: DataFrame) -> DataFrame:
    """Targets of a dimension of which none is over the tokens of its value: what such a value can't
    supply is shared by the others in proportion, so that the sum stays, if there are so many tokens."""
    each = target.join(cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("t")), dim)
    first = Window.orderBy(F.col("t") / F.col("target"), dim)
    full = F.coalesce(F.sum("t").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    free = F.sum("target").over(first.rowsBetween(0, Window.unboundedFollowing))
    tried = each.filter("target > 0").withColumns({"f": (F.sum("target").over(Window.partitionBy()) - full) / free, "rank": F.row_number().over(first)})
    factor = tried.agg(F.min(F.when(F.col("f") * F.col("target") <= F.col("t") * (1 + 1e-12), F.struct("rank", "f")))["f"].alias("f"))
    return each.crossJoin(F.broadcast(factor)).select(dim, F.when(F.col("f").isNull(), F.col("t")).otherwise(F.least("t", F.col("f") * F.col("target"))).alias("target"))


def rake_bounded(cells: DataFrame, targets: dict[str, DataFrame], residual: float = RESIDUAL, rounds: int = ROUNDS) -> DataFrame:
    """As ``rake``, but no weight is over 1: saturated cells stay at 1 and the rest of their values makes up
    for them, and ``attainable`` targets are met. Passes end when no feasible marginal is off by more than ``residual`` of its target;
    targets that contradict each other end when passes gain under 2 % or after ``rounds``, and ``residuals`` tells which are unmet."""
    now = cells.withColumn("u", F.lit(1.0))
    before = None
    targets = {d: materialize(attainable(cells, d, t), "mix-attainable") for d, t in targets.items()}
    for _ in range(rounds):
        for dim, target in targets.items():
            now = _bounded_step(now, dim, target)
        now = materialize(now, "raked")
        worst = residuals(now, targets, "u").filter("target > 0").agg(F.max(F.abs(F.col("expected") - F.col("target")) / F.col("target"))).first()[0]
        if worst is None or worst <= residual or (before is not None and worst > 0.98 * before):
            break
        before = worst
    return now.select(*cells.columns, F.least("u", F.lit(1.0)).alias("weight"))
