"""Weights of at most 1 that meet the targets, on a table whose small cells saturate."""

import pandas as pd
from pyspark.sql import functions as F

from graphloom.llm import raking

DIMS = {"source": 0.5, "lang": 0.9, "topic": 0.7}


def skewed(spark):
    rows = [("a", "en", "general", 100000), ("a", "en", "web", 900), ("a", "fr", "general", 30000), ("b", "fr", "general", 9000), ("b", "en", "web", 20000), ("b", "fr", "web", 400), ("c", "en", "general", 3000), ("c", "fr", "web", 9000)]
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")


def test_expected_tokens_meet_the_targets(spark):
    cells = skewed(spark)
    targets = {d: raking.tempered(cells, d, 0.6, p) for d, p in DIMS.items()}
    weights = raking.cell_weights(cells, 0.6, DIMS, bounded=True)
    got = raking.residuals(cells.join(weights, list(DIMS)), targets).toPandas()
    assert weights.agg(F.max("weight")).first()[0] <= 1
    assert len(got) == 7 and not got[got.value == "c"].feasible.item()
    wanted = {d: raking.attainable(cells, d, t) for d, t in targets.items()}
    met = raking.residuals(cells.join(weights, list(DIMS)), wanted).toPandas()
    assert abs(met[met.dim == "source"].expected.sum() - 0.6 * 172300) < 110 and met[met.value == "c"].target.item() == 12000
    last = met[met.dim == "topic"]  # sources and topics here contradict each other
    assert ((last.expected - last.target).abs() <= 0.001 * last.target).all()
    old = raking.residuals(cells.join(raking.cell_weights(cells, 0.6, DIMS), list(DIMS)), wanted).toPandas()
    off = lambda t: (t.expected - t.target).abs().sum()
    assert off(met) < off(old)


def test_feasible_targets_are_met_exactly(spark):
    cells = spark.createDataFrame([("a", "x", 1000), ("a", "y", 100), ("b", "x", 100), ("b", "y", 1000)], "s string, l string, tokens long")
    targets = {"s": spark.createDataFrame([("a", 1000.0), ("b", 500.0)], "s string, target double"), "l": spark.createDataFrame([("x", 950.0), ("y", 550.0)], "l string, target double")}
    rows = raking.rake_bounded(cells, targets).toPandas()
    rows["t"] = rows.tokens * rows.weight
    assert rows.weight.max() <= 1 and rows.groupby("s").t.sum().sub(pd.Series({"a": 1000, "b": 500})).abs().max() < 2
    assert rows.groupby("l").t.sum().sub(pd.Series({"x": 950, "y": 550})).abs().max() < 2


def test_the_sample_uses_bounded_weights(spark, monkeypatch):
    called = []
    monkeypatch.setattr(raking, "rake_bounded", lambda cells, targets: called.append(1) or raking.rake(cells, targets))
    docs = spark.createDataFrame([(1, "x", "en", "a")], "doc_id long, text string, lang string, source string")
    assert raking.sample(docs, 0.9, DIMS).columns == docs.columns and called


def test_a_pass_reads_the_cells_once(spark, tmp_path):
    skewed(spark).write.parquet(f"{tmp_path}/cells")
    now = cells = spark.read.parquet(f"{tmp_path}/cells").withColumn("u", F.lit(1.0))
    for d, p in DIMS.items():
        target = spark.createDataFrame(raking.tempered(cells, d, 0.6, p).toPandas(), f"{d} string, target double")
        now = raking._bounded_step(now, d, target)
    assert now._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
