"""Written tables: cutting lineage in iterative operators, and ranks over all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share. Where it is unset, a
    temporary one of this machine serves in local mode; elsewhere that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, later reads take the
    columns they need, and a lost executor costs no more than the tasks it ran."""
    path = f"{shared_dir(df.sparkSession)}/rounds-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(rows: DataFrame, name: str, *keys: Column | str) -> DataFrame:
    """``rows`` with ``name``, gapless from 0 in the order of ``keys``. Ranges of the keys are sorted apart,
    each in a task; a range's first rank is the number of rows in the ranges before."""
    placed = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_at") - F.shiftleft("_range", 33)).drop("_at", "_range", "_start")
