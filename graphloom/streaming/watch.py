"""Watching a source tree: debounced rebuilds as a stream."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rounds import cut
from ..sources.detect import list_tree
from ..sources.incremental import FactStore


def debounce(events: DataFrame, gap: str = "3 seconds", *keys: str, time: str = "ts") -> DataFrame:
    """Sessions (keys, start, end, events) of changes that follow each other within ``gap``; batch or,
    with a watermark on the time column, streaming."""
    window = F.session_window(time, gap)
    return events.groupBy(*keys, window.alias("w")).agg(F.count(F.lit(1)).alias("events")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def changed_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change): added, removed or modified between two listings (path, modificationTime, length).
    File streams don't report deletions, so this difference does."""
    side = lambda df, k: df.select("path", F.struct("modificationTime", "length").alias(k))
    both = side(before, "a").join(side(now, "b"), "path", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return both.select("path", change.alias("change")).filter("change is not null")


def watch(spark: SparkSession, root: str, rebuild: Callable[[DataFrame, int], None], checkpoint: str, pattern: str = "*", interval: str | None = "3 seconds"):
    """A running query that hands each micro-batch of new or touched files (path, modificationTime,
    length, content) to ``rebuild(batch, version)``. Without an interval, what is there is
    worked off and the query ends. The checkpoint makes versions go on after a restart."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    writer = files.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def settled(events: DataFrame, gap: str = "3 seconds", late: str = "0 seconds", key: str = "root", time: str = "ts", processing_time: bool = False) -> DataFrame:
    """(key, start, last, events) of a stream of changes, one row when a key has had none for ``gap``.

    The state of a key is the first and last time and the number of its changes; each change puts its timer off again.
    Timers go by event time behind a watermark of ``late``, or else by the clock.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    wait, zone = pd.Timedelta(gap), events.sparkSession.conf.get("spark.sql.session.timeZone")
    columns = [key, "start", "last", "events"]

    def step(k, frames, state):
        held = list(state.get) if state.exists else None
        done = []
        if state.hasTimedOut:
            done.append((k[0], *held))
            state.remove()
        else:
            times = pd.concat([f[time] for f in frames], ignore_index=True).sort_values()
            for t in times:
                t = t.to_pydatetime()
                if held and t - held[1] > wait:
                    done.append((k[0], *held))
                    held = None
                held = [min(held[0], t), max(held[1], t), held[2] + 1] if held else [t, t, 1]
            state.update(tuple(held))
            if processing_time:
                state.setTimeoutDuration(int(wait.total_seconds() * 1000))
            else:
                due = int((pd.Timestamp(held[1]).tz_localize(zone, ambiguous=False, nonexistent="shift_forward") + wait).timestamp() * 1000)
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=columns)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if processing_time else GroupStateTimeout.EventTimeTimeout
    timed = events if processing_time else events.withWatermark(time, late)
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} string, start timestamp, last timestamp, events long", "start timestamp, last timestamp, events long", "append", timeout)


def poll(spark: SparkSession, root: str, seen: DataFrame | None, events: str, at: datetime.datetime | None = None) -> DataFrame:
    """Lists ``root``, appends what changed since the listing ``seen`` (all files, if none) as rows (root, path, change, ts)
    under ``events``, and returns the new listing. Deletions are changes like others."""
    now = cut(list_tree(spark, root))
    changed = changed_files(seen if seen is not None else now.limit(0), now)
    moment = F.lit(at) if at is not None else F.current_timestamp()
    rows = cut(changed.select(F.lit(root).alias("root"), "path", "change", moment.cast("timestamp").alias("ts")))
    if not rows.isEmpty():
        rows.coalesce(1).write.mode("append").parquet(events)
    return now


def change_stream(spark: SparkSession, events: str, files_at_once: int | None = None) -> DataFrame:
    reader = spark.readStream.schema("root string, path string, change string, ts timestamp")
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(events)


def follow(changes: DataFrame, read: Callable[[str], DataFrame], store: FactStore, checkpoint: str, gap: str = "3 seconds", interval: str | None = "3 seconds"):
    """A running query that brings ``store`` up to date whenever the changes of a root have settled: ``read(root)`` gives
    its files (path, text), and only those that differ from the last version are extracted. A batch that runs again
    after a failure finds nothing left to do. Without an interval, what is there is worked off and the query ends."""

    def rebuild(batch: DataFrame, number: int) -> None:
        for r in batch.select("root").distinct().collect():  # the watched roots
            store.update(read(r["root"]))

    writer = settled(changes, gap, processing_time=interval is not None).writeStream.foreachBatch(rebuild).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def publish(tables: dict[str, DataFrame], path: str, version: int) -> None:
    """Writes each table under ``path/version=N``; readers take the largest version that has its mark."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/version={version:08d}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.range(1).select(F.lit(version).alias("version")).write.mode("overwrite").parquet(f"{path}/done/version={version:08d}")


def latest(spark: SparkSession, path: str, name: str) -> DataFrame:
    version = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/done").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{path}/version={version:08d}/{name}")
