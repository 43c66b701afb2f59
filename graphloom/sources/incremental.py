"""Extraction that goes on from a stored one: only changed files are read again.

The facts of each file lie in a table for each kind, dealt into parts by path. A new version writes the
parts that hold changed files, without the old facts of these, and then a manifest that says for each
part which version has it. The manifest is the commit: readers of the last one see old parts and new
parts together or not at all, and a run that dies before it leaves nothing to be seen. One writer at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rounds import cut
from .detect import content_hash
from .extract import FACTS, facts, link

SCHEMAS = {
    "files": "path string, hash string",
    "nodes": "id string, label string, file_type string, source_file string, source_location string, tags array<string>, comment string, ord struct<source_file:string,line:int>, log_messages array<string>, throw_messages array<string>, path string",
    "edges": "source string, target string, relation string, confidence string, confidence_score double, source_file string, source_location string, weight double, ord struct<source_file:string,line:int>, path string",
    "bases": "path string, id string, label string",
    "functions": "path string, lang string, name string, class string, id string",
    "calls": "path string, at int, line int, caller_nid string, callee string, has_object boolean, package boolean, b struct<kind:string,key:string,member:string>",
}


class FactStore:
    """Versions of facts under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = 64):
        self.spark, self.folder, self.parts = spark, folder.rstrip("/"), parts

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsparkSession.sparkContext().hadoopConfiguration()).exists(at)

    def versions(self) -> list[int]:
        """Versions whose manifest is complete."""
        if not self._exists(f"{self.folder}/manifest"):
            return []
        found = self.spark.read.schema("part int, holder int, version int").parquet(f"{self.folder}/manifest").select("version").distinct()
        return sorted(r["version"] for r in found.collect())

    def manifest(self, version: int) -> DataFrame:
        """(part, holder): which version holds each part; a row a part."""
        if version == 0:
            return self.spark.createDataFrame([], "part int, holder int")
        return self.spark.read.schema("part int, holder int").parquet(f"{self.folder}/manifest/version={version}")

    def read(self, table: str, version: int, only: list[int] | None = None) -> DataFrame:
        """Rows of a table as of a version, in all or some parts."""
        if version == 0 or not self._exists(f"{self.folder}/{table}"):
            return self.spark.createDataFrame([], SCHEMAS[table] + ", part int")
        rows = self.spark.read.schema(SCHEMAS[table] + ", holder int, part int").parquet(f"{self.folder}/{table}")
        if only is not None:
            rows = rows.filter(F.col("part").isin(*only))
        return rows.join(F.broadcast(self.manifest(version)), ["part", "holder"]).drop("holder")

    def changes(self, files: DataFrame, version: int) -> DataFrame:
        """(path, hash, change): added, modified or removed against a version."""
        now = files.filter("text IS NOT NULL").select("path", content_hash(F.col("path"), F.col("text")).alias("hash")).groupBy("path").agg(F.min("hash").alias("hash"))
        old = self.read("files", version).select("path", F.col("hash").alias("old"))
        both = now.join(old, "path", "full")
        change = F.when(F.col("old").isNull(), "added").when(F.col("hash").isNull(), "removed").when(F.col("hash") != F.col("old"), "modified")
        return both.select("path", "hash", change.alias("change")).filter("change IS NOT NULL")

    def update(self, files: DataFrame) -> tuple[int, DataFrame]:
        """The version that stands for ``files`` (path, text), and what changed: a new one if anything did. Facts of
        changed and removed files go, and changed and added files alone are extracted."""
        known = self.versions()
        version = known[-1] if known else 0
        changed = cut(self.changes(files, version))
        part = F.pmod(F.xxhash64("path"), F.lit(self.parts)).cast("int")
        touched = [r["part"] for r in changed.select(part.alias("part")).distinct().collect()]  # no more than there are parts
        if not touched:
            return version, changed
        number = self._free(version + 1)
        again = changed.filter("change != 'removed'")
        fresh = facts(files.join(again.select("path"), "path", "left_semi"))
        fresh["files"] = again.select("path", "hash")
        for table in ("files", *FACTS):
            kept = self.read(table, version, touched).drop("part").join(changed.select("path"), "path", "left_anti")
            rows = kept.unionByName(fresh[table].select(*kept.columns)).withColumn("part", part)
            rows.repartition("part").write.partitionBy("part").parquet(f"{self.folder}/{table}/holder={number}")
        all_parts = self.spark.range(self.parts).select(F.col("id").cast("int").alias("part"))
        held = all_parts.join(self.manifest(version), "part", "left").select("part", F.when(F.col("part").isin(*touched), number).otherwise(F.col("holder")).alias("holder")).filter("holder IS NOT NULL")
        held.coalesce(1).write.parquet(f"{self.folder}/manifest/version={number}")
        return number, changed

    def _free(self, number: int) -> int:
        """The next number that no unfinished run has left parts under."""
        while any(self._exists(f"{self.folder}/{t}/holder={number}") for t in SCHEMAS):
            number += 1
        return number

    def graph(self, version: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Nodes, edges and unresolved calls as of a version, the last by default."""
        version = version if version is not None else (self.versions() or [0])[-1]
        return link({table: self.read(table, version).drop("part") for table in FACTS})

    def forget(self, keep: int = 1) -> list[int]:
        """Deletes all but the last ``keep`` manifests, and the parts that none of these names. Their numbers."""
        versions = self.versions()
        last = versions[-keep:] if keep else []
        used = {r["holder"] for r in reduce(DataFrame.unionByName, [self.manifest(v) for v in last]).select("holder").distinct().collect()} if last else set()
        jvm = self.spark._jvm
        conf = self.spark._jsparkSession.sparkContext().hadoopConfiguration()
        gone = [v for v in versions if v not in last]
        for folder in [f"{self.folder}/manifest/version={v}" for v in gone] + [f"{self.folder}/{t}/holder={v}" for v in versions if v not in used for t in SCHEMAS]:
            at = jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(conf).delete(at, True)
        return gone
