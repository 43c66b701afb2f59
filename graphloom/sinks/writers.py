"""Sinks that need more than a file for each task: Python data sources whose commits put tasks' parts together.

Tasks write parts under a folder of the run, beside the target and named by attempt; only parts of attempts
that ended are named in messages. The commit makes the target appear by renaming, so readers see all of it or
nothing, and a run that fails is deleted.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..sources.detect import _file_system, read_tree
from ..sources.files import VECTOR_MAGIC, VECTOR_VERSION

_CHUNK = 4 << 20


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    rows: int


class _Staged(DataSourceArrowWriter):
    """Parts of tasks under a folder of the run."""

    def __init__(self, options):
        self.options, self.path = dict(options), options["path"].rstrip("/")
        self.run = f"{self.path}.run-{uuid.uuid4().hex}"

    def _place(self) -> tuple[int, str]:
        from pyspark import TaskContext

        task = TaskContext.get()
        return task.partitionId(), f"{task.partitionId():08d}-{task.taskAttemptId()}"

    def abort(self, messages) -> None:
        system, run = _file_system(self.run)
        if system.get_file_info(run).type.name == "Directory":
            system.delete_dir(run)


class VectorWriter(_Staged):
    def write(self, iterator: Iterator) -> Part:
        number, name = self._place()
        system, run = _file_system(self.run)
        system.create_dir(run, recursive=True)
        rows = 0
        with system.open_output_stream(f"{run}/{name}") as out:
            for batch in iterator:
                for one, vec in zip(batch.column("id").to_pylist(), batch.column("vec").to_pylist(), strict=True):
                    raw = one.encode()
                    out.write(struct.pack("<I", len(raw)) + raw + struct.pack(f"<{len(vec)}f", *vec))
                    rows += 1
        return Part(number, name, rows)

    def commit(self, messages) -> None:
        system, run = _file_system(self.run)
        target = _file_system(self.path)[1]
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        model = self.options.get("model", "").encode()
        system.create_dir(run, recursive=True)
        with system.open_output_stream(f"{run}/whole") as out:
            out.write(VECTOR_MAGIC + struct.pack("<3I", VECTOR_VERSION, int(self.options["dim"]), len(model)) + model + struct.pack("<I", sum(m.rows for m in parts)))
            for m in parts:
                with system.open_input_stream(f"{run}/{m.name}") as part:
                    while chunk := part.read(_CHUNK):
                        out.write(chunk)
        system.move(f"{run}/whole", target)
        system.delete_dir(run)


class NoteWriter(_Staged):
    def write(self, iterator: Iterator) -> Part:
        number, name = self._place()
        system, run = _file_system(self.run)
        rows = 0
        system.create_dir(f"{run}/{name}", recursive=True)
        for batch in iterator:
            for note, text in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist(), strict=True):
                with system.open_output_stream(f"{run}/{name}/{note}.md") as out:
                    out.write((text or "").encode())
                rows += 1
        return Part(number, name, rows)

    def commit(self, messages) -> None:
        """One rename for each task, then one for the whole."""
        system, run = _file_system(self.run)
        target = _file_system(self.path)[1]
        system.create_dir(f"{run}/whole", recursive=True)
        for m in messages:
            if m is not None and m.rows:
                system.move(f"{run}/{m.name}", f"{run}/whole/{m.number:05d}")
        if system.get_file_info(target).type.name == "Directory":
            system.delete_dir(target)
        system.move(f"{run}/whole", target)
        system.delete_dir(run)


class VectorFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "graphloom_vectors"

    def writer(self, schema, overwrite: bool) -> VectorWriter:
        return VectorWriter(self.options)


class Notes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "graphloom_notes"

    def writer(self, schema, overwrite: bool) -> NoteWriter:
        return NoteWriter(self.options)


def _registered(spark: SparkSession, source) -> str:
    spark.dataSource.register(source)
    return source.name()


def write_vectors(store: DataFrame, path: str, model: str = "", dim: int | None = None) -> int:
    """One vector file at ``path`` from ``store`` (id, vec), in order of id's bytes; the file that ``sources.files.load_vectors``
    reads. Vectors of another length than ``dim`` (by default that of the smallest id), nulls and rows without id are left
    out; of equal ids one stays. The number of dimensions."""
    rows = store.select(F.col("id").cast("string").alias("id"), F.col("vec").cast("array<float>").alias("vec")).filter("id IS NOT NULL AND vec IS NOT NULL")
    if dim is None:
        first = rows.orderBy("id", "vec").select(F.size("vec").alias("n")).head()
        dim = first["n"] if first else 0
    fit = rows.filter((F.size("vec") == dim) & F.forall("vec", lambda x: x.isNotNull())).groupBy("id").agg(F.max("vec").alias("vec"))
    ordered = fit.repartitionByRange("id").sortWithinPartitions("id")
    ordered.write.format(_registered(store.sparkSession, VectorFile)).mode("append").option("model", model).option("dim", str(dim)).save(path)
    return dim


def write_notes(notes: DataFrame, path: str) -> None:
    """A Markdown file for each of ``notes`` (name, value) of ``sinks.export.obsidian``, in folders by task; names that links give
    are found in any folder. What was at ``path`` is replaced."""
    notes.select("name", "value").write.format(_registered(notes.sparkSession, Notes)).mode("append").save(path)


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of a folder of notes."""
    files = read_tree(spark, path).filter(F.col("path").endswith(".md"))
    return files.select(F.regexp_extract("path", r"([^/]*)\.md$", 1).alias("name"), F.col("content").cast("string").alias("value"))
