"""Archives as a scan: a partition for each range of members, read by executors from where the archive lies."""

from __future__ import annotations

import posixpath
import tarfile
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .detect import _file_system

#: Bytes of members in a partition.
PARTITION_BYTES = 16 << 20


class Members(InputPartition):
    def __init__(self, first: int, last: int, top: str):
        self.first, self.last, self.top = first, last, top


def _checked(name: str) -> str:
    """A member's path within the archive; one that would leave it is an error."""
    clean = posixpath.normpath(name.replace("\\", "/"))
    if clean.startswith(("/", "../")) or clean == ".." or (len(clean) > 1 and clean[1] == ":"):
        raise ValueError(f"entry leaves the archive: {name}")
    return clean


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("partition_bytes", PARTITION_BYTES))

    def _open(self):
        system, path = _file_system(self.path)
        return system.open_input_file(path)

    def _is_zip(self) -> bool:
        return self.path.lower().endswith(".zip")

    def _listed(self) -> list[tuple[str, int]]:
        """Names and sizes of all files, in order. A zip's directory is read from its end; a tar is passed over once."""
        with self._open() as f:
            if self._is_zip():
                with zipfile.ZipFile(f) as z:
                    return [(_checked(i.filename), i.file_size) for i in z.infolist() if not i.is_dir()]
            with tarfile.open(fileobj=f) as t:
                return [(_checked(m.name), m.size) for m in t if m.isfile()]

    def partitions(self) -> list[Members]:
        members = self._listed()
        tops = {name.split("/")[0] if "/" in name else "" for name, _ in members}
        top = next(iter(tops)) if len(tops) == 1 and "" not in tops else ""
        # a compressed tar can't be entered in the middle, so it is one partition
        if not self._is_zip() and not self.path.lower().endswith(".tar"):
            return [Members(0, len(members), top)]
        cuts, total = [0], 0
        for k, (_, size) in enumerate(members):
            if total and total + size > self.size:
                cuts.append(k)
                total = 0
            total += size
        return [Members(a, b, top) for a, b in zip(cuts, [*cuts[1:], len(members)], strict=True) if a < b]

    def read(self, partition: Members) -> Iterator[tuple]:
        within = lambda name: name[len(partition.top) + 1 :] if partition.top else name
        with self._open() as f:
            if self._is_zip():
                with zipfile.ZipFile(f) as z:
                    for i in [i for i in z.infolist() if not i.is_dir()][partition.first : partition.last]:
                        yield within(_checked(i.filename)), z.read(i), i.file_size
                return
            with tarfile.open(fileobj=f) as t:
                k = 0
                for m in t:
                    if not m.isfile():
                        continue
                    if partition.first <= k < partition.last:
                        yield within(_checked(m.name)), t.extractfile(m).read(), m.size
                    k += 1
                    if k >= partition.last:
                        return


class Archive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "graphloom_archive"

    def schema(self) -> str:
        return "path string, content binary, length long"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archive(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(path, content, length, text) of the files of a .zip, .tar or compressed tar: what ``detect.read_tree`` gives of a tree. A
    single top folder is entered; links are left out, and an entry that would leave the archive is an error.
    ``text`` is null where bytes aren't UTF-8."""
    spark.dataSource.register(Archive)
    files = spark.read.format(Archive.name()).option("partition_bytes", str(partition_bytes)).load(path)
    text = F.col("content").cast("string")
    return files.withColumn("text", F.when(F.is_valid_utf8(text), text))
