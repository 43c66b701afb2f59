"""Graph files, vector files, office documents, archives."""

from __future__ import annotations

import hashlib
import io
import os
import re
import struct
import tarfile
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import PropertyGraph, overwrite_edges, upsert_nodes, with_columns_of
from ..schema import EDGE, NODE

_GRAPH = T.StructType(
    [
        T.StructField("directed", T.BooleanType()),
        T.StructField("graph", T.MapType(T.StringType(), T.StringType())),
        T.StructField("nodes", T.ArrayType(NODE)),
        T.StructField("links", T.ArrayType(T.StructType([*EDGE.fields, T.StructField("_src", T.StringType()), T.StructField("_tgt", T.StringType())]))),
    ]
)


def load_node_link(spark: SparkSession, path: str) -> PropertyGraph:
    """From one node-link document; nodes without id and links without an endpoint are left out.
    Of nodes that repeat each attribute's last value counts, and endpoints that are no nodes become
    nodes without attributes. ``_src`` and ``_tgt`` give an edge's direction where present."""
    document = spark.read.schema(_GRAPH).json(path, multiLine=True)
    nodes = upsert_nodes(document.select(F.posexplode("nodes").alias("ord", "n")).select("ord", "n.*"))
    links = document.select(F.posexplode("links").alias("ord", "l")).select("ord", "l.*").filter("source is not null AND target is not null")
    links = links.withColumns({"source": F.coalesce("_src", "source"), "target": F.coalesce("_tgt", "target")}).drop("_src", "_tgt")
    directed = bool(document.select(F.coalesce("directed", F.lit(False))).head()[0])
    ends = links.select(F.explode(F.array("source", "target")).alias("id")).distinct().join(nodes, "id", "left_anti")
    return PropertyGraph(nodes.unionByName(with_columns_of(ends, nodes.schema)), overwrite_edges(links, directed=directed), directed)


def load_node_link_folders(spark: SparkSession, path: str, directed: bool = False) -> PropertyGraph:
    """What sinks.export.write_node_link wrote, in any number of parts."""
    links = spark.read.schema(EDGE).json(f"{path}/links")
    return PropertyGraph(spark.read.schema(NODE).json(f"{path}/nodes"), overwrite_edges(links.withColumn("ord", F.struct("source", "target")), directed=directed), directed)


# The vector file begins with these four bytes and this version.
VECTOR_MAGIC, VECTOR_VERSION = b"GFYE", 1


def parse_vectors(data: bytes) -> list[tuple[str, str, list[float]]]:
    """(model, id, vector) of a vector file: little-endian version, dimension and model length; the model; the
    count; then for each vector the length of its id, the id, and 32-bit floats."""
    if data[:4] != VECTOR_MAGIC:
        raise ValueError("not a vector file")
    _, dim, n_model = struct.unpack_from("<3I", data, 4)
    at = 20 + n_model
    model, out = data[16 : at - 4].decode(), []
    (count,) = struct.unpack_from("<I", data, at - 4)
    for _ in range(count):
        (n,) = struct.unpack_from("<I", data, at)
        name = data[at + 4 : at + 4 + n].decode()
        at += 4 + n
        out.append((model, name, list(struct.unpack_from(f"<{dim}f", data, at))))
        at += 4 * dim
    return out


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(model, id, vec) of one or many vector files, each read in a task."""

    def rows(batches):
        for pdf in batches:
            for data in pdf["content"]:
                yield pd.DataFrame(parse_vectors(bytes(data)), columns=["model", "id", "vec"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "model string, id string, vec array<float>")


def _zip_xml(data: bytes, pattern: str) -> list[tuple[str, ElementTree.Element]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [(n, ElementTree.fromstring(z.read(n))) for n in sorted(z.namelist(), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]) if re.fullmatch(pattern, n)]


def _tag(e) -> str:
    return e.tag.rpartition("}")[2]


def docx_text(data: bytes) -> str:
    """Paragraphs as lines; headings as markdown."""
    lines = []
    for _, root in _zip_xml(data, r"word/document\.xml"):
        for para in (e for e in root.iter() if _tag(e) == "p"):
            text = "".join(e.text or "" for e in para.iter() if _tag(e) == "t")
            style = next((v for e in para.iter() if _tag(e) == "pStyle" for k, v in e.attrib.items() if k.endswith("val")), "")
            level = re.fullmatch(r"[Hh]eading\s*(\d)", style)
            lines.append(f"{'#' * int(level[1])} {text}" if level and text else text)
    return "\n".join(x for x in lines if x)


def xlsx_text(data: bytes) -> str:
    """A markdown table for each sheet; short rows are padded."""
    shared = [("".join(t.text or "" for t in si.iter() if _tag(t) == "t")) for _, root in _zip_xml(data, r"xl/sharedStrings\.xml") for si in root if _tag(si) == "si"]
    out = []
    for name, root in _zip_xml(data, r"xl/worksheets/[^/]+\.xml"):
        rows = []
        for row in (e for e in root.iter() if _tag(e) == "row"):
            cells = []
            for c in (e for e in row if _tag(e) == "c"):
                value = "".join(v.text or "" for v in c.iter() if _tag(v) in ("v", "t"))
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
            rows.append(cells)
        if rows:
            width = max(map(len, rows))
            table = [f"| {' | '.join(r + [''] * (width - len(r)))} |" for r in rows]
            out.append("\n".join([f"## {os.path.splitext(os.path.basename(name))[0]}", table[0], "|" + " --- |" * width, *table[1:]]))
    return "\n\n".join(out)


@F.pandas_udf(T.StringType())
def office_text(path: pd.Series, content: pd.Series) -> pd.Series:
    """Text of .docx and .xlsx files; null for others and for broken ones. PDF needs a library that
    isn't there, so its text is null too."""

    def one(p, data):
        read = {".docx": docx_text, ".xlsx": xlsx_text}.get(os.path.splitext(p)[1].lower())
        try:
            return read(bytes(data)) if read and data is not None else None
        except (zipfile.BadZipFile, ElementTree.ParseError, IndexError, ValueError, KeyError):
            return None

    return pd.Series([one(p, d) for p, d in zip(path, content, strict=True)], dtype=object)


def readable(files: DataFrame) -> DataFrame:
    """``files`` (path, content, text) with the text of office documents filled in."""
    office = F.lower("path").rlike(r"\.(docx|xlsx)$")
    return files.withColumn("text", F.when(office, office_text("path", F.when(office, F.col("content")))).otherwise(F.col("text")))


def is_archive(name: str) -> bool:
    return name.lower().endswith((".zip", ".tar", ".tar.gz", ".tgz"))


def is_git_url(text: str) -> bool:
    return bool(re.match(r"(git@|ssh://|git://)", text) or (re.match(r"https?://", text) and (text.rstrip("/").endswith(".git") or re.match(r"https?://(github|gitlab|bitbucket)\.", text))))


def is_hex_hash(text: str) -> bool:
    return bool(re.fullmatch(r"[0-9a-fA-F]{7,40}", text))


def unpack_archive(path: str, cache: str) -> str:
    """The folder, under ``cache`` by content hash, that holds the archive's files; a single top
    folder is entered. Entries that would leave it are refused."""
    with open(path, "rb") as f:
        folder = os.path.join(cache, hashlib.sha256(f.read()).hexdigest()[:16])
    if not os.path.isdir(folder):
        part = folder + ".part"
        os.makedirs(part, exist_ok=True)
        root = os.path.realpath(part)
        if path.lower().endswith(".zip"):
            with zipfile.ZipFile(path) as z:
                for name in z.namelist():
                    if not os.path.realpath(os.path.join(root, name)).startswith(root + os.sep):
                        raise ValueError(f"entry leaves the archive: {name}")
                z.extractall(part)
        else:
            with tarfile.open(path) as t:
                t.extractall(part, filter="data")
        os.rename(part, folder)
    inside = os.listdir(folder)
    return os.path.join(folder, inside[0]) if len(inside) == 1 and os.path.isdir(os.path.join(folder, inside[0])) else folder


def pick_model(models: DataFrame, preferred: list[str], largest: float = 14.0) -> DataFrame:
    """One row of ``models`` (name): the first preferred one, else the largest by the billions in its
    name that isn't over ``largest``; ties by name."""
    size = F.regexp_extract(F.lower("name"), r"(\d+(?:\.\d+)?)\s*b\b", 1)
    sized = models.withColumn("size", F.when(size != "", size.cast("double")).otherwise(0.0))
    rank = F.lit(len(preferred))
    for i, p in reversed(list(enumerate(preferred))):
        rank = F.when(F.col("name").startswith(p), i).otherwise(rank)
    usable = sized.withColumn("rank", rank).filter((F.col("rank") < len(preferred)) | (F.col("size") <= largest))
    return usable.orderBy("rank", F.desc("size"), "name").limit(1).select("name", "size")
