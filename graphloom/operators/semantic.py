"""Documents into the graph: baseline nodes, model answers, embeddings."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import base_name, make_id, snippet
from ..schema import CONFIDENCES

TEXT_LIMIT, CONTENT_LIMIT, BATCH = 60_000, 4_000, 32

_ANSWER = """
n array<struct<id:string,l:string,t:string,f:string>>, e array<struct<s:string,g:string,r:string,c:string,cs:double,f:string,w:double>>,
nodes array<struct<id:string,label:string,file_type:string,source_file:string>>,
edges array<struct<source:string,target:string,relation:string,confidence:string,confidence_score:double,source_file:string,weight:double>>
"""


def document_nodes(files: DataFrame) -> DataFrame:
    """A baseline node for each document or paper (path, file_type, text)."""
    stem = F.regexp_replace(base_name("path"), r"\.[^.]*$", "")
    return files.filter(F.col("file_type").isin("document", "paper")).select(make_id(stem, F.lit("doc")).alias("id"), base_name("path").alias("label"), "file_type", F.col("path").alias("source_file"), snippet(F.col("text"), CONTENT_LIMIT).alias("content"))


def node_directory(nodes: DataFrame) -> DataFrame:
    """One row, ``directory``: a line ``id: label [file]`` for each code node, in id order."""
    line = F.concat("id", F.lit(": "), F.coalesce("label", F.lit("")), F.lit(" ["), F.coalesce("source_file", F.lit("")), F.lit("]"))
    return nodes.filter("file_type = 'code'").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"]), "\n").alias("directory"))


def parse_answers(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of model answers (answer): thinking and fences are cut off, the short form
    (n, e) is taken where it has rows, else the long one, each for itself; invalid JSON gives nothing."""
    bare = F.trim(F.regexp_replace("answer", r"(?s)<think>.*?</think>", ""))
    bare = F.when(bare.startswith("```"), F.trim(F.regexp_replace(F.regexp_replace(bare, r"^```[^\n]*\n", ""), r"(?s)```[^`]*$", ""))).otherwise(bare)
    a = answers.select(F.from_json(bare, _ANSWER).alias("a")).filter("a is not null")
    short_n = F.transform("a.n", lambda x: F.struct(x["id"].alias("id"), x["l"].alias("label"), x["t"].alias("file_type"), x["f"].alias("source_file")))
    short_e = F.transform("a.e", lambda x: F.struct(x["s"].alias("source"), x["g"].alias("target"), x["r"].alias("relation"), x["c"].alias("confidence"), x["cs"].alias("confidence_score"), x["f"].alias("source_file"), x["w"].alias("weight")))
    pick = lambda s, c: F.when(F.size(F.col(f"a.{s}")) > 0, short_n if s == "n" else short_e).otherwise(F.col(f"a.{c}"))
    return a.select(F.inline(pick("n", "nodes"))), normalize_edges(a.select(F.inline(pick("e", "edges"))))


def normalize_edges(edges: DataFrame) -> DataFrame:
    """Unknown confidences become INFERRED, scores outside (0, 1] 0.8, weights not over 0 1."""
    score, weight = F.col("confidence_score"), F.col("weight")
    return edges.withColumns(
        {
            "confidence": F.when(F.col("confidence").isin(*CONFIDENCES), F.col("confidence")).otherwise("INFERRED"),
            "confidence_score": F.when((score > 0) & (score <= 1), score).otherwise(0.8),
            "weight": F.when(weight > 0, weight).otherwise(1.0),
        }
    )


def ask(files: DataFrame, client: Callable[[str, str], str]) -> DataFrame:
    """(path, answer): ``client(path, text)`` for each file's first 60,000 characters, called on the workers.
    A client that fails gives an empty answer for the file."""

    def rows(batches):
        for pdf in batches:
            out = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                try:
                    out.append((path, client(path, text)))
                except (OSError, ValueError):
                    out.append((path, ""))
            yield pd.DataFrame(out, columns=["path", "answer"])

    return files.select("path", F.substring("text", 1, TEXT_LIMIT).alias("text")).mapInPandas(rows, "path string, answer string")


def embed(rows: DataFrame, client: Callable[[list[str]], list[list[float]]], text: str = "text") -> DataFrame:
    """``rows`` with ``vec``: vectors of non-blank texts, asked for in batches of 32; vectors whose length
    differs from the commonest are dropped with their rows, as are blank texts."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(texts: pd.Series) -> pd.Series:
        out: list = [None] * len(texts)
        some = [i for i, t in enumerate(texts) if t and t.strip()]
        for k in range(0, len(some), BATCH):
            part = some[k : k + BATCH]
            for i, v in zip(part, client([texts.iloc[i] for i in part]), strict=True):
                out[i] = v
        return pd.Series(out, dtype=object)

    made = rows.withColumn("vec", vectors(F.col(text))).filter("vec is not null AND size(vec) > 0")
    common = made.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1)
    return made.join(F.broadcast(common), F.size("vec") == F.col("d"), "left_semi")
