"""Harmonic packing of token sequences.

A piece of ``length`` ids belongs to class ``capacity // length``: that many such pieces fit
in a bin, so every bin of a class holds that fixed number and bins fill independently on all
workers. Documents are cut into whole capacities and powers of two down to ``SMALL``, which
fill their bins without a gap; the rest of a document, under ``SMALL`` ids, leaves a gap of at
most its own length in a bin of many.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import encoder

CAPACITY, SMALL = 4096, 64


def cut_lengths(n: int, capacity: int = CAPACITY, small: int = SMALL) -> list[int]:
    """Lengths of the pieces of a document with ``n`` ids, in order."""
    whole, rest = divmod(n, capacity)
    out, power = [capacity] * whole, capacity // 2
    while power >= small:
        if rest >= power:
            out.append(power)
            rest -= power
        power //= 2
    return out + [rest] * (rest > 0)


def pieces(docs: DataFrame, doc_id: str, text: str, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces with the class of each and its number within (task, class)."""
    import pyarrow as pa

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "part", "number"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]

    def cut(batches):
        from pyspark import TaskContext

        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        taken: dict[int, int] = {}
        for b in batches:
            docs_left = iter(b.column(0).to_pylist())
            for ids, bounds in enc.encode(b.column(1)):
                rows, data = [], memoryview(ids.astype("<u4").view(np.uint8))
                for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    doc, at = next(docs_left), lo
                    for length in cut_lengths(hi - lo, capacity):
                        kind = capacity // length
                        number = taken.get(kind, 0)
                        taken[kind] = number + 1
                        rows.append((doc, at - lo, length, zlib.crc32(data[4 * at : 4 * (at + length)]), hi - lo, kind, part, number))
                        at += length
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, part int, number long")


def _first_fit(capacity: int):
    """Packs the pieces that don't fill a bin of their class, longest first."""

    def pack(pdf):
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        room, low, bins, offsets = [], 0, [], []
        for n in pdf["length"].astype(int):
            k = next((k for k in range(low, len(room)) if room[k] >= n), len(room))
            if k == len(room):
                room.append(capacity)
            bins.append(k)
            offsets.append(capacity - room[k])
            room[k] -= n
            while low < len(room) and room[low] == 0:
                low += 1
        pdf["bin"], pdf["offset"] = bins, offsets
        return pdf

    return pack


def harmonic_pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text counts as empty: the end id alone. Documents may be cut at any id; every id lies
    in one piece. Rows that repeat are packed each for itself; null ids are kept. An empty
    table gives no rows. Classes number their pieces across tasks by adding, for each task,
    the counts of the tasks before; bins that stay short (fewer pieces than the class wants,
    under ``capacity`` of them in each of at most ``SMALL + 6`` classes, whatever the input)
    are packed together by first fit.
    """
    cut = materialize(pieces(docs, doc_id, text, tokenizer, capacity), "pieces")
    counts = cut.groupBy("part", "class").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # one row for each class, of which there are no more than SMALL + log2(capacity)
    classes = cut.groupBy("class").agg(F.floor(F.count(F.lit(1)) / F.col("class")).alias("full"))
    first = Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    bases = classes.select("class", "full", F.coalesce(F.sum("full").over(first), F.lit(0)).alias("base"))
    numbered = (
        cut.join(starts, ["part", "class"])
        .join(F.broadcast(bases), "class")
        .withColumn("_n", F.col("before") + F.col("number"))
        .withColumn("_bin", F.floor(F.col("_n") / F.col("class")))
    )
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    in_bin = Window.partitionBy("sequence_id").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    full = numbered.filter("_bin < full").withColumn("sequence_id", F.col("base") + F.col("_bin")).select(*keep, "sequence_id", F.coalesce(F.sum("length").over(in_bin), F.lit(0)).alias("offset"))
    short = numbered.filter("_bin >= full").select(*keep)
    packed = short.groupBy(F.lit(0).alias("_one")).applyInPandas(lambda pdf: _first_fit(capacity)(pdf[keep]), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin long, offset long")
    total = classes.agg(F.coalesce(F.sum("full"), F.lit(0)).alias("_bins"))
    rest = packed.crossJoin(F.broadcast(total)).select(*keep, (F.col("_bins") + F.col("bin")).alias("sequence_id"), "offset")
    return full.unionByName(rest)
