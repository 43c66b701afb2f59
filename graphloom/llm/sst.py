"""Sorted-string-table shards of token ids.

A shard is one file: data blocks, a Bloom filter, a sparse block index and a footer, every
part ended by one newline byte, since Spark's text writer puts the parts down (so that any
file system Spark writes to will do, and its commit protocol keeps only whole files of
tasks that succeeded).

* block: entries in key order; each is ``shared prefix, rest of key, value length`` as
  varints, then the rest of the key and the value. The first entry of a block shares nothing.
* filter: ``n_hashes u32`` and the bits.
* index: for each block its offset, length, number of entries and ids (u64 each) and last key.
* footer: 8 u64 (filter offset and length, index offset and length, entries, ids, id width,
  blocks) and 8 magic bytes of which the last is the newline.

Values are ids as little-endian unsigned integers of 2 bytes if the vocabulary fits, else 4.
Keys are order-preserving bytes of a long or a string; null comes before every other key.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import encoder

MAGIC = b"GLSST01\n"
BLOCK_BYTES = 32 * 1024
BITS_A_KEY, HASHES = 10, 7
_FOOTER = struct.Struct("<8Q")
_ENTRY = struct.Struct("<4QI")


def key_bytes(key: int | str | None) -> bytes:
    if key is None:
        return b"\x00"
    if isinstance(key, str):
        return b"\x02" + key.encode()
    return b"\x01" + ((key + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def key_value(raw: bytes) -> int | str | None:
    if raw[:1] == b"\x00":
        return None
    return raw[1:].decode() if raw[:1] == b"\x02" else int.from_bytes(raw[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _probes(key: bytes, bits: int, hashes: int) -> Iterator[int]:
    d = hashlib.blake2b(key, digest_size=16).digest()
    a, b = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little") | 1
    return ((a + i * b) % bits for i in range(hashes))


class ShardWriter:
    """Takes entries in key order and gives the parts of the file one by one; holds a block,
    the index and the keys' hashes, never the whole shard."""

    def __init__(self, width: int):
        self.width, self.at, self.entries, self.ids = width, 0, 0, 0
        self.block, self.n, self.n_ids, self.last = bytearray(), 0, 0, b""
        self.index, self.keys = [], []

    def add(self, key: bytes, value: bytes) -> bytes | None:
        shared = _shared(self.last, key) if self.block else 0
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.n, self.n_ids, self.last = self.n + 1, self.n_ids + len(value) // self.width, key
        self.keys.append(key)
        return self._close() if len(self.block) >= BLOCK_BYTES else None

    def _part(self, data: bytes) -> bytes:
        self.at += len(data) + 1
        return data

    def _close(self) -> bytes:
        self.index.append(_ENTRY.pack(self.at, len(self.block), self.n, self.n_ids, len(self.last)) + self.last)
        self.entries, self.ids = self.entries + self.n, self.ids + self.n_ids
        data, self.block, self.n, self.n_ids = bytes(self.block), bytearray(), 0, 0
        return self._part(data)

    def finish(self) -> Iterator[bytes]:
        if self.block:
            yield self._close()
        bits = max(64, len(self.keys) * BITS_A_KEY)
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _probes(key, bits, HASHES):
                bloom[p >> 3] |= 1 << (p & 7)
        where = [self.at, len(bloom) + 12]
        yield self._part(struct.pack("<IQ", HASHES, bits) + bytes(bloom))
        index = b"".join(self.index)
        where += [self.at, len(index)]
        yield self._part(index)
        yield self._part(_FOOTER.pack(*where, self.entries, self.ids, self.width, len(self.index)) + MAGIC[:-1])


class Block(NamedTuple):
    offset: int
    length: int
    entries: int
    ids: int
    last: bytes


class Shard:
    """Reads one shard from its bytes."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        self.blocks: list[Block] = []
        self.entries = self.ids = 0
        if not data:
            return
        if bytes(data[-8:]) != MAGIC:
            raise ValueError("not a shard, or one cut short")
        f, _, i, n, self.entries, self.ids, self.width, blocks = _FOOTER.unpack_from(data, len(data) - 8 - _FOOTER.size)
        self.hashes, self.bits = struct.unpack_from("<IQ", data, f)
        self.bloom, at = self.data[f + 12 :], i
        for _ in range(blocks):
            *head, size = _ENTRY.unpack_from(data, at)
            at += _ENTRY.size
            self.blocks.append(Block(*head, bytes(data[at : at + size])))
            at += size

    def scan(self, block: Block) -> Iterator[tuple[bytes, memoryview]]:
        at, end, last = block.offset, block.offset + block.length, b""
        while at < end:
            shared, at = _read_varint(self.data, at)
            rest, at = _read_varint(self.data, at)
            size, at = _read_varint(self.data, at)
            last = last[:shared] + bytes(self.data[at : at + rest])
            at += rest
            yield last, self.data[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, memoryview]]:
        for block in self.blocks:
            yield from self.scan(block)

    def may_hold(self, key: bytes) -> bool:
        return bool(self.blocks) and all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits, self.hashes))

    def get(self, key: bytes) -> list[bytes]:
        """Values of every entry with this key: filter, binary search in the index, one or few blocks."""
        if not self.may_hold(key):
            return []
        lo, hi = 0, len(self.blocks)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.blocks[mid].last < key else (lo, mid)
        found = []
        for block in self.blocks[lo:]:
            for k, v in self.scan(block):
                if k == key:
                    found.append(bytes(v))
                elif k > key:
                    return found
        return found


def unpack(value: bytes | memoryview, width: int) -> bytes:
    """The ids as little-endian unsigned 32-bit bytes."""
    import numpy as np

    return np.frombuffer(value, dtype=f"<u{width}").astype("<u4").tobytes()


def write_shards(docs: DataFrame, key: str, text: str, path: str, tokenizer: str, shard_bytes: int = 16 << 20) -> None:
    """Encode every text and write the shards under ``path``, in ascending key order by file name.

    A null text counts as empty and has the end id alone; a null key sorts first; rows with
    equal keys all stay, in order of their texts; an empty table gives files without entries.
    Shards hold about ``shard_bytes`` of text: ranges of (key, hash of text), so that one key
    with many rows spreads too. Only ``key`` and ``text`` are read, whatever other columns there are.
    """
    import pyarrow as pa

    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t") + F.lit(64))).first()[0] or 0
    n = max(1, -(-total // shard_bytes))

    def parts(batches):
        enc = encoder(tokenizer)
        width = 2 if enc.vocab_size <= 1 << 16 else 4
        writer = ShardWriter(width)
        for b in batches:
            keys = iter(b.column(0).to_pylist())
            for ids, bounds in enc.encode(b.column(1)):
                data, bounds = ids.astype(f"<u{width}").tobytes(), (width * bounds).tolist()
                out = [part for lo, hi in zip(bounds[:-1], bounds[1:], strict=True) if (part := writer.add(key_bytes(next(keys)), data[lo:hi]))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["part"])
        yield pa.RecordBatch.from_arrays([pa.array(list(writer.finish()), pa.binary())], ["part"])

    ranged = rows.repartitionByRange(n, "k", F.xxhash64("t")).sortWithinPartitions("k", "t")
    ranged.mapInArrow(parts, "part binary").select(F.col("part").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.regexp_extract(name, r"^part-(\d+)", 1).cast("int").alias("shard"), "content")


def read_shards(spark: SparkSession, path: str, key_type: str = "long") -> DataFrame:
    """One row for each entry: shard, row (within the shard), key, ids (array), first (ids of the shard before it)."""
    def entries(batches):
        import numpy as np

        for b in batches:
            for shard, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s, before, rows = Shard(content.as_buffer().to_pybytes()), 0, []
                for i, (k, v) in enumerate(s):
                    ids = np.frombuffer(v, f"<u{s.width}")
                    rows.append((shard, i, key_value(k), ids.tolist(), before))
                    before += len(ids)
                    if len(rows) == 1000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    import pyarrow as pa

    kind = pa.string() if key_type == "string" else pa.int64()
    types = [pa.int32(), pa.int64(), kind, pa.list_(pa.int64()), pa.int64()]

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["shard", "row", "key", "ids", "first"])

    return _files(spark, path).mapInArrow(entries, f"shard int, row long, key {key_type}, ids array<long>, first long")


def read_digests(spark: SparkSession, path: str, key_type: str = "long") -> DataFrame:
    """As read_shards, with the number and CRC-32 of the ids in place of them, and ``start``,
    the ids of all entries before it in key order."""
    import pyarrow as pa

    kind = pa.string() if key_type == "string" else pa.int64()
    types = [pa.int32(), pa.int64(), kind, pa.int64(), pa.int64(), pa.int64()]

    def digests(batches):
        for b in batches:
            for shard, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s, before, rows = Shard(content.as_buffer().to_pybytes()), 0, []
                for i, (k, v) in enumerate(s):
                    n = len(v) // s.width
                    rows.append((shard, i, key_value(k), n, zlib.crc32(unpack(v, s.width)), before))
                    before += n
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["shard", "row", "key", "n_tokens", "ids_crc32", "first"])

    found = materialize(_files(spark, path).mapInArrow(digests, f"shard int, row long, key {key_type}, n_tokens long, ids_crc32 long, first long"), "sst-digests")
    # one row for each shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = found.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return found.join(starts, "shard").withColumn("start", F.col("before") + F.col("first")).drop("before", "first")


def lookup(spark: SparkSession, path: str, keys: list[int | str | None]) -> DataFrame:
    """Rows (position of the key in ``keys``, shard, ids) for a short list of keys, found by
    each shard's filter and index without reading its other blocks."""
    import pyarrow as pa

    wanted = [key_bytes(k) for k in keys]

    def find(batches):
        import numpy as np

        for b in batches:
            for shard, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = Shard(content.as_buffer().to_pybytes())
                rows = [(i, shard, np.frombuffer(v, f"<u{s.width}").tolist()) for i, k in enumerate(wanted) for v in s.get(k)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.int32(), pa.list_(pa.int64())], strict=True)], ["wanted", "shard", "ids"])

    return _files(spark, path).mapInArrow(find, "wanted int, shard int, ids array<long>")
