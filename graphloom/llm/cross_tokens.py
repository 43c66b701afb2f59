"""Alignment of two tokenizers: which of their tokens cover the same bytes, corpus-wide.

A text is encoded by both. The cumulative ends of its tokens on either side are
merged like two sorted lists; where both end, a group ends, and all pairs of an A token and a B token of a group are links. Tasks emit, for
slices of documents, each document's groups and links and the slice's different id pairs with the
number of documents that hold them. Spark adds the pairs' counts up, takes the largest of each
A id and each B id, and joins both back to the slices. A pair comes from a slice once, however
often it occurs there, so no pair has more rows than there are slices.

Both tokenizers cut before a space that follows a visible character, so texts are encoded as
their different units between such cuts, each once in a worker; ``Tokenizers`` checks that the
files in use have that property, and otherwise takes every text for a unit.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Bytes of text in a slice, and units kept between slices, in each Python worker.
SLICE_BYTES, CACHE_UNITS = 2 << 20, 1 << 18
#: Links of a group above which its different ids are counted first.
WIDE = 1024

#: Printable bytes stand for themselves in the alphabet of byte-level models, others for code points from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
BYTE_OF = {chr(b): b for b in _SHOWN} | {chr(256 + k): b for k, b in enumerate(_HIDDEN)}

#: The one pre-tokenizer whose cuts are known here.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def merge_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many A tokens and B tokens lie up to the end of each group: the two rising lists are merged, and a group
    ends where both hold the same value."""
    at = np.searchsorted(b_ends, a_ends)
    both = np.flatnonzero(b_ends[np.minimum(at, len(b_ends) - 1)] == a_ends) if len(b_ends) else np.zeros(0, np.int64)
    return both + 1, at[both] + 1


def linked(a: np.ndarray, b: np.ndarray, a_to: np.ndarray, b_to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each group as (group, code of the id pair, number). A pair may come more than once, unless its group
    is wide: there, different ids are counted first, so that a long stretch without a common end stays small."""
    a_from, b_from = np.concatenate([[0], a_to[:-1]]), np.concatenate([[0], b_to[:-1]])
    n, m = a_to - a_from, b_to - b_from
    group = np.flatnonzero(n * m <= WIDE)
    each = (n * m)[group]
    within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    group = np.repeat(group, each)
    row, col = np.divmod(within, m[group])
    out = [(group, a[a_from[group] + row] << 32 | b[b_from[group] + col], np.ones(len(group), np.int64))]
    for g in np.flatnonzero(n * m > WIDE):
        x, k = np.unique(a[a_from[g] : a_to[g]], return_counts=True)
        y, l = np.unique(b[b_from[g] : b_to[g]], return_counts=True)
        out.append((np.full(len(x) * len(y), g), (x[:, None] << 32 | y).ravel(), (k[:, None] * l).ravel()))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def spelt_out(a: np.ndarray, b: np.ndarray, a_to: np.ndarray, b_to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2;`` of all groups as bytes, and where each group ends in them."""
    size = len(a) + len(b)
    a_group, b_group = np.searchsorted(a_to, np.arange(len(a)), "right"), np.searchsorted(b_to, np.arange(len(b)), "right")
    ids, mark = np.empty(size, np.int64), np.full(size, ord(","), np.uint8)
    a_at = np.arange(len(a)) + np.concatenate([[0], b_to])[a_group]
    b_at = np.arange(len(b)) + a_to[b_group]
    ids[a_at], ids[b_at] = a, b
    mark[a_at[a_to - 1]], mark[b_at[b_to - 1]] = ord("|"), ord(";")
    known = np.array([str(k) for k in range(ids.max(initial=-1) + 1)], "S")
    width = known.itemsize + 1
    digits = np.char.str_len(known)[ids]
    wide = np.zeros((size, width), np.uint8)
    wide[:, :-1] = known.view(np.uint8).reshape(-1, width - 1)[ids] if size else 0
    wide[np.arange(size), digits] = mark
    ends = np.cumsum(digits + 1)
    return wide[wide > 0], ends[b_at[b_to - 1]] if size else np.zeros(0, np.int64)


class Pieces:
    """The bytes of a vocabulary's tokens in a row."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.array([len(x) for x in pieces], np.int64)
        self.at, self.data = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(pieces), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.data[np.repeat(self.at[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class Tokenizers:
    """A byte-level tokenizer (A) and a SentencePiece model (B) with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings are plain text
        with open(path_a, encoding="utf-8") as f:
            parts = json.load(f)
        a_piece = [b""] * (1 + max(self.a.get_vocab().values()))
        for piece, k in self.a.get_vocab().items():
            if all(c in BYTE_OF for c in piece):
                a_piece[k] = bytes(BYTE_OF[c] for c in piece)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        b_piece = [b"" if self.b.IsControl(k) else bytes([int(p[3:5], 16)]) if self.b.IsByte(k) else p.replace("▁", " ").encode() for k in range(self.b.GetPieceSize()) for p in [self.b.IdToPiece(k)]]
        with open(path_b, "rb") as f:
            spec = model.ModelProto.FromString(f.read())
        normal = spec.normalizer_spec
        self.by_unit = (
            parts["normalizer"] is None
            and parts["pre_tokenizer"] == BYTE_LEVEL
            and not any(parts[k] for k in ("post_processor", "truncation", "padding"))
            and all(t["special"] and not t["lstrip"] and not t["rstrip"] for t in parts["added_tokens"])
            and not (parts["model"].get("dropout") or parts["model"].get("unk_token"))
            and not normal.precompiled_charsmap
            and (normal.add_dummy_prefix, normal.remove_extra_whitespaces, normal.escape_whitespaces) == (True, False, True)
            and (spec.trainer_spec.model_type, spec.trainer_spec.treat_whitespace_as_suffix) == (model.TrainerSpec.BPE, False)
            and not any(p.type == model.ModelProto.SentencePiece.USER_DEFINED or "▁" in p.piece.lstrip("▁") for p in spec.pieces)
        )
        self.pieces = [Pieces(a_piece), Pieces(b_piece)]
        self.forget()

    def forget(self) -> None:
        self.units: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.sizes = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.fits = np.zeros(0, bool)

    def encode(self, spaced: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of stretches that begin with a space each, on either side: all in a row, and how many each has; and
        whether both sides' tokens spell the stretch."""
        a = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        b = self.b.encode([s[1:] for s in spaced], num_threads=1)
        raw = [s.encode() for s in spaced]
        data, length = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
        rows, sizes, fits = [], [], np.ones(len(spaced), bool)
        for ids, pieces in zip((a, b), self.pieces, strict=True):
            sizes.append(np.array([len(x) for x in ids], np.int64))
            rows.append(np.fromiter(chain.from_iterable(ids), np.int64, sizes[-1].sum()))
            owner = np.repeat(np.arange(len(spaced)), sizes[-1])
            same = np.bincount(owner, pieces.size[rows[-1]], len(spaced)) == length
            spelt = pieces.spell(rows[-1][same[owner]])
            differ = spelt != data[np.repeat(same, length)]
            fits &= same
            fits[np.repeat(np.flatnonzero(same), length[same])[differ]] = False
        return rows, sizes, fits

    def learn(self, spaced: list[str]) -> np.ndarray:
        """The number of each stretch among those known; new ones are encoded."""
        new = [s for s in spaced if s not in self.units]
        if new:
            self.units.update(zip(new, range(len(self.units), len(self.units) + len(new)), strict=True))
            rows, sizes, fits = self.encode(new)
            self.ids = [np.concatenate(x) for x in zip(self.ids, rows, strict=True)]
            self.sizes = [np.concatenate(x) for x in zip(self.sizes, sizes, strict=True)]
            self.fits = np.concatenate([self.fits, fits])
        return np.array([self.units[s] for s in spaced], np.int64)


@functools.lru_cache(maxsize=1)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """One for each Python worker."""
    return Tokenizers(path_a, path_b)


def _cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of spaces, not last in their text, that follow a printable ASCII character or a letter of two bytes
    from U+00C0 on (no white space among these)."""
    space = np.flatnonzero(data == 32)
    space = space[(space > 1) & ~np.isin(space, ends - 1)]
    last, before = data[space - 1], data[space - 2]
    return space[((last > 32) & (last < 127)) | ((last > 127) & (before > 0xC2) & (before < 0xE0))]


def slices(doc_ids, texts, toks: Tokenizers) -> Iterator[tuple]:
    """For slices of documents (Arrow arrays): doc ids; per document n_a, n_b, n_groups, n_links and the groups'
    digest; which of the slice's pairs each document holds (bounds, pair numbers, number of links); the slice's
    different pairs and the number of its documents that hold each."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = min(len(texts), max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_BYTES))))
        yield _slice(doc_ids.slice(lo, hi - lo), texts.slice(lo, hi - lo), toks)
        lo = hi


def _slice(doc_ids, texts, toks: Tokenizers) -> tuple:
    import pyarrow as pa
    import pyarrow.compute as pc

    n = len(texts)
    spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
    at = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + n + 1]
    data = np.frombuffer(spaced.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    begins = np.zeros(len(data), bool)
    begins[at[:-1]] = True
    if toks.by_unit:
        begins[_cuts(data, at[1:])] = True
    starts = np.flatnonzero(begins)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
    if len(toks.units) > CACHE_UNITS or not toks.by_unit:
        toks.forget()
    units = toks.learn(words.dictionary.to_pylist())[words.indices.to_numpy()]
    first = np.searchsorted(starts, at)
    doc = np.repeat(np.arange(n), np.diff(first))
    # if the tokens of a unit don't give its bytes back, neither do those of the document
    live = pc.binary_length(texts).to_numpy() > 0
    live[doc[~toks.fits[units]]] = False
    units = units[live[doc]]
    doc = doc[live[doc]]
    sides, owners = [], []
    for ids, sizes in zip(toks.ids, toks.sizes, strict=True):
        size = sizes[units]
        place = np.cumsum(sizes) - sizes
        sides.append(ids[np.repeat(place[units] - (np.cumsum(size) - size), size) + np.arange(size.sum())])
        owners.append(np.bincount(doc, size, n).astype(np.int64))
    a, b = sides
    a_to, b_to = merge_ends(*(np.cumsum(p.size[ids]) for p, ids in zip(toks.pieces, sides, strict=True)))
    group_doc = np.repeat(np.arange(n), owners[0])[a_to - 1]
    groups = np.bincount(group_doc, minlength=n)
    said, ends = spelt_out(a, b, a_to, b_to)
    to = np.concatenate([[0], ends])[np.cumsum(groups)]
    sha = [hashlib.sha256(said[x : y - 1]).hexdigest() if x < y else "" for x, y in zip([0, *to], to, strict=False)]
    group, code, number = linked(a, b, a_to, b_to)
    codes, code = np.unique(code, return_inverse=True)
    pair, back = np.unique(group_doc[group] * max(1, len(codes)) + code, return_inverse=True)
    links = np.bincount(back, number, len(pair)).astype(np.int64)
    doc, pair = np.divmod(pair, max(1, len(codes)))
    sums = [*owners, groups, np.bincount(doc, links, n).astype(np.int64)]
    return doc_ids, sums, sha, (np.searchsorted(doc, np.arange(n + 1)), pair, links), codes, np.bincount(pair, minlength=len(codes))


def _aligned(docs: DataFrame, doc_id: str, text: str, path_a: str, path_b: str) -> DataFrame:
    """A row for each document and, as rows of their own (``pairs`` null), each slice's different pairs."""
    import pyarrow as pa

    fields = [("slice", pa.int64()), ("doc_id", pa.int64()), *((k, pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int32())), ("links", pa.list_(pa.int64())), ("code", pa.int64()), ("docs", pa.int32()), ("number", pa.int32())]
    schema = pa.schema(fields)

    def rows(batches):
        from pyspark import TaskContext

        toks, number = tokenizers(path_a, path_b), TaskContext.get().partitionId() << 32
        for b in batches:
            for ids, sums, sha, (bounds, pairs, links), codes, holders in slices(b.column(0), b.column(1), toks):
                n, m = len(ids), len(codes)
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, t)) for x, t in ((pairs, pa.int32()), (links, pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number), pa.int64()), ids, *map(pa.array, sums), pa.array(sha, pa.string()), *lists, *(pa.nulls(n, schema.field(k).type) for k in ("code", "docs", "number"))], schema=schema)
                if m:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, number), pa.int64()), *(pa.nulls(m, f.type) for f in list(schema)[1:9]), pa.array(codes), pa.array(holders, pa.int32()), pa.array(np.arange(m), pa.int32())], schema=schema)
                number += 1

    rows_in = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows_in.mapInArrow(rows, "slice long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, links array<long>, code long, docs int, number int")


def _scored(docs, pairs):
    """One slice: sums over each document's links."""
    import pyarrow as pa

    number = pairs.column("number").to_numpy()
    known = np.zeros((3, 1 + number.max(initial=-1)), np.int64)
    for k, name in enumerate(("count", "best_a", "best_b")):
        known[k, number] = pairs.column(name).to_numpy()
    lists, links = docs.column("pairs").combine_chunks(), docs.column("links").combine_chunks()
    at, times = lists.flatten().to_numpy(), links.flatten().to_numpy()
    ends = np.cumsum(lists.value_lengths().to_numpy())
    sums = [np.diff(np.concatenate([[0], np.cumsum(known[k, at] * times)])[np.concatenate([[0], ends])]) for k in range(3)]
    kept = [docs.column(k) for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    out = [*kept, pa.array(sums[1], pa.int64()), pa.array(sums[0], pa.int64()), docs.column("groups_sha256"), pa.array(sums[2], pa.int64())]
    return pa.table(out, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_b"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """code, count: how many documents hold each pair of ids linked; a code is the A id times 2**32 plus the B id."""
    return aligned.filter("code is not null").groupBy("code").agg(F.sum("docs").alias("count"))


def id_pairs(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """a, b, count, best_a, best_b: every linked pair of ids, the number of documents that hold it, and whether
    that is the highest of its A id and of its B id. That table translates one vocabulary to the other."""
    aligned = materialize(_aligned(docs, doc_id, text, path_a, path_b).select("code", "docs"), "pairs-of-slices")
    found = _with_best(materialize(pair_counts(aligned), "pair-counts"))
    return found.select(_a().cast("int").alias("a"), _b().cast("int").alias("b"), "count", "best_a", "best_b")


def _a():
    return F.shiftright("code", 32)


def _b():
    return F.col("code").bitwiseAND((1 << 32) - 1)


def _with_best(counts: DataFrame) -> DataFrame:
    """Each pair's count with whether it is the largest of its A id and of its B id, ties included."""
    for side, one in (("best_a", _a()), ("best_b", _b())):
        most = counts.groupBy(one.alias("one")).agg(F.max("count").alias("most"))
        counts = counts.withColumn("one", one).join(most, "one").select(*counts.columns, (F.col("count") == F.col("most")).alias(side))
    return counts


def align_tokens(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_a, n_b (tokens), n_groups, n_links, n_best and n_best_b (links whose count is the
    highest of their A id and of their B id, ties included), count_sum (of counts over links) and groups_sha256
    (of ``a1,a2|b1;a3|b2``: ids of each group).

    Null and empty texts, and texts whose tokens of either side don't spell a space and the text, have no
    tokens: zeros and an empty digest. Repeated rows count as documents each; an id may be null. Other columns of
    ``docs`` are not read. A text is held whole in its task. An empty table gives no rows.
    """
    aligned = materialize(_aligned(docs, doc_id, text, path_a, path_b), "aligned")
    counts = materialize(pair_counts(aligned), "pair-counts")
    known = materialize(_with_best(counts), "best-pairs")
    numbered = aligned.filter("code is not null").select("slice", "number", "code").join(known, "code")
    looked = numbered.select(F.col("slice").alias("of"), "number", "count", F.col("best_a").cast("long").alias("best_a"), F.col("best_b").cast("long").alias("best_b"))
    rows = aligned.filter("pairs is not null").select("slice", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links")
    out = rows.groupBy("slice").cogroup(looked.groupBy("of")).applyInArrow(
        _scored, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_best_b long"
    )
    discard(counts)
    return out
