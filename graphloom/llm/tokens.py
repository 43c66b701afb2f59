"""Token ids of whole texts: different words are encoded once, texts are put together from them."""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

END_ID = 2
#: Bytes of text encoded at a time, and words kept between slices (about 10 MB), in each Python worker.
SLICE_BYTES, CACHE_WORDS = 2 << 20, 1 << 18

# ---- fixed values: the parts of a tokenizer file for which words can be encoded apart ----
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# ---- end of fixed values ----

_SPACES = " \t\n\v\f\r"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE, _LETTER, _DIGIT, _PUNCT, _QUOTE = range(1, 6)
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _PUNCT
_KIND[ord("'")] = _QUOTE
_KIND[48:58] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[ord(c) for c in _SPACES]] = _SPACE
#: Whether a word begins between two bytes of these kinds.
_CUT = np.zeros((6, 6), bool)
_CUT[_SPACE] = True
_CUT[:, _SPACE] = False
_CUT[_LETTER, [_DIGIT, _PUNCT, _QUOTE]] = _CUT[_DIGIT, [_LETTER, _DIGIT, _PUNCT, _QUOTE]] = _CUT[_PUNCT, [_LETTER, _DIGIT]] = True
_CUT = _CUT.reshape(-1)
#: Words of Latin letters in the alphabet of bytes that byte-level models use: printable bytes stand
#: for themselves, others for code points from 256 on.
_LATIN = re.compile("[a-zß-öø-ÿ]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: (b if b in _SHOWN else 256 + sum(x not in _SHOWN for x in range(b))) for b in range(256)}
_BYTES = {b: chr(c) for b, c in _BYTES.items()}
_SPELT = {c: "".join(_BYTES[b] for b in chr(c).encode()) for c in range(128, 256)}


class WordEncoder:
    """Encodes texts with the tokenizers library.

    A tokenizer that lower-cases, drops white space and divides at punctuation (its file says
    so: NORMALIZER, PRE_TOKENIZER) gives a text the ids of its words in a row, where a word
    begins after ASCII white space and wherever ASCII letters, digits and punctuation meet, but
    for a letter or digit after an apostrophe; every digit is a word. Each different word is
    encoded once; words of lower-case Latin letters go to the model itself, which is all that the
    tokenizer does with them. Texts that spell an added token, and all texts under other
    tokenizers, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.vocab_size = self.tok.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.added = [t["content"].lower() for t in parts["added_tokens"]]
        self.by_word = (
            (parts["normalizer"], parts["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER)
            and not any(parts[k] for k in ("post_processor", "truncation", "padding"))
            and parts["model"]["type"] == "BPE"
            and not parts["model"]["dropout"]
            and not any(c.isspace() for t in self.added for c in t)
        )
        self._forget()

    def _forget(self) -> None:
        """Of the words known, ids in a row with the place of the first and their number. The word
        at 0 is that of the end id, which no text can spell; at 1, the empty one."""
        import pyarrow as pa

        self.words = pa.array(["\n", ""])
        self.flat, self.first, self.size = np.array([END_ID], np.uint32), np.array([0, 1], np.int32), np.array([1, 0], np.int32)

    def _learn(self, new) -> None:
        """Encode words (an Arrow array) and add them to those known."""
        import pyarrow as pa

        ids, sizes, hard = [], np.zeros(len(new), np.int32), []
        model, latin = self.tok.model.tokenize, _LATIN.fullmatch
        for k, w in enumerate(new.to_pylist()):
            if latin(w):
                found = model(w if w.isascii() else w.translate(_SPELT))
                sizes[k] = len(found)
                ids += [t.id for t in found]
            else:
                hard.append((k, w, len(ids)))
        flat = np.array(ids, np.uint32)
        if hard:
            more = [e.ids for e in self.tok.encode_batch_fast([w for _, w, _ in hard], add_special_tokens=False)]
            at, n = [k for k, _, _ in hard], [len(x) for x in more]
            sizes[at] = n
            flat = np.insert(flat, np.repeat([x for _, _, x in hard], n), list(chain.from_iterable(more)))
        self.words = pa.concat_arrays([self.words, new])
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(sizes, dtype=np.int32) - sizes])
        self.size, self.flat = np.concatenate([self.size, sizes]), np.concatenate([self.flat, flat])

    def _by_words(self, texts) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.words) > CACHE_WORDS:
            self._forget()
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = _FOLD[np.frombuffer(raw, np.uint8)[at[0] : at[-1]]] if raw else np.zeros(0, np.uint8)
        at = at - at[0]
        kind = _KIND[data]
        starts = np.zeros(len(data), bool)
        starts[1:] = _CUT[kind[:-1] * np.uint8(6) + kind[1:]]
        starts[at[:-1][at[:-1] < at[1:]]] = True
        starts = np.flatnonzero(starts).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, np.int32(len(data)))), pa.py_buffer(data)).dictionary_encode()
        spelt = pc.utf8_trim(words.dictionary, _SPACES)
        found = pc.index_in(spelt, value_set=self.words)
        find = pc.fill_null(found, 0).to_numpy().copy()
        if found.null_count:
            new, base = spelt.filter(missing := found.is_null()), len(self.words)
            self._learn(different := pc.unique(new))
            find[missing.to_numpy(zero_copy_only=False)] = base + pc.index_in(new, value_set=different).to_numpy()
        slots = np.insert(find[words.indices.to_numpy()], np.searchsorted(starts, at[1:]), 0)
        size = self.size[slots]
        ends = np.cumsum(size, dtype=np.int64)
        ids = self.flat[np.repeat(self.first[slots] - (ends - size), size) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends[slots == 0]])

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array([*e.ids, END_ID], np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])

    def encode(self, texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For slices of an Arrow array of strings in order: ids (little-endian unsigned 32 bits) of
        all texts, each followed by END_ID, and the bounds of each text. Null counts as empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(texts):
            return
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = np.ones(len(texts), bool)
        if self.by_word:
            whole[:] = False
            for t in self.added:
                whole |= pc.match_substring(texts, t, ignore_case=True).to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        cuts = np.flatnonzero(np.diff(whole)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(texts)], strict=True):
            while lo < hi:
                to = min(hi, max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_BYTES))))
                part = texts.slice(lo, to - lo)
                yield self._whole(part.to_pylist()) if whole[lo] else self._by_words(part)
                lo = to


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One for each Python worker."""
    return WordEncoder(path)
