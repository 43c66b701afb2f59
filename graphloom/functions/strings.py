"""Scalar expressions over strings: ids, labels, tokens, distances."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_id(c: Column | str) -> Column:
    """Every run of non-alphanumerics becomes one underscore; outer ones go; lower case."""
    return F.lower(F.btrim(F.regexp_replace(_col(c), "[^a-zA-Z0-9]+", "_"), F.lit("_")))


def make_id(*parts: Column | str) -> Column:
    """An id from parts: outer ``_`` and ``.`` of each part go, then empty parts, then as normalize_id."""
    trimmed = F.filter(F.array(*[F.btrim(_col(p), F.lit("_.")) for p in parts]), lambda x: x.isNotNull() & (x != ""))
    return normalize_id(F.array_join(trimmed, "_"))


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def extension(path: Column | str) -> Column:
    """From the last dot of the last segment on, dot included; empty without a dot."""
    return F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1)


def file_stem(path: Column | str) -> Column:
    """``parent.stem`` of a path; the stem alone at the top."""
    stem = F.regexp_replace(base_name(path), r"\.[^.]*$", "")
    parts = F.split(_col(path), "/")
    parent = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")
    return F.when(parent == "", stem).otherwise(F.concat(parent, F.lit("."), stem))


def is_file_label(label: Column | str) -> Column:
    """A label that looks like a file: extension of at most five bytes, dot included, and no ``()``."""
    ext = extension(label)
    return F.coalesce((ext != "") & (F.octet_length(ext) <= 5) & ~_col(label).contains("()"), F.lit(False))


def clean_label(label: Column | str) -> Column:
    """Without trailing parentheses (any mix of them) and leading dots, lower-cased."""
    return F.lower(F.regexp_replace(F.regexp_replace(_col(label), r"[()]+$", ""), r"^[.]+", ""))


@F.pandas_udf(T.StringType())
def strip_diacritics(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks; Spark has no built-in for it."""

    def one(t: str | None) -> str | None:
        return t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.category(c) != "Mn")

    return text.map(one)


def normalize_label(label: Column | str) -> Column:
    return F.lower(strip_diacritics(_col(label)))


@F.pandas_udf(T.IntegerType())
def byte_levenshtein(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance over UTF-8 bytes; equal to Spark's ``levenshtein`` on ASCII, which is faster."""

    def one(x: str, y: str) -> int:
        x, y = x.encode(), y.encode()
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, q in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != q))
        return row[-1]

    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


# Words that carry no meaning.
STOP_WORDS = """
    the and for are but not you all can had her was one our out has have been will with
    this that from they most said each which their what more when make like than into just over such take
    other some could them then does also after would about these only should very where
""".split()
# Suffix, letters a word must exceed, letters cut, letters added; the first that fits is used.
SUFFIXES = (("ation", 7, 5, ""), ("ment", 7, 4, ""), ("ness", 7, 4, ""), ("ting", 5, 4, ""), ("ing", 5, 3, ""), ("ies", 4, 3, "y"), ("ed", 4, 2, ""), ("es", 4, 2, ""), ("s", 4, 1, ""))


def stem(word: Column) -> Column:
    out = word
    for suffix, longer, cut, added in reversed(SUFFIXES):
        fits = word.endswith(suffix) & (F.octet_length(word) > longer)
        if suffix == "s":
            fits = fits & ~word.endswith("ss")
        out = F.when(fits, F.concat(F.substr(word, F.lit(1), F.length(word) - cut), F.lit(added))).otherwise(out)
    return out


def split_camel(text: Column) -> Column:
    """A space at each change from lower to upper case, and before the last capital of a run."""
    return F.regexp_replace(F.regexp_replace(text, r"(\p{Ll})(\p{Lu})", "$1 $2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")


def tokenize(text: Column | str) -> Column:
    """Tokens for matching meaning: camel parts, lower-cased, three bytes or more, no stop words, stemmed."""
    parts = F.split(F.lower(split_camel(F.coalesce(_col(text), F.lit("")))), r"[^\p{L}\p{Nd}]+")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    kept = F.filter(parts, lambda w: (F.octet_length(w) >= 3) & ~F.array_contains(stop, w))
    return F.filter(F.transform(kept, stem), lambda w: F.octet_length(w) >= 3)


def canonical_tokens(label: Column | str) -> Column:
    """Sorted camel and separator parts of a label, lower-cased, two characters or more."""
    bare = F.regexp_replace(F.regexp_replace(_col(label), r"^\.", ""), r"\(\)$", "")
    spaced = F.regexp_replace(F.regexp_replace(bare, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z0-9])", "$1 $2")
    return F.array_sort(F.filter(F.split(F.lower(spaced), "[^a-zA-Z0-9]+"), lambda w: F.length(w) >= 2))


def set_jaccard(a: Column, b: Column) -> Column:
    """Of arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Of arrays as multisets; two empty ones are equal."""
    values = F.array_union(a, b)
    count = lambda x, v: F.size(F.filter(x, lambda y: y == v))
    least = F.aggregate(values, F.lit(0), lambda s, v: s + F.least(count(a, v), count(b, v)))
    most = F.aggregate(values, F.lit(0), lambda s, v: s + F.greatest(count(a, v), count(b, v)))
    return F.when(F.size(values) == 0, 1.0).otherwise(least / most)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for unequal lengths and zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def label_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer label, in lower case."""
    longest = F.greatest(F.octet_length(F.lower(a)), F.octet_length(F.lower(b)))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(F.lower(a), F.lower(b)) / longest)


def half_up(x: Column, digits: int) -> Column:
    """floor(x * 10**digits + 0.5) / 10**digits, in doubles."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def snippet(text: Column, limit: int) -> Column:
    """The first ``limit`` characters, with an ellipsis if there were more."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def cypher_escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def safe_name(c: Column) -> Column:
    """A file name: anything but letters, digits, dot, dash, underscore and space becomes an underscore."""
    return F.regexp_replace(c, r"[^\p{L}\p{N} ._-]", "_")
