"""Language identification by fusing evidence.

The posterior over languages multiplies a text likelihood (hashed byte trigrams), what the
markup declares, the address suffix and a host prior. Host priors are counted over all rows by
grouped aggregation and smoothed down a hierarchy: all rows, suffix, domain, host.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

BUCKETS = 1 << 16
#: A text's mean log-likelihood counts as that of at most so many trigrams, as they are far from independent.
WEIGHT = 40
#: Probability that a declaration, or a country's suffix, names the text's language.
DECLARED, SUFFIX = 0.9, 0.7
#: Rows' worth of belief that each level of the hierarchy takes from the one above.
STRENGTH = 5.0
#: Labelled rows of each language, about, that the likelihood is fitted on.
SAMPLE = 3000
#: Share of the labelled rows that a label needs to be a language, which bounds their number by 1 / SUPPORT.
SUPPORT = 0.001
UNKNOWN = "und"
_OUT = ["lang", "confidence", "text_lang", "n", "accepted"]

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
for _c in range(97, 123):
    _FOLD[_c] = _FOLD[_c - 32] = _c


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the byte trigrams of a whole text: letters lower-cased, runs of anything else in ASCII one space."""
    b = _FOLD[np.frombuffer((" " + (text or "").lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)]
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])].astype(np.uint32)
    if len(b) < 4:
        return np.zeros(0, np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


class Model(NamedTuple):
    """languages in order and log_p: (language, bucket) float32; bounded by the number of languages times BUCKETS."""

    languages: list[str]
    log_p: np.ndarray

    def means(self, text: str | None) -> tuple[np.ndarray, int]:
        """Mean log-likelihood of the trigrams under each language, and their number."""
        t = trigrams(text)
        if not len(t):
            return np.zeros(len(self.languages)), 0
        at, n = np.unique(t, return_counts=True)
        return self.log_p[:, at].astype(np.float64) @ n / len(t), len(t)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, support: float = SUPPORT) -> Model:
    """Fit on about ``sample`` rows of each language (all, if fewer), chosen by a hash of the
    text; null texts and labels are left out, and so are labels of less than
    ``support`` of the rows: their texts go to another language or to ``und``. Counts are summed on the workers and the
    result has at most languages x BUCKETS figures."""
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l")).filter("t is not null and l is not null")
    labels = materialize(rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")), "labels")
    total = labels.agg(F.sum("n")).head()[0] or 0
    sizes = {r["l"]: r["n"] for r in labels.filter(F.col("n") >= support * total).collect()}  # at most 1 / support
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))]) if sizes else F.create_map()
    chosen = rows.filter(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < F.try_element_at(share, F.col("l")) * (1 << 20)) if sizes else rows

    def counted(batches):
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}
        for b in batches:
            for t, k in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                total.setdefault(k, np.zeros(BUCKETS, np.int64))
                total[k] += np.bincount(trigrams(t.as_py()), minlength=BUCKETS)
        for k, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["l", "bucket", "n"])

    counts = chosen.mapInArrow(counted, "l string, bucket int, n long").groupBy("l", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(sizes)
    table = np.full((len(languages), BUCKETS), 0.05)
    at = {k: i for i, k in enumerate(languages)}
    np.add.at(table, ([at[k] for k in counts.column(0).to_pylist()], counts.column(1).to_numpy()), counts.column(2).to_numpy())
    return Model(languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def _evidence(rows: DataFrame, model: Model) -> DataFrame:
    """For each row: n (trigrams), best (largest mean log-likelihood), text_lang, and belief:
    normalised text likelihoods times those of declaration and suffix."""
    import pyarrow as pa

    kept = [f for f in rows.schema if f.name not in ("text", "declared", "suffix")]
    names = [f.name for f in kept]
    added = {"n": T.LongType(), "best": T.DoubleType(), "text_lang": T.StringType(), "belief": T.ArrayType(T.DoubleType())}
    schema = T.StructType([*kept, *(T.StructField(k, t) for k, t in added.items())])
    index = {k: i for i, k in enumerate(model.languages)}

    def read(batches):
        k = len(model.languages)
        for b in batches:
            if not b.num_rows:
                continue
            n, best, lang, beliefs = [], [], [], []
            for text, said, suffix in zip(b.column("text"), b.column("declared").to_pylist(), b.column("suffix").to_pylist(), strict=True):
                mean, count = model.means(text.as_py())
                log = mean * min(count, WEIGHT)
                n.append(count)
                best.append(float(mean.max()) if k else 0.0)
                lang.append(model.languages[int(mean.argmax())] if count and k else None)
                for key, right in ((said, DECLARED), (suffix, SUFFIX)):
                    if key in index and k > 1:
                        log = log + np.log((1 - right) / (k - 1))
                        log[index[key]] += np.log(right * (k - 1) / (1 - right))
                p = np.exp(log - log.max()) if k else log
                beliefs.append(p / p.sum() if k else p)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(x) for x in names), pa.array(n, pa.int64()), pa.array(best, pa.float64()), pa.array(lang, pa.string()), pa.array(beliefs, pa.list_(pa.float64()))], [*names, "n", "best", "text_lang", "belief"]
            )

    return rows.mapInArrow(read, schema)


def _sums(k: int) -> Column:
    return F.array(*[F.sum(F.col("belief")[i]) for i in range(k)])


def _smoothed(own: str, size: str, above: str) -> Column:
    """(counts + STRENGTH * prior above) / (size + STRENGTH)"""
    return F.zip_with(own, above, lambda a, b: (a + STRENGTH * b) / (F.col(size) + STRENGTH))


def identify(rows: DataFrame, model: Model, accept: float = 0.5) -> DataFrame:
    """``rows`` (any keys, and text, declared, suffix, domain, host) without texts and with lang,
    confidence, text_lang, n, accepted.

    Each null piece of evidence is left out: a null host takes its prior from null as a host of
    its own. A row without letters (null, empty, symbols) is ``und`` and not accepted; one that no
    language explains better than uniform noise, or whose best language has a posterior under
    ``accept``, is not accepted. Rows that repeat are judged alike. Keys may have any name; one
    that is named like a result gives way to it. The host's counts hold the
    row itself, which weighs no more than one row.
    """
    k = len(model.languages)
    names = [c for c in rows.columns if c not in ("text", "declared", "suffix", "domain", "host")]
    keys = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in names if c not in _OUT]).alias("keys")
    clean = rows.select(keys, "text", "declared", "suffix", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("domain", "host")], F.coalesce("suffix", F.lit("")).alias("top"))
    seen = materialize(_evidence(clean, model), "language-evidence")
    voting = seen.filter("n > 0")
    hosts = voting.groupBy("top", "domain", "host").agg(_sums(k).alias("c"), F.count(F.lit(1)).alias("size"))
    hosts = materialize(hosts, "language-hosts")
    up = lambda keys: hosts.groupBy(*keys).agg(F.array(*[F.sum(F.col("c")[i]) for i in range(k)]).alias("c"), F.sum("size").alias("size"))
    every = up([]).select(F.transform("c", lambda x: (x + 1) / (F.col("size") + k)).alias("all"))
    tops = up(["top"]).crossJoin(F.broadcast(every)).select("top", _smoothed("c", "size", "all").alias("p_top"))
    domains = up(["top", "domain"]).join(tops, "top").select("top", "domain", _smoothed("c", "size", "p_top").alias("p_domain"))
    priors = hosts.join(domains, ["top", "domain"]).select("top", "domain", "host", _smoothed("c", "size", "p_domain").alias("prior"))
    fused = seen.join(priors, ["top", "domain", "host"], "left")
    weighed = F.when(F.col("prior").isNull(), F.col("belief")).otherwise(F.zip_with("belief", "prior", lambda a, b: a * b))
    fused = fused.withColumn("w", weighed).withColumn("most", F.array_max("w")).withColumn("total", F.aggregate("w", F.lit(0.0), lambda a, b: a + b))
    named = F.element_at(F.array(*[F.lit(x) for x in model.languages]), F.array_position("w", F.col("most")).cast("int")) if k else F.lit(None).cast("string")
    known = F.col("n") > 0
    confidence = F.when(known & (F.col("total") > 0), F.col("most") / F.col("total")).otherwise(0.0)
    out = fused.withColumn("confidence", confidence).withColumn("lang", F.when(known, F.coalesce(named, F.lit(UNKNOWN))).otherwise(UNKNOWN))
    accepted = known & (F.col("confidence") >= accept) & (F.col("best") > -float(np.log(BUCKETS)))
    return out.withColumn("accepted", accepted).select(*[F.col(f"keys.`{c}`").alias(c) for c in names if c not in _OUT], *_OUT)


def visible_text(html: Column) -> Column:
    """Tags, scripts, styles and character references left out."""
    return F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<[^>]*>|&#?\w+;", " ")


def declared_language(html: Column) -> Column:
    """Primary tag of the html element's lang, lower-cased; null where there is none."""
    found = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    return F.when(found != "", found)
