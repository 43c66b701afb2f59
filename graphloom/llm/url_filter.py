"""URL filter: rules by host and path, else naive Bayes over the words of host and path.

Hosts run words together; each part of a host is cut into words by unigram Viterbi, with
word counts taken from a whole corpus by aggregation. Only substrings that occur as words
meet their counts, in a join, so no vocabulary is sent to the workers.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, materialize

LONGEST_WORD = 24
#: Letters of a label whose spans begin in one row; copies of the counts of short words, which occur in most labels.
CHUNK, SHORT, SALTS = 200, 3, 16
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does. Rules are a short list."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        chosen = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def word_counts(texts: DataFrame, text: str, markup: bool = True) -> DataFrame:
    """word, n over every row: runs of letters, lower-cased; tags, scripts and styles left out."""
    body = F.coalesce(F.col(text), F.lit(""))
    if markup:
        body = F.regexp_replace(body, r"(?is)<script.*?</script>|<style.*?</style>|<[^>]*>|&\w+;", " ")
    words = texts.select(F.explode(F.split(F.lower(body), r"[^\p{L}]+")).alias("word"))
    return words.filter("word != ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def viterbi(label: str, known: dict[tuple[int, int], float], total: float) -> list[str]:
    """The likeliest cut. ``known``: log-probability by (start, length); an unknown word of n
    letters has probability 10 / (total * 10**n)."""
    best, back = [0.0] + [-np.inf] * len(label), [0] * (len(label) + 1)
    for end in range(1, len(label) + 1):
        for start in range(max(0, end - LONGEST_WORD), end):
            p = known.get((start, end - start), 2.302585 * (1 - (end - start)) - np.log(total))
            if best[start] + p > best[end]:
                best[end], back[end] = best[start] + p, start
    out, end = [], len(label)
    while end:
        out.append(label[back[end] : end])
        end = back[end]
    return out[::-1]


def segment(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """label, words for each different non-empty label."""
    total = max(float(counts.agg(F.sum("n")).first()[0] or 1), 1.0)
    labels = materialize(labels.select("label").filter("label != ''").distinct().withColumn("lid", F.monotonically_increasing_id()), "labels")
    # a long label is taken in chunks that overlap by the longest word, so a span's row carries no more than its word
    starts = F.sequence(F.lit(0), F.floor((F.length("label") - 1) / CHUNK).cast("int"))
    chunks = labels.select("lid", "label", F.explode(starts).alias("c")).select("lid", (F.col("c") * CHUNK).alias("base"), F.substr("label", F.col("c") * CHUNK + 1, F.lit(CHUNK + LONGEST_WORD - 1)).alias("chunk"))
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.least(F.lit(CHUNK), F.length("chunk"))),
            lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("chunk") - i + 1)), lambda n: F.struct((i + F.col("base")).alias("i"), n.alias("n"), F.substr(F.col("chunk"), i, n).alias("word"))),
        )
    )
    salt = lambda length, of: F.when(length <= SHORT, of).otherwise(0)
    parts = chunks.select("lid", F.explode(spans).alias("s")).select("lid", "s.*").withColumn("salt", salt(F.col("n"), F.pmod("lid", F.lit(SALTS)).cast("int")))
    copies = F.when(F.length("word") <= SHORT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    counted = counts.select("word", F.col("n").alias("count"), F.explode(copies).alias("salt"))
    known = parts.join(counted, ["word", "salt"]).groupBy("lid").agg(F.collect_list(F.struct("i", "n", "count")).alias("known"))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(label, known):
        import pandas as pd

        out = []
        for text, found in zip(label, known, strict=True):
            p = {(int(f["i"]) - 1, int(f["n"])): float(np.log(f["count"] / total)) for f in (found if found is not None else [])}
            out.append(viterbi(text, p, total))
        return pd.Series(out)

    return labels.join(known, "lid", "left").select("label", cut("label", "known").alias("words"))


def _path_tokens(path: Column) -> Column:
    parts = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.transform(parts, lambda x: F.concat(F.lit("p:"), F.when(x.rlike(r"^\p{N}+$"), F.concat(F.lit("#"), F.length(x).cast("string"))).otherwise(x)))


class UrlFilter(NamedTuple):
    """weights: token, weight (log-odds of block); hosts: host, tokens; prior: log-odds of the classes."""

    weights: DataFrame
    hosts: DataFrame
    prior: float

    def scores(self, urls: DataFrame) -> DataFrame:
        """``urls`` (row, host, path, …) with ``log_odds`` of block, from whole host and path."""
        by_host = self.hosts.select("host", F.explode("tokens").alias("token")).join(self.weights, "token").groupBy("host").agg(F.sum("weight").alias("_h"))
        by_path = urls.select("row", F.explode(_path_tokens(F.col("path"))).alias("token")).join(self.weights, "token").groupBy("row").agg(F.sum("weight").alias("_p"))
        joined = urls.join(by_host, "host", "left").join(by_path, "row", "left")
        return joined.withColumn("log_odds", F.lit(self.prior) + F.coalesce("_h", F.lit(0.0)) + F.coalesce("_p", F.lit(0.0))).drop("_h", "_p")


def fit(urls: DataFrame, counts: DataFrame, smoothing: float = 1.0) -> UrlFilter:
    """Fit on the rows of ``urls`` (row, host, path, label) with label ``allow`` or ``block``; all
    hosts are cut into words, labelled or not. Rows of a host are counted before they meet its words."""
    each = urls.groupBy("host").agg(*[F.sum(F.when(F.col("label") == c, 1).otherwise(0)).alias(c) for c in ("allow", "block")])
    each = materialize(each, "url-hosts")
    parts = each.select("host", F.posexplode(F.split(F.regexp_replace("host", r"[.][^.]*$", ""), r"[^\p{L}]+")).alias("at", "label")).filter("label != ''")
    words = segment(parts, counts)
    hosts = parts.join(words, "label").select("host", F.explode("words").alias("w")).groupBy("host").agg(F.collect_list(F.concat(F.lit("h:"), "w")).alias("tokens"))
    hosts = materialize(hosts, "url-words")
    classes = ("allow", "block")
    from_hosts = each.join(hosts, "host").select(F.explode("tokens").alias("token"), *classes)
    from_paths = urls.filter("label is not null").select(F.explode(_path_tokens(F.col("path"))).alias("token"), *[(F.col("label") == c).cast("long").alias(c) for c in classes])
    seen = materialize(from_hosts.unionByName(from_paths).groupBy("token").agg(*[F.sum(c).alias(c) for c in classes]), "url-tokens")
    n, allow, block = seen.agg(F.count(F.lit(1)), F.sum("allow"), F.sum("block")).first()
    n_allow, n_block = each.agg(F.sum("allow"), F.sum("block")).first()
    a, b = (allow or 0) + smoothing * max(n, 1), (block or 0) + smoothing * max(n, 1)
    weight = F.log((F.col("block") + smoothing) / b) - F.log((F.col("allow") + smoothing) / a)
    prior = float(np.log(((n_block or 0) + smoothing) / ((n_allow or 0) + smoothing)))
    return UrlFilter(seen.select("token", weight.alias("weight")), hosts, prior)


def url_filter(pages: DataFrame, rules: list[Rule], counts: DataFrame, seeds: list[str], url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row for each row of ``pages``: ``keep``, host, path, rule, verdict, log_odds.

    Training labels are the verdicts of the rules and, where none fits, ``block`` for hosts of
    which a part between dots and hyphens is one of ``seeds``. Without a fitting rule the
    verdict is ``block`` if the log-odds are over 0. Null and unparsable urls have empty host
    and path, no tokens, and the prior's verdict; repeated rows are judged alike. Urls and hosts may be of any
    length. Columns of ``keep`` that are named like one of the result's are left out.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    kept = [c for c in keep if c not in ("host", "path", "rule", "verdict", "log_odds")]
    rows = pages.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(c) for c in kept]).alias("_keep"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    seeded = F.exists(F.split("host", r"[^\p{L}]+"), lambda x: x.isin(seeds)) if seeds else F.lit(False)
    rows = materialize(rows.withColumn("label", F.coalesce(F.col("_rule.verdict"), F.when(seeded, F.lit("block")))), "urls")
    judged = fit(rows, counts).scores(rows)
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    return judged.select(*[F.col("_keep")[c].alias(c) for c in kept], "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "log_odds")
