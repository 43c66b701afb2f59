"""Scanning a source tree: what to read, and as what."""

from __future__ import annotations

import fnmatch
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import base_name, extension
from ..operators.rounds import cut

# Extensions by type.
CODE = [".py", ".ts", ".js", ".jsx", ".tsx", ".mjs", ".ejs", ".go", ".rs", ".java", ".cpp", ".cc", ".cxx", ".c", ".h", ".hpp", ".rb", ".swift", ".kt", ".kts", ".cs", ".scala", ".php", ".lua", ".toc", ".zig", ".ps1", ".ex", ".exs", ".m", ".mm", ".jl", ".vue", ".svelte", ".dart", ".v", ".sv"]
DOCUMENT = [".md", ".mdx", ".txt", ".rst", ".html", ".yaml", ".yml"]
PAPER, OFFICE = [".pdf"], [".docx", ".xlsx"]
IMAGE = [".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg"]
VIDEO = [".mp4", ".mov", ".webm", ".mkv", ".avi", ".m4v", ".mp3", ".wav", ".m4a", ".ogg"]
# Folders and files that are never read.
SKIP_FOLDERS = ["venv", ".venv", "env", ".env", "node_modules", "__pycache__", ".git", "dist", "build", "target", "out", "site-packages", "lib64", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".eggs"]
SKIP_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "Gemfile.lock", "composer.lock", "go.sum", "go.work.sum"]
# Names that tell of secrets.
SENSITIVE = (
    r"(?i)(^|[\\/])\.(env|envrc)(\.|$)",
    r"(?i)\.(pem|key|p12|pfx|cert|crt|der|p8)$",
    r"(?i)(credential|secret|passwd|password|token|private_key)",
    r"(id_rsa|id_dsa|id_ecdsa|id_ed25519)(\.pub)?$",
    r"(?i)(\.netrc|\.pgpass|\.htpasswd)$",
    r"(?i)(aws_credentials|gcloud_credentials|service.account)",
)
# Signs of an academic paper; three of them make one.
PAPER_SIGNS = (
    r"(?i)\barxiv\b", r"(?i)\bdoi\s*:", r"(?i)\babstract\b", r"(?i)\bproceedings\b", r"(?i)\bjournal\b", r"(?i)\bpreprint\b", r"\\cite\{",
    r"\[\d+\]", r"(?s)\[\n\d+\n\]", r"(?i)eq\.\s*\d+|equation\s+\d+", r"\d{4}\.\d{4,5}", r"(?i)\bwe propose\b", r"(?i)\bliterature\b",
)
PAPER_LEAST, PAPER_BYTES = 3, 3000
# Word and file counts at which a corpus is small or large.
SMALL_WORDS, LARGE_WORDS, LARGE_FILES = 50_000, 500_000, 200


def is_sensitive(name: Column) -> Column:
    out = F.lit(False)
    for pattern in SENSITIVE:
        out = out | name.rlike(pattern)
    return out


def looks_like_paper(text: Column) -> Column:
    """By the first 3000 characters."""
    head = F.substring(text, 1, PAPER_BYTES)
    signs = F.lit(0)
    for pattern in PAPER_SIGNS:
        signs = signs + head.rlike(pattern).cast("int")
    return signs >= PAPER_LEAST


def classify(path: Column, text: Column) -> Column:
    """File type by name and, of documents, by content; null for what isn't read."""
    ext, low = F.lower(extension(path)), F.lower(path)
    assets = path.rlike(r"\.(xcassets|imageset|appiconset|colorset|launchimage)/")
    return (
        F.when(low.endswith(".blade.php") | ext.isin(CODE), "code")
        .when(ext.isin(PAPER), F.when(~assets, "paper"))
        .when(ext.isin(IMAGE), "image")
        .when(ext.isin(DOCUMENT), F.when(looks_like_paper(text), "paper").otherwise("document"))
        .when(ext.isin(OFFICE), "document")
        .when(ext.isin(VIDEO), "video")
    )


def word_count(text: Column) -> Column:
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+"))).cast("long")


def is_noise(folder: Column) -> Column:
    """Of a folder's name: hidden, or of a kind that is never read."""
    return folder.isin(SKIP_FOLDERS) | folder.startswith(".") | folder.endswith("_venv") | folder.endswith("_env") | folder.endswith(".egg-info")


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to ``root``, length, modificationTime) of every file outside noise folders, whatever
    its name. Folders are listed in tasks, a round for each level of the tree."""
    import pyarrow as pa
    from pyarrow import fs

    names = ["path", "is_folder", "length", "modificationTime"]
    types = [pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC")]

    def entries(batches):
        system, base = _file_system(root)
        for b in batches:
            for folder in b.column(0).to_pylist():
                found = system.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base))
                rows = [(f"{folder}/{i.base_name}" if folder else i.base_name, i.type == fs.FileType.Directory, i.size or 0, i.mtime) for i in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    folders, levels = spark.createDataFrame([("",)], "path string"), []
    while True:
        level = cut(folders.repartition("path").mapInArrow(entries, "path string, is_folder boolean, length long, modificationTime timestamp"))
        levels.append(level.filter("not is_folder").drop("is_folder"))
        folders = level.filter(F.col("is_folder") & ~is_noise(base_name("path"))).select("path")
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, levels)


def _file_system(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/*", "/", root.rstrip("/")))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """list_tree's columns with content and text (null where the bytes aren't UTF-8)."""
    import pyarrow as pa

    names = ["path", "content", "length", "modificationTime"]

    def contents(batches):
        system, base = _file_system(root)
        for b in batches:
            for i in range(b.num_rows):
                with system.open_input_stream(f"{base}/{b.column(0)[i].as_py()}") as f:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([f.read()], pa.binary()), b.column(1).slice(i, 1), b.column(2).slice(i, 1)], names)

    files = list_tree(spark, root).mapInArrow(contents, "path string, content binary, length long, modificationTime timestamp")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return files.withColumn("text", F.when(valid, F.col("content").cast("string")))


class IgnoreRule:
    """One line of an ignore file: a glob, of a folder or the whole tree, perhaps negated."""

    def __init__(self, folder: str, line: str, order: int, may_negate: bool = False):
        self.folder, self.order = folder.strip("/"), order
        self.negated = may_negate and line.startswith("!")
        line = line[1:] if self.negated else line
        self.folders_only = line.endswith("/")
        line = line.rstrip("/")
        self.anchored = "/" in line
        self.glob = line.lstrip("/")

    @property
    def pattern(self) -> str:
        """A regular expression over relative paths; a rule on a folder covers what is in it."""
        inner = fnmatch.translate(self.glob)
        inner = re.sub(r"^\(\?s:(.*)\)\\[zZ]$", r"\1", inner).replace(".*", "[^/]*")
        prefix = re.escape(self.folder) + "/" if self.folder else ""
        return f"^{prefix}{'' if self.anchored else '(?:.*/)?'}{inner}{'/' if self.folders_only else '(?:/|$)'}"


def parse_ignore(folder: str, text: str, may_negate: bool = False, first: int = 0) -> list[IgnoreRule]:
    lines = [x.strip() for x in text.splitlines()]
    return [IgnoreRule(folder, x, first + i, may_negate) for i, x in enumerate(lines) if x and not x.startswith("#")]


#: Names of ignore files; only in the second a line may take a file in again.
IGNORE_FILES = (".gitignore", ".graphloomignore")


#: Copies of each folder's rules, so that the files below one folder are spread over as many keys.
_SALTS = 32
_RULE = "folder string, rules array<struct<turn:bigint, negated:boolean, prefix:string, pattern:string>>"


def _glob_pattern(glob: Column, anchored: Column, folders_only: Column) -> Column:
    """A regular expression over paths relative to the rule's folder: signs but for ``*``, ``?`` and brackets stand for
    themselves, and none of these spans folders."""
    plain = F.regexp_replace(glob, r"([.^$+(){}|\\])", r"\\$1")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\[(?![^\]]+\])", r"\\["), r"\[!", "[^")
    inner = F.regexp_replace(F.regexp_replace(plain, r"\*+", "[^/]*"), r"\?", "[^/]")
    return F.concat(F.lit("^"), F.when(anchored, "").otherwise("(?:.*/)?"), inner, F.when(folders_only, "/").otherwise("(?:/|$)"))


def ignore_rules(files: DataFrame, outside: bool = False) -> DataFrame:
    """(folder, rules in order) of the ignore files among ``files`` (path, text); in a folder lines of the second
    kind of file follow those of the first. With ``outside``, files also have ``prefix``, what leads from the folder to
    the root, and count as rules of the root."""
    name, here = base_name("path"), F.regexp_replace("path", r"/?[^/]*$", "")
    found = files.filter(name.isin(*IGNORE_FILES) & F.col("text").isNotNull())
    prefix = F.col("prefix") if outside else F.lit("")
    depth = F.col("depth") if outside else F.lit(0)
    lines = found.select((F.lit("") if outside else here).alias("folder"), prefix.alias("prefix"), (depth * 2 + (name == IGNORE_FILES[1]).cast("int")).alias("file"), (name == IGNORE_FILES[1]).alias("may_negate"), F.posexplode(F.split("text", r"\r?\n")).alias("at", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"\s", " ")))
    lines = lines.filter("line != '' AND NOT startswith(line, '#') AND (may_negate OR NOT startswith(line, '!'))")
    negated = F.col("line").startswith("!")
    body = F.regexp_replace(F.regexp_replace("line", "^!", ""), "/+$", "")
    pattern = _glob_pattern(F.regexp_replace(body, "^/+", ""), body.contains("/"), F.col("line").endswith("/"))
    one = F.struct((F.col("file").cast("long") * (1 << 32) + F.col("at")).alias("turn"), negated.alias("negated"), "prefix", pattern.alias("pattern"))
    return lines.groupBy("folder").agg(F.array_sort(F.collect_list(one)).alias("rules"))


def listed_rules(spark: SparkSession, rules: list[IgnoreRule]) -> DataFrame:
    """Rules given one by one, as rules of the root."""
    rows = [(r.order, r.negated, "", r.pattern) for r in sorted(rules, key=lambda r: r.order)]
    return spark.createDataFrame([("", rows)] if rows else [], _RULE)


def rules_above(spark: SparkSession, root: str) -> DataFrame:
    """Rules of ignore files in the folders above ``root``, up to the nearest that holds ``.git``: none if the root
    itself holds it, or if they would leave out the root."""
    from pyarrow import fs

    none = spark.createDataFrame([], _RULE)
    system, base = _file_system(root)
    exists = lambda path: system.get_file_info(path).type != fs.FileType.NotFound
    if exists(f"{base}/.git"):
        return none
    rows, folder, prefix, depth = [], base, "", 0
    while "/" in folder.strip("/"):
        folder, _, last = folder.rpartition("/")
        prefix, depth = f"{last}/{prefix}", depth - 1  # outer folders come first
        for name in IGNORE_FILES:
            if exists(f"{folder}/{name}"):
                with system.open_input_stream(f"{folder}/{name}") as f:
                    rows.append((name, f.read().decode(errors="replace"), prefix, depth))
        if exists(f"{folder}/.git"):
            break
    rules = ignore_rules(spark.createDataFrame(rows, "path string, text string, prefix string, depth int"), outside=True)
    own = rules.select(F.explode("rules").alias("r")).filter(F.regexp_like(F.regexp_replace("r.prefix", "/$", ""), F.col("r.pattern")))
    last = own.agg(F.max_by("r.negated", "r.turn").alias("negated")).first()["negated"]
    return none if last is False else rules


def folders_of(path: Column) -> Column:
    """The folders that hold a path, from the root, which is the empty text, inwards."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The paths that the last matching rule leaves out; rules of inner folders come after those of outer ones, and
    those from above the root before all. An equi-join of paths' folders with rules' folders, whatever their number."""
    held = paths.select("path", F.posexplode(folders_of(F.col("path"))).alias("depth", "folder")).withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(_SALTS)))
    copies = rules.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    met = held.join(copies, ["folder", "salt"])
    rest = F.when(F.col("folder") == "", F.col("path")).otherwise(F.expr("substring(path, length(folder) + 2)"))
    met = met.withColumn("rest", rest)
    hit = F.try_element_at(F.filter("rules", lambda r: F.regexp_like(F.concat(r["prefix"], F.col("rest")), r["pattern"])), F.lit(-1))
    decided = met.select("path", F.struct("depth", hit["turn"].alias("turn")).alias("turn"), hit["negated"].alias("negated")).filter("negated IS NOT NULL")
    return decided.groupBy("path").agg(F.max_by("negated", "turn").alias("negated")).filter("NOT negated").select("path")


def detect(files: DataFrame, rules: DataFrame | list[IgnoreRule] | None = None) -> DataFrame:
    """(path, file_type, words, skipped) of ``files`` (path, text): hidden and noise folders,
    submodules, lock files, ignored and unknown files are left out; sensitive ones stay as skipped.
    Unless ``rules`` are given, they are those of the ignore files among ``files``."""
    rules = ignore_rules(files) if rules is None else listed_rules(files.sparkSession, rules) if isinstance(rules, list) else rules
    submodules = files.filter(base_name("path") == ".git").filter(F.col("text").startswith("gitdir:")).select(F.regexp_replace("path", r"/?\.git$", "").alias("folder")).filter("folder != ''").distinct()
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    noise = F.exists(folders, is_noise)
    hidden = base_name("path").startswith(".") & ~is_sensitive(base_name("path"))
    kept = files.filter(~noise & ~hidden & ~base_name("path").isin(SKIP_FILES))
    in_submodules = kept.select("path", F.explode(folders_of(F.col("path"))).alias("folder")).join(submodules, "folder", "left_semi").select("path")
    out = ignored(kept.select("path"), rules).unionByName(in_submodules)
    kept = kept.join(out, "path", "left_anti")
    secret = is_sensitive(base_name("path"))
    typed = kept.select("path", classify(F.col("path"), F.coalesce("text", F.lit(""))).alias("file_type"), F.when(secret, F.lit(0)).otherwise(F.coalesce(word_count(F.col("text")), F.lit(0))).cast("long").alias("words"), secret.alias("skipped"))
    return typed.filter("file_type is not null OR skipped")


def summary(detected: DataFrame) -> DataFrame:
    """One row: files, words, skipped, warning (null, small or large)."""
    s = detected.agg(F.count(F.when(~F.col("skipped"), 1)).alias("files"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.count(F.when(F.col("skipped"), 1)).alias("skipped"))
    return s.withColumn("warning", F.when(F.col("words") < SMALL_WORDS, "small").when((F.col("words") >= LARGE_WORDS) | (F.col("files") >= LARGE_FILES), "large"))


def strip_frontmatter(text: Column) -> Column:
    """A leading block between lines of three dashes goes."""
    return F.regexp_replace(text, r"(?s)^---\r?\n.*?\n---\r?\n", "")


def content_hash(path: Column, text: Column) -> Column:
    body = F.when(F.lower(extension(path)).isin(".md", ".mdx"), strip_frontmatter(text)).otherwise(text)
    return F.sha2(F.concat(path, F.lit("\x00"), body).cast("binary"), 256)


def not_cached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose hash the cache table (hash, …) lacks: what an incremental run extracts."""
    return files.withColumn("hash", content_hash(F.col("path"), F.coalesce("text", F.lit("")))).join(cache.select("hash"), "hash", "left_anti")
