"""File trees: ignore-aware discovery on the driver, contents by Spark."""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """A glob as an anchored regular expression: ``**`` crosses folders, ``*`` and ``?`` don't."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
        elif c == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(glob_regex(g)[2:-2] for g in glob[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return rf"\A{out}\z"


class IgnoreRules:
    """The ignore rules of one folder, as git reads them: later rules win, ``!``
    takes back, ``/`` at the end means folders, one within anchors."""

    def __init__(self, lines: list[str]):
        self.rules = []
        for line in lines:
            line = line.rstrip("\n").rstrip("\r")
            line = line if line.endswith("\\ ") else line.rstrip(" ")
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            body = line[1:] if keep or line.startswith("\\") else line
            folders = body.endswith("/")
            body = body.rstrip("/")
            anchored = "/" in body
            pattern = glob_regex(body.lstrip("/") if anchored else "**/" + body)
            self.rules.append((re.compile(pattern.replace(r"\z", r"\Z")), keep, folders))

    def verdict(self, relative: str, is_dir: bool) -> bool | None:
        """Ignored, taken back, or None where no rule says."""
        out = None
        for pattern, keep, folders in self.rules:
            if (is_dir or not folders) and pattern.match(relative):
                out = not keep
        return out


def discover(root: str, extensions: tuple[str, ...] = ("md",), hidden: bool = False, gitignore: bool = True, exclude: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """Sorted paths below ``root`` and diagnostics. Symbolic links aren't
    followed, template folders (``{{…}}``) are left out."""
    if not os.path.isdir(root):
        return [], [f"search path {'is no directory' if os.path.exists(root) else 'is missing'}: {root}"]
    out, notes = [], []
    patterns = [re.compile(glob_regex(g).replace(r"\z", r"\Z")) for g in exclude]

    def walk(folder: str, rules: list[tuple[str, IgnoreRules]]) -> None:
        own = os.path.join(folder, ".gitignore")
        if gitignore and os.path.isfile(own):
            with open(own, encoding="utf-8", errors="replace") as f:
                rules = [*rules, (folder, IgnoreRules(f.readlines()))]
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as error:
            notes.append(f"unreadable: {folder}: {error.strerror}")
            return
        for e in entries:
            if e.is_symlink() or (not hidden and e.name.startswith(".")) or "{{" in e.name:
                continue
            is_dir = e.is_dir()
            said = [v for at, r in rules if (v := r.verdict(os.path.relpath(e.path, at), is_dir)) is not None]
            relative = os.path.relpath(e.path, root)
            if (said and said[-1]) or any(p.match(relative) for p in patterns):
                continue
            if is_dir:
                walk(e.path, rules)
            elif e.name.rpartition(".")[2].lower() in extensions:
                out.append(e.path)

    walk(root, [])
    return out, notes


def read_texts(spark: SparkSession, paths: list[str], root: str | None = None) -> DataFrame:
    """``path, raw`` of files, relative to ``root`` if given; ``raw`` is null where
    a file is no UTF-8."""
    if not paths:
        return spark.createDataFrame([], "path string, raw string")
    d = spark.read.format("binaryFile").load(paths)
    name = F.regexp_replace("path", r"\Afile:/+", "/")
    if root is not None:
        name = F.substring(name, len(os.path.abspath(root)) + 2, 1_000_000)
    return d.select(name.alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("raw"))


def unreadable(texts: DataFrame) -> DataFrame:
    """A ``diagnostic`` for each file that is no UTF-8."""
    return texts.where("raw IS NULL").select(F.concat(F.lit("document-unreadable: "), "path", F.lit(": invalid UTF-8")).alias("diagnostic"))


def load_repo(spark: SparkSession, root: str, **options) -> tuple[DataFrame, DataFrame]:
    """``(sources, diagnostics)`` of the documents below a local folder. A file that
    can't be read as UTF-8 is a diagnostic."""
    paths, notes = discover(root, **options)
    texts = read_texts(spark, paths, root)
    return texts.where("raw IS NOT NULL"), spark.createDataFrame([(n,) for n in notes], "diagnostic string").unionAll(unreadable(texts))


def ignored(path: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Whether the ignore files (``folder, lines``, outer folders first) ignore a path
    below the root or a folder above it."""
    compiled = [(folder, IgnoreRules(lines)) for folder, lines in rules]

    def run(paths: pa.Array) -> pa.Array:
        out = []
        for path in paths.to_pylist():
            parts = path.split("/")
            gone = False
            for n in range(1, len(parts) + 1):
                here = "/".join(parts[:n])
                said = [v for at, r in compiled if (not at or here.startswith(at + "/")) and (v := r.verdict(here[len(at) + 1 if at else 0 :], n < len(parts))) is not None]
                gone = gone or bool(said and said[-1])
            out.append(gone)
        return pa.array(out, pa.bool_())

    return F.arrow_udf(run, "boolean")(path)


def load_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("md",), gitignore: bool = True, exclude: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """As :func:`load_repo`, for any store that Spark reads: it lists the tree itself,
    in parallel, and leaves out names that begin with ``.`` or ``_``. The names of
    folders go through the driver, which looks for their ignore files, and so do
    the lines of these; the files' paths don't."""
    top = root.rstrip("/")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(top)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = store.makeQualified(where).toString().rstrip("/")

    def listed(pattern: str) -> DataFrame:
        d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(top)
        inner = F.substring(F.url_decode(F.replace(F.regexp_replace("path", r"\A([a-z]+):/+", "$1:/"), F.lit("+"), F.lit("%2B"))), len(re.sub(r"\A([a-z]+):/+", r"\1:/", full)) + 2, 1_000_000)
        return d.select(inner.alias("path"), "content")

    found = listed("*.{" + ",".join(sorted({c for x in extensions for c in (x, x.upper())})) + "}")
    found = found.where(~F.contains("path", F.lit("{{")))
    for glob in exclude:
        pattern = glob_regex(glob)
        found = found.where(~F.exists(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/")), lambda p: F.rlike(p, F.lit(pattern))))
    if gitignore:
        parts = F.split("path", "/")
        folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        rules = []
        for r in found.select(F.explode(folders).alias("folder")).distinct().collect():
            own = jvm.org.apache.hadoop.fs.Path("/".join(filter(None, (full, r["folder"], ".gitignore"))))
            if store.exists(own):
                stream = store.open(own)
                rules.append((r["folder"], str(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).splitlines()))
                stream.close()
        if rules:
            found = found.where(~ignored(F.col("path"), sorted(rules, key=lambda r: (r[0].count("/") + bool(r[0]), r[0]))))
    texts = found.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("raw"))
    return texts.where("raw IS NOT NULL"), unreadable(texts)


def text_table(table: DataFrame, key: str, text: str, prefix: str = "") -> DataFrame:
    """A table of texts as sources: ``path, raw``."""
    return table.select(F.concat(F.lit(prefix), F.col(key).cast("string"), F.lit(".md")).alias("path"), F.col(text).alias("raw"))
