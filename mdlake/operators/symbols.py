"""Source symbols: extraction, marker bindings, search and test scepticism.

Python is parsed with ``ast``. Of Rust and TypeScript strings and comments are
told from code, and declarations are followed to their closing brace; shell and
native sources are scanned line by line. None of the four is parsed by a grammar,
which :func:`mdlake.functions.text.language_confidence` says.
"""

from __future__ import annotations

import ast
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from mdlake.functions import text as t
from mdlake.operators._lexer import code_of
from mdlake.sources.files import glob_regex

#: Kinds of symbols that are evidence, and those that are production code.
EVIDENCE = ("test_function", "benchmark", "fuzz_target", "entry_point")
PRODUCTION = ("function", "container")

SYMBOL = "struct<language:string,path:string,qualified_name:string,kind:string,line:int,leading_line:int,end_line:int,container:string,marks:array<struct<text:string,line:int>>,ignored:boolean,id:string>"


def _symbol(language, path, name, kind, line, leading, end, container, marks, ignored):
    return {
        "language": language, "path": path, "qualified_name": name, "kind": kind, "line": line, "leading_line": leading, "end_line": end, "container": container,
        "marks": [{"text": x, "line": n} for x, n in marks], "ignored": ignored, "id": json.dumps([language, path, name, kind], ensure_ascii=False, separators=(",", ":")),
    }


def python_symbols(path: str, source: str) -> list[dict]:
    """Functions, classes and tests: ``test_`` functions, and ``test_`` methods of
    ``Test*`` classes or direct ``TestCase`` subclasses. Only classes are scopes."""
    lines, out = source.split("\n"), []

    def comments(first: int) -> list[tuple[str, int]]:
        found, n = [], first - 1
        while n > 0 and lines[n - 1].lstrip().startswith("#"):
            found.append((lines[n - 1].strip(), n))
            n -= 1
        return found[::-1]

    def visit(body, scope: list[str], test_class: bool) -> None:
        for node in body:
            if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            marks = comments(first) + [("@" + ast.unparse(d), d.lineno) for d in node.decorator_list]
            name = ".".join([*scope, node.name])
            if isinstance(node, ast.ClassDef):
                tests = node.name.startswith("Test") or any(ast.unparse(b).rpartition(".")[2] == "TestCase" for b in node.bases)
                out.append(_symbol("python", path, name, "container", node.lineno, first, node.end_lineno, ".".join(scope) or None, marks, False))
                visit(node.body, [*scope, node.name], tests)
            else:
                is_test = node.name.startswith("test_") and (not scope or test_class)
                ignored = any("skip" in m for m, _ in marks if m.startswith("@"))
                out.append(_symbol("python", path, name, "test_function" if is_test else "function", node.lineno, first, node.end_lineno, ".".join(scope) or None, marks, ignored))

    visit(ast.parse(source).body, [], False)
    return out


_DECLARED = {
    "rust": re.compile(r"\s*(?:#!?\[[^\]]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|async|unsafe|const)\s+|extern\s+(?:\"[^\"]*\"\s+)?)*(?:(fn|struct|enum|trait|mod)\s+(\w+)|impl\b(.*))"),
    "typescript": re.compile(
        r"\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?"
        r"(?:(function|class|interface|enum)\b\s*\*?\s*(\w+)|(x?(?:test|it|describe)|suite)((?:\.\w+)*)(?:\([^()]*\))?\(\s*(['\"`])(.*?)\5)"
    ),
}


def _impl_scope(head: str) -> str | None:
    """The scope of an ``impl``: the plain target type, ``<Type as Trait>`` of a
    trait, or none for a target without a name."""
    head, depth = head.strip(), 0
    if head.startswith("<"):
        for i, c in enumerate(head):
            depth += (c == "<") - (c == ">" and head[i - 1] != "-")
            if not depth:
                head = head[i + 1 :]
                break
    head = re.sub(r"\s+", " ", re.split(r"\bwhere\b|\{", head)[0]).strip()
    trait, is_trait, target = head.rpartition(" for ")
    if is_trait:
        return f"<{target.strip()} as {trait.strip()}>"
    plain = re.match(r"(?:\w+::)*(\w+)", target)
    return plain[1] if plain else None


def _declared(language: str, m: re.Match, line: str, above: str) -> tuple[str | None, str | None, bool, bool]:
    """Kind (none for what only is a scope), name, whether it is ignored, and whether it is a call."""
    if language == "rust":
        if m[1] is None:
            return None, _impl_scope(m[3]), False, False
        test = bool(re.search(r"#\[(?:\w+::)*test\b|#\[rstest\b", above))
        kind = "container" if m[1] != "fn" else "test_function" if test else "benchmark" if "#[bench]" in above else "function"
        return kind, m[2], bool(re.search(r"#\[ignore\b", above)), False
    if m[1]:
        return "function" if m[1] == "function" else "container", m[2], False, False
    chain = m[4].split(".")
    suite = m[3] in ("describe", "suite", "xdescribe") or "describe" in chain
    return "container" if suite else "test_function", line[m.start(6) : m.end(6)], m[3].startswith("x") or "skip" in chain, True


class _Open:
    """A declaration whose end is not met yet: the braces and brackets around it."""

    def __init__(self, scope: str | None, symbol: dict | None, braces: int, brackets: int, call: bool) -> None:
        self.scope, self.symbol, self.braces, self.brackets, self.call, self.entered = scope, symbol, braces, brackets, call, False

    def ends(self, c: str, braces: int, brackets: int) -> bool:
        if self.call:
            return c == ")" and brackets <= self.brackets
        if c == "}":
            return braces < self.braces or (self.entered and braces == self.braces)
        return c == ";" and not self.entered and (braces, brackets) == (self.braces, self.brackets)


def braced_symbols(language: str, path: str, source: str) -> list[dict]:
    """Symbols of Rust or TypeScript; attributes and comments right above are marks.

    A symbol ends with its closing brace, or with a semicolon if it has no body.
    Rust names are qualified by modules, traits and impls; an ``impl`` is a scope,
    but no symbol. A TypeScript suite holds its tests without qualifying them. What
    is not closed ends with the file.
    """
    code, strings = code_of(language, source)
    lines, codes = source.split("\n"), code.split("\n")
    last = max((n for n, x in enumerate(lines, 1) if x.strip()), default=1)
    out, marks, opened, braces, brackets, at = [], [], [], 0, 0, 0
    if language == "typescript":
        out.append(_symbol(language, path, path.rpartition("/")[2], "container", 1, 1, len(lines), None, [], False))
    within = iter(strings)
    span = next(within, None)
    for n, (line, bare_code) in enumerate(zip(lines, codes, strict=True), 1):
        while span and span[1] <= at:
            span = next(within, None)
        quoted = span is not None and span[0] < at  # the line begins inside a string
        m, bare = None if quoted else _DECLARED[language].match(bare_code), line.strip()
        if not m and not quoted and bare and (not bare_code.strip() or bare.startswith(("#[", "#![") if language == "rust" else "@")):
            marks.append((bare, n))
        new = None
        if m:
            own = re.match(r"\s*((?:#!?\[[^\]]*\]\s*)+)", line)
            if language == "rust" and own:
                marks.append((own[1].strip(), n))
            kind, name, ignored, call = _declared(language, m, line, " ".join(x for x, _ in marks))
            container = next((o.scope for o in reversed(opened) if o.scope), None)
            scope = f"{container}::{name}" if language == "rust" and container and name else name or container
            symbol = kind and _symbol(language, path, scope, kind, n, marks[0][1] if marks else n, last, container, marks, ignored)
            if symbol:
                out.append(symbol)
            holds = kind in (None, "container")  # a function is no scope
            new = (m.start(3) if kind is None else m.end(), scope if holds else None, symbol, call)
        if bare and not (marks and marks[-1][1] == n and not m):
            marks = []
        for i, c in enumerate(bare_code + "\n"):
            if new and i == new[0]:
                opened.append(_Open(new[1], new[2], braces, brackets - new[3], new[3]))
                new = None
            if c in "([":
                brackets += 1
            elif c in ")]":
                brackets -= 1
            elif c == "{":
                for o in opened[-1:]:
                    o.entered |= (braces, brackets) == (o.braces, o.brackets)
                braces += 1
            elif c == "}":
                braces -= 1
            elif c != ";":
                continue
            while opened and opened[-1].ends(c, braces, brackets):
                done = opened.pop()
                if done.symbol:
                    done.symbol["end_line"] = n
        at += len(line) + 1
    return out


_SCAN = {
    "shell": (re.compile(r"\s*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)\s*\{?"), ("#",)),
    "native": (re.compile(r"\s*(rule|test|entry)\s+([\w.-]+)"), ("#", "--")),
}


def scanned_symbols(language: str, path: str, source: str) -> list[dict]:
    """Symbols by a line scanner; comments right above are marks, and a symbol ends
    before the next."""
    pattern, leads = _SCAN[language]
    lines, out, marks = source.split("\n"), [], []
    for n, line in enumerate(lines, 1):
        bare = line.strip()
        m = pattern.match(line)
        if bare.startswith(leads) and not m:
            marks.append((bare, n))
            continue
        if m:
            name = m[1] if language == "shell" else m[2]
            kind = "function" if language == "shell" else {"test": "test_function", "entry": "entry_point"}.get(m[1], "function")
            out.append(_symbol(language, path, name, kind, n, marks[0][1] if marks else n, n, None, marks, False))
        if bare:
            marks = []
    for a, b in zip(out, [*out[1:], None], strict=True):
        a["end_line"] = max(a["end_line"], (b["leading_line"] - 1) if b else len(lines))
    if language == "shell":
        tags = [(x.strip(), i) for i, x in enumerate(lines, 1) if x.strip().startswith("#") and not x.startswith("#!")]
        out.append(_symbol(language, path, path.rpartition("/")[2], "entry_point", 1, 1, len(lines), None, tags, False))
    return out


def extract_file(path: str, language: str | None, source: str) -> list[dict]:
    """Symbols of one file; a file that can't be parsed has none."""
    try:
        if language == "python":
            return python_symbols(path, source)
        if language in _DECLARED:
            return braced_symbols(language, path, source)
        return scanned_symbols(language, path, source) if language in _SCAN else []
    except (SyntaxError, ValueError, RecursionError):
        return []


def extract(files: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """Symbols of ``files`` (``path, source``), without excluded globs; filtered before any parsing."""
    rows = files.withColumn("language", t.language_of(F.col("path"))).where("language IS NOT NULL")
    for g in exclude:
        rows = rows.where(~F.rlike("path", F.lit(glob_regex(g))))
    kind = to_arrow_type(DataType.fromDDL(f"array<{SYMBOL}>"))

    def extracted(paths: pa.Array, languages: pa.Array, sources: pa.Array) -> pa.Array:
        parts = zip(paths.to_pylist(), languages.to_pylist(), sources.to_pylist(), strict=True)
        return pa.array([extract_file(p, g, s or "") for p, g, s in parts], kind)

    return rows.select(F.explode(F.arrow_udf(extracted, f"array<{SYMBOL}>")("path", "language", "source")).alias("s")).select("s.*")


def bare_name(qualified: Column) -> Column:
    return F.substring_index(F.substring_index(qualified, "::", -1), ".", -1)


def bind(symbols: DataFrame, forms: list[dict]) -> DataFrame:
    """``id, relation, path, symbol, line, ignored`` of trace ids in marks.

    A form has a ``pattern`` whose group 1 holds ids (split on commas), and may
    name ``languages`` and ``kinds``. Evidence verifies, production implements.
    Forms are unrolled into one array expression: no join, one scan.
    """
    relation = F.when(F.col("kind").isin(*EVIDENCE), "verifies").when(F.col("kind").isin(*PRODUCTION), "implements")
    m = symbols.withColumn("m", F.explode("marks"))
    parts = []
    for f in forms:
        ok = F.lit(True)
        if "languages" in f:
            ok = ok & F.col("language").isin(*f["languages"])
        if "kinds" in f:
            ok = ok & F.col("kind").isin(*f["kinds"])
        hits = F.flatten(F.transform(F.regexp_extract_all(F.col("m.text"), F.lit(f["pattern"]), 1), lambda g: F.transform(F.split(g, ","), lambda x: F.regexp_replace(x, r"\A[\s\"']+|[\s\"']+\z", ""))))
        parts.append(F.when(ok, hits).otherwise(F.array().cast("array<string>")))
    ids = F.array_distinct(F.filter(F.flatten(F.array(*parts)), lambda x: x != ""))
    return m.select(F.explode(ids).alias("id"), relation.alias("relation"), "path", F.col("qualified_name").alias("symbol"), F.col("m.line").alias("line"), "ignored").where("relation IS NOT NULL").distinct()


def census(symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """Per language: candidates, tagged and bound symbols."""
    held = bindings.select("path", F.col("symbol").alias("qualified_name")).distinct().withColumn("bound", F.lit(True))
    j = symbols.where(F.col("kind").isin(*EVIDENCE, *PRODUCTION)).join(held, ["path", "qualified_name"], "left")
    return j.groupBy("language").agg(F.count("*").alias("candidates"), F.count_if(F.size("marks") > 0).alias("tagged"), F.count_if("bound").alias("bound")).orderBy("language")


def language_counts(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("language").agg(F.count("*").alias("n")).orderBy("language")


def fold_id(identifier: Column) -> Column:
    """Compared in search: lower case, zero padding of numbers dropped, segments kept."""
    return F.regexp_replace(F.lower(identifier), r"(?<=-|\A)0+(?=\d)", "")


def search(bindings: DataFrame, symbols: DataFrame, *, identifier: str | None = None, symbol: str | None = None, path: str | None = None) -> DataFrame:
    """Bindings by id, by symbol (qualified or bare name) or by file."""
    out = bindings
    if identifier is not None:
        out = out.where(fold_id(F.col("id")) == fold_id(F.lit(identifier)))
    if symbol is not None:
        out = out.where((F.col("symbol") == symbol) | (bare_name(F.col("symbol")) == symbol))
    if path is not None:
        out = out.where(F.col("path") == path)
    return out.orderBy("id", "path", "symbol", "line")


def symbol_nodes(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph records: nodes of symbols and files, edges ``defined_in`` and ``contains``."""
    own = symbols.select("id", F.lit("symbol").alias("kind"), F.col("qualified_name").alias("name"))
    file_id = t.stable_id(F.lit("file"), F.col("path"))
    files = symbols.select(file_id.alias("id"), F.lit("file").alias("kind"), F.col("path").alias("name")).distinct()
    defined = symbols.select(F.col("id").alias("source"), file_id.alias("target"), F.lit("defined_in").alias("edge_type"))
    inner = symbols.where("container IS NOT NULL").select("path", "language", F.col("container").alias("name"), F.col("id").alias("target"))
    outer = symbols.where("kind = 'container'").select("path", F.col("qualified_name").alias("name"), F.col("id").alias("source"))
    contains = inner.join(outer, ["path", "name"]).select("source", "target", F.lit("contains").alias("edge_type"))
    return own.unionByName(files), defined.unionByName(contains).distinct()


def similar_sets(a: DataFrame, b: DataFrame, floor: float) -> DataFrame:
    """``a, b, score`` of rows (``id, t``: a set of tokens) of two tables whose sets
    have a Jaccard similarity of ``floor`` or more.

    Only the rarest tokens of a set are looked up: of n tokens in the order of
    their frequency, two such sets share one of the first ``n - ceil(floor * n) + 1``.
    So a frequent token makes no pairs but of sets that have little else, and no
    pair is missed. Rounding can't hide one: the prefix is one longer than needed.
    """
    sides = [(x.select(F.col("id").alias(n), F.col("t").alias(f"t_{n}")), n) for x, n in ((a, "a"), (b, "b"))]
    tokens = [x.select(n, F.size(f"t_{n}").alias("n"), F.explode(f"t_{n}").alias("token")) for x, n in sides]
    seen = tokens[0].select("token").unionAll(tokens[1].select("token")).groupBy("token").agg(F.count("*").alias("seen"))
    prefixes = []
    for rows, (_, n) in zip(tokens, sides, strict=True):
        ordered = rows.join(seen, "token").groupBy(n).agg(F.array_sort(F.collect_list(F.struct("seen", "token"))).alias("o"), F.first("n").alias("n"))
        length = F.least(F.col("n"), F.col("n") - F.ceil(F.lit(floor) * F.col("n")).cast("int") + 2)
        prefixes.append(ordered.select(n, F.explode(F.slice("o", F.lit(1), length)).alias("o")).select(n, F.col("o.token").alias("token")))
    pairs = prefixes[0].join(prefixes[1], "token").select("a", "b").distinct()
    out = pairs.join(sides[0][0], "a").join(sides[1][0], "b").withColumn("score", t.jaccard(F.col("t_a"), F.col("t_b")))
    return out.where(F.col("score") >= floor).select("a", "b", "score")


def copied_oracles(symbols: DataFrame, sources: DataFrame, floor: float = 0.75, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """Test functions whose tokens are much like those of a production function."""
    body = symbols.join(sources, "path").withColumn("text", F.array_join(F.slice(F.split("source", "\n"), F.col("line"), F.greatest(F.col("end_line") - F.col("line") + 1, F.lit(1))), "\n"))
    b = body.select("id", "kind", t.tokens(F.col("text"), stop_words).alias("t"))
    hit = similar_sets(b.where(F.col("kind").isin(*EVIDENCE)), b.where("kind = 'function'"), floor)
    return hit.select(F.col("a").alias("test"), F.col("b").alias("function"), "score").orderBy("test", "function")


def vacuous_tests(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """Tests all of whose assertions stand behind a narrowing guard (``if``)."""
    lines = F.slice(F.split("source", "\n"), F.col("line") + 1, F.greatest(F.col("end_line") - F.col("line"), F.lit(0)))
    d = symbols.where(F.col("kind") == "test_function").join(sources, "path").withColumn("l", lines)
    asserts = F.filter("l", lambda x: F.rlike(x, F.lit(r"\b(?:assert\w*|expect)\b")))
    guard = F.exists("l", lambda x: F.rlike(x, F.lit(r"\A\s*if\b")))
    least = F.array_min(F.transform(F.filter("l", lambda x: F.rlike(x, F.lit(r"\S"))), lambda x: F.length(F.regexp_extract(x, r"\A(\s*)", 1))))
    deep = F.forall(asserts, lambda x: F.length(F.regexp_extract(x, r"\A(\s*)", 1)) > least)
    return d.where((F.size(asserts) > 0) & guard & deep).select("id", "path").orderBy("id")
