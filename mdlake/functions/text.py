"""String and path expressions. All are plain Catalyst columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rx(pattern: str) -> str:
    """A pattern with Unicode classes; write ``\\z`` for the end, as Java's ``$`` matches before a last newline."""
    return "(?U)" + pattern


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind (``trim`` takes spaces only)."""
    return F.regexp_replace(text, rx(r"\A\s+|\s+\z"), "")


def slug(text: Column) -> Column:
    """Lower case, runs of anything but ``[a-z0-9]`` as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"\A-|-\z", "")


def slug_line_id(text: Column, line: Column) -> Column:
    return F.concat(slug(text), F.lit("-L"), line.cast("string"))


def normalize_heading(text: Column) -> Column:
    """A heading without its section number (``2.1 Scope``, ``3. Scope``)."""
    return strip(F.regexp_replace(text, rx(r"\A\d+(?:\.\d+)*\.?\s+"), ""))


def same_heading(a: Column, b: Column) -> Column:
    return F.lower(normalize_heading(a)) == F.lower(normalize_heading(b))


def split_cells(line: Column) -> Column:
    """Cells of a table row: split on unescaped pipes, ``\\|`` as a literal pipe,
    an empty first and last cell dropped."""
    cells = F.transform(F.split(strip(line), r"(?<!\\)\|"), lambda c: strip(F.replace(c, F.lit("\\|"), F.lit("|"))))
    return F.transform(
        F.array(cells),
        lambda x: F.slice(
            x,
            F.when(x[0] == "", 2).otherwise(1),
            F.greatest(F.size(x) - F.when(x[0] == "", 1).otherwise(0) - F.when((F.size(x) > 1) & (F.element_at(x, -1) == ""), 1).otherwise(0), F.lit(0)),
        ),
    )[0]


def is_separator(line: Column) -> Column:
    return F.rlike(line, F.lit(r"\A\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*\z"))


def target_id(target: Column) -> Column:
    """The trailing identifier of an ``ix://`` reference, or of a plain one."""
    return F.substring_index(F.regexp_replace(target, r"\Aix://", ""), "/", -1)


def authority(target: Column) -> Column:
    """``org/repo`` of an ``ix://org/repo/…/id`` reference in lower-case ASCII, or null."""
    found = F.regexp_extract(target, r"\Aix://([^/]+/[^/]+)/", 1)
    return F.when(found != "", F.lower(found))


def normalize_path(path: Column) -> Column:
    """Lexically: without ``.``, and ``..`` taken back; the result never climbs above its root."""

    def step(acc: Column, part: Column) -> Column:
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolve_link(source_path: Column, link: Column) -> Column:
    """Normalized path of a relative link in the document at ``source_path``."""
    folder = F.regexp_extract(source_path, r"(?s)\A(.*/)?[^/]*\z", 1)
    return normalize_path(F.concat(folder, F.regexp_replace(link, r"[#?].*\z", "")))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))


def language_of(path: Column) -> Column:
    """Source language by extension, or null."""
    ext = extension(path)
    return (
        F.when(ext == "rs", "rust").when(ext == "py", "python").when(ext.isin("ts", "tsx"), "typescript").when(ext.isin("sh", "bash"), "shell").when(ext == "qsl", "native")
    )


def language_confidence(language: Column) -> Column:
    """Python is parsed; the others are scanned line by line."""
    return F.when(language == "python", "structural").otherwise("line_heuristic")


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def interpolate(template: Column, fields: Column) -> Column:
    """``{key}`` replaced from a map; unknown keys stay."""
    return F.aggregate(F.map_entries(fields), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def unresolved_fields(template: Column) -> Column:
    """Keys of the ``{key}`` that are left."""
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{([A-Za-z_][\w.-]*)\}"), 1))


def is_whole_placeholder(value: Column) -> Column:
    """A value that is nothing but one ``{{…}}``."""
    return F.rlike(value, F.lit(r"\A\s*\{\{[\s\S]*\}\}\s*\z"))


def is_placeholder(value: Column) -> Column:
    v = F.lower(strip(value))
    return v.isin("placeholder", "none specified") | F.rlike(v, F.lit(r"\A\{\{[^{}]*\}\}\z")) | F.rlike(v, F.lit(r"\A(?:todo|tbd)"))


def content_status(values: Column) -> Column:
    """``missing``, ``empty``, ``placeholder`` or ``substantive`` for an array of values."""
    return (
        F.when(values.isNull() | (F.size(values) == 0), "missing")
        .when(F.forall(values, lambda v: strip(v) == ""), "empty")
        .when(F.forall(values, lambda v: (strip(v) == "") | is_placeholder(v)), "placeholder")
        .otherwise("substantive")
    )


def expand_range(reference: Column, limit: int = 200) -> Column:
    """``A-1..3`` as its members, zero padding kept; a range that is larger
    than ``limit`` or runs backwards stays as it is; annotations in
    parentheses are dropped."""
    plain = strip(F.regexp_replace(reference, r"\([^()]*\)", ""))
    part = lambda i: F.regexp_extract(plain, r"\A(.*?)(\d+)\.\.(\d+)\z", i)
    low, high, width = F.expr("1L") * part(2).try_cast("bigint"), part(3).try_cast("bigint"), F.length(part(2))
    ok = (part(3) != "") & (high >= low) & (high - low < limit)
    members = F.transform(F.sequence(F.coalesce(F.when(ok, low), F.lit(0)), F.coalesce(F.when(ok, high), F.lit(0))), lambda n: F.concat(part(1), F.lpad(n.cast("string"), F.greatest(width, F.length(n.cast("string"))), F.lit("0"))))
    return F.when(ok, members).otherwise(F.array(plain))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.?!]+"), strip), lambda s: s != "")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(rx(r"([\p{L}\p{N}]+)")), 1))


def tokens(text: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Distinct lower-case tokens of two or more characters, without stop words."""
    found = F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9_]+"), lambda t: F.length(t) > 1))
    return F.array_except(found, F.array(*[F.lit(w) for w in stop_words])) if stop_words else found


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def stable_id(*parts: Column) -> Column:
    """A compact JSON array of the parts, the identity of symbols and graph nodes."""
    return F.to_json(F.array(*parts))
