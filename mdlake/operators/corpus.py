"""The corpus: documents, harvested references, resolved edges and graph queries.

Edges come from three harvests, frontmatter relationships, ``ix://`` references
and relative links; they are resolved by a left equi-join with the members'
identifiers and collapsed by ``(member, source, target, type)``. Identifier
tables are small next to the corpus or not: the planner chooses the join.

A corpus parses its texts once: what the rules need of a document, its header
and its references, is written as a narrow table without the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mdlake.functions import text as t
from mdlake.operators import parse
from mdlake.shared import written

_RELATIONSHIPS = "array<struct<target:string,type:string>>"


def documents(sources: DataFrame, member: str = "") -> DataFrame:
    """``member, path, key, id, type, object, fm_json, body, raw`` of the documents.

    The key is the identifier, else the UUID, else the path.
    """
    d = parse.members(parse.with_header(sources))
    d = d.withColumns({"id": F.nullif(parse.fm("id"), F.lit("")), "uuid": parse.fm("uuid"), "type": parse.fm("type"), "object": parse.fm("object")})
    return d.select(F.lit(member).alias("member"), "path", F.coalesce("id", "uuid", "path").alias("key"), "id", "type", "object", "fm_json", "body", "raw")


def rejected(sources: DataFrame) -> DataFrame:
    """Diagnostics of files that are no documents."""
    d = parse.with_header(sources).where("fm_status <> 'present'")
    return d.select("path", F.when(F.col("fm_status") == "malformed", "malformed-frontmatter").otherwise("document-without-frontmatter").alias("diagnostic"))


def first_wins(docs: DataFrame) -> DataFrame:
    """Documents with ``is_first``: the first by path of each identifier and member."""
    w = W.partitionBy("member", "id").orderBy("path")
    return docs.withColumn("is_first", F.col("id").isNull() | (F.row_number().over(w) == 1))


def duplicates(docs: DataFrame) -> DataFrame:
    return first_wins(docs).where("NOT is_first").select("member", "id", "path").orderBy("member", "id", "path")


def relationships(docs: DataFrame) -> DataFrame:
    """Frontmatter relationships; the default verb is ``references``, and one without target is skipped."""
    r = docs.select("member", F.col("key").alias("source"), "path", F.explode(_found(docs, "relationships")).alias("r")).where("r.target IS NOT NULL AND r.target <> ''")
    return r.select("member", "source", "path", F.col("r.target").alias("reference"), F.coalesce("r.type", F.lit("references")).alias("edge_type"), F.lit(True).alias("authored"))


#: Two or more segments, each with a letter or digit; possessive, so that a longer path isn't cut to fit.
_IX = r"ix://(?:[\w.-]*[A-Za-z0-9][\w.-]*+/)+[\w.-]*[A-Za-z0-9](?:[\w-]|\.(?=[\w-]))*+(?!/)"


_LINK = r"(?<!!)\[[^\]]*\]\(\s*<?((?!\w+:)[^)\s>#?]+\.md)(?:[#?][^)\s>]*)?>?(?:\s+[^)]*)?\)"


def _found(docs: DataFrame, name: str) -> Column:
    """A harvest of :func:`harvested` documents, or taken now from their texts."""
    if name in docs.columns:
        return F.col(name)
    if name == "relationships":
        return F.from_json(parse.fm("relationships"), _RELATIONSHIPS)
    return F.array_distinct(F.regexp_extract_all("body", F.lit(_IX), 0) if name == "ix" else F.regexp_extract_all("body", F.lit(_LINK), 1))


def harvested(docs: DataFrame) -> DataFrame:
    """The narrow table of documents, without texts: their header fields and
    references. It is written, so that each text is parsed once."""
    head = [c for c in docs.columns if c not in ("body", "raw")]
    rows = docs.select(*head, *[_found(docs, n).alias(n) for n in ("relationships", "ix", "links")])
    return written(rows, "documents")


def ix_references(docs: DataFrame) -> DataFrame:
    r = docs.select("member", F.col("key").alias("source"), "path", F.explode(_found(docs, "ix")).alias("reference"))
    return r.select("*", F.lit("references").alias("edge_type"), F.lit(False).alias("authored"))


def link_references(docs: DataFrame) -> DataFrame:
    """Relative links to ``.md`` files; index pages are no sources."""
    r = docs.where(~F.rlike("path", F.lit(r"(?:\A|/)index\.md\z"))).select("member", F.col("key").alias("source"), "path", F.explode(_found(docs, "links")).alias("link"))
    return r.select("member", "source", "path", t.resolve_link(F.col("path"), F.col("link")).alias("target_path"), F.col("link").alias("reference"))


@dataclass
class Corpus:
    """Documents and their edges. ``docs`` have their texts, which whatever reads
    them parses again; ``heads`` are the same documents, narrow and written."""

    docs: DataFrame
    edges: DataFrame
    heads: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.heads is None:
            self.heads = self.docs

    @classmethod
    def of(cls, docs: DataFrame) -> Corpus:
        heads = harvested(docs)
        return cls(docs, written(resolve(heads), "edges"), heads)

    def by_id(self, identifier: str) -> DataFrame:
        return first_wins(self.heads).where((F.col("id") == identifier) & F.col("is_first"))

    def by_qualified_id(self, member: str, identifier: str) -> DataFrame:
        return self.by_id(identifier).where(F.col("member") == member)

    def by_type(self, kind: str) -> DataFrame:
        return self.heads.where(F.col("type") == kind).orderBy("key")

    def referencing(self, key: str) -> DataFrame:
        return self.edges.where((F.col("target") == key) & (F.col("resolution") == "resolved")).orderBy("source", "edge_type")

    def outgoing(self, key: str) -> DataFrame:
        return self.edges.where(F.col("source") == key).orderBy("target", "edge_type")

    def dangling(self) -> DataFrame:
        return self.edges.where("resolution = 'dangling'").orderBy("source", "target", "edge_type")

    def orphans(self, kind: str, missing: str, toward: str | None = None) -> DataFrame:
        """Documents of a type without a resolved edge of a verb (toward a type)."""
        e = self.edges.where((F.col("edge_type") == missing) & (F.col("resolution") == "resolved"))
        if toward is not None:
            to = self.heads.where(F.col("type") == toward).select(F.col("member").alias("target_member"), F.col("key").alias("target"))
            e = e.join(to, ["target_member", "target"], "left_semi")
        return self.heads.where(F.col("type") == kind).join(e.select("member", F.col("source").alias("key")), ["member", "key"], "left_anti").orderBy("key")

    def diagnostics(self) -> DataFrame:
        dup = duplicates(self.heads).select("path", F.concat(F.lit("duplicate-artifact-id "), "id").alias("diagnostic"))
        untyped = self.heads.where("type IS NULL").select("path", F.lit("untyped-artifact").alias("diagnostic"))
        return dup.unionByName(untyped).orderBy("path", "diagnostic")


def resolve(docs: DataFrame) -> DataFrame:
    """``member, source, target, edge_type, resolution, target_member,
    authorities, references, authored`` of each distinct edge.

    Members with identities (``org/repo``) are looked up by the authority of a
    reference, and a foreign authority is dangling under its name; a single
    member without identity ignores authorities. One spelling without foreign
    authority empties ``authorities``.
    """
    ids = first_wins(docs).where("is_first").select(F.col("member").alias("in_member"), F.col("key").alias("in_key"), F.col("path").alias("in_path"))
    named = relationships(docs).unionByName(ix_references(docs)).withColumns({"target": t.target_id(F.col("reference")), "authority": t.authority(F.col("reference"))})
    look_in = F.when((F.col("member") != "") & F.col("authority").isNotNull(), F.col("authority")).otherwise(F.col("member"))
    named = named.withColumn("look_in", look_in).join(ids.drop("in_path"), (F.col("look_in") == F.col("in_member")) & (F.col("target") == F.col("in_key")), "left")
    linked = link_references(docs).join(ids, (F.col("member") == F.col("in_member")) & (F.col("target_path") == F.col("in_path")), "left")
    linked = linked.select("member", "source", F.coalesce("in_key", "target_path").alias("target"), F.lit("references").alias("edge_type"), F.lit(None).cast("string").alias("authority"), "reference", F.lit(False).alias("authored"), "in_key", "in_member", F.col("member").alias("look_in"))
    foreign = F.when((F.col("member") != "") & (F.col("look_in") != F.col("member")), F.col("authority"))
    rows = named.select(*linked.columns).unionByName(linked).withColumn("foreign", foreign)
    out = rows.groupBy("member", "source", "target", "edge_type", "in_member").agg(
        F.when(F.bool_or(F.col("foreign").isNull()), F.array().cast("array<string>")).otherwise(F.array_sort(F.collect_set("foreign"))).alias("authorities"),
        F.array_sort(F.collect_set("reference")).alias("references"),
        F.bool_or("authored").alias("authored"),
    )
    return out.withColumn("resolution", F.when(F.col("in_member").isNull(), "dangling").otherwise("resolved")).withColumnRenamed("in_member", "target_member")


def relation_edges(edges: DataFrame, inverse: dict[str, str]) -> DataFrame:
    """Edges read from both ends: each under its verb, and with ends swapped under the inverse verb."""
    e = edges.select("source", "target", "edge_type", F.lit(True).alias("own"))
    if not inverse:
        return e
    both = {**inverse, **{v: k for k, v in inverse.items()}}
    names = F.create_map(*[F.lit(x) for pair in both.items() for x in pair])
    swapped = e.select(F.col("target").alias("source"), F.col("source").alias("target"), F.element_at(names, F.col("edge_type")).alias("edge_type"), F.lit(False).alias("own"))
    return e.unionByName(swapped.where("edge_type IS NOT NULL"))


def index_gaps(docs: DataFrame) -> DataFrame:
    """``folder, missing``: documents beside an ``index.md`` that its ``## Contents`` (or all of it) doesn't link."""
    at = docs.withColumns({"folder": F.regexp_extract("path", r"\A(.*/)?[^/]*\z", 1), "name": F.substring_index("path", "/", -1)})
    index = at.where("name = 'index.md'")
    contents = F.regexp_extract("body", r"(?s)(?:\A|\n)## Contents[ \t]*\n(.*?)(?=\n## |\z)", 1)
    linked = F.regexp_extract_all(F.when(contents != "", contents).otherwise(F.col("body")), F.lit(r"\]\(([^)\s#]+)"), 1)
    listed = index.select("folder", F.explode(F.transform(linked, lambda x: F.substring_index(x, "/", -1))).alias("name"))
    beside = at.where("name <> 'index.md'").join(index.select("folder"), "folder", "left_semi")
    return beside.join(listed, ["folder", "name"], "left_anti").select("folder", F.col("name").alias("missing")).orderBy("folder", "missing")


def index_versions(docs: DataFrame) -> DataFrame:
    """``path`` of a root ``index.md`` without ``okf_version``."""
    return docs.where((F.col("path") == "index.md") & parse.fm("okf_version").isNull()).select("path")


#: The prefixes of identifiers that prose may mention.
ID_TOKEN = r"\b((?:FR|NFR|StR|US|IT|TC)-\d+(?:-(?:AC|CON|VC)-\d+)?)\b"


def unlinked(docs: DataFrame, pattern: str = ID_TOKEN) -> DataFrame:
    """``path, token, outcome``: identifiers in prose outside code and links.

    One holder: ``link`` (the relative path can be filled in); none:
    ``unresolved``; several: ``ambiguous``. A criterion falls back on its parent.
    """
    prose = F.regexp_replace("body", r"(?s)(?m:^)(```|~~~).*?(?:\n\1|\z)", "")
    prose = F.regexp_replace(F.regexp_replace(prose, r"!?\[[^\]]*\]\([^)]*\)", ""), r"ix://\S+", "")
    found = docs.select("path", "key", F.explode(F.array_distinct(F.regexp_extract_all(prose, F.lit(pattern), 1))).alias("token"))
    found = found.withColumn("holder", F.regexp_replace("token", r"-(?:AC|CON|VC)-\d+\z", "")).where("holder <> key")
    counts = docs.groupBy(F.col("id").alias("holder")).agg(F.count("*").alias("n"), F.min("path").alias("target_path"))
    out = found.join(counts, "holder", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    outcome = F.when(F.col("n") == 1, "link").when(F.col("n") == 0, "unresolved").otherwise("ambiguous")
    return out.select("path", "token", outcome.alias("outcome"), F.when(F.col("n") == 1, relative_path(F.col("path"), F.col("target_path"))).alias("link")).orderBy("path", "token")


def relative_path(source: Column, target: Column) -> Column:
    """The path of ``target`` from the folder of ``source``."""
    a = F.slice(F.split(source, "/"), F.lit(1), F.size(F.split(source, "/")) - 1)
    b = F.split(target, "/")
    same = F.size(F.filter(F.zip_with(F.transform(a, lambda x, i: F.array_join(F.slice(a, F.lit(1), i + 1), "/")), F.transform(a, lambda x, i: F.array_join(F.slice(b, F.lit(1), i + 1), "/")), lambda x, y: x == y), lambda x: x))
    up = F.repeat(F.lit("../"), F.size(a) - same)
    return F.concat(up, F.array_join(F.slice(b, same + 1, F.size(b)), "/"))


def glossary(docs: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Distinct terms: column Term or Name of ``## Terms`` tables, bold bullets of ``## Ubiquitous Language``, and a module's own."""
    s = parse.sections(docs, keep=("path",)).withColumn("h", F.lower(t.normalize_heading(F.col("heading"))))
    cells = parse.table_cells(s.where("h IN ('terms', 'ubiquitous language')"), keep=("path",))
    term = F.coalesce(parse.cell(F.col("headers"), F.col("cells"), "Term"), parse.cell(F.col("headers"), F.col("cells"), "Name"))
    by_table = cells.select(term.alias("term"))
    by_list = s.where("h = 'ubiquitous language'").select(F.explode(parse.bullet_array(F.col("content"), "bold_description")).alias("i")).where("i.description <> ''").select(F.col("i.title").alias("term"))
    out = by_table.unionByName(by_list)
    if extra:
        out = out.unionByName(docs.sparkSession.createDataFrame([(e,) for e in extra], "term string"))
    return out.where("term IS NOT NULL AND term <> ''").distinct().orderBy("term")
