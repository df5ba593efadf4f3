"""Whole validations: all packs of checks over documents and their corpus, as one table.

``findings`` are long: ``pack, check, key, severity, message``. Rules are
unrolled by type into one union; nothing runs once a document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdlake.functions import text as t
from mdlake.operators import contract, corpus, coverage, extract, parse, prose, relations, symbols
from mdlake.operators.corpus import Corpus
from mdlake.plans.registry import Registry

#: Severities by posture; whatever isn't named is a warning.
POSTURES = {
    "strict": {"dangling-reference": "error", "duplicate-artifact-id": "error", "frontmatter": "error", "missing": "error", "type": "error", "disallowed-edge-type": "warning", "required-relation": "warning"},
    "open": {"frontmatter": "error", "type": "error"},
}


def _shape(rows: DataFrame, pack: str, check: Column | str, message: Column) -> DataFrame:
    name = F.lit(check) if isinstance(check, str) else check
    return rows.select(F.lit(pack).alias("pack"), name.alias("check"), "key", F.coalesce(message, F.lit("")).alias("message"))


def document_findings(docs: DataFrame, registry: Registry) -> list[DataFrame]:
    """Concept shape, frontmatter schema, required content and heading
    uniqueness, by the document's type and its object type; an object type that
    no module has is a finding."""
    out = [_shape(contract.concept_findings(docs).withColumnRenamed("finding", "f"), "concept", F.col("f"), F.col("f"))]
    for name, a in registry.archetypes.items():
        mine = docs.where((F.col("object") if a.object else F.col("type")) == name)
        if a.schema is not None:
            e = mine.select("key", F.explode(contract.schema_errors(F.col("fm_json"), a.schema.root)).alias("e"))
            out.append(_shape(e, "document", "frontmatter", F.concat_ws(" ", "e.pointer", "e.message")))
        if a.extraction and "match" in a.extraction:
            required = {k: x for k, x in a.extraction["match"].items() if x.get("required")}
            for field, x in required.items():
                r = extract.extract(mine, {"match": {field: {**x, "required": False}, "_key": {"from": "frontmatter_field", "field": "id"}}})
                status = t.content_status(F.filter(F.array(F.element_at("record", F.lit(field))), lambda v: v.isNotNull()))
                out.append(_shape(r.withColumn("s", status).where("s <> 'substantive'"), "document", F.col("s"), F.lit(field)))
        if a.id_pattern:
            out.append(_shape(mine.where(~F.rlike(F.coalesce("id", F.lit("")), F.lit(a.id_pattern))), "document", "id-pattern", F.col("id")))
    known = [n for n, a in registry.archetypes.items() if a.object]
    out.append(_shape(docs.where(F.col("object").isNotNull() & ~F.col("object").isin(*known)), "document", "unknown-object-type", F.col("object")))
    repeated = contract.repeated_headings(parse.sections(docs, keep=("key",)), ("key",))
    out.append(_shape(repeated, "document", "duplicate-heading", F.col("heading")))
    return out


#: The sections that hold requirements, by type, and the column of
#: those that are tables; the sections that hold criteria.
REQUIREMENTS = {"FR": {"Description": None, "Behavior": None, "Constraints": "Constraint"}, "NFR": {"Statement": None}, "StR": {"Stakeholder Need": None}}
CRITERIA = {"FR": "Acceptance Criteria", "NFR": "Acceptance Criteria", "StR": "Validation Criteria"}


def statements(docs: DataFrame) -> DataFrame:
    """``key, kind, row_id, line, statement``: requirements, a sentence with a modal
    verb or a table cell each, and criteria. ``line`` is the body's, from 0."""
    s = parse.sections(docs.where(F.col("type").isin(*REQUIREMENTS)), keep=("key", "type"))
    s = s.withColumn("h", F.lower(t.normalize_heading(F.col("heading")))).select("key", "type", "h", "start_line", "content")

    def where(pairs: list[tuple[str, str]]) -> Column:
        hit = F.lit(False)
        for kind, heading in pairs:
            hit = hit | ((F.col("type") == kind) & (F.col("h") == heading.lower()))
        return hit

    modal = r"(?iU)\b(?:shall|should|must|may)\b"
    prose_ = s.where(where([(k, h) for k, x in REQUIREMENTS.items() for h, c in x.items() if c is None]))
    seen = prose_.select("key", "start_line", F.explode(parse.visible_lines(F.col("content"))).alias("v")).where(~F.rlike("v.text", F.lit(r"\A\s*[>|]")))
    text = F.regexp_replace("v.text", r"\A\s*(?:[-*]\s|\d+\.\s)?\s*", "")
    parts = seen.select("key", (F.col("start_line") + 1 + F.col("v.line")).alias("line"), F.explode(F.split(text, r"(?<=[.!?])\s+")).alias("statement"))
    out = parts.where(F.rlike("statement", F.lit(modal))).select("key", F.lit("requirement").alias("kind"), F.lit(None).cast("string").alias("row_id"), "line", "statement")
    tables = [("requirement", [(k, h) for k, x in REQUIREMENTS.items() for h, c in x.items() if c], "Constraint"), ("criterion", list(CRITERIA.items()), "Criteria")]
    for kind, pairs, column in tables:
        c = parse.table_cells(s.where(where(pairs)), keep=("key", "start_line")).where("table_no = 0")
        get = lambda name: t.strip(parse.cell(F.col("headers"), F.col("cells"), name))
        rows = c.select("key", F.lit(kind).alias("kind"), get("ID").alias("row_id"), (F.col("start_line") + 1 + F.col("line")).alias("line"), get(column).alias("statement"))
        out = out.unionByName(rows.where("statement <> ''"))
    return out


def grammar_findings(docs: DataFrame, lexicon: tuple[str, ...] = ()) -> list[DataFrame]:
    """What the prose grammars find in the requirements and criteria of documents."""
    s = statements(docs)
    packs = (("ears", "requirement", prose.ears_checks(F.col("statement"), lexicon)), ("quality", "requirement", prose.quality_checks(F.col("statement"))), ("ac", "criterion", prose.criterion_checks(F.col("statement"), lexicon)))
    out = []
    for pack, kind, checks in packs:
        f = s.where(F.col("kind") == kind).select("key", "statement", F.explode(checks).alias("c"))
        out.append(_shape(f, "grammar", F.concat(F.lit(pack + ":"), "c"), t.truncated(t.strip(F.col("statement")), 157)))
    return out


def corpus_findings(c: Corpus, registry: Registry, required: list[relations.RequiredRelation] = ()) -> list[DataFrame]:
    """Dangling references (but foreign authorities), repeated identifiers,
    disallowed verbs, wrong target kinds, index gaps and required relations."""
    key = lambda df: df.withColumnRenamed("source", "key")
    e = c.edges
    foreign = (F.size("authorities") > 0) & (F.col("member") != "")
    out = [
        _shape(key(e.where((F.col("resolution") == "dangling") & ~foreign)), "refs", "dangling-reference", F.col("target")),
        _shape(corpus.duplicates(c.heads).withColumnRenamed("id", "key"), "bundle", "duplicate-artifact-id", F.col("path")),
        _shape(corpus.index_versions(c.heads).select(F.col("path").alias("key")), "bundle", "index-okf-version", F.col("key")),
        _shape(corpus.index_gaps(c.docs).withColumnRenamed("folder", "key"), "bundle", "index-completeness", F.col("missing")),
    ]
    allowed = registry.allowed_table(c.docs.sparkSession)
    inverse = registry.inverse_verbs()
    out.append(_shape(key(relations.disallowed_edges(c.heads, corpus.relationships(c.heads), allowed.select("type", "edge_type"), inverse)), "edges", "disallowed-edge-type", F.col("edge_type")))
    out.append(_shape(key(relations.wrong_target_kinds(c.heads, e, allowed, inverse, registry.role_map())), "edges", "edge-target-kind", F.col("target")))
    if required:
        out.append(_shape(relations.required_gaps(c.heads, e, list(required), inverse), "trace", "required-relation", F.concat_ws(" ", "rule", "finding")))
    return out


def validate(c: Corpus, registry: Registry, posture: str = "strict", required: list[relations.RequiredRelation] = (), severities: dict[str, str] | None = None) -> DataFrame:
    """All findings of a corpus, with severities by posture, module and caller, sorted."""
    parts = document_findings(c.docs, registry) + grammar_findings(c.docs, tuple(registry.vocab["lexicon"])) + corpus_findings(c, registry, required)
    everything = reduce(DataFrame.unionByName, parts).distinct()
    levels = {**POSTURES[posture], **registry.vocab["grammar_severity"], **(severities or {})}
    return contract.routed(everything, levels).orderBy("pack", "check", "key", "message")


def coverage_tables(docs: DataFrame, sources: DataFrame, targets: list[coverage.TraceTarget], rows: tuple[str, str, str], status_column: str, statuses: coverage.Statuses, forms: list[dict]) -> dict[str, DataFrame]:
    """The coverage report's tables: minted targets, classified reference rows,
    groups and totals, untracked tags, shared ids, census, kinds of ids.

    ``rows`` is the type, section and column of the reference rows; a row is
    backed if any id that it answers for is bound by evidence.
    """
    s = symbols.extract(sources)
    b = symbols.bind(s, forms)
    minted = coverage.mint(docs, targets)
    refs = coverage.references(docs, *rows)
    verified = b.where("relation = 'verifies'").select(F.col("id").alias("reference"), F.lit(True).alias("bound")).distinct()
    own = parse.cell(F.col("headers"), F.col("cells"), 0)
    per_row = (
        refs.withColumn("row_id", own).join(verified, "reference", "left").groupBy("document", "path", "table_no", "row_no", "row_id", "headers", "cells")
        .agg(F.bool_or(F.coalesce("bound", F.lit(False))).alias("any_bound"))
        .join(verified.toDF("row_id", "own_bound"), "row_id", "left")
        .withColumn("backed", F.coalesce("own_bound", F.lit(False)) | F.col("any_bound"))
    )
    status = statuses.classify(parse.cell(F.col("headers"), F.col("cells"), status_column))
    classed = per_row.withColumn("status", status).withColumn("finding", coverage.row_finding(F.col("status"), F.col("backed"), F.lit(True)))
    live = classed.where("finding NOT IN ('retired', 'undeclared-status')")
    kinds = minted.select(F.regexp_extract("id", r"\A([A-Za-z]+)", 1).alias("kind")).distinct()
    return {
        "minted": minted, "rows": classed.select("document", "row_id", "status", "backed", "finding"), "groups": coverage.groups_and_totals(live, "document"),
        "untracked": coverage.untracked(b, minted), "shared": coverage.shared_ids(b), "census": symbols.census(s, b), "id_kinds": kinds.orderBy("kind"),
    }
