"""Declared relation rules over a corpus: each declaration becomes joins of one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdlake.operators import parse
from mdlake.operators.corpus import relation_edges
from mdlake.shared import drop_written, written


def target_satisfies(tokens: Column, kind: Column, object_: Column, roles: Column) -> Column:
    """Whether a target's type, object type or roles meet one of the accepted tokens; ``*`` or none accept all."""
    return (
        tokens.isNull() | (F.size(tokens) == 0) | F.array_contains(tokens, "*") | F.coalesce(F.array_contains(tokens, kind), F.lit(False))
        | F.coalesce(F.array_contains(tokens, object_), F.lit(False)) | F.coalesce(F.arrays_overlap(tokens, roles), F.lit(False))
    )


def disallowed_edges(docs: DataFrame, relationships: DataFrame, allowed: DataFrame, inverse: dict[str, str]) -> DataFrame:
    """Relationships whose verb a source's type doesn't allow. ``allowed`` has
    ``type, edge_type``; inverse labels of allowed verbs are fine too. Types
    without any row are unconstrained."""
    known = docs.join(allowed.select("type").distinct(), "type", "left_semi")
    labels = allowed
    if inverse:
        names = F.create_map(*[F.lit(x) for pair in inverse.items() for x in pair])
        labels = allowed.unionByName(allowed.select("type", F.element_at(names, F.col("edge_type")).alias("edge_type")).where("edge_type IS NOT NULL"))
    rows = relationships.join(known.select("member", F.col("key").alias("source"), "type"), ["member", "source"])
    return rows.join(labels, ["type", "edge_type"], "left_anti").select("source", "type", "edge_type", "reference").orderBy("source", "edge_type", "reference")


def wrong_target_kinds(docs: DataFrame, edges: DataFrame, accepted: DataFrame, inverse: dict[str, str], roles: dict[str, list[str]] | None = None) -> DataFrame:
    """Resolved edges whose target is of a kind that the declaring type doesn't
    accept. ``accepted`` has ``type, edge_type, tokens``. An inverse verb is
    checked from its other end, and reported as it was written."""
    d = docs.select("key", "type", "object")
    both = relation_edges(edges.where("resolution = 'resolved'"), {v: k for k, v in inverse.items()})
    e = both.join(d.select(F.col("key").alias("source"), "type"), "source").join(d.select(F.col("key").alias("target"), F.col("type").alias("target_type"), F.col("object").alias("target_object")), "target")
    e = e.join(accepted, ["type", "edge_type"])
    role = F.create_map(*[x for k, v in roles.items() for x in (F.lit(k), F.array(*[F.lit(r) for r in v]))]) if roles else None
    held = F.element_at(role, F.col("target_type")) if roles else F.array().cast("array<string>")
    bad = e.where(~target_satisfies(F.col("tokens"), F.col("target_type"), F.col("target_object"), held))
    names = F.create_map(*[F.lit(x) for p in inverse.items() for x in p]) if inverse else None
    written_ = F.when(F.col("own"), F.col("edge_type")).otherwise(F.element_at(names, F.col("edge_type"))) if inverse else F.col("edge_type")
    return bad.select("source", "target", written_.alias("edge_type"), "target_type").orderBy("source", "target", "edge_type")


@dataclass
class RequiredRelation:
    """Documents of ``type`` (that meet ``where``) need an edge of ``verb``.

    ``direction``: outgoing, incoming or either. ``toward``: accepted target
    types. ``when_any``: only documents that have one of these edges.
    """

    name: str
    type: str
    verb: str
    direction: str = "outgoing"
    toward: tuple[str, ...] = ()
    where: str = "true"
    when_any: tuple[str, ...] = ()


def required_gaps(docs: DataFrame, edges: DataFrame, rules: list[RequiredRelation], inverse: dict[str, str] | None = None) -> DataFrame:
    """``rule, key, finding``: ``unsatisfied`` documents, and ``kind-mismatch``
    for own outgoing edges of the verb whose target is of another type."""
    e = relation_edges(edges.where("resolution = 'resolved'"), inverse or {})
    kinds = docs.select(F.col("key").alias("other"), F.col("type").alias("other_type"))
    out = None
    for rule in rules:
        obliged = docs.where((F.col("type") == rule.type) & F.expr(rule.where))
        if rule.when_any:
            obliged = obliged.join(e.where(F.col("edge_type").isin(*rule.when_any)).select(F.col("source").alias("key")), "key", "left_semi")
        verb = e.where(F.col("edge_type") == rule.verb)
        ends = []
        if rule.direction in ("outgoing", "either"):
            ends.append(verb.select(F.col("source").alias("key"), F.col("target").alias("other"), "own"))
        if rule.direction in ("incoming", "either"):
            ends.append(verb.select(F.col("target").alias("key"), F.col("source").alias("other"), F.lit(False).alias("own")))
        near = ends[0] if len(ends) == 1 else ends[0].unionByName(ends[1])
        near = near.join(kinds, "other")
        fits = F.col("other_type").isin(*rule.toward) if rule.toward else F.lit(True)
        gaps = obliged.join(near.where(fits), "key", "left_anti").select("key", F.lit("unsatisfied").alias("finding"))
        wrong = obliged.select("key").join(near.where(F.col("own") & ~fits), "key").select("key", F.lit("kind-mismatch").alias("finding")).distinct()
        found = gaps.unionByName(wrong).select(F.lit(rule.name).alias("rule"), "key", "finding")
        out = found if out is None else out.unionByName(found)
    return out.orderBy("rule", "key", "finding")


def dead_declarations(docs: DataFrame, kinds: list[str]) -> DataFrame:
    """Declared kinds that no document has: one aggregation for all of them."""
    declared = docs.sparkSession.createDataFrame([(k,) for k in kinds], "type string")
    return declared.join(docs.select("type").distinct(), "type", "left_anti").orderBy("type")


def cycles(edges: DataFrame, verb: str) -> DataFrame:
    """``label, hops`` of each cycle of resolved edges of a verb, however long:
    its smallest node, once a shortest cycle.

    A breadth-first search from all starts at once. Each ``(start, node)`` pair
    is reached once; starts are the smallest of their cycle, so that each is
    followed through larger nodes only, until its cycle closes or it reaches no
    new node. A round is a few jobs, and there are as many as the longest search
    has hops; a ring of n nodes has about n * n / 2 pairs.
    """
    e = edges.where((F.col("edge_type") == verb) & (F.col("resolution") == "resolved")).select("source", "target").distinct()
    e = written(e, "cycles")
    # Only nodes with edges both ways can be on a cycle: chains are taken off from both ends.
    n = e.count()
    while n:
        less = e
        for _ in range(3):
            less = less.join(less.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(less.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        e, before = written(less.select("source", "target"), "cycles"), n
        n = e.count()
        if n == before:
            break
    seen = new = written(e.where("target >= source").select(F.col("source").alias("start"), F.col("target").alias("node"), F.lit(1).alias("hops")), "cycles")
    parts, hops = [seen], 1
    while new.limit(1).count():
        hops += 1
        closed = seen.where("node = start").select("start")
        step = new.join(closed, "start", "left_anti").join(e, F.col("node") == F.col("source")).where("target >= start").select("start", F.col("target").alias("node")).distinct()
        new = written(step.join(seen, ["start", "node"], "left_anti").select("start", "node", F.lit(hops).alias("hops")), "cycles")
        parts.append(new)
        seen = seen.unionByName(new)
        if hops % 10 == 0:
            seen = written(seen.coalesce(e.sparkSession.sparkContext.defaultParallelism), "cycles")
            drop_written(*parts[:-1])  # the last one is the next round's start
            parts = [seen, new]
    return seen.where("node = start").select(F.col("start").alias("label"), "hops").orderBy("label")


@dataclass
class FlowRule:
    """Subjects of a type, paths of ``(verb, direction, kind or None)`` hops, and
    a predicate over the frontmatter at the end. All paths of ``match`` must
    reach such a document, none of ``unless_any`` may."""

    name: str
    type: str
    match: list[tuple[list[tuple[str, str, str | None]], str]] = field(default_factory=list)
    unless_any: list[tuple[list[tuple[str, str, str | None]], str]] = field(default_factory=list)
    remediation: str = ""


def _reach(docs: DataFrame, edges: DataFrame, subjects: DataFrame, hops: list, predicate: str) -> DataFrame:
    """Subjects from which a path leads to a document that meets the predicate."""
    e = edges.where("resolution = 'resolved'")
    at = subjects.select("key", F.col("key").alias("here"))
    for verb, direction, kind in hops:
        a, b = ("source", "target") if direction == "outgoing" else ("target", "source")
        step = e.where(F.col("edge_type") == verb).select(F.col(a).alias("here"), F.col(b).alias("there"))
        at = at.join(step, "here").select("key", F.col("there").alias("here")).distinct()
        if kind is not None:
            at = at.join(docs.where(F.col("type") == kind).select(F.col("key").alias("here")), "here", "left_semi")
    end = docs.where(F.expr(predicate)).select(F.col("key").alias("here"))
    return at.join(end, "here", "left_semi").select("key").distinct()


def flow_findings(docs: DataFrame, edges: DataFrame, rules: list[FlowRule]) -> DataFrame:
    """``rule, key, remediation`` of the subjects that a rule fires for."""
    out = None
    for rule in rules:
        hit = docs.where(F.col("type") == rule.type).select("key")
        for hops, predicate in rule.match:
            hit = hit.join(_reach(docs, edges, hit, hops, predicate), "key", "left_semi")
        for hops, predicate in rule.unless_any:
            hit = hit.join(_reach(docs, edges, hit, hops, predicate), "key", "left_anti")
        found = hit.select(F.lit(rule.name).alias("rule"), "key", F.lit(rule.remediation).alias("remediation"))
        out = found if out is None else out.unionByName(found)
    return out.orderBy("rule", "key")


def stated(value: Column) -> Column:
    """Null, blank and empty values are not stated."""
    return value.isNotNull() & ~F.rlike(value, F.lit(r"\A\s*\z")) & ~value.isin("[]", "{}")


def missing_fields(docs: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """``key, field``: required frontmatter fields, by type, that aren't stated."""
    out = None
    for kind, names in required.items():
        d = docs.where(F.col("type") == kind)
        for name in names:
            rows = d.where(~stated(parse.fm(name))).select("key", F.lit(name).alias("field"))
            out = rows if out is None else out.unionByName(rows)
    return out.orderBy("key", "field")


def field_consistency(docs: DataFrame, edges: DataFrame, verb: str, source_rank: Column, target_rank: Column) -> DataFrame:
    """Edges of a verb whose source ranks below its target. Ranks are columns
    over ``docs`` (null: not ranked, which is silent)."""
    a = docs.select(F.col("key").alias("source"), source_rank.alias("rank_from"))
    b = docs.select(F.col("key").alias("target"), target_rank.alias("rank_to"))
    e = edges.where((F.col("edge_type") == verb) & (F.col("resolution") == "resolved")).select("source", "target")
    return e.join(a, "source").join(b, "target").where("rank_from < rank_to").orderBy("source", "target")


def rank(value: Column, ordered: list[str]) -> Column:
    at = F.array_position(F.array(*[F.lit(x) for x in ordered]), value)
    return F.when(at > 0, at)


def vocabulary_coverage(values: DataFrame, claims: DataFrame) -> DataFrame:
    """``value, state``: owned if some claim owns it, else excused, else unowned.
    ``claims`` has ``value, excused``."""
    c = claims.groupBy("value").agg(F.bool_or(~F.col("excused")).alias("owned"))
    state = F.when(F.col("owned"), "owned").when(F.col("owned").isNotNull(), "excused").otherwise("unowned")
    return values.join(c, "value", "left").select("value", state.alias("state")).orderBy("value")


def verification(backed: Column, total: Column) -> Column:
    """The standing of a document by its backed criteria."""
    return F.when(total == 0, "not-tracked").when(backed == total, "verified").when(backed == 0, "unverified").otherwise("partial")


def relation_report(docs: DataFrame, edges: DataFrame, obliged: str, verb: str, toward: str, standing: DataFrame) -> DataFrame:
    """``key, state, linked, dangling``: whether each obliged document is
    covered, by which documents with what standing, and what dangles.
    ``standing`` has ``key, backed, total``."""
    e = edges.where(F.col("edge_type") == verb)
    good = e.where("resolution = 'resolved'").join(docs.where(F.col("type") == toward).select(F.col("key").alias("target")), "target", "left_semi")
    s = standing.select(F.col("key").alias("target"), verification(F.col("backed"), F.col("total")).alias("verification"))
    linked = good.join(s, "target", "left").groupBy(F.col("source").alias("key")).agg(
        F.array_sort(F.collect_list(F.struct("target", F.coalesce("verification", F.lit("not-tracked")).alias("verification")))).alias("linked")
    )
    loose = e.where("resolution = 'dangling'").groupBy(F.col("source").alias("key")).agg(F.array_sort(F.collect_set("target")).alias("dangling"))
    out = docs.where(F.col("type") == obliged).select("key").join(linked, "key", "left").join(loose, "key", "left")
    return out.select("key", F.when(F.col("linked").isNull(), "uncovered").otherwise("covered").alias("state"), "linked", "dangling").orderBy("key")


def relation_summary(report: DataFrame) -> DataFrame:
    """Counts of a report by state and by verification of what is linked."""
    states = report.groupBy(F.lit("state").alias("kind"), F.col("state").alias("name")).count()
    seen = report.select(F.explode("linked").alias("l")).groupBy(F.lit("verification").alias("kind"), F.col("l.verification").alias("name")).count()
    return states.unionByName(seen).withColumnRenamed("count", "n").orderBy("kind", "name")


def design_matrix(criteria: DataFrame, realized: DataFrame) -> DataFrame:
    """``criterion, elements``: design elements that realize each criterion, sorted; empty where none does."""
    r = realized.groupBy("criterion").agg(F.array_sort(F.collect_set("element")).alias("elements"))
    return criteria.join(r, "criterion", "left").select("criterion", F.coalesce("elements", F.array().cast("array<string>")).alias("elements")).orderBy("criterion")
