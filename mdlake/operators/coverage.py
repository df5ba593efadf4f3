"""Traceability coverage: minted targets, references, statuses, matrix, totals, metrics."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mdlake.functions import text as t
from mdlake.operators import parse


@dataclass
class TraceTarget:
    """Where identifiers are minted: type, section and table column, or list items or headings that match."""

    type: str
    section: str
    column: str | None = None
    pattern: str = r"\S+"
    source: str = "table"


def _sections_of(docs: DataFrame, type_: str, section: str | None) -> DataFrame:
    s = parse.sections(docs.where(F.col("type") == type_), keep=("path", "key"))
    return s if section is None else s.where(t.same_heading(F.col("heading"), F.lit(section)))


def mint(docs: DataFrame, targets: list[TraceTarget]) -> DataFrame:
    """``id, document, path, line, texts``: identifiers that documents mint."""
    out = None
    for x in targets:
        s = _sections_of(docs, x.type, x.section)
        if x.source == "table":
            c = parse.table_cells(s.select("path", "key", "start_line", "content"), keep=("path", "key", "start_line"))
            value = F.coalesce(parse.cell(F.col("headers"), F.col("cells"), x.column), F.lit(""))
            rows = c.select(value.alias("v"), "path", "key", (F.col("start_line") + 2 + F.col("line")).alias("line"), F.col("cells").alias("texts"))
        elif x.source == "list":
            i = s.select("path", "key", "start_line", F.explode(parse.list_item_array(F.col("content"))).alias("i"))
            rows = i.select(F.col("i.raw").alias("v"), "path", "key", (F.col("start_line") + 2 + F.col("i.line")).alias("line"), F.array("i.raw").alias("texts"))
        else:
            rows = s.select(F.col("heading").alias("v"), "path", "key", (F.col("start_line") + 1).alias("line"), F.array("heading").alias("texts"))
        found = rows.select(F.regexp_extract("v", rf"\A[*`\[]*({x.pattern})", 1).alias("id"), F.col("key").alias("document"), "path", "line", "texts").where("id <> ''")
        out = found if out is None else out.unionByName(found)
    return out


def references(docs: DataFrame, type_: str, section: str, column: str, limit: int = 200) -> DataFrame:
    """``document, row_no, headers, cells, reference`` of reference cells, lists split and ranges expanded."""
    c = parse.table_cells(_sections_of(docs, type_, section), keep=("path", "key"))
    cell = F.coalesce(parse.cell(F.col("headers"), F.col("cells"), column), F.lit(""))
    parts = F.filter(F.transform(F.split(F.regexp_replace(cell, r"\([^()]*\)", ""), r"[,;]"), t.strip), lambda p: p != "")
    rows = c.select(F.col("key").alias("document"), "path", "table_no", "row_no", "headers", "cells", F.explode(parts).alias("r"))
    return rows.withColumn("reference", F.explode(t.expand_range(F.col("r"), limit))).drop("r")


def broken_references(refs: DataFrame, minted: DataFrame) -> DataFrame:
    """References that nothing mints."""
    return refs.join(minted.select(F.col("id").alias("reference")), "reference", "left_anti")


@dataclass
class Statuses:
    complete: tuple[str, ...] = ()
    pending: tuple[str, ...] = ()
    failed: tuple[str, ...] = ()
    retired: tuple[str, ...] = ()

    def classify(self, value: Column) -> Column:
        """Exact words of all classes first, in order; then leading markers that end at no letter or digit."""
        v, out = t.strip(value), F.lit(None).cast("string")
        kinds = [(k, w) for k in ("complete", "pending", "failed", "retired") for w in getattr(self, k)]
        for k, w in reversed(kinds):
            lead = F.startswith(v, F.lit(w)) & ~F.rlike(F.substr(v, F.lit(len(w) + 1), F.lit(1)), F.lit(t.rx(r"[\p{L}\p{N}]")))
            out = F.when(lead, k).otherwise(out)
        for k, w in reversed(kinds):
            out = F.when(v == w, k).otherwise(out)
        return out


def row_finding(status: Column, backed: Column, has_symbol: Column) -> Column:
    """One class a row: an undeclared status first, then retired rows, contradicted ones, unbacked ones."""
    return (
        F.when(status.isNull(), "undeclared-status").when(status == "retired", "retired")
        .when((status == "complete") & ~backed, "status-lie").when((status == "pending") & backed, "status-lie")
        .when(~has_symbol, "no-symbol").when(~backed, "unbacked").otherwise("backed")
    )


def row_backed(own_bound: Column, is_obligation: Column, referenced: Column, any_answer: Column) -> Column:
    """A row that is an obligation must be bound itself; else all obligations it
    references must be (``referenced``: their states); else any answer is enough."""
    return F.when(is_obligation, own_bound).when(F.size(referenced) > 0, F.forall(referenced, lambda x: x)).otherwise(any_answer)


def matrix_status(retired: Column, qualified: Column, method: Column, symbols: Column, tagged: Column, ignored: Column) -> Column:
    """Status of an obligation, by precedence."""
    return (
        F.when(retired, "retired").when(qualified, "qualified-record").when(method.isNotNull() & (symbols == 0), "method-without-symbol")
        .when(~tagged, "untagged").when(ignored, "tagged-by-ignored-test").otherwise("tagged")
    )


def groups_and_totals(rows: DataFrame, by: str) -> DataFrame:
    """``document, backed, total`` of each document and, with a null document, of all: one rollup."""
    return rows.rollup(by).agg(F.count_if("backed").alias("backed"), F.count("*").alias("total")).orderBy(F.col(by).asc_nulls_last())


def shared_ids(bindings: DataFrame) -> DataFrame:
    """Trace ids that more than one symbol claims."""
    return bindings.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("path", "symbol"))).alias("symbols")).where("size(symbols) > 1").orderBy("id")


def untracked(bindings: DataFrame, minted: DataFrame) -> DataFrame:
    """Tags of identifiers that no document declares."""
    return bindings.join(minted.select("id"), "id", "left_anti").orderBy("id", "path", "symbol")


def qualified(reference: Column, prefixes: list[tuple[str, str]]) -> Column:
    """``struct<member, id>`` of a reference: an ``ix://org/repo/…`` one, else the
    first declared prefix that leaves a non-empty rest, else its own member (null)."""
    rest = F.regexp_extract(reference, r"\Aix://[^/]+/[^/]+/(.+)\z", 1)
    out = F.struct(F.lit(None).cast("string").alias("member"), reference.alias("id"))
    for prefix, member in reversed(prefixes):
        out = F.when(F.startswith(reference, F.lit(prefix)) & (F.length(reference) > len(prefix)), F.struct(F.lit(member).alias("member"), F.substr(reference, F.lit(len(prefix) + 1), F.length(reference)).alias("id"))).otherwise(out)
    return F.when(rest != "", F.struct(t.authority(reference).alias("member"), t.target_id(reference).alias("id"))).otherwise(out)


def audit_gaps(declared: DataFrame, mapped: DataFrame, limit: int = 1000) -> DataFrame:
    """``id, gap``: declared criteria that no audit row maps (``unmapped``) and
    mapped ones that nothing declares (``undeclared``); ranges count member by
    member, tombstones (``retired`` declared rows) are neither."""
    live = declared.where("NOT retired").select("id").distinct()
    names = mapped.select(F.explode(t.expand_range(F.col("reference"), limit)).alias("id")).distinct()
    one = live.join(names, "id", "left_anti").select("id", F.lit("unmapped").alias("gap"))
    two = names.join(declared.select("id"), "id", "left_anti").select("id", F.lit("undeclared").alias("gap"))
    return one.unionByName(two).orderBy("id", "gap")


def obligations(rows: DataFrame, id_format: str, fields: dict[str, str], method: str = "method") -> DataFrame:
    """Obligations from declared rows: ``id, method, target_ids, parameters``.

    ``id_format`` has ``{column}`` of the row; the method is the text before
    ``(``, its targets stand in closed parentheses; ``fields`` name parameters.
    """
    keys = F.map_from_arrays(F.array(*[F.lit(c) for c in rows.columns]), F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]))
    cell = F.coalesce(F.col(method), F.lit(""))
    inner = F.regexp_extract(cell, r"\A[^(]*\(([^)]*)\)", 1)
    params = F.create_map(*[x for k, c in fields.items() for x in (F.lit(k), F.col(c).cast("string"))])
    return rows.select(
        t.interpolate(F.lit(id_format), keys).alias("id"),
        F.nullif(t.strip(F.substring_index(cell, "(", 1)), F.lit("")).alias("method"),
        F.filter(F.transform(F.split(inner, ","), t.strip), lambda x: x != "").alias("target_ids"),
        F.map_filter(params, lambda k, v: v.isNotNull() & (v != "")).alias("parameters"),
    )


def combinatorial_tuples(values: DataFrame, strength: int, excluded: DataFrame | None = None) -> DataFrame:
    """t-way tuples of a dimensions table (``dimension, value``) without those
    that hold an excluded pair (``dim_a, value_a, dim_b, value_b``, ``dim_a < dim_b``).

    The tuples are the result itself; dimensions are joined in order, an
    inequality join on their names. The values are broadcast: they are few
    beside their tuples, and a product by partitions has their number squared.
    """
    out = values.select(*[F.col(c).alias(f"{c}_1") for c in ("dimension", "value")])
    for i in range(2, strength + 1):
        more = values.select(*[F.col(c).alias(f"{c}_{i}") for c in ("dimension", "value")])
        out = out.join(F.broadcast(more), F.col(f"dimension_{i - 1}") < F.col(f"dimension_{i}"))
    if excluded is not None:
        for a, b in combinations(range(1, strength + 1), 2):
            pair = excluded.select(F.col("dim_a").alias(f"dimension_{a}"), F.col("value_a").alias(f"value_{a}"), F.col("dim_b").alias(f"dimension_{b}"), F.col("value_b").alias(f"value_{b}"))
            out = out.join(pair, [f"dimension_{a}", f"value_{a}", f"dimension_{b}", f"value_{b}"], "left_anti")
    return out


def metric_rows(df: DataFrame, measures: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``metric, matched, population, value, state``: all from one aggregation.
    A metric over an empty population isn't computed; one that matches nothing is hollow."""
    aggs = [x for n, (m, p) in measures.items() for x in (F.count_if(m & p).alias(f"m_{n}"), F.count_if(p).alias(f"p_{n}"))]
    row = df.agg(*aggs)
    parts = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"m_{n}").alias("matched"), F.col(f"p_{n}").alias("population")) for n in measures])
    out = row.select(F.inline(parts))
    value = F.when(F.col("population") > 0, F.round(100.0 * F.col("matched") / F.col("population"), 2))
    state = F.when(F.col("population") == 0, "not_computed").when(F.col("matched") == 0, "hollow").otherwise("measured")
    return out.withColumns({"value": value, "state": state}).orderBy("metric")


def ratchets(metrics: DataFrame, baselines: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """``metric, value, baseline, state`` of measured metrics (``metric, value``)
    against baselines (``metric, baseline, rising``: whether more is better): a
    metric may not get worse by more than the tolerance. One that a baseline has
    and that wasn't measured is ``missing``, one without a baseline ``new``."""
    j = metrics.select("metric", "value").join(baselines, "metric", "full")
    worse = F.when(F.col("rising"), F.col("baseline") - F.col("value")).otherwise(F.col("value") - F.col("baseline"))
    state = F.when(F.col("rising").isNull(), "new").when(F.col("value").isNull(), "missing").when(worse > tolerance, "regressed").when(worse < -tolerance, "improved").otherwise("held")
    return j.select("metric", "value", "baseline", state.alias("state"))


#: Outcomes of a retained record that is not qualified.
EVIDENCE_CAUSES = ("failed", "errored", "skipped", "absent", "unevaluated", "wrong-revision", "selection-mismatch", "stale", "invalid-target", "ambiguous-target", "record-conflict", "qualification-rejected", "inventory-incomplete")


def reconcile_evidence(records: DataFrame, targets: DataFrame, revision: str) -> DataFrame:
    """``record, target, cause`` of retained records (``record, target, outcome,
    revision, content``): null where a record qualifies its target."""
    held = targets.groupBy(F.col("id").alias("target")).agg(F.count("*").alias("holders"))
    conflict = F.size(F.collect_set("content").over(W.partitionBy("target", "revision"))) > 1
    r = records.withColumn("conflict", conflict).join(held, "target", "left")
    cause = (
        F.when(F.col("holders").isNull(), "invalid-target").when(F.col("holders") > 1, "ambiguous-target").when(F.col("revision") != revision, "wrong-revision")
        .when(F.col("conflict"), "record-conflict").when(F.col("outcome").isin("failed", "errored", "skipped"), F.col("outcome")).when(F.col("outcome") != "passed", "unevaluated")
    )
    return r.select("record", "target", cause.alias("cause")).orderBy("record", "target")


def strict_decision(rows: DataFrame, n_targets: int, evidence_causes: int = 0, input_errors: int = 0) -> list[str]:
    """All reasons to reject, in order. Rows planned, blocked or parked are exempt."""
    exempt = F.rlike(F.lower(F.coalesce("status", F.lit(""))), F.lit(r"\A[^a-z0-9]*(?:planned|blocked|parked)\b"))
    n = rows.agg(F.count_if((F.col("finding") == "unbacked") & ~exempt).alias("unbacked"), F.count_if(F.col("finding") == "status-lie").alias("lies")).first()
    checks = {"no-targets": n_targets == 0, "unbacked-rows": n["unbacked"] > 0, "status-lies": n["lies"] > 0, "evidence": evidence_causes > 0, "declared-input": input_errors > 0}
    return [name for name, bad in checks.items() if bad]


def inventory(rows: DataFrame, sources: list[str], known: list[str], stop_limit: int | None = None) -> tuple[DataFrame | None, list[str]]:
    """Obligations of selected sources: fails closed on no, repeated or unknown
    names; a stop limit returns part of the rows with its cause."""
    causes = (["no-source"] if not sources else []) + (["duplicate-source"] if len(set(sources)) < len(sources) else []) + [f"unknown-source {s}" for s in sources if s not in known]
    if causes:
        return None, causes
    picked = rows.where(F.col("source").isin(*sources)).orderBy("source", "id")
    if stop_limit is None:
        return picked, []
    return picked.limit(stop_limit), (["stop-limit"] if picked.limit(stop_limit + 1).count() > stop_limit else [])
