"""Queries within documents: sections, tables, lists, code, search and edits."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdlake.functions import text as t
from mdlake.operators import parse


def section(sections: DataFrame, heading: str, by: tuple[str, ...] = ("doc_key",)) -> DataFrame:
    """The first section of each document with a heading; numbers and case don't count."""
    hit = sections.where(t.same_heading(F.col("heading"), F.lit(heading)))
    rest = F.struct(*[c for c in sections.columns if c not in by])
    return hit.groupBy(*by).agg(F.min_by(rest, "section_no").alias("s")).select(*by, "s.*")


def table_of_section(sections: DataFrame, heading: str, by: tuple[str, ...] = ("doc_key",)) -> DataFrame:
    """Rows of the first table of a named section."""
    return parse.table_cells(section(sections, heading, by), keep=by).where("table_no = 0")


def search(sections: DataFrame, needle: str, by: tuple[str, ...] = ("doc_key",)) -> DataFrame:
    """Lines of sections that contain a string, in any case; ``line`` is 1-based in the body."""
    rows = sections.select(*by, "section_no", "heading", "start_line", F.posexplode(F.split("content", "\n")).alias("i", "text"))
    hit = rows.where(F.contains(F.lower("text"), F.lit(needle.lower())))
    return hit.select(*by, "section_no", "heading", (F.col("start_line") + 1 + F.col("i")).alias("line"), "text")


def deep_merge(current: Column, patch: Column) -> Column:
    """Merge two JSON texts: objects recursively, all else replaced by the patch."""

    def merge(a, b):
        if isinstance(a, dict) and isinstance(b, dict):
            return {k: merge(a[k], b[k]) if k in a and k in b else b.get(k, a.get(k)) for k in {**a, **b}}
        return b

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        pairs = zip(left.to_pylist(), right.to_pylist(), strict=True)
        return pa.array([a if b is None else json.dumps(merge(json.loads(a or "null"), json.loads(b)), ensure_ascii=False, separators=(",", ":")) for a, b in pairs], pa.string())

    return F.arrow_udf(run, "string")(current, patch)


def _spliced(raw: Column, start: Column, end: Column, new: Column) -> Column:
    """Bytes of ``raw`` with ``[start, end)`` replaced; all else stays byte for byte."""
    data = F.encode(raw, "UTF-8")
    head, tail = F.substring(data, F.lit(1), start), F.substring(data, end + 1, F.octet_length(data))
    return F.decode(F.concat(head, F.encode(new, "UTF-8"), tail), "UTF-8")


def body_offset(raw: Column, body: Column) -> Column:
    """Bytes before the body."""
    return F.octet_length(raw) - F.octet_length(body)


def update_section(docs: DataFrame, heading: str, content: Column, raw: str = "raw") -> DataFrame:
    """Add ``updated``: the text with the content of one section replaced, and
    ``error`` where there is no such section. The content ends with a line end
    unless it is empty; a heading on the last line gets one before it."""
    one = F.filter(parse.section_array(F.col("body")), lambda s: t.same_heading(s["heading"], F.lit(heading)))
    d = docs.withColumn("_s", F.get(one, F.lit(0))).withColumn("_at", body_offset(F.col(raw), F.col("body")))
    text = F.when(content == "", "").otherwise(F.when(F.endswith(content, F.lit("\n")), content).otherwise(F.concat(content, F.lit("\n"))))
    last = F.col("_s.byte_content") == F.col("_s.byte_end")
    bare = last & ~F.endswith(F.substring(F.encode(raw, "UTF-8"), F.lit(1), F.col("_at") + F.col("_s.byte_content")), F.lit(b"\n"))
    new = F.when(bare & (text != ""), F.concat(F.lit("\n"), text)).otherwise(text)
    out = _spliced(F.col(raw), F.col("_at") + F.col("_s.byte_content"), F.col("_at") + F.col("_s.byte_end"), new)
    return d.withColumns({"updated": out, "error": F.when(F.col("_s").isNull(), F.lit(f"no section {heading!r}"))}).drop("_s", "_at")


def update_block(docs: DataFrame, block_id: str, new: Column, raw: str = "raw") -> DataFrame:
    """Add ``updated``: heading and content of the section with a block identifier replaced."""
    one = F.filter(parse.section_array(F.col("body")), lambda s: s["block_id"] == block_id)
    d = docs.withColumn("_s", F.get(one, F.lit(0))).withColumn("_at", body_offset(F.col(raw), F.col("body")))
    out = _spliced(F.col(raw), F.col("_at") + F.col("_s.byte_start"), F.col("_at") + F.col("_s.byte_end"), new)
    return d.withColumns({"updated": out, "error": F.when(F.col("_s").isNull(), F.lit(f"no block {block_id!r}"))}).drop("_s", "_at")
