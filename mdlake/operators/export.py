"""Graph records, assurance export and import, deterministic reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdlake.functions import text as t


def graph_records(docs: DataFrame, edges: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` with stable ids: JSON arrays of what identifies them."""
    nodes = docs.select(t.stable_id(F.lit(project), F.col("key")).alias("id"), F.coalesce("type", F.lit("document")).alias("kind"), "key", "path")
    rows = edges.select(
        t.stable_id(F.lit(project), F.col("source"), F.col("edge_type"), F.col("target")).alias("id"),
        t.stable_id(F.lit(project), F.col("source")).alias("source"), t.stable_id(F.lit(project), F.col("target")).alias("target"), "edge_type", "resolution",
    )
    return nodes.distinct(), rows.distinct()


def assurance(artifacts: DataFrame, obligations: DataFrame, symbols: DataFrame, relations: DataFrame, modules: list[str]) -> DataFrame:
    """One row ``export``: a deterministic JSON of everything, arrays sorted. It is
    one value by definition; write the tables themselves for corpora that outgrow it."""

    def sorted_rows(df: DataFrame):
        return df.agg(F.array_sort(F.collect_list(F.struct(*sorted(df.columns)))).alias("x"))

    parts = {"artifacts": artifacts, "obligations": obligations, "relations": relations, "symbols": symbols}
    out = artifacts.sparkSession.range(1).select()
    for name, df in parts.items():
        out = out.crossJoin(sorted_rows(df).withColumnRenamed("x", name))  # one row each
    head = [F.lit("assurance").alias("format"), F.lit(1).alias("format_version"), F.array(*[F.lit(m) for m in sorted(modules)]).cast("array<string>").alias("modules")]
    return out.select(F.to_json(F.struct(*head, *sorted(parts))).alias("export"))


def read_assurance(text: str, modules: list[str]) -> dict:
    """Parse an export; another format, version or set of modules is refused."""
    data = json.loads(text)
    if data.get("format") != "assurance" or data.get("format_version") != 1:
        raise ValueError("not an assurance export of version 1")
    if data.get("modules") != sorted(modules):
        raise ValueError("the export was made under other modules")
    return data


def write_assurance(folder: str, artifacts: DataFrame, obligations: DataFrame, symbols: DataFrame, relations: DataFrame, modules: list[str]) -> None:
    """The export as folders of sorted JSON lines, one a table, beside a manifest:
    for corpora that are too large for one value. Nothing goes through the driver."""
    for name, df in {"artifacts": artifacts, "obligations": obligations, "relations": relations, "symbols": symbols}.items():
        columns = sorted(df.columns)
        df.select(*columns).orderBy(*columns).write.json(f"{folder}/{name}")
    head = json.dumps({"format": "assurance", "format_version": 1, "modules": sorted(modules)}, sort_keys=True)
    artifacts.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.text(f"{folder}/manifest")


def read_assurance_tables(spark: SparkSession, folder: str, modules: list[str], schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of :func:`write_assurance`, by name and with the given schemas; an
    export of another format, version or set of modules is refused."""
    read_assurance(spark.read.text(f"{folder}/manifest").first()["value"], modules)
    return {name: spark.read.schema(schema).json(f"{folder}/{name}") for name, schema in schemas.items()}


def report_json(tables: dict[str, DataFrame], order: dict[str, list[str]]) -> str:
    """A byte-deterministic report: each table sorted by its key columns, streamed to the driver."""
    body = {name: [json.loads(r["j"]) for r in df.orderBy(*order[name]).select(F.to_json(F.struct(*sorted(df.columns))).alias("j")).toLocalIterator()] for name, df in tables.items()}
    return json.dumps(body, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def symbol_table(symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """``path, symbol, kind, fate, ids`` of each symbol: bound, tagged without binding, or untagged."""
    held = bindings.groupBy("path", F.col("symbol").alias("qualified_name")).agg(F.array_sort(F.collect_set("id")).alias("ids"))
    j = symbols.join(held, ["path", "qualified_name"], "left")
    fate = F.when(F.col("ids").isNotNull(), "bound").when(F.size("marks") > 0, "tagged").otherwise("untagged")
    return j.select("path", F.col("qualified_name").alias("symbol"), "kind", fate.alias("fate"), "ids").orderBy("path", "symbol")
