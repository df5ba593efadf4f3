"""Diagnostics around coverage: tags that nearly bind, tags that can't, claims to
formalize, criteria by the shape of their property, methods no catalog has.

All are joins, filters and aggregations of the tables that coverage makes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mdlake.functions import text as t
from mdlake.operators import prose, symbols

#: Children that a finding names.
SHOWN = 5


def normalized_id(identifier: Column) -> Column:
    """Upper case, without zero padding and separators: two spellings of one id agree."""
    return F.regexp_replace(F.regexp_replace(F.upper(identifier), r"(?<![0-9])0+(?=[0-9])", ""), t.rx(r"[^\p{L}\p{N}]"), "")


def near_misses(untracked: DataFrame, unbacked: DataFrame) -> DataFrame:
    """``id, row_id, document, path, symbol, line``: tags that no row has (``id,
    path, symbol, line``) beside unbacked rows (``target_id, document``) that differ
    only in padding, case or separators; a pair once, at its first place."""
    rows = unbacked.groupBy(normalized_id(F.col("target_id")).alias("norm")).agg(F.min(F.struct("document", "target_id")).alias("r"))
    rows = rows.select("norm", F.col("r.target_id").alias("row_id"), F.col("r.document").alias("document"))
    hit = untracked.withColumn("norm", normalized_id(F.col("id"))).join(rows, "norm").where("id <> row_id")
    first = hit.groupBy("id", "row_id", "document").agg(F.min(F.struct("path", "line", "symbol")).alias("at"))
    return first.select("id", "row_id", "document", "at.path", "at.symbol", "at.line")


def _prefixes(identifier: Column, least: int, leave: int) -> Column:
    """The leading segments of an id, ``least`` at least, without the last ``leave``."""
    parts = F.split(identifier, "-")
    most = F.size(parts) - leave
    lengths = F.when(most >= least, F.sequence(F.lit(least), F.greatest(most, F.lit(least)))).otherwise(F.array().cast("array<int>"))
    return F.transform(lengths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))


def minted_children(untracked: DataFrame, minted: DataFrame) -> DataFrame:
    """``id, path, symbol, line, parent, n, shown``: tags that aren't minted, but
    under which, or under whose nearest parent, ids are; ``shown`` has the first few."""
    child = minted.select("id").distinct().select(F.explode(_prefixes(F.col("id"), 2, 1)).alias("parent"), F.col("id").alias("child"))
    place = F.row_number().over(W.partitionBy("parent").orderBy("child"))
    shown = child.withColumn("place", place).where(F.col("place") <= SHOWN).groupBy("parent").agg(F.array_sort(F.collect_list("child")).alias("shown"))
    held = child.groupBy("parent").agg(F.count("*").alias("n")).join(shown, "parent")
    up = untracked.join(minted.select("id").distinct(), "id", "left_anti").select("*", F.explode(_prefixes(F.col("id"), 2, 0)).alias("parent"))
    best = up.join(held, "parent").groupBy("id", "path", "symbol", "line").agg(F.max_by(F.struct("parent", "n", "shown"), F.length("parent")).alias("b"))
    return best.select("id", "path", "symbol", "line", "b.parent", "b.n", "b.shown")


def outside_markers(extracted: DataFrame, bindings: DataFrame, id_pattern: str, templates: dict[str, str] | None = None) -> DataFrame:
    """``id, path, symbol, line, owner, instead``: ids in comments on symbols that
    no marker binds there. ``templates`` has, by language, the marker to write
    (``{ids}``); production code binds none."""
    found = extracted.withColumn("m", F.explode("marks")).where(~F.startswith("m.text", F.lit("@")))
    found = found.select("language", "path", F.col("qualified_name").alias("symbol"), "kind", F.col("m.line").alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("m.text", F.lit(f"({id_pattern})"), 1))).alias("id"))
    loose = found.join(bindings.select("id", "path", "symbol").distinct(), ["id", "path", "symbol"], "left_anti")
    owner = F.when(F.col("kind").isin(*symbols.EVIDENCE), "evidence").otherwise("production")
    names = F.create_map(*[F.lit(x) for p in templates.items() for x in p]) if templates else None
    instead = F.replace(F.element_at(names, F.col("language")), F.lit("{ids}"), F.concat(F.lit('"'), F.col("id"), F.lit('"'))) if templates else F.lit(None).cast("string")
    return loose.select("id", "path", "symbol", "line", owner.alias("owner"), F.when(owner == "evidence", instead).alias("instead"))


def formalizes(extracted: DataFrame, pattern: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(relations, findings)`` of marks whose group 1 names what a declaration
    formalizes. Relations (``id, path, symbol, line``) name ``known`` ids; findings
    are ``formalizes-unknown-id`` and ``duplicate-formalizes-claim``."""
    m = extracted.withColumn("m", F.explode("marks"))
    ids = F.transform(F.flatten(F.transform(F.regexp_extract_all("m.text", F.lit(pattern), 1), lambda g: F.split(g, ","))), t.strip)
    named = m.select(F.explode(F.filter(ids, lambda x: x != "")).alias("id"), "path", F.col("qualified_name").alias("symbol"), F.col("m.line").alias("line"))
    claims = named.groupBy("id", "path", "symbol").agg(F.min("line").alias("line"), F.count("*").alias("n"))
    keys = known.select("id").distinct()
    relations = claims.join(keys, "id", "left_semi").drop("n")
    unknown = claims.join(keys, "id", "left_anti").select(F.lit("formalizes-unknown-id").alias("reason"), "id", "path", "symbol", "line")
    twice = claims.where("n > 1").select(F.lit("duplicate-formalizes-claim").alias("reason"), "id", "path", "symbol", "line")
    return relations, unknown.unionByName(twice)


def criteria_counts(criteria: DataFrame, statement: str = "statement", idioms: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``document, criteria, property_shaped, specific_shaped, by_property,
    catch_all_id, catch_all_line`` of criteria (``document, row_id, line`` and the
    statement): how many can be extracted, how many of these name a specific
    shape, and, where none does, the first universal one."""
    c = criteria.select("document", "row_id", "line", prose.property_shape(F.col(statement), idioms).alias("shape"), prose.property_extraction(F.col(statement), idioms).alias("extraction"))
    ready = F.col("extraction") == "extractable"
    tallies = c.groupBy("document", "shape").agg(F.count("*").alias("n"), F.count_if(ready).alias("ready"), F.min(F.when(ready, F.struct("line", "row_id"))).alias("first"))
    specific = F.sum(F.when(~F.col("shape").isin("universal", "example", "unclassified"), F.col("ready")).otherwise(0))
    out = tallies.groupBy("document").agg(
        F.sum("n").alias("criteria"), F.sum("ready").alias("property_shaped"), specific.alias("specific_shaped"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("shape", "n")))).alias("by_property"),
        F.min(F.when(F.col("shape") == "universal", F.col("first"))).alias("universal"),
    )
    only = (F.col("property_shaped") > 0) & (F.col("specific_shaped") == 0)
    return out.select("document", "criteria", "property_shaped", "specific_shaped", "by_property", F.when(only, F.col("universal.row_id")).alias("catch_all_id"), F.when(only, F.col("universal.line")).alias("catch_all_line"))


def catch_all(counts: DataFrame) -> DataFrame:
    """``documents, of, document, row_id, line``: one row if some documents with
    criteria to extract name a specific shape for none of them, with the first."""
    row = counts.where("property_shaped > 0").agg(
        F.count_if(F.col("specific_shaped") == 0).alias("documents"), F.count("*").alias("of"),
        F.min(F.when(F.col("specific_shaped") == 0, F.struct("document", F.col("catch_all_id").alias("row_id"), F.col("catch_all_line").alias("line")))).alias("first"),
    )
    return row.where("documents > 0").select("documents", "of", "first.document", "first.row_id", "first.line")


def hollow(metrics: DataFrame) -> DataFrame:
    """``metric, population`` of measured ratios that matched nothing."""
    return metrics.where("state = 'hollow'").select("metric", "population")


def uncatalogued(obligations: DataFrame, known: DataFrame) -> DataFrame:
    """``source, method, rows, document``: methods of live obligations (``source,
    method, document, retired``) that neither a method nor a class of ``known``
    (``name``) is, in any case."""
    names = known.select(F.lower(t.strip(F.col("name"))).alias("folded")).distinct()
    live = obligations.where("NOT retired AND method IS NOT NULL").withColumn("folded", F.lower(t.strip(F.col("method"))))
    return live.join(names, "folded", "left_anti").groupBy("source", "method").agg(F.count("*").alias("rows"), F.min("document").alias("document"))
