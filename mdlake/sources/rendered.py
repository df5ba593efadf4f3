"""Markdown corpora rendered from relational tables.

Each row becomes a document with frontmatter, sections, a table and code, so
that what the engine recovers can be compared with the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Documents that one task renders and parses, about.
TASK_ROWS = 20_000


def spread(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``rows`` dealt by a key over enough tasks for the parsing that follows:
    at least the cluster's cores, else one for each ``TASK_ROWS`` of ``size``.
    A count given explicitly is left alone by adaptive execution, which would
    merge the few bytes of a shuffle into one task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-size // TASK_ROWS)), key)


def lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_key, path, raw`` of one document an order: its line items as a
    table, its customer as a relationship, and a fence that holds a heading."""
    o = table(spark, sf_dir, "orders")
    size = o.count()  # of the file's footer
    row = text("| ", F.col("l_linenumber"), " | PRT-", F.col("l_partkey"), " | ", F.col("l_quantity").cast("decimal(12,2)"), " | ", F.col("l_returnflag"), " \\| ", F.col("l_linestatus"), " |")
    # Dealt once by the order's key: the aggregation and the join need no shuffle of their own.
    item = spread(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", size).groupBy("o_orderkey")
    item = item.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), row.alias("r")))), lambda x: x["r"]), "\n").alias("rows"))
    raw = lines(
        "---", text("id: ORD-", F.col("o_orderkey")), "type: ORD", text("status: ", F.col("o_orderstatus")), text("priority: '", F.col("o_orderpriority"), "'"),
        "relationships:", text("  - {target: 'ix://acme/sales/CUS-", F.col("o_custkey"), "', type: placed_by}"), "---",
        text("# Order ", F.col("o_orderkey"), " {#ord-", F.col("o_orderkey"), "}"), "Intro of the order.",
        "## 1. Items", "", "| Line | Part | Quantity | Flags |", "|---|---|--:|---|", F.coalesce("rows", F.lit("")), "",
        "## 2. Notes", "```md", "## not a heading", text("total ", F.col("o_orderkey")), "```",
        text("See [customer](../customers/CUS-", F.col("o_custkey"), ".md) and ix://acme/sales/CUS-", F.col("o_custkey"), "."),
        "### Details", text("- **status** — ", F.col("o_orderstatus")), text("- **priority:** ", F.col("o_orderpriority")), "1. ordered", "",
    )
    return spread(o, "o_orderkey", size).join(item, "o_orderkey", "left").select(
        F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("doc_key"), F.concat(F.lit("orders/ORD-"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"), raw.alias("raw")
    )


def customers(spark: SparkSession, sf_dir: str, drop_every: int = 0) -> DataFrame:
    """One document a customer, without each ``drop_every``-th if set."""
    c = table(spark, sf_dir, "customer")
    if drop_every:
        c = c.where(F.col("c_custkey") % drop_every != 0)
    c = spread(c, "c_custkey", c.count())
    key = F.concat(F.lit("CUS-"), F.col("c_custkey").cast("string"))
    raw = lines(
        "---", text("id: ", key), "type: CUS", text("segment: ", F.col("c_mktsegment")), "relationships:",
        text("  - {target: NAT-", F.col("c_nationkey"), ", type: located_in}"), "---", text("# ", F.col("c_name")), "## Attributes",
        text("- **segment** — ", F.col("c_mktsegment")), text("- **balance** — ", F.col("c_acctbal").cast("decimal(12,2)")), "",
    )
    return c.select(key.alias("doc_key"), F.concat(F.lit("customers/"), key, F.lit(".md")).alias("path"), raw.alias("raw"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    key = F.concat(F.lit("NAT-"), F.col("n_nationkey").cast("string"))
    raw = lines("---", text("id: ", key), "type: NAT", "relationships:", text("  - {target: REG-", F.col("n_regionkey"), ", type: part_of}"), "---", text("# ", F.col("n_name")), "")
    return n.select(key.alias("doc_key"), F.concat(F.lit("nations/"), key, F.lit(".md")).alias("path"), raw.alias("raw"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    key = F.concat(F.lit("REG-"), F.col("r_regionkey").cast("string"))
    raw = lines("---", text("id: ", key), "type: REG", "---", text("# ", F.col("r_name")), "")
    return r.select(key.alias("doc_key"), F.concat(F.lit("regions/"), key, F.lit(".md")).alias("path"), raw.alias("raw"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a conversation, a section a turn."""
    t = table(spark, sf_dir, "conversations")
    part = F.concat(F.lit("## "), F.col("role"), F.lit("\n"), F.regexp_replace("text", r"(?m)^(#|```|~~~|<!--)", "· $1"), F.lit("\n"))
    turns = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "")
    key = F.concat(F.lit("CNV-"), F.col("conv_id").cast("string"))
    raw = F.concat(F.lit("---\nid: "), key, F.lit("\ntype: CNV\n---\n# Conversation\n"), F.col("turns"))
    return spread(t, "conv_id", t.count()).groupBy("conv_id").agg(turns.alias("turns")).select(key.alias("doc_key"), F.concat(F.lit("chat/"), key, F.lit(".md")).alias("path"), raw.alias("raw"))
