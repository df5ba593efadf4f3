"""Queries of the parse, lookup and edit operators over rendered corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdlake.functions import text as t
from mdlake.operators import parse, query
from mdlake.sources import rendered as r

QUERIES, ORACLE = {}, {}


def register(sql: str | None = None, queries: dict = QUERIES, oracle: dict = ORACLE):
    def add(f):
        queries[f.__name__] = f
        if sql:
            oracle[f.__name__] = sql
        return f

    return add


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.with_header(r.orders(spark, sf_dir))


@register("SELECT 'ORD-' || o_orderkey AS id, 'ORD' AS type, o_orderstatus AS status, o_orderpriority AS priority, 'present' AS fm_status FROM orders")
def frontmatter_fields(spark, sf_dir):
    d = _orders(spark, sf_dir)
    return d.select(*[parse.fm(c).alias(c) for c in ("id", "type", "status", "priority")], "fm_status")


@register("""SELECT page_id % 6 AS kind, CASE page_id % 6 WHEN 0 THEN 'present' WHEN 1 THEN 'absent' WHEN 2 THEN 'absent' WHEN 3 THEN 'malformed'
  WHEN 4 THEN 'absent' ELSE 'present' END AS fm_status, count(*) AS n, min(CASE page_id % 6 WHEN 0 THEN 5 WHEN 1 THEN 12 WHEN 2 THEN 5 WHEN 3 THEN 19 WHEN 4 THEN 8 ELSE 3 END)::INT AS body_length
  FROM pages GROUP BY 1, 2""")
def frontmatter_status(spark, sf_dir):
    """Boundary cases: byte order mark, empty block, no block at all, invalid YAML, unclosed, close within a line."""
    texts = ["﻿---\na: 1\n---\n# H\n\n", "a: 1\n---\n# H", "---\n\n---\nbody\n", "---\na: [1\n---\nbody\n", "---\na: 1\n", "---\r\na: 1\r\n---x\nb"]
    texts[4] = "---\nb: 1"
    p = r.table(spark, sf_dir, "pages").select((F.col("page_id") % 6).cast("int").alias("kind"))
    raw = F.element_at(F.array(*[F.lit(x) for x in texts]), F.col("kind") + 1)
    d = parse.with_header(p.withColumn("raw", raw))
    return d.groupBy(F.col("kind").cast("long").alias("kind"), "fm_status").agg(F.count("*").alias("n"), F.min(F.length("body")).alias("body_length"))


@register("""SELECT level, heading, count(*) AS n, min(parent) AS parent FROM orders, (VALUES (1, 'Order', NULL), (2, '1. Items', 'Order'), (2, '2. Notes', 'Order'), (3, 'Details', '2. Notes')) v(level, heading, parent) GROUP BY 1, 2""")
def headings_by_level(spark, sf_dir):
    s = parse.sections(_orders(spark, sf_dir))
    name = lambda c: F.regexp_replace(c, r"\AOrder \d+\z", "Order")
    parent = F.when(F.size("heading_path") > 1, name(F.get("heading_path", F.size("heading_path") - 2)))
    return s.groupBy("level", name(F.col("heading")).alias("heading")).agg(F.count("*").alias("n"), F.min(parent).alias("parent"))


@register("SELECT 'ord-' || o_orderkey AS block_id, 'order-' || o_orderkey AS slug, 'order-' || o_orderkey || '-L9' AS line_id FROM orders")
def block_ids_and_slugs(spark, sf_dir):
    s = parse.sections(_orders(spark, sf_dir), level=1)
    return s.select("block_id", t.slug(F.col("heading")).alias("slug"), t.slug_line_id(F.col("heading"), F.lit(9)).alias("line_id"))


@register("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slug_ids(spark, sf_dir):
    return r.table(spark, sf_dir, "part").select("p_partkey", t.slug(F.col("p_name")).alias("slug"))


@register("""SELECT 'ORD-' || o_orderkey AS doc_key, 'Intro of the order.' || chr(10) AS content, 0::INT AS start_line, strlen('# Order ' || o_orderkey || ' {#ord-' || o_orderkey || '}') + 1 AS byte_content,
  strlen('# Order ' || o_orderkey || ' {#ord-' || o_orderkey || '}') + 1 + 20 AS byte_end FROM orders""")
def section_slices(spark, sf_dir):
    s = parse.sections(_orders(spark, sf_dir), level=1)
    return s.select("doc_key", "content", "start_line", F.col("byte_content").cast("long").alias("byte_content"), F.col("byte_end").cast("long").alias("byte_end"))


@register("SELECT 'ORD-' || o_orderkey AS doc_key, 2::TINYINT AS level, '2. Notes' AS heading, 'ix://acme/sales/CUS-' || o_custkey AS reference FROM orders")
def section_lookup(spark, sf_dir):
    s = query.section(parse.sections(_orders(spark, sf_dir)), "NOTES")
    return s.select("doc_key", F.col("level").cast("tinyint").alias("level"), "heading", F.regexp_extract("content", r"(ix://[\w/-]+)", 1).alias("reference"))


@register("""SELECT 'ORD-' || l_orderkey AS doc_key, l_linenumber AS line_no, 'PRT-' || l_partkey AS part, l_quantity::DECIMAL(12,2) AS quantity, l_returnflag || ' | ' || l_linestatus AS flags FROM lineitem""")
def table_cells(spark, sf_dir):
    c = query.table_of_section(parse.sections(_orders(spark, sf_dir)), "Items")
    get = lambda name: parse.cell(F.col("headers"), F.col("cells"), name)
    return c.select("doc_key", get("Line").cast("int").alias("line_no"), get("Part").alias("part"), get("quantity").cast("decimal(12,2)").alias("quantity"), get(3).alias("flags"))


@register("""SELECT doc_id, n AS line, len(cells)::INT AS n_cells, array_to_string(list_transform(cells, lambda c: trim(replace(c, chr(1), '|'), ' ' || chr(9) || chr(13))), '~') AS cells FROM (
  SELECT doc_id, n, list_slice(c, 1 + (trim(c[1]) = '')::INT, len(c) - (len(c) > 1 AND trim(c[len(c)]) = '')::INT) AS cells FROM (
    SELECT doc_id, n, string_split(trim(replace(l, '\\|', chr(1))), '|') AS c FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10)))))::INT AS n FROM documents) WHERE contains(l, '|')))""")
def split_cells(spark, sf_dir):
    d = r.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l")).where(F.contains("l", F.lit("|")))
    cells = t.split_cells(F.col("l"))
    return d.select("doc_id", "line", F.size(cells).alias("n_cells"), F.array_join(cells, "~").alias("cells"))


@register("""SELECT 'ORD-' || o_orderkey AS doc_key, unnest(['status', 'priority']) AS title, unnest([o_orderstatus, o_orderpriority]) AS description FROM orders""")
def list_items(spark, sf_dir):
    s = query.section(parse.sections(_orders(spark, sf_dir)), "details")
    i = s.select("doc_key", F.explode(parse.bullet_array(F.col("content"), "bold_description")).alias("i"))
    return i.select("doc_key", "i.title", "i.description")


@register("SELECT 'ORD-' || o_orderkey AS doc_key, 3 AS n_items, 'ordered' AS last FROM orders")
def list_item_lines(spark, sf_dir):
    items = parse.list_item_array(F.col("body"))
    return _orders(spark, sf_dir).withColumn("i", items).select("doc_key", F.size("i").cast("int").alias("n_items"), F.element_at("i", -1)["raw"].alias("last"))


@register("SELECT 'ORD-' || o_orderkey AS doc_key, 'md' AS language, '2. Notes' AS section, '## not a heading' || chr(10) || 'total ' || o_orderkey AS source FROM orders")
def code_blocks(spark, sf_dir):
    b = _orders(spark, sf_dir).select("doc_key", F.explode(parse.code_block_array(F.col("body"))).alias("b"))
    return b.select("doc_key", "b.language", "b.section", "b.source")


@register("SELECT doc_id, i::INT AS line, l AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE contains(lower(l), 'license')")
def search_lines(spark, sf_dir):
    d = r.table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("section_no"), F.lit("").alias("heading"), F.lit(-1).alias("start_line"), F.col("text").alias("content"))
    return query.search(d, "License", ("doc_id",)).select("doc_id", "line", "text")


@register("""SELECT event_id, 'x' AS by_whom, json_extract_string(props, '$.k')::INT + 0 AS kept, 1 AS k FROM events""")
def deep_merge(spark, sf_dir):
    e = r.table(spark, sf_dir, "events")
    nested = F.concat(F.lit('{"a": {"old": '), "props", F.lit('}, "k": [1]}'))
    merged = query.deep_merge(nested, F.lit('{"a": {"by": "x"}, "k": 1}'))
    e = e.select("event_id", merged.alias("m"))
    return e.select("event_id", F.get_json_object("m", "$.a.by").alias("by_whom"), F.get_json_object("m", "$.a.old.k").cast("int").alias("kept"), F.get_json_object("m", "$.k").cast("int").alias("k"))


@register("""SELECT 'CNV-' || conv_id AS doc_key, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS section_no, role AS heading, length(text)::INT AS n FROM conversations""")
def iterate_heading_records(spark, sf_dir):
    d = parse.with_header(r.conversations(spark, sf_dir))
    s = parse.sections(d, level=2)
    clean = F.regexp_replace("content", r"(?m)^· (#|```|~~~|<!--)", "$1")
    return s.select("doc_key", "section_no", "heading", (F.length(clean) - 1).alias("n"))


@register("""SELECT 'CNV-' || conv_id AS doc_key, role AS heading, n::INT AS occurrence FROM (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) WHERE n > 1""")
def duplicate_headings(spark, sf_dir):
    """Each later occurrence of a heading among those of its level."""
    s = parse.sections(parse.with_header(r.conversations(spark, sf_dir)))
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("doc_key", "level", "heading").orderBy("section_no"))
    return s.withColumn("occurrence", n).where("occurrence > 1").select("doc_key", "heading", "occurrence")


@register("""SELECT 'ORD-' || o_orderkey AS doc_key, '## 2. Notes' || chr(10) || 'replaced ' || o_orderkey || chr(10) || '### Details' AS changed, NULL::VARCHAR AS error FROM orders""")
def update_section_bytes(spark, sf_dir):
    new = F.concat(F.lit("replaced "), F.regexp_replace("doc_key", "ORD-", ""))
    d = query.update_section(_orders(spark, sf_dir), "Notes", new)
    return d.select("doc_key", F.regexp_extract("updated", r"(?s)(## 2\. Notes.*?### Details)", 1).alias("changed"), "error")


@register("""SELECT 'ORD-' || o_orderkey AS doc_key, '# New' || chr(10) || '## 1. Items' AS changed FROM orders""")
def update_block_bytes(spark, sf_dir):
    d = _orders(spark, sf_dir).where(F.lit(True))
    d = query.update_block(d.withColumn("body", F.regexp_replace("body", r"\{#ord-\d+\}", "{#the-block}")).withColumn("raw", F.regexp_replace("raw", r"\{#ord-\d+\}", "{#the-block}")), "the-block", F.lit("# New\n"))
    return d.select("doc_key", F.regexp_extract("updated", r"(?s)\A---.*?---\n(.*?## 1\. Items)", 1).alias("changed"))


@register("""SELECT p_partkey, 'Part ' || p_brand || ' of size {size}' AS filled, ['size'] AS unresolved FROM part""")
def interpolated(spark, sf_dir):
    p = r.table(spark, sf_dir, "part")
    filled = t.interpolate(F.lit("Part {brand} of size {size}"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("other"), F.lit("x")))
    return p.select("p_partkey", filled.alias("filled"), t.unresolved_fields(filled).alias("unresolved"))


@register("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'empty' WHEN 2 THEN 'placeholder' WHEN 3 THEN 'placeholder' WHEN 4 THEN 'substantive' ELSE 'placeholder' END AS status FROM part""")
def content_statuses(spark, sf_dir):
    values = F.array(*[F.array(*[F.lit(x) for x in v]).cast("array<string>") for v in ([], ["  ", "\t"], ["{{ name }}", ""], ["TODO later"], ["text", "tbd"], ["None specified", "placeholder"])])
    p = r.table(spark, sf_dir, "part")
    return p.select("p_partkey", t.content_status(F.get(values, F.col("p_size") % 6)).alias("status"))


@register("""SELECT l_orderkey, l_linenumber, unnest(range(l_partkey, l_partkey + l_linenumber))::VARCHAR AS n FROM lineitem""")
def range_expansion(spark, sf_dir):
    i = r.table(spark, sf_dir, "lineitem")
    ref = F.concat(F.lit("P-"), F.col("l_partkey"), F.lit(".."), F.col("l_partkey") + F.col("l_linenumber") - 1, F.lit(" (note)"))
    return i.select("l_orderkey", "l_linenumber", F.explode(t.expand_range(ref)).alias("n")).withColumn("n", F.regexp_replace("n", "P-", ""))
