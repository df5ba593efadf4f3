"""Queries of the corpus, relation, coverage and clause operators."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from mdlake.functions import text as t
from mdlake.operators import clauses, corpus, coverage, relations
from mdlake.operators import parse
from mdlake.plans import documents_queries as base
from mdlake.sources import rendered as r

QUERIES, ORACLE = {}, {}
register = partial(base.register, queries=QUERIES, oracle=ORACLE)

#: Documents of orders, customers (without each 7th), nations and regions.
_EDGE_SQL = """
  edges AS (SELECT 'ORD-' || o_orderkey AS source, 'CUS-' || o_custkey AS target, 'placed_by' AS edge_type, (o_custkey % 7 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer)) AS ok FROM orders
    UNION ALL SELECT 'CUS-' || c_custkey, 'NAT-' || c_nationkey, 'located_in', true FROM customer WHERE c_custkey % 7 <> 0
    UNION ALL SELECT 'NAT-' || n_nationkey, 'REG-' || n_regionkey, 'part_of', true FROM nation)"""


def _docs(spark, sf_dir, order_filter="true"):
    o = r.orders(spark, sf_dir).where(order_filter)
    return corpus.documents(o.unionByName(r.customers(spark, sf_dir, 7)).unionByName(r.nations(spark, sf_dir)).unionByName(r.regions(spark, sf_dir)))


def _authored(spark, sf_dir, order_filter="true"):
    c = corpus.Corpus.of(_docs(spark, sf_dir, order_filter))
    return c.heads, c.edges.where("authored")


def _edges(spark, sf_dir):
    return _authored(spark, sf_dir)[1]


@register(f"WITH {_EDGE_SQL} SELECT source, target, edge_type FROM edges WHERE ok")
def edges_resolved(spark, sf_dir):
    return _edges(spark, sf_dir).where("resolution = 'resolved'").select("source", "target", "edge_type")


@register(f"WITH {_EDGE_SQL} SELECT source, target, edge_type FROM edges WHERE NOT ok")
def edges_dangling(spark, sf_dir):
    docs, e = _authored(spark, sf_dir)
    return corpus.Corpus(docs, e).dangling().select("source", "target", "edge_type")


@register("""SELECT 'ORD-' || o_orderkey AS source, CASE WHEN o_custkey % 7 = 0 THEN 'customers/CUS-' || o_custkey || '.md' ELSE 'CUS-' || o_custkey END AS target,
  CASE WHEN o_custkey % 7 = 0 THEN 'dangling' ELSE 'resolved' END AS resolution FROM orders
  UNION ALL SELECT 'ORD-' || o_orderkey, 'CUS-' || o_custkey, 'dangling' FROM orders WHERE o_custkey % 7 = 0""")
def body_references(spark, sf_dir):
    """Relative links and ``ix://`` references; two spellings of one target are one edge."""
    e = corpus.Corpus.of(_docs(spark, sf_dir)).edges.where("edge_type = 'references'")
    return e.select("source", "target", "resolution")


@register("SELECT 'ORD-' || o_orderkey AS source, 'placed_by' AS edge_type FROM orders WHERE o_custkey = 4")
def referencing(spark, sf_dir):
    docs, e = _authored(spark, sf_dir)
    return corpus.Corpus(docs, e).referencing("CUS-4").select("source", "edge_type")


@register("SELECT 'NAT-' || c_nationkey AS target, 'resolved' AS resolution FROM customer WHERE c_custkey = 4")
def outgoing(spark, sf_dir):
    docs, e = _authored(spark, sf_dir)
    return corpus.Corpus(docs, e).outgoing("CUS-4").select("target", "resolution")


@register("SELECT 'CUS-' || c_custkey AS key FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 11 <> 0)")
def orphans(spark, sf_dir):
    """Customers that no order (of those kept) was placed by: read from the inverse verb."""
    docs, e = _authored(spark, sf_dir, "raw NOT LIKE '%CUS-%' OR cast(regexp_extract(raw, 'CUS-(\\\\d+)', 1) AS bigint) % 11 <> 0")
    swapped = relations.relation_edges(e.where("resolution = 'resolved'"), {"placed_by": "places"}).where("NOT own")
    swapped = swapped.select(F.lit("").alias("member"), "source", "target", "edge_type", F.lit("resolved").alias("resolution"), F.lit("").alias("target_member"))
    return corpus.Corpus(docs, swapped).orphans("CUS", "places", "ORD").select("key")


@register("SELECT 'CUS-' || c_custkey AS key, 'customers/CUS-' || c_custkey || '.md' AS path FROM customer WHERE c_custkey % 7 <> 0")
def by_type(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return corpus.Corpus(docs, docs).by_type("CUS").select("key", "path")


@register("SELECT 'CUS-' || c_custkey AS id, 'zz/CUS-' || c_custkey || '.md' AS path FROM customer WHERE c_custkey % 3 = 0")
def duplicate_ids(spark, sf_dir):
    c = r.customers(spark, sf_dir)
    copies = c.where("cast(substr(doc_key, 5) AS bigint) % 3 = 0").withColumn("path", F.concat(F.lit("zz/"), "doc_key", F.lit(".md")))
    return corpus.duplicates(corpus.documents(c.unionByName(copies))).select("id", "path")


@register("""SELECT 'ORD-' || o_orderkey AS key, CASE WHEN o_custkey % 7 = 0 THEN 'unsatisfied' END AS finding FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 7 = 0
  UNION ALL SELECT 'CUS-' || c_custkey, 'kind-mismatch' FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT 'CUS-' || c_custkey, 'unsatisfied' FROM customer WHERE c_custkey % 7 <> 0""")
def required_relation_gaps(spark, sf_dir):
    docs, e = _authored(spark, sf_dir)
    rules = [
        relations.RequiredRelation("order-customer", "ORD", "placed_by", toward=("CUS",), where="get_json_object(fm_json, '$.status') = 'F'"),
        relations.RequiredRelation("customer-region", "CUS", "located_in", toward=("REG",)),
    ]
    return relations.required_gaps(docs, e, rules).select("key", "finding")


@register("SELECT 'CUS-' || c_custkey AS source, 'NAT-' || c_nationkey AS target, 'NAT' AS target_type FROM customer WHERE c_custkey % 7 <> 0")
def edge_target_kinds(spark, sf_dir):
    docs, e = _authored(spark, sf_dir)
    accepted = spark.createDataFrame([("CUS", "located_in", ["REG"]), ("ORD", "placed_by", ["*"]), ("NAT", "part_of", ["area"])], "type string, edge_type string, tokens array<string>")
    return relations.wrong_target_kinds(docs, e, accepted, {}, {"REG": ["area"]}).select("source", "target", "target_type")


@register("SELECT 'NAT-' || n_nationkey AS source, 'part_of' AS edge_type FROM nation")
def disallowed_edges(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    allowed = spark.createDataFrame([("ORD", "placed_by"), ("CUS", "located_in"), ("NAT", "borders")], "type string, edge_type string")
    return relations.disallowed_edges(docs, corpus.relationships(docs), allowed, {"located_in": "houses"}).select("source", "edge_type")


@register("""SELECT 'ORD-' || o_orderkey AS key FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_custkey % 7 <> 0 AND n_regionkey = 1 AND c_mktsegment <> 'BUILDING'""")
def flow_two_hop(spark, sf_dir):
    docs, e = _authored(spark, sf_dir)
    to_region = [("placed_by", "outgoing", "CUS"), ("located_in", "outgoing", "NAT"), ("part_of", "outgoing", "REG")]
    rule = relations.FlowRule("region-1", "ORD", [(to_region, "key = 'REG-1'")], [(to_region[:1], "get_json_object(fm_json, '$.segment') = 'BUILDING'")], "move it")
    return relations.flow_findings(docs, e, [rule]).select("key")


@register("""WITH p(v, n) AS (VALUES ('1-URGENT', 1), ('2-HIGH', 2), ('3-MEDIUM', 3), ('4-NOT SPECIFIED', 4), ('5-LOW', 5)), s(v, n) AS (VALUES ('AUTOMOBILE', 1), ('BUILDING', 2), ('FURNITURE', 3), ('MACHINERY', 4))
  SELECT 'ORD-' || o_orderkey AS source, 'CUS-' || o_custkey AS target FROM orders JOIN customer ON o_custkey = c_custkey JOIN p ON p.v = o_orderpriority JOIN s ON s.v = c_mktsegment WHERE o_custkey % 7 <> 0 AND p.n < s.n""")
def field_consistency(spark, sf_dir):
    docs, e = _authored(spark, sf_dir)
    a = relations.rank(parse.fm("priority"), ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
    b = relations.rank(parse.fm("segment"), ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"])
    return relations.field_consistency(docs, e, "placed_by", a, b).select("source", "target")


@register("""WITH RECURSIVE e AS (SELECT 'N' || n_nationkey AS a, 'N' || ((n_nationkey * 7 + 3) % 25) AS b FROM nation),
  w(s, n, h) AS (SELECT a, b, 1 FROM e WHERE b >= a UNION ALL SELECT s, b, h + 1 FROM w JOIN e ON e.a = w.n WHERE w.n <> w.s AND b >= s AND h < (SELECT count(*) FROM nation))
  SELECT s AS label, min(h)::INT AS hops FROM w WHERE n = s GROUP BY s""")
def acyclic_verbs(spark, sf_dir):
    n = r.table(spark, sf_dir, "nation")
    e = n.select(F.concat(F.lit("N"), "n_nationkey").alias("source"), F.concat(F.lit("N"), (F.col("n_nationkey") * 7 + 3) % 25).alias("target"), F.lit("precedes").alias("edge_type"), F.lit("resolved").alias("resolution"))
    return relations.cycles(e, "precedes")


@register("""SELECT p_brand AS value, CASE WHEN bool_or(p_size < 3) THEN 'owned' WHEN bool_or(p_size < 6) THEN 'excused' ELSE 'unowned' END AS state FROM part GROUP BY p_brand""")
def vocabulary_coverage(spark, sf_dir):
    p = r.table(spark, sf_dir, "part")
    claims = p.where("p_size < 6").select(F.col("p_brand").alias("value"), (F.col("p_size") >= 3).alias("excused"))
    return relations.vocabulary_coverage(p.select(F.col("p_brand").alias("value")).distinct(), claims)


@register("SELECT 'PRT-' || l_partkey AS id, 'ORD-' || l_orderkey AS document, (7 + l_linenumber)::INT AS line FROM (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, '| ' || l_linenumber || ' | PRT-' || l_partkey || ' | ' || l_quantity::DECIMAL(12,2) || ' | ') - 1 AS l_linenumber FROM lineitem)")
def minted_ids(spark, sf_dir):
    docs = corpus.documents(r.orders(spark, sf_dir))
    return coverage.mint(docs, [coverage.TraceTarget("ORD", "Items", "Part", r"PRT-\d+")]).select("id", "document", F.col("line").cast("int").alias("line"))


@register("SELECT 'ORD-' || l_orderkey AS document, 'PRT-' || l_partkey AS reference FROM lineitem WHERE l_partkey % 9 = 0")
def reference_integrity(spark, sf_dir):
    docs = corpus.documents(r.orders(spark, sf_dir))
    refs = coverage.references(docs, "ORD", "Items", "Part")
    known = r.table(spark, sf_dir, "part").where("p_partkey % 9 <> 0").select(F.concat(F.lit("PRT-"), "p_partkey").alias("id"))
    return coverage.broken_references(refs, known).select("document", "reference")


_STATUS = coverage.Statuses(complete=("F",), pending=("O",), retired=("retired",))


@register("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'pending' END WHEN 2 THEN NULL WHEN 3 THEN 'retired' ELSE CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'pending' END END AS status FROM orders""")
def status_classes(spark, sf_dir):
    """Exact words, words with a letter after them, and leading markers."""
    o = r.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    value = F.when(k == 1, F.concat("o_orderstatus", F.lit(" (note)"))).when(k == 2, F.concat("o_orderstatus", F.lit("inal"))).when(k == 3, F.lit(" retired: old ")).otherwise(F.col("o_orderstatus"))
    return o.select("o_orderkey", _STATUS.classify(value).alias("status"))


@register("""SELECT l_orderkey, l_linenumber, CASE WHEN o_orderstatus = 'P' THEN 'undeclared-status' WHEN o_orderstatus = 'F' AND l_returnflag <> 'R' THEN 'status-lie' WHEN o_orderstatus = 'O' AND l_returnflag = 'R' THEN 'status-lie'
  WHEN l_linenumber = 1 THEN 'no-symbol' WHEN l_returnflag <> 'R' THEN 'unbacked' ELSE 'backed' END AS finding FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def status_findings(spark, sf_dir):
    i = r.table(spark, sf_dir, "lineitem").join(r.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    f = coverage.row_finding(_STATUS.classify(F.col("o_orderstatus")), F.col("l_returnflag") == "R", F.col("l_linenumber") != 1)
    return i.select("l_orderkey", "l_linenumber", f.alias("finding"))


@register("SELECT 'ORD-' || l_orderkey AS document, count(*) FILTER (l_returnflag = 'R') AS backed, count(*) AS total FROM lineitem GROUP BY ROLLUP (document)")
def coverage_groups_and_totals(spark, sf_dir):
    docs = corpus.documents(r.orders(spark, sf_dir))
    cells = coverage.references(docs, "ORD", "Items", "Part")
    rows = cells.select("document", F.startswith(parse.cell(F.col("headers"), F.col("cells"), "Flags"), F.lit("R")).alias("backed"))
    return coverage.groups_and_totals(rows, "document")


@register("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'retired' WHEN o_orderkey % 10 = 0 THEN 'qualified-record' WHEN o_orderpriority = '5-LOW' AND n = 0 THEN 'method-without-symbol' WHEN n = 0 THEN 'untagged' WHEN a THEN 'tagged-by-ignored-test' ELSE 'tagged' END AS status
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS n, bool_and(l_linestatus = 'O') AS a FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE n IS NOT NULL""")
def coverage_matrix_status(spark, sf_dir):
    b = r.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("n"), F.bool_and(F.col("l_linestatus") == "O").alias("ignored"))
    o = r.table(spark, sf_dir, "orders").join(b, F.col("l_orderkey") == F.col("o_orderkey"))
    status = coverage.matrix_status(F.col("o_orderstatus") == "P", F.col("o_orderkey") % 10 == 0, F.when(F.col("o_orderpriority") == "5-LOW", "test"), F.col("n"), F.col("n") > 0, F.col("ignored"))
    return o.select("o_orderkey", status.alias("status"))


@register("""SELECT 'P' || p AS id, list(x ORDER BY x) AS symbols FROM (SELECT DISTINCT l_partkey AS p, l_suppkey || ':' || l_linenumber AS x FROM lineitem) GROUP BY p HAVING count(*) > 1""")
def shared_trace_ids(spark, sf_dir):
    b = r.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("id"), F.col("l_suppkey").cast("string").alias("path"), F.col("l_linenumber").cast("string").alias("symbol"))
    s = coverage.shared_ids(b)
    return s.select("id", F.array_sort(F.transform("symbols", lambda x: F.concat(x["path"], F.lit(":"), x["symbol"]))).alias("symbols"))


@register("SELECT DISTINCT 'P' || l_partkey AS id FROM lineitem WHERE l_partkey % 5 = 0")
def untracked_symbols(spark, sf_dir):
    i = r.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("id"), F.lit("p").alias("path"), F.lit("s").alias("symbol")).distinct()
    m = r.table(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(F.concat(F.lit("P"), "p_partkey").alias("id"))
    return coverage.untracked(i, m).select("id")


@register("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'acme/shop' WHEN 1 THEN 'm1' WHEN 2 THEN 'm2' END AS member, CASE o_orderkey % 4 WHEN 2 THEN 'B-' ELSE '' END || o_orderkey AS id FROM orders""")
def qualified_ids(spark, sf_dir):
    o = r.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    ref = F.concat(F.when(k == 0, "ix://Acme/Shop/deep/").when(k == 1, "one:").when(k == 2, "one-B-").otherwise(""), "o_orderkey")
    q = coverage.qualified(ref, [("one:", "m1"), ("one-", "m2"), ("one", "m3")])
    return o.select("o_orderkey", q["member"].alias("member"), q["id"].alias("id"))


@register("""WITH d AS (SELECT p_partkey AS id, p_size = 1 AS retired FROM part), m AS (SELECT DISTINCT p_partkey + i AS id FROM part, (VALUES (0), (1)) v(i) WHERE p_partkey % 4 = 0)
  SELECT 'A-' || id AS id, 'unmapped' AS gap FROM d WHERE NOT retired AND id NOT IN (SELECT id FROM m) UNION ALL SELECT 'A-' || id, 'undeclared' FROM m WHERE id NOT IN (SELECT id FROM d)""")
def audit_gaps(spark, sf_dir):
    p = r.table(spark, sf_dir, "part")
    d = p.select(F.concat(F.lit("A-"), "p_partkey").alias("id"), (F.col("p_size") == 1).alias("retired"))
    m = p.where("p_partkey % 4 = 0").select(F.concat(F.lit("A-"), "p_partkey", F.lit(".."), F.col("p_partkey") + 1).alias("reference"))
    return coverage.audit_gaps(d, m)


@register("""SELECT 'OB-' || o_orderkey AS id, o_orderpriority AS method, CASE WHEN o_orderkey % 2 = 0 THEN ['T-1', 'T-' || o_custkey] ELSE []::VARCHAR[] END AS target_ids, o_orderstatus AS status FROM orders""")
def obligations(spark, sf_dir):
    o = r.table(spark, sf_dir, "orders")
    tail = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("T-1, T-"), "o_custkey", F.lit(")"))).otherwise("T-1")
    rows = o.withColumn("method", F.concat("o_orderpriority", F.lit(" ("), tail))
    ob = coverage.obligations(rows, "OB-{o_orderkey}", {"status": "o_orderstatus", "none": "missing"} if "missing" in rows.columns else {"status": "o_orderstatus"})
    return ob.select("id", "method", "target_ids", F.element_at("parameters", F.lit("status")).alias("status"))


@register("""WITH v AS (SELECT DISTINCT 'brand' AS d, p_brand AS v FROM part UNION SELECT DISTINCT 'size', p_size::VARCHAR FROM part UNION SELECT 'x', unnest(['a', 'b']))
  SELECT a.v AS value_1, b.v AS value_2 FROM v a JOIN v b ON a.d < b.d WHERE NOT (a.d = 'size' AND a.v = '1' AND b.d = 'x' AND b.v = 'a')""")
def combinatorial_tuples(spark, sf_dir):
    """Pairs of every brand and every size of the part table."""
    p = r.table(spark, sf_dir, "part")
    v = p.select(F.lit("brand").alias("dimension"), F.col("p_brand").alias("value")).union(p.select(F.lit("size"), F.col("p_size").cast("string"))).distinct()
    v = v.union(spark.createDataFrame([("x", "a"), ("x", "b")], v.schema))
    bad = spark.createDataFrame([("size", "1", "x", "a")], "dim_a string, value_a string, dim_b string, value_b string")
    return coverage.combinatorial_tuples(v, 2, bad).select("value_1", "value_2")


@register("""SELECT metric, matched::BIGINT AS matched, population::BIGINT AS population, CASE WHEN population > 0 THEN round(100.0 * matched / population, 2)::DOUBLE END AS value, CASE WHEN population = 0 THEN 'not_computed' WHEN matched = 0 THEN 'hollow' ELSE 'measured' END AS state FROM (
  SELECT 'finished' AS metric, count(*) FILTER (o_orderstatus = 'F') AS matched, count(*) AS population FROM orders UNION ALL SELECT 'impossible', 0, count(*) FILTER (o_orderstatus = 'O') FROM orders UNION ALL SELECT 'nobody', 0, 0)""")
def metrics(spark, sf_dir):
    o = r.table(spark, sf_dir, "orders")
    yes, no = F.lit(True), F.lit(False)
    return coverage.metric_rows(o, {"finished": (F.col("o_orderstatus") == "F", yes), "impossible": (F.col("o_orderkey") < 0, F.col("o_orderstatus") == "O"), "nobody": (yes, no)})


@register("""SELECT o_orderkey AS record, CASE WHEN o_custkey % 5 = 0 THEN 'invalid-target' WHEN o_orderstatus = 'P' THEN 'wrong-revision' WHEN c > 1 THEN 'record-conflict' WHEN o_orderpriority = '5-LOW' THEN 'failed' END AS cause
  FROM (SELECT *, o_orderstatus = 'P' AS old FROM orders) JOIN (SELECT o_custkey, o_orderstatus = 'P' AS old, count(DISTINCT o_orderpriority) AS c FROM orders GROUP BY 1, 2) USING (o_custkey, old)""")
def evidence_causes(spark, sf_dir):
    """The causes of every order's record."""
    o = r.table(spark, sf_dir, "orders")
    records = o.select(F.col("o_orderkey").alias("record"), F.col("o_custkey").alias("target"), F.when(F.col("o_orderpriority") == "5-LOW", "failed").otherwise("passed").alias("outcome"), F.when(F.col("o_orderstatus") == "P", "old").otherwise("r1").alias("revision"), F.col("o_orderpriority").alias("content"))
    targets = o.where("o_custkey % 5 <> 0").select(F.col("o_custkey").alias("id")).distinct()
    return coverage.reconcile_evidence(records, targets, "r1").select("record", "cause")


@register("""SELECT c_custkey, clause, CASE WHEN e THEN 'binding' WHEN NOT e THEN 'not_binding' ELSE 'unresolved' END AS outcome FROM (
  SELECT c_custkey, 'all' AS clause, (s = 'BUILDING') AND (t >= 2) AS e FROM d UNION ALL SELECT c_custkey, 'any', (s = 'BUILDING') OR (t >= 2) FROM d UNION ALL SELECT c_custkey, 'free', true FROM d UNION ALL SELECT c_custkey, 'not', NOT (s IN ('FURNITURE', 'MACHINERY')) FROM d)""".replace("FROM d", "FROM (SELECT c_custkey, CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_mktsegment END AS s, CASE WHEN c_custkey % 4 < 3 THEN c_custkey % 4 + 1 END AS t FROM customer) d"))
def clause_binding(spark, sf_dir):
    c = r.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.element_at(F.array(F.lit("low"), F.lit("mid"), F.lit("high"), F.lit(None)), (F.col("c_custkey") % 4 + 1).cast("int")).alias("tier"))
    dims = {"segment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"], "tier": ["low", "mid", "high"]}
    a, b = {"eq": ["segment", "BUILDING"]}, {"at_least": ["tier", "mid"]}
    rules = [{"id": "all", "applies": {"all": [a, b]}}, {"id": "any", "applies": {"any": [a, b]}}, {"id": "free"}, {"id": "not", "applies": {"not": {"in": ["segment", ["FURNITURE", "MACHINERY"]]}}}]
    return clauses.evaluate(c, rules, dims).select("c_custkey", "clause", "outcome")


@register("SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'added' WHEN c_custkey % 10 = 1 THEN 'removed' ELSE 'changed' END AS change FROM customer WHERE c_custkey % 10 < 3")
def clause_diff(spark, sf_dir):
    c = r.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"))
    new = c.where("id % 10 <> 1").withColumn("text", F.when(F.col("id") % 10 == 2, F.lit("new")).otherwise(F.col("text")))
    return clauses.diff(c.where("id % 10 <> 0"), new)


@register("""WITH s AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS b, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT 'CUS-' || c_custkey AS key, c_nationkey FROM customer WHERE c_custkey % 7 <> 0)
  SELECT 'ORD-' || o_orderkey AS key, CASE WHEN o_custkey % 7 = 0 THEN 'uncovered' ELSE 'covered' END AS state, CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN b = n THEN 'verified' WHEN b = 0 THEN 'unverified' ELSE 'partial' END AS verification,
  CASE WHEN o_custkey % 7 = 0 THEN ['CUS-' || o_custkey] END AS dangling FROM orders JOIN s USING (o_custkey)""")
def relation_report(spark, sf_dir):
    docs, e = _authored(spark, sf_dir)
    s = r.table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("CUS-"), "o_custkey").alias("key")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("backed"), F.count("*").alias("total"))
    rep = relations.relation_report(docs, e, "ORD", "placed_by", "CUS", s)
    return rep.select("key", "state", F.get("linked", F.lit(0))["verification"].alias("verification"), "dangling")


@register("SELECT p_brand AS criterion, coalesce(list(DISTINCT 'S' || p_size ORDER BY 'S' || p_size) FILTER (p_size < 9), []) AS elements FROM part GROUP BY p_brand")
def design_matrix(spark, sf_dir):
    p = r.table(spark, sf_dir, "part")
    realized = p.where("p_size < 9").select(F.col("p_brand").alias("criterion"), F.concat(F.lit("S"), "p_size").alias("element"))
    return relations.design_matrix(p.select(F.col("p_brand").alias("criterion")).distinct(), realized)


@register("""SELECT 'n' || c_nationkey || '/' AS folder, 'C' || c_custkey || '.md' AS missing FROM customer WHERE c_custkey % 5 = 0""")
def index_completeness(spark, sf_dir):
    c = r.table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey", F.lit("/")).alias("folder"), F.concat(F.lit("C"), "c_custkey", F.lit(".md")).alias("name"), "c_custkey")
    leaf = c.select(F.concat("folder", "name").alias("path"), F.lit("---\nid: x\n---\nbody").alias("raw"))
    link = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("- [c](./"), "name", F.lit(")")))
    index = c.groupBy("folder").agg(F.array_join(F.array_sort(F.collect_list(link)), "\n").alias("links"))
    index = index.select(F.concat("folder", F.lit("index.md")).alias("path"), F.concat(F.lit("---\nkind: index\n---\n# I\n## Contents\n"), "links", F.lit("\n## Other\n[x](C5.md)")).alias("raw"))
    docs = corpus.documents(leaf.unionByName(index))
    return corpus.index_gaps(docs)


@register("""SELECT 'p' || p_partkey || '.md' AS path, 'FR-' || (p_size + 40) AS token, CASE WHEN p_size + 40 <= 60 THEN 'link' WHEN p_size + 40 <= 70 THEN 'ambiguous' ELSE 'unresolved' END AS outcome, CASE WHEN p_size + 40 <= 60 THEN 'd/FR-' || (p_size + 40) || '.md' END AS link FROM part
  UNION ALL SELECT 'p' || p_partkey || '.md', 'FR-41-AC-2', 'link', 'd/FR-41.md' FROM part""")
def unlinked_refs(spark, sf_dir):
    holders = spark.range(1, 71).select(F.concat(F.lit("d/FR-"), "id", F.lit(".md")).alias("path"), F.concat(F.lit("---\nid: FR-"), "id", F.lit("\n---\nx")).alias("raw"))
    more = spark.range(61, 71).select(F.concat(F.lit("e/FR-"), "id", F.lit(".md")).alias("path"), F.concat(F.lit("---\nid: FR-"), "id", F.lit("\n---\nx")).alias("raw"))
    p = r.table(spark, sf_dir, "part")
    prose = p.select(F.concat(F.lit("p"), "p_partkey", F.lit(".md")).alias("path"), r.text("---\nid: P-", F.col("p_partkey"), "\n---\nSee FR-", F.col("p_size") + 40, " and FR-41-AC-2, [FR-3](x.md), ix://a/b/FR-4.\n```\nFR-5\n```\n").alias("raw"))
    docs = corpus.documents(holders.unionByName(more).unionByName(prose))
    return corpus.unlinked(docs).where("path LIKE 'p%'")


@register("SELECT DISTINCT upper(p_brand) AS term FROM part UNION SELECT 'Extra' UNION SELECT DISTINCT 'T' || p_size FROM part")
def glossary(spark, sf_dir):
    p = r.table(spark, sf_dir, "part")
    raw = r.text("---\nid: G-", F.col("p_partkey"), "\n---\n## Terms\n| Term | Meaning |\n|--|--|\n| ", F.upper("p_brand"), " | m |\n\n## 2. Ubiquitous Language\n- **T", F.col("p_size"), "** — meaning\n- plain\n")
    return corpus.glossary(corpus.documents(p.select(r.text(F.col("p_partkey"), ".md").alias("path"), raw.alias("raw"))), ["Extra"])


@register("SELECT p_partkey, 'a/b/x-' || p_size || '.md' AS resolved, '../../c/d.md' AS relative FROM part")
def paths(spark, sf_dir):
    p = r.table(spark, sf_dir, "part")
    link = F.concat(F.lit(".././q/../x-"), "p_size", F.lit(".md#part"))
    return p.select("p_partkey", t.resolve_link(F.lit("a/b/c/doc.md"), link).alias("resolved"), corpus.relative_path(F.lit("a/b/doc.md"), F.lit("c/d.md")).alias("relative"))


@register(f"""WITH {_EDGE_SQL} SELECT 'documents ORD' AS metric, count(*) AS value FROM orders UNION ALL SELECT 'documents CUS', count(*) FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT 'documents NAT', count(*) FROM nation
  UNION ALL SELECT 'documents REG', count(*) FROM region UNION ALL SELECT 'edges resolved', count(*) FROM edges WHERE ok UNION ALL SELECT 'edges dangling', count(*) FROM edges WHERE NOT ok
  UNION ALL SELECT 'duplicate ids', 0""")
def corpus_report(spark, sf_dir):
    """The flagship: a corpus in numbers, from Markdown text to resolved edges."""
    docs, e = _authored(spark, sf_dir)
    kinds = docs.groupBy(F.concat(F.lit("documents "), "type").alias("metric")).agg(F.count("*").alias("value"))
    edges = e.groupBy(F.concat(F.lit("edges "), "resolution").alias("metric")).agg(F.count("*").alias("value"))
    dup = corpus.duplicates(docs).agg(F.lit("duplicate ids").alias("metric"), F.count("*").alias("value"))
    return kinds.unionByName(edges).unionByName(dup).orderBy("metric")
