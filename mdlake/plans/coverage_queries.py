"""Queries of diagnostics, asserts, profiles, lookups and scepticism."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from mdlake.operators import bundle, contract, corpus, coverage, diagnostics, extract, parse, prose, query, relations, semantic, symbols
from mdlake.plans import documents_queries as base
from mdlake.plans import graph_queries as graph
from mdlake.sources import rendered as r

QUERIES, ORACLE = {}, {}
register = partial(base.register, queries=QUERIES, oracle=ORACLE)


def _part(spark, sf_dir):
    return r.table(spark, sf_dir, "part")


def _documents(p, path, *raw):
    return corpus.documents(p.select(r.text(*path).alias("path"), r.text(*raw).alias("raw")))


@register("""SELECT 'fr' || p_size || '-ac' || lpad(p_partkey::VARCHAR, 9, '0') AS id, 'FR-' || p_size || '-AC-' || p_partkey AS row_id FROM part WHERE p_partkey % 3 <> 2""")
def trace_near_misses(spark, sf_dir):
    """Tags in another case and padding than the unbacked row; every third row has none."""
    p = _part(spark, sf_dir)
    tags = p.select(F.concat(F.lit("fr"), "p_size", F.lit("-ac"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("id"), F.lit("a.py").alias("path"), F.lit("t").alias("symbol"), F.lit(1).alias("line"))
    rows = p.where("p_partkey % 3 <> 2").select(F.concat(F.lit("FR-"), "p_size", F.lit("-AC-"), "p_partkey").alias("target_id"), F.lit("d").alias("document"))
    return diagnostics.near_misses(tags, rows).select("id", "row_id")


@register("""WITH c AS (SELECT 'FR-' || p_size AS parent, 'FR-' || p_size || '-AC-' || p_partkey AS id FROM part WHERE p_size % 3 <> 0)
  SELECT 'FR-' || s.p_size || '-X-1' AS id, c.parent, count(*) AS n, list_slice(list(c.id ORDER BY c.id), 1, 5) AS shown FROM (SELECT DISTINCT p_size FROM part) s JOIN c ON c.parent = 'FR-' || s.p_size GROUP BY 1, 2""")
def minted_children(spark, sf_dir):
    """A tag whose nearest parent has minted ids."""
    p = _part(spark, sf_dir)
    minted = p.where("p_size % 3 <> 0").select(F.concat(F.lit("FR-"), "p_size", F.lit("-AC-"), "p_partkey").alias("id"))
    tags = p.select(F.concat(F.lit("FR-"), "p_size", F.lit("-X-1")).alias("id"), F.lit("a.py").alias("path"), F.lit("t").alias("symbol"), F.lit(1).alias("line")).distinct()
    return diagnostics.minted_children(tags, minted).select("id", "parent", "n", "shown")


def _marked(spark, sf_dir):
    p = _part(spark, sf_dir)
    source = r.text("# see FR-", F.col("p_partkey"), "\ndef area(x):\n    return x\n\n# FR-7 and FR-", F.col("p_partkey"), "\n# formalizes: FR-", F.col("p_size"), ", FR-", F.col("p_size"), "\n@trace(\"FR-7\")\ndef test_area():\n    assert area(1) == 1\n")
    return symbols.extract(p.select(r.text("t", F.col("p_partkey"), ".py").alias("path"), source.alias("source")))


@register("""SELECT id, path, symbol, owner, instead FROM (SELECT 't' || p_partkey || '.py' AS path, unnest(['FR-' || p_partkey, 'FR-' || p_partkey, 'FR-' || p_size]) AS id, unnest(['area', 'test_area', 'test_area']) AS symbol,
  unnest(['production', 'evidence', 'evidence']) AS owner, unnest([NULL, '@trace("FR-' || p_partkey || '")', '@trace("FR-' || p_size || '")']) AS instead, unnest([3, 1, 2]) AS n, p_partkey, p_size FROM part)
  WHERE NOT (owner = 'evidence' AND id = 'FR-7') GROUP BY ALL""")
def outside_markers(spark, sf_dir):
    """Ids in comments that no marker binds: on a function, and on a test with another id."""
    s = _marked(spark, sf_dir)
    b = symbols.bind(s, [{"pattern": r"@trace\(['\"]([^)]*)['\"]\)"}])
    return diagnostics.outside_markers(s, b, r"FR-\d+", {"python": "@trace({ids})"}).select("id", "path", "symbol", "owner", "instead").distinct()


@register("""SELECT 'FR-' || p_size AS id, 't' || p_partkey || '.py' AS path, CASE WHEN p_size > 40 THEN 'formalizes-unknown-id' END AS unknown, 'duplicate-formalizes-claim' AS twice FROM part""")
def formalized_ids(spark, sf_dir):
    """Claims of known and unknown ids, each named twice."""
    known = spark.range(1, 41).select(F.concat(F.lit("FR-"), "id").alias("id"))
    relations_, findings = diagnostics.formalizes(_marked(spark, sf_dir), r"\A# formalizes: (.*)\z", known)
    f = findings.groupBy("id", "path").agg(F.max(F.when(F.col("reason") == "formalizes-unknown-id", F.col("reason"))).alias("unknown"), F.max(F.when(F.col("reason") != "formalizes-unknown-id", F.col("reason"))).alias("twice"))
    held = relations_.select("id", "path", F.lit(True).alias("resolved"))
    return f.join(held, ["id", "path"], "left").where(F.col("resolved").isNull() == F.col("unknown").isNotNull()).select("id", "path", "unknown", "twice")


@register("""SELECT 'B' || p_brand AS document, count(*) AS criteria, count(*) FILTER (p_size % 3 < 2) AS property_shaped, count(*) FILTER (p_size % 3 = 1 AND p_size > 25) AS specific_shaped,
  CASE WHEN count(*) FILTER (p_size % 3 < 2) > 0 AND count(*) FILTER (p_size % 3 = 1 AND p_size > 25) = 0 THEN min(p_partkey) FILTER (p_size % 3 < 2) END AS catch_all_line FROM part GROUP BY p_brand""")
def criteria_shapes(spark, sf_dir):
    """Universal, specific and example criteria of each brand."""
    k = F.col("p_size") % 3
    s = F.when(k == 0, "Every row has a key").when((k == 1) & (F.col("p_size") > 25), "Rows are sorted by key").when(k == 1, "Each row keeps its key").otherwise("The door returns a code")
    rows = _part(spark, sf_dir).select(F.concat(F.lit("B"), "p_brand").alias("document"), F.concat(F.lit("AC-"), "p_partkey").alias("row_id"), F.col("p_partkey").alias("line"), s.alias("statement"))
    return diagnostics.criteria_counts(rows).select("document", "criteria", "property_shaped", "specific_shaped", "catch_all_line")


@register("""SELECT p_brand AS source, 'M' || p_size AS method, count(*) AS rows, min('D' || p_partkey) AS document FROM part WHERE p_size > 10 AND p_size % 2 = 1 GROUP BY 1, 2""")
def uncatalogued_methods(spark, sf_dir):
    """Methods of live obligations that the catalog lacks; it has the even ones, in lower case."""
    o = _part(spark, sf_dir).select(F.col("p_brand").alias("source"), F.concat(F.lit("M"), "p_size").alias("method"), F.concat(F.lit("D"), "p_partkey").alias("document"), (F.col("p_size") <= 10).alias("retired"))
    known = spark.range(0, 60, 2).select(F.concat(F.lit(" m"), "id").alias("name"))
    return diagnostics.uncatalogued(o, known)


@register("""SELECT 'P-' || p_partkey AS key, unnest(CASE p_size % 4 WHEN 0 THEN [] WHEN 1 THEN ['level'] WHEN 2 THEN ['min-items'] ELSE ['level', 'min-items'] END) AS "check",
  unnest(CASE p_size % 4 WHEN 0 THEN [] WHEN 1 THEN ['level 3'] WHEN 2 THEN ['1 items'] ELSE ['no section', 'no section'] END) AS message FROM part""")
def section_asserts(spark, sf_dir):
    """A section at another level, with too few items, and none."""
    k = F.col("p_size") % 4
    head = F.when(k == 3, "## Other").when(k == 1, "### 1. Steps").otherwise("## Steps")
    items = F.when(k == 2, "- a\n").otherwise("- a\n* b\n")
    docs = _documents(_part(spark, sf_dir), (F.col("p_partkey"), ".md"), "---\nid: P-", F.col("p_partkey"), "\n---\n# T\n", head, "\n", items, "1. no bullet\n")
    return contract.section_asserts(docs, "Steps", 2, 2)


@register("""SELECT 'P-' || p_partkey AS key, 'sentence-length' AS rule, 1 AS line FROM part WHERE p_size % 4 = 0 UNION ALL SELECT 'P-' || p_partkey, 'heading-skip', NULL FROM part WHERE p_size % 4 = 1
  UNION ALL SELECT 'P-' || p_partkey, 'undefined-acronym', NULL FROM part WHERE p_size % 4 = 2""")
def plain_language(spark, sf_dir):
    """A profile over documents that break one rule each, define what they abbreviate, or are of another type."""
    return prose.check_profile(_plain(spark, sf_dir), _PROFILE)["findings"].select("key", "rule", "line")


@register("""SELECT 'plain' AS profile, '1' AS version, count(*) AS documents_examined, count(*) FILTER (p_size % 4 <> 3 OR p_size % 8 = 7) AS readable_documents, 2 * count(*) FILTER (p_size % 4 <> 3) + 2 * count(*) FILTER (p_size % 8 = 7) + count(*) FILTER (p_size % 4 = 1) AS readable_blocks FROM part""")
def plain_language_counts(spark, sf_dir):
    return prose.check_profile(_plain(spark, sf_dir), _PROFILE)["counts"]


_PROFILE = prose.Profile("plain", "1", 8, 1, ("A",), ("KNW",), ("MUST",))


def _plain(spark, sf_dir):
    k = F.col("p_size") % 4
    body = F.when(k == 0, "# H\nOne two three four five six seven eight nine.\n```\nX Y\n```\n").when(k == 1, "# H\n### J\nShort MUST text.\n").when(k == 2, "# H\nThe ABC is not defined, KNW is.\n")
    body = body.otherwise(F.when(F.col("p_size") % 8 == 7, "# H\nA Big Cat (ABC) is an ABC.\n").otherwise("```\ncode only\n```\n"))
    return _documents(_part(spark, sf_dir), (F.col("p_partkey"), ".md"), "---\nid: P-", F.col("p_partkey"), "\ntype: A\n---\n", body)


@register("""SELECT 'P-' || p_partkey AS key, kind, line, statement FROM part, (VALUES ('requirement', 1, 'The system shall manage it.'), ('requirement', 1, 'It may stop.'), ('requirement', 10, 'It shall be robust'), ('criterion', 14, 'The door works')) v(kind, line, statement) WHERE p_size % 2 = 0""")
def requirement_statements(spark, sf_dir):
    """Sentences with a modal verb and cells of the sections that hold requirements, by type."""
    kind = F.when(F.col("p_size") % 2 == 0, "FR").otherwise("TC")
    body = "## Description\nIntro. The system shall manage it. It may stop.\n> quoted shall\n```\nit shall not\n```\n## 2. Constraints\n| ID | Constraint |\n|---|---|\n| C-1 |  |\n| C-2 | It shall be robust |\n## Acceptance Criteria\n| ID | Criteria |\n|---|---|\n| AC-1 | The door works |\n"
    docs = _documents(_part(spark, sf_dir), (F.col("p_partkey"), ".md"), "---\nid: P-", F.col("p_partkey"), "\ntype: ", kind, "\n---\n", F.lit(body))
    return bundle.statements(docs).select("key", "kind", F.col("line").cast("int").alias("line"), "statement")


@register("""SELECT 'P-' || p_partkey AS key, "check" FROM part, (VALUES ('ears:vague-response'), ('quality:ambiguous-term'), ('ac:vacuous-outcome')) v("check")""")
def grammar_packs(spark, sf_dir):
    body = "## Description\nThe system shall manage it.\nIt shall write robust code by the tool.\n## Acceptance Criteria\n| ID | Criteria |\n|---|---|\n| AC-1 | The door works |\n"
    docs = _documents(_part(spark, sf_dir), (F.col("p_partkey"), ".md"), "---\nid: P-", F.col("p_partkey"), "\ntype: FR\n---\n", F.lit(body))
    out = None
    for f in bundle.grammar_findings(docs):
        out = f if out is None else out.unionByName(f)
    return out.select("key", "check")


@register("SELECT doc_id, acronym FROM (SELECT p_partkey AS doc_id, unnest(CASE p_size % 3 WHEN 0 THEN ['XY'] WHEN 1 THEN [] ELSE ['QRS', 'XY'] END) AS acronym FROM part)")
def acronym_definitions(spark, sf_dir):
    """Used without definition, defined before use, used before its definition."""
    k = F.col("p_size") % 3
    text = F.when(k == 0, "The XY opens, see TC-12.").when(k == 1, "A Xtra Yard (XY) opens. The XY shuts.").otherwise("The XY shuts. A Xtra Yard (XY) opens. QRS too.")
    return prose.undefined_acronyms(_part(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), text.alias("text")), by="doc_id")


@register("SELECT 'ORD-' || o_orderkey AS doc_key, 2 AS id_line, 4 AS status_line, NULL::INT AS none_line, strlen('---' || chr(10) || 'id: ORD-' || o_orderkey || chr(10) || 'type: ORD' || chr(10) || 'status: ' || o_orderstatus || chr(10) || 'priority: ''' || o_orderpriority || '''' || chr(10) || 'relationships:' || chr(10) || '  - {target: ''ix://acme/sales/CUS-' || o_custkey || ''', type: placed_by}' || chr(10) || '---' || chr(10)) AS offset FROM orders")
def key_lines(spark, sf_dir):
    """Lines of header keys, and the bytes before the body."""
    d = parse.with_header(r.orders(spark, sf_dir))
    return d.select("doc_key", parse.key_line(F.col("raw"), "id").alias("id_line"), parse.key_line(F.col("raw"), "status").alias("status_line"), parse.key_line(F.col("raw"), "status.none").alias("none_line"), query.body_offset(F.col("raw"), F.col("body")).cast("long").alias("offset"))


@register("""SELECT 'CUS-' || c_custkey AS source, 'NAT-' || c_nationkey AS target, CASE WHEN c_nationkey % 5 <> 0 THEN 'resolved' ELSE 'dangling' END AS resolution, CASE WHEN c_nationkey % 5 <> 0 THEN 'acme/geo' END AS target_member, ['acme/geo'] AS authorities FROM customer""")
def cross_repository_edges(spark, sf_dir):
    """References by authority into another member of the corpus, which lacks some of them."""
    c, n = r.table(spark, sf_dir, "customer"), r.table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0")
    crm = c.select(r.text("c/", F.col("c_custkey"), ".md").alias("path"), r.text("---\nid: CUS-", F.col("c_custkey"), "\n---\nix://Acme/Geo/NAT-", F.col("c_nationkey"), "\n").alias("raw"))
    geo = n.select(r.text("n/", F.col("n_nationkey"), ".md").alias("path"), r.text("---\nid: NAT-", F.col("n_nationkey"), "\n---\n").alias("raw"))
    docs = corpus.documents(crm, "acme/crm").unionByName(corpus.documents(geo, "acme/geo"))
    return corpus.Corpus.of(docs).edges.select("source", "target", "resolution", "target_member", "authorities")


@register("SELECT 'CUS-4' AS key, 'customers/CUS-4.md' AS path, 'CUS' AS type")
def lookup_by_id(spark, sf_dir):
    docs = corpus.documents(r.customers(spark, sf_dir))
    return corpus.Corpus(docs, docs).by_qualified_id("", "CUS-4").select("key", "path", "type")


@register("""WITH s AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS b, count(*) AS n FROM orders GROUP BY 1), q AS (SELECT CASE WHEN o_custkey % 7 = 0 THEN 'uncovered' ELSE 'covered' END AS state, CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN b = n THEN 'verified' WHEN b = 0 THEN 'unverified' ELSE 'partial' END AS v FROM orders JOIN s USING (o_custkey))
  SELECT 'state' AS kind, state AS name, count(*) AS n FROM q GROUP BY state UNION ALL SELECT 'verification', v, count(*) FROM q WHERE v IS NOT NULL GROUP BY v""")
def relation_summary(spark, sf_dir):
    docs, e = graph._authored(spark, sf_dir)
    s = r.table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("CUS-"), "o_custkey").alias("key")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("backed"), F.count("*").alias("total"))
    return relations.relation_summary(relations.relation_report(docs, e, "ORD", "placed_by", "CUS", s))


@register("SELECT 'Brand#' || a || b AS type FROM range(1, 7) x(a), range(1, 7) y(b) WHERE 'Brand#' || a || b NOT IN (SELECT p_brand FROM part)")
def dead_declarations(spark, sf_dir):
    docs = _documents(_part(spark, sf_dir), (F.col("p_partkey"), ".md"), "---\nid: P-", F.col("p_partkey"), "\ntype: '", F.col("p_brand"), "'\n---\n")
    return relations.dead_declarations(docs, [f"Brand#{a}{b}" for a in range(1, 7) for b in range(1, 7)])


@register("SELECT p_brand AS source, 'P-' || p_partkey AS id FROM part WHERE p_brand IN ('Brand#11', 'Brand#23')")
def obligation_inventory(spark, sf_dir):
    rows = _part(spark, sf_dir).select(F.col("p_brand").alias("source"), F.concat(F.lit("P-"), "p_partkey").alias("id"))
    return coverage.inventory(rows, ["Brand#11", "Brand#23"], ["Brand#11", "Brand#12", "Brand#23"])[0]


@register("""SELECT unnest(list_filter([CASE WHEN n_unbacked > 0 THEN 'unbacked-rows' END, CASE WHEN n_lies > 0 THEN 'status-lies' END, 'evidence'], lambda x: x IS NOT NULL)) AS reason FROM (
  SELECT count(*) FILTER (l_returnflag <> 'R' AND o_orderstatus = 'O') AS n_unbacked, count(*) FILTER (o_orderstatus = 'F' AND l_returnflag <> 'R') AS n_lies FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")
def strict_reasons(spark, sf_dir):
    i = r.table(spark, sf_dir, "lineitem").join(r.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    finding = F.when((F.col("o_orderstatus") == "F") & (F.col("l_returnflag") != "R"), "status-lie").when((F.col("o_orderstatus") == "O") & (F.col("l_returnflag") != "R"), "unbacked").otherwise("backed")
    status = F.when(F.col("o_orderstatus") == "P", "Planned later").otherwise(F.col("o_orderstatus"))
    reasons = coverage.strict_decision(i.select(finding.alias("finding"), status.alias("status")), 5, 3, 0)
    return spark.createDataFrame([(x,) for x in reasons], "reason string")


def _copies(spark, sf_dir):
    """Two functions and two tests a part: one test repeats the function, one calls it."""
    p = _part(spark, sf_dir)
    body = lambda name: r.text("def ", F.lit(name), F.col("p_partkey"), "(width", F.col("p_partkey"), ", height", F.col("p_partkey"), "):\n    total = width", F.col("p_partkey"), " * height", F.col("p_partkey"), "\n    return total\n")
    more = F.when(F.col("p_size") % 2 == 0, "    assert total\n    if total:\n        print(one, two, three, four)\n").otherwise("")
    source = F.concat(body("area"), F.lit("\n"), body("test_area"), more, F.lit("\ndef test_call():\n    if area(1, 2):\n        assert area(1, 2) == 2\n"))
    return p.select(r.text("m", F.col("p_partkey"), ".py").alias("path"), source.alias("source"))


@register("""WITH t AS (SELECT p_partkey AS k, unnest(['area', 'test_area', 'test_call']) AS f, unnest([['def', 'area' || p_partkey, 'width' || p_partkey, 'height' || p_partkey, 'total', 'return'],
    list_concat(['def', 'test_area' || p_partkey, 'width' || p_partkey, 'height' || p_partkey, 'total', 'return'], CASE WHEN p_size % 2 = 0 THEN ['assert', 'if', 'print', 'one', 'two', 'three', 'four'] ELSE [] END),
    ['def', 'test_call', 'if', 'area', 'assert']]) AS w FROM part),
  x AS (SELECT k, f, unnest(w) AS w, len(w) AS n FROM t)
  SELECT 'test_area' || a.k AS test, 'area' || b.k AS function, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 6) AS score FROM x a JOIN x b ON a.w = b.w AND a.f = 'test_area' AND b.f = 'area' GROUP BY a.k, b.k HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.7""")
def copied_oracles(spark, sf_dir):
    """Tests that repeat a function's text; the SQL compares all pairs that share a token."""
    f = _copies(spark, sf_dir)
    s = symbols.extract(f)
    c = symbols.copied_oracles(s, f, 0.7)
    name = lambda x: F.get_json_object(x, "$[2]")
    return c.select(name(F.col("test")).alias("test"), name(F.col("function")).alias("function"), F.round("score", 6).alias("score"))


@register("SELECT 'm' || p_partkey || '.py' AS path, 'test_call' AS symbol FROM part")
def vacuous_tests(spark, sf_dir):
    f = _copies(spark, sf_dir)
    return symbols.vacuous_tests(symbols.extract(f), f).select("path", F.get_json_object("id", "$[2]").alias("symbol"))


@register("""SELECT 'P-' || p_partkey AS key, name, category, error FROM part, (VALUES ('own', 'owns', 0), ('bad', 'hums', 1), ('far', 'owns', 2)) v(name, verb, n), LATERAL (SELECT CASE WHEN n <> 1 THEN 'structure' END AS category, CASE WHEN n = 1 THEN 'unknown-verb' WHEN n = 2 AND p_size % 2 = 0 THEN 'no-target' END AS error)""")
def semantic_relationships(spark, sf_dir):
    far = F.when(F.col("p_size") % 2 == 0, " ").otherwise("Other")
    docs = _documents(_part(spark, sf_dir), (F.col("p_partkey"), ".md"), "---\nid: P-", F.col("p_partkey"), "\n---\n## Relationships\n| Name | Verb | Target | Multiplicity |\n|---|---|---|---|\n| own | owns | Part | 1 |\n| bad | hums | Part | 1 |\n| far | owns | ", far, " | 0..* |\n")
    return semantic.relationships(docs, {"owns": "structure"}).select("key", "name", "category", "error")


@register("""SELECT 'P-' || p_partkey AS key, source, target, (n = 0 OR p_size % 2 = 0) AS resolved FROM part, (VALUES (0, 'a.in', 'b.out'), (1, 'a.in', 'c.none')) v(n, source, target)""")
def system_connections(spark, sf_dir):
    """Connections that end at declared ports, or don't."""
    third = F.when(F.col("p_size") % 2 == 0, "| c | none |\n").otherwise("")
    docs = _documents(_part(spark, sf_dir), (F.col("p_partkey"), ".md"), "---\nid: P-", F.col("p_partkey"), "\n---\n## Parts\n| Part | Type |\n|---|---|\n| a | T |\n\n## Ports\n| Part | Port |\n|---|---|\n| a | in |\n| b | out |\n", third, "\n## Connections\n| From | To |\n|---|---|\n| a.in | b.out |\n| a.in | c.none |\n\n## Allocations\n| Function | Part |\n|---|---|\n| f | a |\n")
    return semantic.system_tables(docs)["connections"]


@register("SELECT 'P-' || p_partkey AS key, 'Why ' || p_brand AS why, NULL::VARCHAR AS none FROM part")
def record_sections(spark, sf_dir):
    docs = _documents(_part(spark, sf_dir), (F.col("p_partkey"), ".md"), "---\nid: P-", F.col("p_partkey"), "\n---\n## 1. Context\nWhy ", F.col("p_brand"), "\n\n## Other\nx\n")
    return semantic.record(docs, {"why": "Context", "none": "Decision"}).select("key", "record.why", "record.none")


@register("SELECT 'index.md' AS path FROM (SELECT count(*) AS n FROM part) WHERE n > 0")
def index_versions(spark, sf_dir):
    """A root index without version; those of folders and of versioned roots are fine."""
    p = _part(spark, sf_dir)
    folders = p.select(r.text("f", F.col("p_partkey"), "/index.md").alias("path"), F.lit("---\nkind: index\n---\n").alias("raw"))
    root = p.agg(F.lit("index.md").alias("path"), F.concat(F.lit("---\nn: "), F.count("*").cast("string"), F.lit("\n---\n")).alias("raw"))
    return corpus.index_versions(corpus.documents(folders.unionByName(root)))


@register("""SELECT metric, value, baseline, CASE WHEN baseline IS NULL THEN 'new' WHEN value IS NULL THEN 'missing' WHEN value < baseline - 0.5 THEN 'regressed' WHEN value > baseline + 0.5 THEN 'improved' ELSE 'held' END AS state FROM
  (SELECT p_brand AS metric, round(100.0 * count(*) FILTER (p_size > 25) / count(*), 2)::DOUBLE AS value FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1) FULL JOIN (SELECT DISTINCT p_brand AS metric, 50.0::DOUBLE AS baseline FROM part WHERE p_brand <> 'Brand#12') USING (metric)""")
def metric_ratchets(spark, sf_dir):
    p = _part(spark, sf_dir)
    value = F.round(100.0 * F.count_if(F.col("p_size") > 25) / F.count("*"), 2)
    m = p.where("p_brand <> 'Brand#11'").groupBy(F.col("p_brand").alias("metric")).agg(value.cast("double").alias("value"))
    b = p.where("p_brand <> 'Brand#12'").select(F.col("p_brand").alias("metric"), F.lit(50.0).alias("baseline"), F.lit(True).alias("rising")).distinct()
    return coverage.ratchets(m, b, 0.5)


@register("SELECT 'ORD-' || o_orderkey AS key, ['status', 'priority'] AS items FROM orders")
def extract_lists(spark, sf_dir):
    """The values of a locator with ``multiple``, as an array."""
    rule = {"match": {"items": {"from": "list_item", "after_heading": "Details", "pattern": "bold_description", "multiple": True}}}
    x = extract.extract(corpus.documents(r.orders(spark, sf_dir)), rule)
    return x.select("key", F.element_at("lists", F.lit("items")).alias("items"))
