"""Queries of the extraction, contract, lint and prose operators."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from mdlake.functions import text as t
from mdlake.operators import contract, corpus, extract, parse, prose, symbols
from mdlake.plans import documents_queries as base
from mdlake.sources import rendered as r

QUERIES, ORACLE = {}, {}
register = partial(base.register, queries=QUERIES, oracle=ORACLE)


def _orders(spark, sf_dir):
    return corpus.documents(r.orders(spark, sf_dir))


@register("""SELECT 'ORD-' || o_orderkey AS key, o_orderstatus AS status, 'Order ' || o_orderkey AS title, '## not a heading' || chr(10) || 'total ' || o_orderkey AS code, 'status' || chr(10) || 'priority' AS items, coalesce('PRT-' || p, '') AS part, o_orderkey::VARCHAR AS number, 'ORD-' || o_orderkey AS fallback
  FROM orders JOIN (SELECT l_orderkey, first(l_partkey ORDER BY l_linenumber, '| ' || l_linenumber || ' | PRT-' || l_partkey || ' | ' || l_quantity::DECIMAL(12,2) || ' | ') AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def extract_match(spark, sf_dir):
    """All locator kinds in one rule, with a fallback chain, a captured regex and a collapsed array."""
    rule = {
        "match": {
            "status": {"from": "frontmatter_field", "field": "status", "required": True},
            "title": {"from": "heading", "level": 1},
            "code": {"from": "code_block", "language": "md", "after_heading": "Notes"},
            "items": {"from": "list_item", "after_heading": "Details", "pattern": "bold_description", "multiple": True},
            "part": {"from": "table_row", "after_heading": "Items", "column": "Part", "required": True},
            "number": {"from": "heading", "regex": r"Order (\d+)"},
            "fallback": {"from": "section_body", "after_heading": "No such", "fallback": [{"from": "frontmatter_field", "field": "id"}]},
            "absent": {"from": "section_body", "after_heading": "No such"},
        }
    }
    x = extract.extract(_orders(spark, sf_dir), rule).where("error IS NULL AND NOT map_contains_key(record, 'absent')")
    return x.select("key", *[F.element_at("record", F.lit(n)).alias(n) for n in ("status", "title", "code", "items", "part", "number", "fallback")])


@register("SELECT 'ORD-' || l_orderkey AS key, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, '| ' || l_linenumber || ' | PRT-' || l_partkey || ' | ' || l_quantity::DECIMAL(12,2) || ' | ') - 1)::INT AS unit, 'PRT-' || l_partkey AS part, l_linenumber::VARCHAR AS line_no FROM lineitem")
def extract_table_units(spark, sf_dir):
    rule = {"iterate_over": {"kind": "table_row", "root": "Items"}, "per_match": {"part": {"from": "table_row", "column": "Part", "required": True}, "line_no": {"from": "table_row", "column": "Line"}}}
    x = extract.extract(_orders(spark, sf_dir), rule)
    return x.select("key", "unit", F.element_at("record", F.lit("part")).alias("part"), F.element_at("record", F.lit("line_no")).alias("line_no"))


@register("SELECT 'CNV-' || conv_id AS key, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS unit, role FROM conversations")
def extract_heading_units(spark, sf_dir):
    rule = {"iterate_over": {"kind": "heading", "root": "Conversation"}, "per_match": {"role": {"from": "heading"}}}
    x = extract.extract(corpus.documents(r.conversations(spark, sf_dir)), rule)
    return x.select("key", "unit", F.element_at("record", F.lit("role")).alias("role"))


@register("SELECT 'ORD-' || l_orderkey AS key, 'PRT-' || l_partkey AS target, 'uses' AS edge_type FROM lineitem")
def extract_edges(spark, sf_dir):
    rule = {"iterate_over": {"kind": "table_row", "root": "Items"}, "per_match": {"part": {"from": "table_row", "column": "Part"}}}
    return extract.record_edges(extract.extract(_orders(spark, sf_dir), rule), "uses", "part").select("key", "target", "edge_type")


_SCHEMA = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 80}, "name": {"enum": ["a"]}}}


@register("SELECT event_id, (props::JSON->>'k')::INT BETWEEN 10 AND 80 AS valid, CASE WHEN (props::JSON->>'k')::INT NOT BETWEEN 10 AND 80 THEN '/k' END AS pointer FROM events")
def json_schema(spark, sf_dir):
    """The lowered predicate and the full validator on the same rows."""
    e = r.table(spark, sf_dir, "events").select("event_id", contract.lowered("props", _SCHEMA).alias("valid"), contract.schema_errors(F.col("props"), _SCHEMA).alias("e"))
    return e.where("valid = (size(e) = 0)").select("event_id", "valid", F.get("e", F.lit(0))["pointer"].alias("pointer"))


@register("""SELECT 'ORD-' || l_orderkey AS doc_key, 'column-pattern' AS "check", 'PRT-' || l_partkey AS message FROM lineitem WHERE l_partkey % 10 <> 1
  UNION ALL SELECT 'ORD-' || l_orderkey, 'column-choice', l_returnflag || ' | ' || l_linestatus FROM lineitem WHERE l_returnflag = 'A'
  UNION ALL SELECT 'ORD-' || l_orderkey, 'min-rows', 'Line | Part | Quantity | Flags' FROM lineitem GROUP BY l_orderkey HAVING count(*) < 3""")
def table_asserts(spark, sf_dir):
    cells = parse.table_cells(parse.sections(parse.with_header(r.orders(spark, sf_dir)), level=2))
    flags = [f"{a} | {b}" for a in "NR" for b in "FO"]
    f = contract.table_asserts(cells, ["Line", "Part", "Colour", "Quantity", "Flags"], ("Colour",), 3, 99, {"Part": r"PRT-\d*1"}, {"Flags": flags})
    return f.select("doc_key", "check", "message")


@register("""SELECT 'D-' || p_partkey AS key, unnest(CASE p_size % 4 WHEN 0 THEN ['type'] WHEN 1 THEN ['description'] WHEN 2 THEN ['tags'] ELSE [] END) AS finding FROM part""")
def concept_shape(spark, sf_dir):
    texts = F.array(*[F.lit(x) for x in ("description: d", "type: T\ndescription: [1]", "type: T\ntags: {a: 1}", "type: T\ndescription: d\ntags: [a, b]")])
    p = r.table(spark, sf_dir, "part").select(r.text(F.col("p_partkey"), ".md").alias("path"), r.text("---\nid: D-", F.col("p_partkey"), "\n", F.get(texts, F.col("p_size") % 4), "\n---\n").alias("raw"))
    return contract.concept_findings(corpus.documents(p))


@register("""SELECT 'P-' || p_partkey AS key, unnest(CASE p_size % 4 WHEN 0 THEN ['values'] WHEN 1 THEN ['body', 'forbidden'] WHEN 2 THEN ['body'] ELSE ['forbidden'] END) AS rule FROM part""")
def lint_findings(spark, sf_dir):
    k = F.col("p_size") % 4
    raw = r.text(
        "---\nid: P-", F.col("p_partkey"), "\ntype: ", F.when(k == 3, "B").otherwise("A"), "\n---\n## Table\n| S |\n|---|\n| ", F.when(k == 0, "wrong").otherwise("ok (note)"),
        " |\n\n## Text\n", F.when(k.isin(1, 2), "nothing").otherwise("has 42"), "\n", F.when(k.isin(1, 3), "## Secret\nx\n").otherwise(""),
    )
    docs = corpus.documents(r.table(spark, sf_dir, "part").select(r.text(F.col("p_partkey"), ".md").alias("path"), raw.alias("raw")))
    rules = [
        contract.LintRule("values", "table_column_values", "table", column="S", values=("ok",), annotation=r"\([^)]*\)", types=("A",)),
        contract.LintRule("body", "section_body_pattern", "1. Text", pattern=r"\d+"),
        contract.LintRule("forbidden", "forbidden_section", "secret"),
    ]
    return contract.lint(docs, rules).select("key", "rule")


@register("""SELECT 'P-' || p_partkey AS key, p_size % 4 NOT IN (1, 3) AS is_valid, (p_size % 4 IN (1, 3))::BIGINT AS errors, (p_size % 4 = 0)::BIGINT AS warnings FROM part""")
def severity_routing(spark, sf_dir):
    p = r.table(spark, sf_dir, "part").select(r.text("P-", F.col("p_partkey")).alias("key"), (F.col("p_size") % 4).alias("k"))
    f = p.select("key", F.when(F.col("k") == 0, "soft").when(F.col("k") == 2, "quiet").otherwise("hard").alias("check"))
    return contract.verdicts(contract.routed(f, {"hard": "error", "quiet": "off"}), p)


_SENTENCES = "string_split_regex(text, '[.?!]+')"


@register(f"SELECT doc_id, words FROM (SELECT doc_id, len(regexp_extract_all(s, '[\\p{{L}}\\p{{N}}]+'))::INT AS words FROM (SELECT doc_id, unnest({_SENTENCES}) AS s FROM documents)) WHERE words > 30")
def sentence_length(spark, sf_dir):
    return prose.long_sentences(r.table(spark, sf_dir, "documents").select("doc_id", "text"), 30).select("doc_id", "words")


@register(r"""SELECT doc_id, acronym FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(' ' || regexp_replace(text, '([^A-Za-z0-9-])', '  ', 'g') || ' ', '[^A-Za-z0-9-]([A-Z0-9][A-Z0-9-]{1,11})[^A-Za-z0-9-]', 1)) AS acronym FROM documents)
  WHERE length(regexp_replace(acronym, '[^A-Z]', '', 'g')) >= 2 AND NOT regexp_matches(acronym, '^[A-Z]+-\d+$') AND NOT regexp_matches(acronym, '-$')""")
def acronyms(spark, sf_dir):
    return prose.undefined_acronyms(r.table(spark, sf_dir, "documents").select("doc_id", "text"), by="doc_id")


@register("SELECT page_id, 'Third ' || page_id AS heading, 1 AS before, 3 AS level FROM pages")
def heading_skip(spark, sf_dir):
    raw = F.concat(F.lit("# One\n### Third "), "page_id", F.lit("\n#### Fourth\n# Two\n## Ok\n"))
    s = parse.sections(r.table(spark, sf_dir, "pages").select("page_id", raw.alias("body")), keep=("page_id",))
    return prose.heading_skips(s, by=("page_id",)).select("page_id", "heading", F.col("before").cast("int").alias("before"), F.col("level").cast("int").alias("level"))


@register("""SELECT page_id, line::INT AS line, kind, text FROM pages, (VALUES (0, 'heading', 'Title x'), (2, 'paragraph', 'A word and link.'), (6, 'item', 'item one'), (8, 'quote', 'said'), (9, 'alert', 'care')) v(line, kind, text)""")
def reader_blocks(spark, sf_dir):
    body = "# Title *x*\n\nA **word** and [link](u).\n```\ncode\n```\n- item `c` one\n---\n> said\n> [!NOTE] care\n<!-- no -->"
    d = r.table(spark, sf_dir, "pages").select("page_id", F.lit(body).alias("body"))
    rows = prose.reader_lines(d, keep=("page_id",)).where("text <> ''")
    return rows.select("page_id", "line", "kind", F.regexp_replace("text", r"\s+", " ").alias("text"))


_LEADS = ["", "When it rains, ", "While hot, ", "Where fitted, ", "If it fails, then ", "While idle, when a job arrives, ", "On startup, ", "After login, "]
_BODIES = [
    "the system shall emit a record.", "shall be created on first use.", "the system shall support pagination.", "the system shall provide flexibility.", "the user shall be able to export data by mail.",
    "the handler shall process only push events.", "the system shall handle errors gracefully.", "the service shall mint a token and shall carry it on.", "the system never stops.", "the system shall not manage `Keys`.",
]


def _statement(leads, bodies, by):
    """Every lead before every body, by a row's number."""
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (n % len(xs) + 1).cast("int"))
    return F.concat(pick(leads, F.col(by)), pick(bodies, F.floor(F.col(by) / len(leads))))


_EARS_SQL = f"""WITH s AS (SELECT p_partkey, ({_LEADS})[p_partkey % {len(_LEADS)} + 1] || ({_BODIES})[(p_partkey // {len(_LEADS)}) % {len(_BODIES)} + 1] AS s FROM part),
  l AS (SELECT p_partkey, lower(s) AS l, regexp_extract(lower(s), '^[a-z]+') AS w FROM s),
  m AS (SELECT *, CASE WHEN w IN ('when', 'while', 'where', 'if') AND contains(l, ', ') THEN substr(l, strpos(l, ', ') + 2) ELSE l END AS main, regexp_matches(l, '\\bshall\\b') AS shall,
    (SELECT count(*) FROM (VALUES ('when'), ('while'), ('where'), ('if')) v(x) WHERE list_contains(string_split_regex(l, '[^a-z]+'), x)) AS n,
    regexp_extract(l, 'shall (?:not )?(support|handle|manage|process|deal with|provide|enable|be able to)\\b', 1) AS verb,
    regexp_extract(l, 'shall (?:not )?(?:support|handle|manage|process|deal with|provide|enable|be able to)\\b(.*)$', 1) AS rest FROM l),
  c AS (SELECT *, regexp_matches(main, '^(then )?shall') AS bare, CASE WHEN verb = 'be able to' THEN true WHEN verb = '' OR regexp_matches(rest, '\\b(by|using|via|only|not|within|that)\\b|[0-9<>%`]') THEN false
    WHEN regexp_matches(rest, 'flexibility|gracefully') THEN true ELSE NOT regexp_matches(rest, '\\bpaginations?\\b') END AS vague FROM m),
  p AS (SELECT *, CASE WHEN NOT shall THEN 'unclassifiable' WHEN n >= 2 THEN 'complex' WHEN w = 'when' THEN 'event' WHEN w = 'while' THEN 'state' WHEN w = 'where' THEN 'optional' WHEN w = 'if' THEN 'unwanted'
    WHEN bare THEN 'unclassifiable' ELSE 'ubiquitous' END AS pattern FROM c)
  SELECT p_partkey, pattern, list_sort(list_filter([CASE WHEN pattern = 'unclassifiable' THEN 'unclassifiable' END, CASE WHEN len(regexp_extract_all(l, '\\bshall\\b')) > 1 THEN 'non-singular' END,
    CASE WHEN bare THEN 'missing-subject' END, CASE WHEN vague THEN 'vague-response' END, CASE WHEN shall AND w IN ('on', 'upon', 'after', 'before', 'once', 'during') THEN 'non-canonical-trigger' END], lambda x: x IS NOT NULL)) AS checks FROM p"""


@register(_EARS_SQL)
def ears_shapes(spark, sf_dir):
    """Eighty sentences: each lead with each body. The SQL applies the rules anew."""
    s = _statement(_LEADS, _BODIES, "p_partkey")
    return r.table(spark, sf_dir, "part").select("p_partkey", prose.ears_pattern(s).alias("pattern"), prose.ears_checks(s, ("pagination",)).alias("checks"))


_CRITERIA = [
    ("Given a door, when it opens, then a bell rings", "given-when-then", ["non-canonical-shape"]),
    ("Given a door, when it opens, then a bell rings, then the lamp burns", "given-when-then", ["non-canonical-shape", "non-singular"]),
    ("The door shall close", "obligation", ["non-canonical-shape"]),
    ("The door shall close and shall lock", "obligation", ["non-canonical-shape", "non-singular"]),
    ("The task shall render `skipped` and shall not execute", "obligation", ["non-canonical-shape"]),
    ("The field shall be present; otherwise it shall be omitted", "obligation", ["non-canonical-shape"]),
    ("The door returns a code", "assertion", []),
    ("A statement with two `shall shall` yields one finding", "assertion", []),
    ("Task ID", "unstructured", ["unclassifiable"]),
    ("Structural evaluation", "unstructured", ["unclassifiable"]),
    ("No token in the response body", "assertion", []),
    ("Attach job to scenario version", "assertion", []),
    ("Attach Job To Scenario", "unstructured", ["unclassifiable"]),
    ("Pagination works", "assertion", ["vacuous-outcome"]),
    ("Pagination works and returns the next cursor", "assertion", []),
    ("The system shall manage the queue", "obligation", ["non-canonical-shape", "vague-response"]),
    ("The system supports offline mode", "assertion", []),
    ("The tools support offline mode", "assertion", ["vague-response"]),
    ("The tools handle 404 errors by a toast", "assertion", []),
    ("The code functions that implement it are found", "assertion", []),
    ("Collection functions independently of exporters", "assertion", ["vacuous-outcome"]),
]


def _cases(rows, n: int, column: str) -> str:
    return f"CASE {column} % {len(rows)} " + " ".join(f"WHEN {i} THEN {x[n]!r}" for i, x in enumerate(rows)) + " END"


def _pick(rows, column: str):
    return F.element_at(F.array(*[F.lit(x[0]) for x in rows]), (F.col(column) % len(rows) + 1).cast("int"))


@register(f"SELECT p_partkey, {_cases(_CRITERIA, 1, 'p_partkey')} AS shape, ({_cases(_CRITERIA, 2, 'p_partkey')})::VARCHAR[] AS checks FROM part")
def criterion_shapes(spark, sf_dir):
    s = _pick(_CRITERIA, "p_partkey")
    return r.table(spark, sf_dir, "part").select("p_partkey", prose.criterion_shape(s).alias("shape"), prose.criterion_checks(s).alias("checks"))


_PROPERTIES = [
    ("Encoding then decoding yields the input", "round-trip", "extractable"),
    ("Every record round-trips byte-identical", "round-trip", "candidate"),
    ("Saving twice leaves the file alone", "idempotence", "extractable"),
    ("Rows are sorted by key", "ordering", "extractable"),
    ("Sorted output", "ordering", "extractable"),
    ("The total is never negative", "invariant", "extractable"),
    ("Every row has a key", "universal", "extractable"),
    ("When a row arrives, it is stored", "universal", "extractable"),
    ("In the report, each total is stated", "universal", "extractable"),
    ("The parser rejects with a code", "error-case", "not-extractable"),
    ("No state transition is lost", "lifecycle", "extractable"),
    ("Two writers run in parallel", "concurrency", "not-extractable"),
    ("The door returns a code", "example", "not-extractable"),
    ("Report `never` of the totals", "unclassified", "not-extractable"),
    ("A key", "universal", "not-extractable"),
]


@register(f"SELECT shape, extraction, count(*) AS n FROM (SELECT {_cases(_PROPERTIES, 1, 'p_partkey')} AS shape, {_cases(_PROPERTIES, 2, 'p_partkey')} AS extraction FROM part) GROUP BY ALL")
def property_counts(spark, sf_dir):
    s = _pick(_PROPERTIES, "p_partkey")
    p = r.table(spark, sf_dir, "part").select(prose.property_shape(s).alias("shape"), prose.property_extraction(s).alias("extraction"))
    return p.groupBy("shape", "extraction").agg(F.count("*").alias("n"))


_QUALITY = [
    ("It shall be robust", ["ambiguous-term"]),
    ("The queue optimizes reads", ["ambiguous-term"]),
    ("The optimizer shall run", []),
    ("The manifest key `optimize` is rejected", []),
    ("The file shall be written", ["agentless-passive"]),
    ("The file shall be written by the tool", []),
    ("Rows shall be sorted by name", ["agentless-passive"]),
    ("Rows shall be sorted by the name", ["agentless-passive"]),
    ("It shall be closed by 12:00", ["agentless-passive"]),
    ("The file was written", []),
    ("It shall open and should close", ["mixed-modal"]),
    ("It must be given as needed and may vary", ["ambiguous-term", "mixed-modal"]),
]


@register(f"SELECT p_partkey, ({_cases(_QUALITY, 1, 'p_partkey')})::VARCHAR[] AS checks FROM part")
def quality_checks(spark, sf_dir):
    return r.table(spark, sf_dir, "part").select("p_partkey", prose.quality_checks(_pick(_QUALITY, "p_partkey")).alias("checks"))


@register("SELECT 'g:c' || (p_size % 3) AS \"check\", count(*) AS n FROM part GROUP BY 1")
def finding_histogram(spark, sf_dir):
    m = r.text("[g:c", F.col("p_size") % 3, "] text")
    return prose.histogram(r.table(spark, sf_dir, "part").select(m.alias("message")))


@register("""SELECT item_id AS a, i2 AS b FROM (SELECT a.item_id, b.item_id AS i2, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) AS j FROM
  (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda x: length(x) > 1)) AS t FROM benchmark) a JOIN
  (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda x: length(x) > 1)) AS t FROM benchmark) b ON a.item_id < b.item_id) WHERE j >= 0.3""")
def token_jaccard_pairs(spark, sf_dir):
    """Pairs of items with similar tokens; the floor is low, as these items aren't copies."""
    b = r.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), t.tokens(F.col("text")).alias("t"))
    return symbols.similar_sets(b, b, 0.3).where("a < b").select("a", "b")
