from mdlake import api
from mdlake.operators import bundle, coverage, relations
from mdlake.plans.registry import Registry


def sources(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, raw string")


def test_validate(spark):
    r = Registry()
    match = {"description": {"from": "section_body", "after_heading": "Description", "required": True}}
    r.add_manifest({"name": "m", "artifact_types": [{"name": "FR", "allowed_links": {"needs": ["FR"]}, "id_pattern": r"\AFR-\d+\z", "body_extraction": {"yield_pattern": {"match": match}}}, {"name": "TC"}]})
    c = api.corpus_of(
        sources(
            spark,
            {
                "a.md": "---\nid: FR-1\ntype: FR\nrelationships: [{target: FR-2, type: needs}, {target: TC-1, type: needs}, {target: X, type: likes}]\n---\n## Description\ntext\n",
                "b.md": "---\nid: FR-2\ntype: FR\nobject: ghost\n---\n## Description\nTODO\n## Description\nx\n",
                "c.md": "---\nid: TC-1\ntype: TC\n---\n",
                "d.md": "---\nid: bad\ntype: FR\n---\n",
                "e.md": "---\nid: TC-1\n---\n",
            },
        )
    )
    found = {(f["check"], f["key"], f["severity"]) for f in bundle.validate(c, r, required=[relations.RequiredRelation("fr", "FR", "needs", toward=("FR",))], severities={"duplicate-heading": "off"}).collect()}
    assert found == {
        ("type", "TC-1", "error"), ("placeholder", "FR-2", "warning"), ("missing", "bad", "error"), ("id-pattern", "bad", "warning"), ("unknown-object-type", "FR-2", "warning"),
        ("dangling-reference", "FR-1", "error"), ("duplicate-artifact-id", "TC-1", "error"), ("disallowed-edge-type", "FR-1", "warning"), ("edge-target-kind", "FR-1", "warning"),
        ("required-relation", "FR-2", "warning"), ("required-relation", "bad", "warning"), ("required-relation", "FR-1", "warning"),
    }


def test_coverage_tables(spark):
    docs = api.corpus_of(
        sources(
            spark,
            {
                "fr.md": "---\nid: FR-1\ntype: FR\n---\n## Acceptance\n| ID | C |\n|--|--|\n| AC-1 | x |\n| AC-2 | x |\n",
                "t.md": "---\nid: T\ntype: TM\n---\n## Tests\n| ID | Traces | Status |\n|--|--|--|\n| TC-1 | AC-1 | done |\n| TC-2 | AC-2 | done |\n| TC-3 | AC-1..2 | planned |\n| TC-4 | AC-1 | what |\n",
            },
        )
    ).docs
    code = spark.createDataFrame([("t.py", "# TC-1\ndef test_a():\n    pass\n\n# TC-9\ndef test_b():\n    pass\n")], "path string, source string")
    out = bundle.coverage_tables(docs, code, [coverage.TraceTarget("FR", "Acceptance", "ID", r"AC-\d+"), coverage.TraceTarget("TM", "Tests", "ID", r"TC-\d+")], ("TM", "Tests", "Traces"), "Status", coverage.Statuses(complete=("done",), pending=("planned",)), [{"pattern": r"(TC-\d+)"}])
    assert {(r["row_id"], r["finding"]) for r in out["rows"].collect()} == {("TC-1", "backed"), ("TC-2", "status-lie"), ("TC-3", "unbacked"), ("TC-4", "undeclared-status")}
    assert [(r["document"], r["backed"], r["total"]) for r in out["groups"].collect()] == [("T", 1, 3), (None, 1, 3)]
    assert [r["id"] for r in out["untracked"].collect()] == ["TC-9"] and [r["kind"] for r in out["id_kinds"].collect()] == ["AC", "TC"]
