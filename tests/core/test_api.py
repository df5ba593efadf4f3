import pytest

from mdlake import api
from mdlake.operators import parse


def test_single_documents_agree_with_columns(spark):
    texts = ["---\na: 1\n---\n# H\n", "﻿---\r\na: 1\r\n---\r\nb", "---\n---\nx", "---\n\n---\nx", "---\na: [\n---\nx", "plain", "", "---\na: 1", "---\na: 1\n---x\ny"]
    rows = parse.with_header(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, raw string")).orderBy("i").collect()
    for text, row in zip(texts, rows, strict=True):
        _, body, status = api.extract_frontmatter(text)
        assert (row["fm_status"], row["body"]) == (status, body), text


def test_corpus_and_sql(spark):
    t = spark.createDataFrame([("a.md", "---\nid: A\ntype: T\nrelationships: [{target: B, type: needs}, {target: C}]\n---\n# H\n## I\n"), ("b.md", "---\nid: B\ntype: T\n---\n")], "path string, raw string")
    c = api.corpus_of(t)
    assert [r["source"] for r in c.referencing("B").collect()] == ["A"]
    assert [r["target"] for r in c.dangling().collect()] == ["C"]
    assert [r["key"] for r in c.orphans("T", "needs").collect()] == ["B"]
    api.register(spark)
    assert spark.sql("SELECT transform(md_sections('# H\\n## I'), s -> s.heading) AS h").collect()[0]["h"] == ["H", "I"]
    with pytest.raises(ValueError, match="identities"):
        api.from_members({"a": t, "b": t})
    assert api.validate(1, {"type": "string"}) == [("", "is not of type string")]
    assert [s["heading"] for s in api.parse_document("# A\n")["sections"]] == ["A"]
