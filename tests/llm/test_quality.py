import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mdlake.llm import _kernel, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    count, covered, seen, dups = Counter(zip(w, w[1:], w[2:], strict=False)), set(), set(), 0
    for i in range(len(w) - 2):
        if count[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return dict(zip(quality.MEASURES, (len(w), sum(map(len, w)), sum(text.count(s) for s in quality.SYMBOLS), dups, len(covered)), strict=True))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="ab é#|\n\t 漢", max_size=40), max_size=12))
def test_measures(texts):
    assert quality.measure_batch(pa.array(texts, pa.string())).to_pylist() == [brute(t) for t in texts]


def test_long_text_and_slices(monkeypatch):
    monkeypatch.setattr(_kernel, "CHUNK_BYTES", 64)
    texts = ["a b c " * 400, "", None, "x" * 500, "one\n" * 90, "tail"]
    assert quality.measure_batch(pa.array(texts).slice(1)).to_pylist() == [brute(t) for t in texts[1:]]


def rows(spark, hosts):
    good, bad = " ".join(f"w{i}" for i in range(60)), "few words"
    out = [(i, good if ok else bad, host, "extra") for i, (host, ok) in enumerate((h, j < g) for h, (g, n) in hosts.items() for j in range(n))]
    return spark.createDataFrame(out, "doc_id long, text string, source string, kept string").drop("kept")


def test_bad_host_takes_its_good_documents_along(spark):
    docs = rows(spark, {"good": (190, 200), "bad": (4, 400), "tiny": (0, 1), None: (1, 3)})
    got = {(r["source"], r["base_failed"], r["kept"]) for r in quality.judge(docs).collect()}
    assert ("bad", False, False) in got and ("good", False, True) in got and (None, False, True) in got
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 191


def test_empty_and_null(spark):
    schema = "doc_id long, text string, source string"
    assert quality.judge(spark.createDataFrame([], schema)).collect() == []
    (r,) = quality.judge(spark.createDataFrame([(None, None, None)], schema)).collect()
    assert r["base_failed"] and not r["kept"] and r["n_words"] == 0


@pytest.mark.parametrize("n", [1, 5])
def test_one_host(spark, n):
    assert [r["host_rejected"] for r in quality.judge(rows(spark, {"h": (0, n)})).collect()] == [True] * n


def test_columns_named_as_results(spark):
    docs = rows(spark, {"good": (19, 20), "bad": (0, 40)})
    clash = docs.selectExpr("*", "'in' AS kept", "7 AS n_words", "1 AS m", "2 AS hit", "3 AS block")
    got = quality.judge(clash)
    assert len(set(got.columns)) == len(got.columns) and {"m", "hit", "block"} < set(got.columns)
    assert sorted((r["doc_id"], r["kept"], r["n_words"]) for r in got.collect()) == sorted((r["doc_id"], r["kept"], r["n_words"]) for r in quality.judge(docs).collect())
    kept = quality.keep_good(clash)
    assert kept.columns == clash.columns and {(r["n_words"], r["kept"]) for r in kept.collect()} == {(7, "in")} and kept.count() == 19
