import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mdlake.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def expected(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert bpe.counter(PATH).count(text) == expected(text)


def test_every_code_point():
    c = bpe.counter(PATH)
    points = [chr(x) for x in range(0x110000) if not 0xD800 <= x < 0xE000]
    texts = [f"a{p}b" for p in points] + [f"{p}{p}" for p in points]
    got = [c.count(t) for t in texts]
    want = [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert [texts[i] for i in range(len(texts)) if got[i] != want[i]] == []


@pytest.mark.parametrize(
    "text",
    ["", "Hello, WORLD's 1234!", "ΟΔΟΣ Σ", "a<|endoftext|>b<|startoftext|>", "<|ENDOFTEXT|>", "\x1c\x85 x y", "İi ẞ ﬁ é", "x" * 5000, "ab " * 3000, "\n\t "],
)
def test_cases(text):
    assert bpe.counter(PATH).count(text) == expected(text)


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 3)
    c = bpe.MergeCounter(PATH)
    for text in ("one two three four", "five six", "one two"):
        assert c.count(text) == expected(text)


def test_column(spark):
    texts = ["one two", None, "", "one two"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["n"] for r in df.select("doc_id", bpe.token_counts(F.col("text"), PATH).alias("n")).collect()}
    assert got == {i: expected(t) for i, t in enumerate(texts)}
