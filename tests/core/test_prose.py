"""Goldens of the prose grammars: rules by rule, and lines after what is masked."""

from pyspark.sql import functions as F

from mdlake.operators import prose


def column(spark, f, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", f(F.col("s")).alias("x"))
    return [r["x"] for r in rows.orderBy("i").collect()]


def test_patterns(spark):
    got = column(
        spark, prose.ears_pattern, "The system shall emit a log.", "**When** x, the system shall act.", "[While](u) x, it shall act.", "Where x, it shall act.", "If x, then it shall act.",
        "While idle, when x, it shall act.", "It acts.", "shall act", "When x, shall act", "Whenever x, it shall act.", None,
    )
    assert got[:9] == ["ubiquitous", "event", "state", "optional", "unwanted", "complex", "unclassifiable", "unclassifiable", "event"] and got[9] == "ubiquitous"


def test_requirement_checks(spark):
    vague = lambda *texts, lexicon=(): [("vague-response" in x) for x in column(spark, lambda s: prose.ears_checks(s, lexicon), *texts)]
    assert vague("It shall manage X.", "It shall handle X by Y.", "It shall close quickly.", "It shall deal  with X.", "It shall provide `X`.", "It shall be able to act within 3 ms.") == [True, False, False, True, False, True]
    assert vague("It shall provide seamless access only here.", "It shall not support X.", "It should support X.") == [False, True, False]
    assert vague("It shall support policies.", "It shall support boxes.", "It shall provide robust policies.", lexicon=("policy", "box")) == [False, False, True]
    got = column(spark, prose.ears_checks, "On start, it shall act.", "when x, then shall act and shall stop", "Before x, it acts.")
    assert got == [["non-canonical-trigger"], ["missing-subject", "non-singular"], ["unclassifiable"]]


def test_criterion_singularity(spark):
    checks = lambda *texts: [("non-singular" in x) for x in column(spark, prose.criterion_checks, *texts)]
    assert checks("It shall emit A and shall keep B.", "It shall emit A; it shall emit none otherwise.", "It shall reject. No deletion shall occur.", "It shall a, shall b and shall not c.") == [True, False, False, True]
    assert checks("Resolves A first, then B, then C.", "Given a, when b, then c, then d.", "It shall emit no A and shall keep B.") == [False, True, True]


def test_lines_after_masked_parts(spark):
    body = "one\n```\na\nb\n```\nsix <!-- x --> end\n<!-- a\nb -->tail\n\n    code\n- item\n  ~~~\n  # no\n  ~~~\nlast"
    rows = prose.reader_lines(spark.createDataFrame([("d", body)], "doc_key string, body string")).orderBy("line").collect()
    assert [(r["line"], r["kind"], r["text"].split()) for r in rows] == [(0, "paragraph", ["one"]), (5, "paragraph", ["six", "end"]), (7, "paragraph", ["tail"]), (10, "item", ["item"]), (14, "paragraph", ["last"])]


def test_very_long_statement(spark):
    long = "word " * 3000 + "`code` " * 300
    assert column(spark, prose.criterion_shape, long, long + "shall act") == ["assertion", "obligation"]
    assert column(spark, prose.quality_checks, long) == [[]]
