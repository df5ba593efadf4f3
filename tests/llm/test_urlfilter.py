import pytest
from pyspark.sql import functions as F

from mdlake.llm import urlfilter

RULES = urlfilter.parse_rules(["allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/"])


@pytest.mark.parametrize(
    ("url", "rule", "verdict"),
    [
        ("https://Sub.Example.ORG/es/1?x", "example.org/es/", "block"),
        ("https://example.org/en/12", "example.org/en/1", "block"),
        ("https://example.org/en/2", "org/", "allow"),
        ("https://notexample.org/es/", "org/", "allow"),
        ("http://org", None, "allow"),
        ("http://x.com/fr/a", "com/fr/", "allow"),
        ("http://xcom/de/", None, "allow"),
        ("http://com/de/", "com/de/", "block"),
        ("HTTP://www.Bad.net:80/Page/?utm_source=a#top", None, "block"),
        ("https://bad.net/Page.html", None, "block"),
        ("https://bad.net/page", None, "allow"),
        ("https://bad.net/Page?id=2&ref=x", None, "allow"),
        ("ftp://bad.net/List?b=1&utm_a=2&c=3", None, "block"),
        ("a://b://bad.net/Page", None, "allow"),
        (None, None, "allow"),
        ("", None, "allow"),
        ("bad.net/Page", None, "allow"),
    ],
)
def test_verdicts(verdicts, url, rule, verdict):
    assert verdicts[url] == (rule, verdict)


@pytest.fixture(scope="module")
def verdicts(spark):
    urls = [c[0] for c in test_verdicts.pytestmark[0].args[1]]
    pages = spark.createDataFrame([(u, "h") for u in urls], "url string, host string")
    listed = spark.createDataFrame([("http://bad.net/Page",), ("bad://m.bad.net/List?b=1&c=3",), (None,), ("",), ("http://bad.net/Page",)], "u string")
    out = urlfilter.judge(pages.drop("host"), RULES, listed)
    return {r["url"]: (r["rule"], r["verdict"]) for r in out.collect()}


def test_filter_passes_all_listed_and_join_removes_the_rest(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "MAX_BLOCKS", 1)  # a full filter: nearly everything is a possible hit
    pages = spark.range(3000).select("id", F.concat(F.lit("http://h.net/"), "id").alias("url"))
    listed = pages.where("id % 3 = 0").select("url")
    out = urlfilter.judge(pages, [], listed)
    assert {r["id"] for r in out.where("verdict = 'block'").collect()} == set(range(0, 3000, 3))
    assert out.count() == 3000


def test_few_false_positives(spark):
    names = spark.range(4000).select(F.concat(F.lit("h.net/"), "id").alias("canonical_url"), "id")
    blocks = 4000 // urlfilter.URLS_PER_BLOCK
    bloom = urlfilter.filter_blocks(names, blocks)
    block, bits = urlfilter._probe(F.concat(F.lit("other/"), "id"), blocks)
    passes = F.lit(True)
    for i, b in enumerate(bits):
        passes = passes & (F.col(f"w{i}").bitwiseAND(b) == b)
    probes = names.withColumn("block", block).join(bloom, "block").where(passes).count()
    assert probes < 4000 * 0.06


def test_empty(spark):
    pages = spark.createDataFrame([], "url string")
    assert urlfilter.judge(pages, RULES, pages).count() == 0
    assert urlfilter.judge(spark.createDataFrame([("http://a.b/c",)], "url string"), RULES, pages).collect()[0]["verdict"] == "allow"
    with pytest.raises(ValueError, match="not a rule"):
        urlfilter.parse_rules(["deny x/"])


def test_columns_named_as_results_and_long_urls(spark):
    long = "http://h.net/" + "a/" * 200_000
    pages = spark.createDataFrame([(long, "x", "y", 1), ("http://b.org/es/", "x", "y", 1)], "url string, host string, verdict string, block long")
    out = urlfilter.judge(pages, RULES, spark.createDataFrame([(long + "?utm_a=1",)], "u string"))
    assert out.columns == ["url", "block", "host", "path", "rule", "verdict"]
    assert [(r["host"], r["verdict"]) for r in out.orderBy("host").collect()] == [("b.org", "allow"), ("h.net", "block")]
