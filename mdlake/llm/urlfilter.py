"""URL verdicts: rules by host and path, then a list of canonical URLs.

A rule names a host with all its subdomains and a prefix of the path; the
longest that fits wins. URLs that no rule fits are looked up in the list: a
blocked Bloom filter of the listed canonical URLs, 512 bits a block and one
block a URL, passes possible hits, and an exact hash join on the canonical URL
removes the false positives.

The filter has at most ``MAX_BLOCKS`` blocks however long the list is, so
broadcasting it has a proven bound; a longer list only passes more false
positives on to the join, whose results are the same.

Defined cases: a null URL or one without ``://`` has an empty host and path,
fits no rule, is not in the list and is allowed; null, empty and repeated list
entries are ignored; an empty list allows all that the rules leave; repeated
rows are judged each; other columns are kept, but for those named as a result
(``host``, ``path``, ``rule``, ``verdict``), which the results replace.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdlake.llm import bloom
from mdlake.llm._shared import written

MAX_BLOCKS, URLS_PER_BLOCK = bloom.MAX_BLOCKS, bloom.KEYS_PER_BLOCK

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that don't tell pages apart.
TRACKING = "utm_[^=]*|ref|fbclid|gclid"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = ""

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rules(lines: list[str]) -> list[Rule]:
    """Rules from lines such as ``allow org/`` and ``block example.org/es/``."""
    rules = []
    for line in lines:
        verdict, _, place = line.strip().partition(" ")
        host, slash, path = place.strip().partition("/")
        if verdict not in ("allow", "block") or not host:
            raise ValueError(f"not a rule: {line!r}")
        rules.append(Rule(verdict, host.translate(str.maketrans(_UPPER, _LOWER)), slash + path))
    return rules


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z as a-z."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One spelling of a URL: host and path without scheme, ``www.`` or
    ``m.``, default port, fragment, a last ``/``, ``.html`` and tracking
    parameters; null without ``://``."""
    host = F.regexp_replace(host_of(url), r"\A(?:www|m)\.|:(?:80|443)\z", "")
    path = F.regexp_replace(path_of(url), r"/\z|\.html\z", "")
    query = F.split(F.regexp_extract(url, r"(?s)\A.*?://[^?#]*\?([^#]*)", 1), "&")
    query = F.array_join(F.filter(query, lambda p: (p != "") & ~F.rlike(p, F.lit(rf"\A(?:{TRACKING})="))), "&")
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.contains(url, F.lit("://")), whole)


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, or null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host))):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


_probe = bloom.probe


def filter_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter of a column ``canonical_url``."""
    return bloom.filter_blocks(listed, "canonical_url", blocks)


def judge(pages: DataFrame, rules: list[Rule], listed_urls: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``. ``listed_urls`` has one
    column of URLs to block, in any spelling."""
    (source,) = listed_urls.columns
    listed = listed_urls.select(canonical(F.col(source)).alias("canonical_url")).where("canonical_url != ''").distinct()
    listed = written(listed, "listed")
    blocks = bloom.blocks_for(listed.count(), MAX_BLOCKS)

    names = [f"in_{i}" for i in range(len(pages.columns))]
    u = names[pages.columns.index(url)]
    rows = pages.toDF(*names).withColumns({"host": host_of(F.col(u)), "path": path_of(F.col(u)), "canonical_url": canonical(F.col(u))})
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    open_ = F.when(F.col("ruled").isNull(), F.col("canonical_url"))
    block, bits = _probe(open_, blocks)
    # At most MAX_BLOCKS rows of 68 bytes.
    rows = rows.withColumn("block", F.when(open_.isNotNull(), block)).join(F.broadcast(filter_blocks(listed, blocks)), "block", "left")
    # Only possible hits have a key to join on. Distinct ones are looked up, so a page that many rows name is one.
    rows = rows.withColumn("hit_key", F.when(bloom.passes(bits), open_))
    hits = listed.select(F.col("canonical_url").alias("hit_key"), F.lit(True).alias("hit"))
    possible = rows.where("hit_key IS NOT NULL").join(hits, "hit_key", "left")
    rest = rows.where("hit_key IS NULL").withColumn("hit", F.lit(None).cast("boolean"))
    out = possible.select(*rest.columns).unionByName(rest)
    return out.select(
        *[F.col(n).alias(c) for n, c in zip(names, pages.columns, strict=True) if c not in ("host", "path", "rule", "verdict")],
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"),
    )
