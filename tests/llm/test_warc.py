import base64
import gzip
import hashlib
import os
import random
from urllib.parse import urlparse

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mdlake.llm import warc


@given(st.lists(st.lists(st.integers(0, 20), max_size=12).map(sorted), max_size=9))
def test_loser_tree_merges(runs):
    order = list(warc.loser_tree(runs))
    assert [runs[r][i] for r, i in order] == sorted(x for run in runs for x in run)
    assert order == sorted(order, key=lambda o: (runs[o[0]][o[1]], o[0], o[1]))


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_members_in_pieces(piece):
    records = [b"one", b"", b"x" * 5000]
    raw = b"".join(gzip.compress(r) for r in records)
    got = list(warc.members(raw[i : i + piece] for i in range(0, len(raw), piece)))
    assert [r for _, _, r in got] == records
    assert [gzip.decompress(raw[o : o + n]) for o, n, _ in got] == records
    with pytest.raises(ValueError, match="within a record"):
        list(warc.members([raw[:-3]]))


def test_corrupt_payload_is_refused():
    raw = warc.record("1", "http://a/", "2024-01-01T00:00:00Z", b"abc", warc.base32_digest(b"abc"), None, False)
    assert warc.parse(raw)["payload_bytes"] == 3
    with pytest.raises(ValueError, match="another digest"):
        warc.parse(raw.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"))


PAGES = [
    (1, "http://b.org/x", "same"),
    (2, "http://a.b.org/x?q=1#f", "same"),
    (3, None, None),
    (4, "http://a.b.org/x?q=1", ""),
    (5, "no address", "é漢 😀\r\n\r\nWARC/1.1\r\n"),
    (None, "http://a.b.org/x y\n", "same"),
    (6, "http://b.org/x", "z" * 300_000),
    (6, "http://b.org/x", "z" * 300_000),
    (7, "HTTP://B.ORG/X", "same"),
]


def expected(pages, min_bytes=0):
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in pages:
        raw = (h or "").encode()
        revisit = len(raw) >= min_bytes and first.get(h or "") not in (None, i)
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_bytes", [0, 4])
def test_round_trip(spark, monkeypatch, min_bytes):
    rng = random.Random(1)
    pages = PAGES + [(100 + i, f"http://h{rng.randrange(4)}.net/{rng.randrange(9)}", rng.choice(["hot", f"page {i}"])) for i in range(120)]
    table = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, archive string").repartition(3)
    captured = F.timestamp_seconds(F.lit(1_000_000) + F.coalesce("page_id", F.lit(0)))
    folder, index = warc.write_archives(table.drop("archive"), captured, min_bytes=min_bytes)
    names = os.listdir(urlparse(folder).path)
    assert names and index.count() == len(pages) and all(n.endswith(".warc.gz") for n in names)
    out = warc.archive_and_index(table, captured, min_bytes=min_bytes)
    rows = out.orderBy("capture_order").collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=repr) == expected(pages, min_bytes)
    assert [r["capture_order"] for r in rows] == list(range(len(pages)))
    keys = [(r["url_key"], r["captured"], str(r["page_id"] or "")) for r in rows]
    assert keys == sorted(keys)


def test_small_archives(spark):
    folder, index = warc.write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string"), F.current_timestamp())
    assert warc.read_archives(folder, index).count() == len(PAGES)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_and_index(empty, F.current_timestamp()).collect() == []


def test_url_key():
    assert warc.url_key("https://A.Example.org/P?b=1#x") == "org,example,a)/p?b=1"
    assert warc.url_key(None) == warc.url_key("x") == ""


def test_archives_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1)  # one record an archive
    pages = spark.range(50).selectExpr("id AS page_id", "concat('http://h.net/', id % 7) AS url", "repeat('x', int(id)) AS html").repartition(3)
    folder, index = warc.write_archives(pages, F.current_timestamp())
    runs = warc.read_archives(folder, index)
    assert index.select("archive").distinct().count() == 50 == runs.count()
    assert len({f.rpartition("/")[2] for f in runs.inputFiles()}) > 1
    ordered = warc.merge_runs(runs, 9).orderBy("capture_order").collect()
    keys = [(r["url_key"], r["captured"], r["page_id"]) for r in ordered]
    assert keys == sorted(keys) and [r["capture_order"] for r in ordered] == list(range(50))
