import random
from itertools import accumulate
from zlib import crc32

import pytest
import xxhash

from mdlake.llm import sharding


def least_capacity(sizes, shards):
    """Brute force: every candidate capacity is a sum of neighbours."""
    prefix = [0, *accumulate(sizes)]
    for c in sorted({b - a for i, a in enumerate(prefix) for b in prefix[i:]}):
        used, left = 1, c
        for s in sizes:
            if s > c:
                break
            if s > left:
                used, left = used + 1, c
            left -= s
        else:
            if used <= shards:
                return c
    return 0


@pytest.mark.parametrize(("seed", "n", "shards"), [(1, 40, 4), (2, 200, 16), (3, 7, 16), (4, 60, 3)])
def test_capacity_is_the_minimum(spark, monkeypatch, seed, n, shards):
    monkeypatch.setattr(sharding, "BITS", 2)  # many rounds of refinement
    monkeypatch.setattr(sharding, "OUTLINE_ROWS", 16)
    rng = random.Random(seed)
    rows = [(rng.randrange(1 << 60), rng.choice([1, 5, 90, 400])) for _ in range(n)]
    capacity, cuts = sharding.cut_keys(spark.createDataFrame(rows, "key long, size long"), shards)
    ordered = [s for _, s in sorted(rows)]
    assert capacity == least_capacity(ordered, shards)
    filled = [0] * shards
    for key, size in rows:
        filled[sum(key >= c for c in cuts)] += size
    assert len(cuts) == shards - 1 and cuts == sorted(cuts) and max(filled) <= capacity


def test_rows(spark):
    rng = random.Random(5)
    texts = ["hot"] * 80 + [None, None, "", ""] + ["é" * rng.randrange(1, 60) + str(i) for i in range(150)]
    rows = [(i, t, i % 3, "x") for i, t in enumerate(texts)] + [(7, "hot", 1, "x"), (None, "hot", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size long, key string").drop("size")
    got = sharding.shard_rows(docs, 8).collect()
    assert len(got) == len(rows)
    by_shard, shard_of = {}, {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    for slots in by_shard.values():
        assert sorted(slots) == list(range(len(slots)))
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] != 7:
            text = texts[r["doc_id"]] or ""
            assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == crc32(text.encode())
            assert shard_of.setdefault(texts[r["doc_id"]], r["shard"]) == r["shard"]


def test_empty(spark):
    assert sharding.shard_rows(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_query_against_brute_force(spark):
    """Keys by the hash library; order, capacity, groups, laws of slots; columns named as results."""
    rng = random.Random(8)
    texts = ["hot " * 30] * 40 + [None, "", ""] + ["w" * rng.randrange(1, 200) + str(i % 90) for i in range(120)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS shard", "'y' AS slot", "'z' AS cell")
    got = sharding.shard_rows(docs, 5)
    assert len(set(got.columns)) == len(got.columns) and "cell" in got.columns
    got = {r["doc_id"]: r for r in got.collect()}
    key = lambda t: xxhash.xxh64_intdigest(t.encode(), seed=42) >> 4 if t is not None else 42 >> 4
    sizes = {}
    for _, t in rows:
        sizes[key(t)] = sizes.get(key(t), 0) + len((t or "").encode()) + 1
    ordered = sorted(sizes)
    shard = {}
    for i, t in rows:
        assert shard.setdefault(key(t), got[i]["shard"]) == got[i]["shard"]
    assert [shard[k] for k in ordered] == sorted(shard.values())
    filled = [0] * 5
    for k in ordered:
        filled[shard[k]] += sizes[k]
    assert max(filled) == least_capacity([sizes[k] for k in ordered], 5)
    for s in set(shard.values()):
        assert sorted(r["slot"] for r in got.values() if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got.values())))
