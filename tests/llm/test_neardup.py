import random
import re

import numpy as np
import pytest

from mdlake.llm import neardup
from mdlake.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        least[r] = d if r not in least else min(least[r], d)
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(docs))


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: [rng.choice("abcdefghijklmnopqrst") + str(rng.randrange(300)) for _ in range(n)]
    docs = []
    for size, n in ((40, 30), (120, 12), (15, 20)):  # near copies of one text, not all near each other
        base = text(size)
        for i in range(n):
            copy = list(base)
            for _ in range(i % 4):
                copy[rng.randrange(size)] = "edit" + str(rng.randrange(999))
            docs.append(" ".join(copy))
    chain = text(60)
    for _ in range(25):  # a chain: ends are far from each other
        chain = [*chain[2:], *text(2)]
        docs.append(" ".join(chain))
    docs += ["copy of this text in many rows and some more"] * 20 + ["COPY of this text\tin many rows and some more", "", None, "", "  ", "one", "one", "ONE", "one two three four"]
    docs += [" ".join(text(rng.randrange(1, 90))) for _ in range(60)] + [" ".join(text(4000)), "x " * 900]
    rng.shuffle(docs)
    return list(enumerate(docs, 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = corpus(seed)
    got = neardup.judge(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == brute(docs)


def test_keep_first_with_odd_rows(spark):
    a, b = "the same long text of seven words", "another text of more than five words"
    rows = [(3, a, 1), (2, a, 2), (2, b, 3), (None, b, 4), (9, None, 5), (None, None, 6), (8, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long")
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["node"] for r in kept.collect()) == [2, 3, 5, 6, 7]
    assert neardup.keep_first(docs.limit(0)).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(4)
    pool = np.sort(rng.integers(0, 1 << 62, 3000, dtype=np.int64).astype(np.uint64))
    one = neardup.registers(pool, np.array([0, 1000]))
    whole = neardup.registers(pool, np.array([0]))
    assert (np.maximum(one[:, 0], one[:, 1]) == whole[:, 0]).all()
    for shared in (0, 1200, 1800, 2000):
        a, b = pool[:2000], np.concatenate((pool[2000 - shared : 2000], pool[2000 : 4000 - shared]))
        regs = [neardup.registers(x, np.array([0]))[:, 0][None] for x in (a, b)]
        true = shared / (len(a) + len(b) - shared)
        got = neardup.similarity(*regs, np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(got - true) < 0.16


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rng = random.Random(seed)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 230)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_keep_first_keeps_one_row_of_a_component(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a, "y"), (1, a, "x"), (1, a + " more", "z"), (2, a, "w"), (None, a, "v")]  # repeated rows, and a near copy of the same identifier
    rows += [(None, b, "p"), (None, b, "o"), (None, b + " more", "q"), (7, c, "n"), (7, c, "n")]  # only null identifiers; rows equal in all columns
    rows += [(8, "", "e"), (8, "", "e"), (None, None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    got = [tuple(r) for r in neardup.keep_first(docs).collect()]
    assert sorted(str(r[0]) for r in got) == ["1", "7", "8", "8", "None", "None"]
    assert [r[2] in "xz" for r in got if r[0] == 1] == [True] and [r[2] in "oq" for r in got if r[0] is None and r[1]] == [True]
    assert sorted(got, key=str) == sorted((tuple(r) for r in neardup.keep_first(docs.repartition(3)).collect()), key=str)


def test_estimate_loses_no_pair_at_the_threshold():
    """Pairs of similarity 0.75 to 0.80, of sets of all sizes: none is estimated below MIN_ESTIMATE, and all share a band."""
    rng = np.random.default_rng(12)
    for _ in range(400):
        size = int(rng.integers(8, 400))
        shared = -(-int(rng.integers(750, 801)) * 2 * size // (1000 + int(rng.integers(750, 801))))
        shared = min(size, max(shared, -(-6 * size // 7)))  # 100 * shared >= 75 * (2 * size - shared)
        pool = rng.integers(0, 1 << 62, 2 * size - shared, dtype=np.int64).astype(np.uint64)
        a, b = np.sort(pool[:size]), np.sort(pool[size - shared :])
        assert 100 * shared >= 75 * len(np.union1d(a, b))
        one, two = (neardup.registers(x, np.array([0])) for x in (a, b))
        assert neardup.similarity(one.T, two.T, np.array([size]), np.array([size]))[0] >= neardup.MIN_ESTIMATE
        assert (neardup.band_keys(one) == neardup.band_keys(two)).any()
