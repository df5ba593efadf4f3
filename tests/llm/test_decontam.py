import random
import re

from mdlake.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, item in items:
            iw = words(item)
            n = min(13, len(iw))
            wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    ids.add(str(item_id))
        out.append((doc_id, len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.judge(d, b).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["item_ids"]), r["contaminated"]) for r in rows), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["a", "Bb", "ça", "42", "dog", "Éric", "zu"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    p = passage.split()
    items = [(1, passage), (2, " ".join(p[20:40])), (10, " ".join(p[:13])), (3, "short one"), (4, "a a a a a a a a a a a a a a"), (5, None), (6, ""), (7, "dog"), (2, "other text of the same item " * 4)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 80)))) for i in range(30)]
    docs += [(100, passage.upper()), (101, "x, " * 500 + "; ".join(p[5:18])), (102, " ".join(p[:12])), (103, "a " * 300), (104, None), (105, ""), (106, "it is a Short-ONE."), (100, passage), (100, passage), (107, "q " * 3000 + " ".join(p[2:30]) + " q" * 9)]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b"), (2, None)], []) == brute([(1, "a b"), (2, None)], [])


def test_keep_clean(spark):
    docs = spark.createDataFrame([(1, "one two three four", "x"), (1, "other", "y"), (None, "five", None)], "doc_id long, text string, row string")
    items = spark.createDataFrame([(9, "two three")], "item_id long, text string")
    kept = decontam.keep_clean(docs, items)
    assert kept.columns == docs.columns and sorted(r["text"] for r in kept.collect()) == ["five", "other"]


def test_places_of_long_texts(spark, monkeypatch):
    """With few bits for a place, each place that a fingerprint may mean is tried."""
    monkeypatch.setattr(decontam, "PLACE_BITS", 3)
    rng = random.Random(4)
    p = [f"w{rng.randrange(90)}" for _ in range(40)]
    items = [(1, " ".join(p)), (2, " ".join(p[10:24]))]
    docs = [(i, " ".join([f"x{rng.randrange(400)}" for _ in range(rng.randrange(300))] + p[i : i + 14] + ["y"] * i + p[: 2 * i])) for i in range(16)]
    assert run(spark, docs, items) == brute(docs, items)


def test_columns_named_as_results(spark):
    d = spark.createDataFrame([(1, "one two three", "a", 7)], "doc_id long, text string, n_words string, block long")
    b = spark.createDataFrame([(9, "two three")], "item_id long, text string")
    got = decontam.judge(d, b)
    assert sorted(got.columns) == sorted(["doc_id", "block", "n_words", "n_hit", "n_items", "item_ids", "contaminated"])
    assert got.collect()[0]["n_words"] == 3 and decontam.keep_clean(d, b).count() == 0
