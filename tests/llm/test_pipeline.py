import random

import test_decontam
import test_neardup
import test_quality
from pyspark.sql import functions as F

import corpus_pipeline


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioustrndl") for _ in range(rng.randrange(2, 8)))
    texts = [" ".join(word() for _ in range(rng.randrange(60, 140))) for _ in range(40)]
    passage = " ".join(word() for _ in range(40))
    texts += [texts[0], texts[1] + " more", texts[2].upper()]  # copies
    texts += ["few words", "", None, "same again " * 60, "1 2 3 4 " * 30]  # bad ones
    texts += [" ".join(word() for _ in range(60)) + " " + passage, " ".join(word() for _ in range(900)) + " " + passage[:120]]
    docs = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return docs, [(1, passage), (2, " ".join(word() for _ in range(30)))]


def test_against_brute_force(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = []
    for d in docs:
        m = test_quality.brute(d[1])
        if m["n_words"] >= 50 and 100 * m["n_repeat_words"] <= 50 * m["n_words"]:
            left.append(d[:2])
    left = [d for d in left if any(c.isalpha() for c in d[1])]
    kept = {i for i, _, _, keep in test_neardup.brute(left) if keep}
    left = [d for d in left if d[0] in kept]
    bad = {r[0] for r in test_decontam.brute(left, items) if r[4]}
    assert bad and len(left) > 30
    assert {r["doc_id"] for r in rows} == {d[0] for d in left} - bad
    assert all(r["round_trip"] and r["n_pieces"] == len(r["piece_ids"]) for r in rows)


def test_stages_keep_columns_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, node string")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.withColumn("x", F.lit(1)), str(tmp_path)).count() == 0
