import re

import numpy as np
import pyarrow as pa
import pytest

from mdlake.llm import langid

SAMPLES = {
    "en": "the and of to in that it was for on are with as his they be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she which do their time if will way about many then them would write like so these her long make thing see him two has look more day could go come did my sound no most number who over know water than call first people may down side been now find any new work part take get place made live where after back little only round man year came show every good me give our under name very through just form much great think say help low line before turn cause same mean differ move right boy old too does tell sentence set three want air well also play small end put home read hand port large spell add even land here must big high such follow act why ask men change went light kind off need house picture try us again animal point mother world near build self earth father",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei hatte kann gegen vom können schon wenn habe seine mark ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine uhr seiner worden will zwischen immer millionen was sagte gibt alle seit muss wurden beim doch jetzt waren drei jahre neue neuen damit bereits da ab ihr seinen müssen ab ihrer ohne sondern selbst ersten nun etwa heute ihren weil ihm",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son comme mais ou si leur nous ont été même deux aussi elle sa fait ses cette peut tout être sans où très après bien encore entre dont ces autres depuis notre moins vers contre temps toujours monde pays années homme jour avant faire jamais chez autre rien celui alors cela dire quand cet petit eau voir vie femme fois heures maison enfants grand moment trois leurs toute votre donc peu là non ainsi puis nouveau",
}


def corpus(language, n, size=40):
    rng, words = np.random.default_rng(len(language) + n), SAMPLES[language].split()
    return [" ".join(rng.choice(words, size)) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    texts, labels = zip(*[(t, g) for g in SAMPLES for t in corpus(g, 80)], strict=True)
    return langid.fit(list(texts), list(labels))


def test_held_out_accuracy(model):
    for language in SAMPLES:
        count, mean = langid.score_batch(model, pa.array(corpus(language, 61, 15)))
        assert (count > 0).all() and (np.array(model.languages)[mean.argmax(1)] == language).mean() >= 0.97


def page(language, text, declared=True):
    return f'<!DOCTYPE html><html lang="{language}"><body><script>var the = "and";</script><p>{text}</p></body></html>' if declared else f"<p>{text}</p>"


def test_evidence(spark, model):
    rows = [(i, "https://www.seite.example.com/x", page("de", t, False)) for i, t in enumerate(corpus("de", 30))]
    rows += [(200 + i, f"https://h{i % 7}.test.net/", page(g, t, False)) for i, (g, t) in enumerate((g, t) for g in SAMPLES for t in corpus(g, 30))]
    rows += [
        (100, "https://www.seite.example.com/y", page("", "12", False)),  # no text: the host decides
        (101, "http://other.test.net/", page("fr", "12")),  # the declaration decides
        (102, "http://ein.beispiel.de/", "<p>12</p>"),  # the suffix decides
        (103, None, page("fr", corpus("en", 1)[0])),  # the text outweighs a wrong declaration
        (104, None, None),
        (105, "no address", ""),
        (106, "http://h/", "<p>123 456 !!!</p>"),
        (106, "http://h/", "<p>123 456 !!!</p>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in langid.identify_pages(pages, model).collect()}
    assert {got[i]["language"] for i in range(30)} == {"de"}
    assert [got[i]["language"] for i in (100, 101, 102, 103)] == ["de", "fr", "de", "en"]
    assert [got[i]["rejected"] for i in (103, 104, 105, 106)] == [False, True, True, True]
    assert got[101]["declared"] == "fr" and got[104]["declared"] is None
    assert langid.identify_pages(pages.limit(0), model).count() == 0


def test_trained_and_kept(spark):
    rows = [(i, t, g, "s", 0) for g in SAMPLES for i, t in enumerate(corpus(g, 50))] + [(900, "1 2 3", "en", "s", 1), (901, None, None, None, 2), (5, "???", "en", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, host int")
    model = langid.train(docs, rows=20)
    assert model.languages == ("de", "en", "fr")
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == 150


@pytest.mark.parametrize("languages", [("en", "de", "fr"), ("en",)])
def test_text_of_no_trained_language(spark, languages):
    texts, labels = zip(*[(t, g) for g in languages for t in corpus(g, 200, 100)], strict=True)
    rng = np.random.default_rng(3)
    junk = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz   "), 300)) for _ in range(5)]
    rows = [(t, "en", "s") for t in corpus("en", 30, 12)] + [("the and", "en", "s")]
    odd = [(t, "en", "s") for t in ["Быстрая коричневая лиса прыгает через ленивую собаку у старого дома", "これは日本語の文章です。とても長い文章ではありません。", *junk]]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows + odd)], "doc_id long, text string, lang string, source string")
    kept = langid.keep_identified(docs, langid.fit(list(texts), list(labels)))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(len(rows)))


def brute(rows, model):
    """Posteriors by the definition: counts without the row itself, smoothed level by level."""
    names, size = model.languages, len(model.languages)
    texts = [langid.visible(h) if h is not None else None for _, _, h in rows]
    count, mean = langid.score_batch(model, pa.array(texts, pa.string()))
    scores = mean * np.minimum(count, langid.TEXT_WEIGHT)[:, None]
    own = []
    for n, s in zip(count, scores, strict=True):
        e = np.exp(s - s.max())
        own.append(e / e.sum() if n else None)
    host = [(re.search(r"://([^/]+)", u) or [None, None])[1].lower() if u and "://" in u else None for _, u, _ in rows]
    place = [(h, ".".join(h.split(".")[-2:]), h.split(".")[-1]) if h else (None, None, None) for h in host]

    def total(level, name):
        hit = [p for p, at in zip(own, place, strict=True) if p is not None and at[0] is not None and (level is None or at[level] == name)]
        return np.sum(hit, axis=0) if hit else np.zeros(size), len(hit)

    def smooth(level, name, above, weight):
        c, n = total(level, name)
        return (c + weight * above) / (n + weight)

    every = [p for p in own if p is not None]
    out = []
    for (page_id, _, markup), p, at, s in zip(rows, own, place, scores, strict=True):
        if at[0] is not None and total(0, at[0])[1]:
            table = smooth(None, None, np.full(size, 1 / size), langid.SMOOTHING["table"])
            up = smooth(1, at[1], smooth(2, at[2], table, langid.SMOOTHING["suffix"]), langid.SMOOTHING["domain"])
            c, n = total(0, at[0])
            prior = (np.maximum(c - (p if p is not None else 0), 0) + langid.SMOOTHING["host"] * up) / (n - (p is not None) + langid.SMOOTHING["host"])
        else:
            prior = (np.sum(every, axis=0) + 1 / size) / (len(every) + 1)
        post = (s if p is not None else 0) + np.log(np.maximum(prior, 1e-9))
        declared = re.search(r'lang="(\w+)"', markup or "")
        for name, right in ((declared and declared[1], langid.DECLARED_RIGHT), (langid.SUFFIXES.get(at[2]), langid.SUFFIX_RIGHT)):
            if name in names:
                post = post + np.where(np.array(names) == name, np.log(right), np.log((1 - right) / (size - 1)))
        e = np.exp(post - post.max())
        out.append((page_id, names[int(e.argmax())], float(e.max() / e.sum())))
    return out


def test_fusion_against_brute_force(spark, model):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(120):
        g = str(rng.choice(list(SAMPLES)))
        text = " ".join(corpus(g, 1, int(rng.integers(1, 6))))[: int(rng.integers(0, 14))]
        host = rng.choice(["a.one.de", "b.one.de", "c.two.com", "d.two.com", "e.fr", "only.example.org"])
        rows.append((i, f"http://{host}/{i}" if i % 9 else None, page(g, text, bool(i % 3))))
    rows += [(500, "http://nothing.known.net/", "<p>1</p>"), (501, "http://a.one.de/", None)]
    got = {r["page_id"]: r for r in langid.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    for page_id, language, confidence in brute(rows, model):
        assert got[page_id]["language"] == language and got[page_id]["confidence"] == pytest.approx(confidence, rel=1e-6)


def test_very_long_text(spark, model):
    docs = spark.createDataFrame([(1, "the and of " * 400_000, "en", "s"), (2, corpus("de", 1)[0], "de", "s")], "doc_id long, text string, lang string, source string")
    assert langid.keep_identified(docs, model).count() == 2


def test_sample_is_the_least_hashes(spark):
    docs = spark.createDataFrame([(f"text number {i % 300}", "en" if i % 2 else "de") for i in range(900)], "text string, lang string")
    model = langid.train(docs, rows=15)
    again = langid.train(docs.repartition(7), rows=15)
    assert (model.table == again.table).all() and model.typical == again.typical
