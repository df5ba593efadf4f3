"""Language identification by Bayesian evidence fusion.

The posterior of a row's language joins four kinds of evidence: the likelihood
of its text (byte n-grams, trained here on a bounded sample of labelled rows),
the language that its markup declares, the suffix of its address, and the prior
of its host. Host priors are smoothed hierarchically: a host falls back on its
domain, a domain on its suffix, a suffix on the whole table, each by
pseudo-counts. Their counts are grouped aggregations of the texts' posteriors,
and a row's own posterior is taken out of its host's counts.

Defined cases: a null text, or one without n-grams, has no text evidence; a
null or unknown declaration or suffix says nothing; a row without a host has
the prior of the table; ties go to the first language in sorted order; an
empty table gives no rows; repeated rows count each. A row is rejected if its
text has no n-grams, if its language stays below ``MIN_CONFIDENCE``, or if the
text is far less likely per n-gram under each language than held-out texts of
the training sample are: the posterior is closed over the trained languages, so
other scripts and letter junk would else be given to one of them. A language
that is much like a trained one is not told from it.
"""

from __future__ import annotations

import html as html_entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mdlake.llm import _kernel as k
from mdlake.llm._shared import bounded_batches, written
from mdlake.llm.bloom import KEYS, drop_rows

#: Labelled rows of each language that a model is fitted on: those with the least hashes.
SAMPLE_ROWS = 400
#: Buckets that hashed n-grams of one to three bytes fall in.
BUCKETS = 1 << 15
#: A text counts as so many n-grams at most: neighbouring ones aren't independent.
TEXT_WEIGHT = 60.0
#: Pseudo-counts of the level above: host, domain, suffix, table.
SMOOTHING = {"host": 5.0, "domain": 10.0, "suffix": 20.0, "table": 1.0}
#: How often a declaration and a country's suffix are right.
DECLARED_RIGHT, SUFFIX_RIGHT = 0.85, 0.7
MIN_CONFIDENCE = 0.5
#: How far the mean log likelihood of an n-gram may be below that of held-out
#: texts: nats for any text, and standard errors for short ones, in which a
#: letter counts in ``OVERLAP`` n-grams.
FAR, FAR_ERRORS, OVERLAP = 4.0, 3.0, 5.0
#: Languages of country suffixes.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "ie": "en", "au": "en"}

_TAGS = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


@dataclass(frozen=True)
class Model:
    """Log probabilities of hashed n-grams: one row a bucket, one column a language.
    ``typical`` has, by language, their mean over held-out texts and the deviation of an n-gram."""

    languages: tuple[str, ...]
    table: np.ndarray
    typical: tuple[tuple[float, float], ...]


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte bigrams and trigrams that touch a letter, and the row of each."""
    low = k.LOWER[data]
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    low = np.where(letter, low, 32).astype(np.uint32)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out, rows = [], []
    for n in (2, 3):
        if len(low) < n:
            continue
        size = len(low) - n + 1
        code, touches = np.zeros(size, dtype=np.uint32), np.zeros(size, dtype=bool)
        for i in range(n):
            code = code * np.uint32(257) + low[i : i + size]
            touches |= letter[i : i + size]
        whole = touches & (row[:size] == row[n - 1 : n - 1 + size])
        out.append(((code[whole] * np.uint32(2654435761)) >> np.uint32(17)) % BUCKETS)
        rows.append(row[:size][whole])
    return (np.concatenate(out), np.concatenate(rows)) if out else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def _table(texts: list[str], labels: list[str], languages: tuple[str, ...]) -> np.ndarray:
    counts = np.full((BUCKETS, len(languages)), 0.5)
    for text, label in zip(texts, labels, strict=True):
        counts[:, languages.index(label)] += np.bincount(_grams_of(text), minlength=BUCKETS)
    return np.log(counts / counts.sum(0)).astype(np.float32)


def _grams_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    return _grams(data, np.array([0, len(data)]))[0]


def _typical(texts: list[str], labels: list[str], languages: tuple[str, ...]) -> tuple[tuple[float, float], ...]:
    """Each half of a language's texts under a table of the other halves. A
    language with texts of n-grams in only one half has no bound."""
    seen = dict.fromkeys(languages, 0)
    halves: tuple[list, list] = ([], [])
    for text, label in zip(texts, labels, strict=True):
        if len(_grams_of(text)):
            halves[seen[label] % 2].append((text, label))
            seen[label] += 1
    means, squares = ([[] for _ in languages] for _ in range(2))
    for fitted, held in (halves, halves[::-1]):
        table = _table([t for t, _ in fitted], [g for _, g in fitted], languages)
        for text, label in held:
            i = languages.index(label)
            scores = table[_grams_of(text), i].astype(np.float64)
            means[i].append(scores.mean())
            squares[i].append(scores.var())
    return tuple((float(np.mean(m)), float(np.sqrt(np.mean(v)))) if seen[g] > 1 else (-np.inf, 0.0) for g, m, v in zip(languages, means, squares, strict=True))


def fit(texts: list[str], labels: list[str]) -> Model:
    """Naive Bayes over hashed n-grams, with add-one-half smoothing. Without
    labelled texts the only language is ``und``."""
    languages = tuple(sorted(set(labels))) or ("und",)
    return Model(languages, _table(texts, labels, languages), _typical(texts, labels, languages))


def train(docs: DataFrame, text: str = "text", label: str = "lang", rows: int = SAMPLE_ROWS) -> Model:
    """Fit a model on a bounded sample of labelled rows: of each language the
    ``rows`` texts with the least hashes, copies counted once."""
    labelled = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(label).alias("l"))
    labelled = labelled.withColumn("h", F.shiftrightunsigned(F.xxhash64("t", F.lit(7)), 1))
    sizes = {r["l"]: r["n"] for r in labelled.groupBy("l").agg(F.count("*").alias("n")).collect()}
    chosen = F.lit(False)
    for language, n in sizes.items():  # twice as many as wanted, so that few are sorted
        least = min((1 << 63) - 1, int(2 * rows / n * (1 << 63)))
        chosen = chosen | ((F.col("l") == language) & (F.col("h") <= least))
    few = labelled.where(chosen).dropDuplicates(["t", "l"])
    place = F.row_number().over(W.partitionBy("l").orderBy("h", "t"))
    sample = few.withColumn("place", place).where(F.col("place") <= rows).orderBy("l", "place").collect()
    return fit([r["t"] for r in sample], [r["l"] for r in sample])


def score_batch(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of each text, and its mean log likelihoods per n-gram."""
    counts, sums = [], []
    for _, data, offsets in k.chunks(texts, k.CHUNK_BYTES // 4):
        n = len(offsets) - 1
        grams, rows = _grams(data, offsets)
        counts.append(np.bincount(rows, minlength=n))
        sums.append(np.stack([np.bincount(rows, weights=model.table[grams, i], minlength=n) for i in range(len(model.languages))], 1))
    if not counts:
        return np.zeros(0, np.int64), np.zeros((0, len(model.languages)))
    count = np.concatenate(counts)
    return count, np.concatenate(sums) / np.maximum(count, 1)[:, None]


def text_scores(text: Column, model: Model, markup: bool = False) -> Column:
    """``struct<n, scores>``: n-grams, and log likelihoods by language, tempered."""

    def scored(texts: pa.Array) -> pa.Array:
        if markup:
            texts = pa.array([None if t is None else visible(t) for t in texts.to_pylist()], pa.string())
        count, mean = score_batch(model, texts)
        k.release()
        scores = mean * np.minimum(count, TEXT_WEIGHT)[:, None]
        lists = pa.FixedSizeListArray.from_arrays(pa.array(scores.ravel()), len(model.languages)).cast(pa.list_(pa.float64()))
        return pa.StructArray.from_arrays([pa.array(count, pa.int64()), lists], names=["n", "scores"])

    return F.arrow_udf(scored, "struct<n:bigint,scores:array<double>>").asNondeterministic()(text)


def visible(markup: str) -> str:
    """The text of an HTML page, without scripts, styles, comments and tags."""
    text = _TAGS.sub(" ", markup)
    return html_entities.unescape(text) if "&" in text else text


def declared_language(markup: Column) -> Column:
    """The primary language of the ``lang`` of a page's ``html`` element, or null."""
    found = F.lower(F.regexp_extract(markup, r"""(?i)<html\b[^>]*?\b(?:xml:)?lang\s*=\s*["']?([a-z]{2,3})\b""", 1))
    return F.when(found != "", found)


def address(url: Column) -> dict[str, Column]:
    """``host``, ``domain`` (its last two labels) and ``suffix`` (the last) of a URL, or nulls."""
    host = F.lower(F.regexp_extract(url, r"(?s)\A.*?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    return {"host": host, "domain": F.substring_index(host, ".", -2), "suffix": F.substring_index(host, ".", -1)}


def _softmax(scores: Column) -> Column:
    top = F.transform(F.array(scores), lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s))))[0]
    return F.transform(F.array(top), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))[0]


def _likely(t: str, model: Model) -> Column:
    """Whether a text is about as likely under some language as its own texts are."""
    n = F.greatest(F.col(t)["n"], F.lit(1))
    share = F.least(n, F.lit(int(TEXT_WEIGHT)))
    out = F.lit(False)
    for i, (mean, deviation) in enumerate(model.typical):
        out = out | (F.col(t)["scores"][i] / share >= mean - FAR - FAR_ERRORS * deviation * F.sqrt(OVERLAP / n))
    return out


def _counts(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Rows and sums of text posteriors by ``keys``; partial before the shuffle."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(F.col("p")[i]).alias(f"c{i}") for i in range(size)])


def host_priors(rows: DataFrame, size: int) -> DataFrame:
    """``host, n, c (own counts), up (prior of the level above)`` of each host.

    ``rows`` has ``host, domain, suffix`` and ``p``, the posterior by the text.
    """
    hosts = written(_counts(rows.where("host IS NOT NULL AND p IS NOT NULL"), ["host", "domain", "suffix"], size), "hosts")

    def level(keys: list[str]) -> DataFrame:
        sums = [F.sum("n").alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(size)]]
        return hosts.groupBy(*keys).agg(*sums)

    def smooth(above: list[Column], weight: float) -> Column:
        return F.array(*[(F.col(f"c{i}") + weight * above[i]) / (F.col("n") + weight) for i in range(size)])

    table = level([]).select(smooth([F.lit(1.0 / size)] * size, SMOOTHING["table"]).alias("up_table"))
    suffix = level(["suffix"]).join(F.broadcast(table), F.lit(True))  # one row
    suffix = suffix.select("suffix", smooth([F.col("up_table")[i] for i in range(size)], SMOOTHING["suffix"]).alias("up_suffix"))
    domain = level(["domain", "suffix"]).join(suffix, "suffix")
    domain = domain.select("domain", smooth([F.col("up_suffix")[i] for i in range(size)], SMOOTHING["domain"]).alias("up"))
    return hosts.join(domain, "domain").select("host", "n", F.array(*[f"c{i}" for i in range(size)]).alias("c"), "up")


def fuse(rows: DataFrame, model: Model) -> DataFrame:
    """Add ``language, confidence, rejected`` to ``rows``, which have ``t``
    (struct of text scores), ``declared``, ``host``, ``domain``, ``suffix``."""
    languages, size = model.languages, len(model.languages)
    flat = F.array(*[F.lit(1.0 / size)] * size)
    rows = written(rows.withColumn("p", F.when(F.col("t.n") > 0, _softmax(F.col("t.scores")))), "evidence")
    priors = written(host_priors(rows, size), "priors")
    everything = rows.agg(F.count("p").alias("n_all"), *[F.sum(F.col("p")[i]).alias(f"a{i}") for i in range(size)]).select(
        F.array(*[(F.coalesce(f"a{i}", F.lit(0.0)) + 1.0 / size) / (F.col("n_all") + 1) for i in range(size)]).alias("everything")
    )
    joined = rows.join(priors, "host", "left").join(F.broadcast(everything), F.lit(True))  # one row
    weight, zero = SMOOTHING["host"], F.lit(0.0)

    def prior(i: int) -> Column:
        """The host's share without the row itself, smoothed by the level above."""
        own = F.coalesce(F.col("p")[i], zero)
        alone = F.when(F.col("p").isNull(), 0).otherwise(1)
        host = (F.greatest(F.col("c")[i] - own, zero) + weight * F.col("up")[i]) / (F.col("n") - alone + weight)
        return F.coalesce(host, F.col("everything")[i])

    def says(source: Column, right: float, language: str) -> Column:
        """Log likelihood of a source that names a language, which is right so often."""
        wrong = float(np.log((1 - right) / max(1, size - 1)))
        return F.when(source.isin(*languages), F.when(source == language, float(np.log(right))).otherwise(wrong)).otherwise(0.0)

    named = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    by_suffix = F.when(F.col("suffix").isNotNull(), F.element_at(named, F.col("suffix")))
    posterior = F.array(
        *[
            F.coalesce(F.col("t.scores")[i], zero) + F.log(F.greatest(prior(i), F.lit(1e-9)))
            + says(F.col("declared"), DECLARED_RIGHT, language) + says(by_suffix, SUFFIX_RIGHT, language)
            for i, language in enumerate(languages)
        ]
    )
    out = joined.withColumn("posterior", _softmax(posterior))
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    out = out.withColumn("language", F.element_at(F.array(*[F.lit(x) for x in languages]), best))
    out = out.withColumn("confidence", F.coalesce(F.array_max("posterior"), F.array_max(flat)))
    rejected = (F.coalesce(F.col("t.n"), F.lit(0)) == 0) | (F.col("confidence") < MIN_CONFIDENCE) | ~_likely("t", model)
    return out.withColumn("rejected", rejected).drop("c", "up", "n", "p", "everything", "posterior")


def identify_pages(pages: DataFrame, model: Model, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """``page_id, language, confidence, declared, rejected`` of each page."""
    rows = bounded_batches(pages).select(
        F.col(page_id).alias("id"),
        text_scores(F.col(markup), model, markup=True).alias("t"),
        declared_language(F.col(markup)).alias("declared"),
        *[c.alias(n) for n, c in address(F.col(url)).items()],
    )
    return fuse(rows, model).select(F.col("id").alias(page_id), "language", "confidence", "declared", "rejected")


def keep_identified(docs: DataFrame, model: Model, text: str = "text", host: str = "source", declared: str = "lang", row_id: str = "doc_id") -> DataFrame:
    """The documents whose language is identified, with all their columns.
    The column ``declared`` is a declaration, ``host`` a host without domain."""
    none = F.lit(None).cast("string")
    rows = bounded_batches(docs).select(
        F.col(row_id).cast("string").alias("id"),
        F.xxhash64(text).alias("text_hash"),
        text_scores(F.col(text), model).alias("t"),
        F.lower(F.col(declared)).alias("declared"),
        F.col(host).alias("host"),
        F.col(host).alias("domain"),
        F.coalesce(none, F.lit("")).alias("suffix"),
    )
    row_hash = F.xxhash64("id", "text_hash")
    gone = written(fuse(rows, model).where("rejected").select(row_hash.alias(KEYS[0]), F.col("text_hash").alias(KEYS[1])).distinct(), "gone")

    def keys(at) -> tuple[Column, Column]:
        return F.xxhash64(at(row_id).cast("string"), F.xxhash64(at(text))), F.xxhash64(at(text))

    return drop_rows(docs, gone, keys)
