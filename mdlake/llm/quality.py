"""Quality rules of a document and of its host.

Each document is measured by the text alone; a document fails its base rules
if it has too few words or repeats itself too much. Failures are aggregated
by host, each host's failure rate is shrunk by a beta prior fitted to all
hosts (method of moments), and the verdict of a host is joined back to its
documents.

Defined cases: a null text is a text without words; an empty table gives an
empty result; a null host is no host, so its documents have only the base
rules; repeated rows are measured and counted each; other columns are kept,
but for those named as a result, which the results replace.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdlake.llm import _kernel as k
from mdlake.llm._shared import bounded_batches, salted_join, written
from mdlake.llm.bloom import flagged

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host goes if its shrunk failure rate is above this.
MAX_HOST_RATE = 0.9
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (1.0, 10_000.0)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_TYPE = "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">"
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which of these are not the first."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = keys[order[1:]] == keys[order[:-1]]
    any_, later = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    any_[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return any_, later


def _measure_chunk(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    out = np.zeros((len(MEASURES), n), dtype=np.int64)
    starts, ends, at = k.words(data, offsets)
    out[0] = np.diff(at)
    inside = ~k.SPACE[data]
    out[1] = k.sums(inside & ((data & 0xC0) != 0x80), offsets)
    out[2] = k.sums(_IS_SYMBOL[data], offsets)
    spans = k.Spans.of(data)
    row_key = k.mix(np.arange(n, dtype=np.uint64))

    breaks = np.flatnonzero(data == 10)
    first = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    last = np.sort(np.concatenate((breaks, offsets[1:])))
    filled = np.concatenate(([0], np.cumsum(inside)))
    worded = filled[last] > filled[first]
    first, last = first[worded], last[worded]
    row = np.searchsorted(offsets, first, "right") - 1
    _, later = _repeated(spans.hash(first, last) ^ row_key[row])
    out[3] = np.bincount(row[later], minlength=n)

    w = spans.hash(starts, ends)
    if len(w) >= 3:
        row = np.repeat(np.arange(n), np.diff(at))
        whole = row[2:] == row[:-2]
        three = k.mix(k.mix(k.mix(w[:-2]) + w[1:-1]) + w[2:]) ^ row_key[row[2:]]
        again = np.zeros(len(three), dtype=bool)
        again[whole] = _repeated(three[whole])[0]
        covered = np.zeros(len(w), dtype=bool)
        for i in range(3):
            covered[i : i + len(again)] |= again
        out[4] = np.bincount(row[covered], minlength=n)
    return out


def measure_batch(texts: pa.Array) -> pa.Array:
    """The measures of each text of an Arrow string array."""
    parts = [_measure_chunk(data, offsets) for _, data, offsets in k.chunks(texts)]
    full = np.concatenate(parts, axis=1) if parts else np.zeros((len(MEASURES), 0), dtype=np.int64)
    k.release()
    return pa.StructArray.from_arrays([pa.array(x) for x in full], names=list(MEASURES))


def measures(text: Column) -> Column:
    """Struct column of the measures of ``text``; evaluated once a row."""
    return F.arrow_udf(measure_batch, _TYPE).asNondeterministic()(text)


def base_failed(m: Column) -> Column:
    """The base rules over a struct of measures."""
    return (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)


def host_rates(measured: DataFrame, host: str, failed: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``host, n_docs, n_failed, shrunk_rate, host_rejected`` of each host.

    The prior Beta(m k, (1 - m) k) has the mean m of all documents and the
    weight k that the variance of the hosts' rates implies, within
    ``PRIOR_WEIGHT``; one host, or hosts that all agree, get the largest.
    Sums are partial before the shuffle, so a hot host costs one row a task.
    """
    hosts = (
        measured.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    )
    low, high = PRIOR_WEIGHT
    prior = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("m"),
        F.var_pop(F.col("n_failed") / F.col("n_docs")).alias("v"),
    ).select(
        "m",
        F.when(F.coalesce("v", F.lit(0.0)) <= 0, F.lit(high))
        .otherwise(F.greatest(F.lit(low), F.least(F.lit(high), F.col("m") * (1 - F.col("m")) / F.col("v") - 1)))
        .alias("k"),
    )
    # The prior is one row by construction.
    return hosts.join(F.broadcast(prior), F.lit(True)).select(
        "host",
        "n_docs",
        "n_failed",
        ((F.col("n_failed") + F.col("m") * F.col("k")) / (F.col("n_docs") + F.col("k"))).alias("shrunk_rate"),
    ).withColumn("host_rejected", F.col("shrunk_rate") > max_rate)


RESULTS = (*MEASURES, "base_failed", "host_rejected", "kept")


def judge(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``docs`` without its text, with the measures, ``base_failed``,
    ``host_rejected`` and ``kept``. Measures are taken in one pass and
    written, as both the hosts and the documents need them. Verdicts go back by
    a salted join: one host, or none, may have a third of all rows."""
    others = [c for c in docs.columns if c != text]
    narrow = bounded_batches(docs).select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(others)], measures(F.col(text)).alias("m"))
    host_at = f"in_{others.index(host)}"
    narrow = written(narrow.withColumn("failed", base_failed(F.col("m"))), "quality")
    bad = written(host_rates(narrow, host_at, "failed", max_rate).where("host_rejected").select(F.col("host").alias(host_at), "host_rejected"), "hosts")
    spread = F.xxhash64(*[f"in_{i}" for i in range(len(others))], "m")
    joined = salted_join(narrow.withColumn("row_hash", spread), bad, host_at, "row_hash")
    return joined.select(
        *[F.col(f"in_{i}").alias(c) for i, c in enumerate(others) if c not in RESULTS],
        *[F.col(f"m.{m}").alias(m) for m in MEASURES],
        F.col("failed").alias("base_failed"),
        F.coalesce("host_rejected", F.lit(False)).alias("host_rejected"),
        (~F.col("failed") & F.col("host_rejected").isNull()).alias("kept"),
    )


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that are kept, with all their columns, text included.

    Texts are measured twice rather than written: once for the hosts' rates,
    once for the documents. Only documents of hosts that a Bloom filter of the
    rejected ones passes are shuffled.
    """
    measured = bounded_batches(docs).select(F.col(host).alias("h"), measures(F.col(text)).alias("m")).select("h", base_failed(F.col("m")).alias("failed"))
    bad = written(host_rates(measured, "h", "failed", max_rate).where("host_rejected").select("host"), "hosts")
    names = [f"in_{i}" for i in range(len(docs.columns))]
    own_host, own_text = names[docs.columns.index(host)], names[docs.columns.index(text)]
    good = docs.toDF(*names).withColumn("m", measures(F.col(own_text))).where(~base_failed(F.col("m"))).drop("m")
    good = flagged(good, F.col(own_host), bad, "host", "hit")
    back = lambda rows: rows.select(*names).toDF(*docs.columns)
    hits = good.where("hit").withColumn("row_hash", F.xxhash64(*names))
    hits = salted_join(hits, bad.withColumnRenamed("host", own_host), own_host, "row_hash", "left_anti")
    return back(good.where(~F.col("hit"))).unionByName(back(hits))
