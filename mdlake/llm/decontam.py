"""Benchmark decontamination by winnowing.

Fingerprints of a text are the minimum K-gram hashes of all windows of W
successive K-grams. With K + W - 1 = 13, any span of 13 words that a document
shares with a benchmark item has a fingerprint of both inside it, so the join
of fingerprints misses no shared window. A fingerprint holds the low 44 bits of
the hash and, for documents, its place, so that a hit says where it is. Each
hit is extended: the 13-word windows of the document around it are joined with
the windows of the items by their whole words, and the words in matching
windows are hit.

Native: DataFrame and higher-order SQL functions only. The sliding hashes and
minima are built by doubling: arrays are zipped with shifted copies of
themselves, a few passes for any width.

Defined cases: a null text has no words, is never contaminated and makes no
window; an item of fewer than 13 words is one window; repeated documents are
judged each; repeated items count by distinct ``item_id``; a null ``item_id``
is left out; an empty table of items hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdlake.llm._shared import written
from mdlake.llm.bloom import KEYS, drop_rows

#: Words in a window.
WINDOW = 13
#: K-grams; a fingerprint is chosen among WINDOW - K + 1 of them.
K = 8
#: Bits of a fingerprint for its place; all places that agree in them are tried.
PLACE_BITS = 20
#: The characters that separate words, after lower-casing A-Z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A document is contaminated if one word in so many is hit.
MIN_SHARE = 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, an array; empty for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), SEPARATORS), "")


def _let(x: Column, f) -> Column:
    """``f(x)`` with ``x`` evaluated once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _zip_shifted(x: Column, n: int, f) -> Column:
    """``f`` of each element and the one ``n`` after it; ``n`` shorter."""

    def zipped(y: Column) -> Column:
        size = F.greatest(F.size(y) - n, F.lit(0))
        return F.zip_with(F.slice(y, F.lit(1), size), F.slice(y, F.lit(n + 1), size), f)

    return _let(x, zipped)


def _doubled(x: Column, width: int, join) -> Column:
    """``join`` folded over each ``width`` successive elements: the array is
    zipped with itself shifted by as many as each element already covers, or
    by what is lacking."""
    out, done = x, 1
    while done < width:
        n = min(done, width - done)
        out = _zip_shifted(out, n, join)
        done += n
    return out


def gram_hashes(word_list: Column, width: int = K) -> Column:
    """Hashes of each ``width`` successive words (``width`` a power of two)."""
    return _doubled(F.transform(word_list, lambda w: F.xxhash64(w)), width, lambda a, b: F.xxhash64(a, b))


def fingerprints(hashes: Column) -> Column:
    """The distinct minima of all windows of WINDOW - K + 1 K-gram hashes, with
    their places modulo 2**PLACE_BITS in the low bits."""
    placed = F.transform(hashes, lambda h, i: F.shiftleft(h, PLACE_BITS).bitwiseOR(i.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("long")))
    return F.array_distinct(_doubled(placed, WINDOW - K + 1, lambda a, b: F.least(a, b)))


def mark_of(fingerprint: Column) -> Column:
    """The hash of a fingerprint, which texts are compared by."""
    return F.shiftright(fingerprint, PLACE_BITS)


def _windows(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``item_id, window_words, window``: the distinct windows of the items."""
    w = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w"))
    w = w.where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(WINDOW)))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("i")
    return (
        w.select("item_id", "w", "n", starts)
        .select("item_id", F.col("n").alias("window_words"), F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("window"))
        .distinct()
    )


def _runs(word_list: Column, n: int) -> Column:
    """Each ``n`` successive words, joined."""
    starts = F.sequence(F.lit(1), F.size(word_list) - n + 1)
    return F.transform(starts, lambda i: F.array_join(F.slice(word_list, i, n), " "))


def _candidates(docs: DataFrame, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """``row, at``: the documents that share fingerprints with the items, and
    the places of these. ``docs`` has ``row`` and ``w``."""
    marks = (
        items.where(F.col(item_id).isNotNull())
        .select(F.explode(fingerprints(gram_hashes(words(F.col(item_text))))).alias("f"))
        .select(mark_of(F.col("f")).alias("mark"))
        .distinct()
    )
    marks = written(marks, "marks")  # so that its size is known before the join is planned
    own = docs.select("row", F.explode(fingerprints(gram_hashes(F.col("w")))).alias("f"))
    place = F.col("f").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    own = own.select("row", mark_of(F.col("f")).alias("mark"), place.alias("i"))
    return own.join(marks, "mark").groupBy("row").agg(F.collect_set("i").alias("at"))


def hits(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    row_id: str = "doc_id",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``row, n_hit, item_ids`` of each document text with a hit, keyed by
    ``row``: the struct of its identifier and the hash of its text.
    ``item_ids`` are the distinct items with occurring windows, as sorted
    strings."""
    # Few rows whatever the corpus; the plan decides by their size how they are joined.
    windows = written(_windows(items, item_id, item_text), "windows")
    by_words = windows.groupBy("window_words", "window").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")
    )
    source = docs.select(row_key(row_id, text).alias("row"), F.col(text).alias("t"))
    split = source.select("row", words(F.col("t")).alias("w"))
    candidates = written(_candidates(split, items, item_id, item_text), "candidates")

    # Whole windows around each shared fingerprint.
    found = source.join(candidates, "row").select("row", words(F.col("t")).alias("w"), "at")
    # In a text of more than 2**PLACE_BITS words, each place that a fingerprint may mean.
    at = F.flatten(F.transform("at", lambda i: F.sequence(i, F.greatest(i, F.size("w") - 1), F.lit(1 << PLACE_BITS))))
    around = F.flatten(
        F.transform(at, lambda i: F.sequence(F.greatest(i - (WINDOW - K), F.lit(0)), F.greatest(F.lit(0), F.least(i, F.size("w") - WINDOW))))
    )
    places = found.select("row", "w", F.explode(F.array_distinct(around)).alias("i"))
    places = places.select("row", "i", F.lit(WINDOW).alias("window_words"), F.array_join(F.slice("w", F.col("i") + 1, WINDOW), " ").alias("window"))

    # Items shorter than a window have no fingerprint of their own: each run of as many words is looked up.
    for n in sorted(r["window_words"] for r in windows.where(F.col("window_words") < WINDOW).select("window_words").distinct().collect()):
        runs = split.where(F.size("w") >= n).select("row", F.posexplode(_runs(F.col("w"), n)).alias("i", "window"))
        places = places.unionByName(runs.select("row", "i", F.lit(n).alias("window_words"), "window"))

    matched = places.join(by_words, ["window_words", "window"]).select("row", "i", "window_words", "items")
    # A start counts once a row, with its longest window; each word is counted at the first start that covers it.
    starts = matched.groupBy("row", "i").agg(F.max("window_words").alias("n"), F.flatten(F.collect_set("items")).alias("items"))
    per_row = starts.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("i", "n"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["i"] + s["n"]).alias("end"),
            (acc["hit"] + F.greatest(F.lit(0), s["i"] + s["n"] - F.greatest(acc["end"], s["i"]))).alias("hit"),
        ),
        lambda acc: acc["hit"],
    )
    return per_row.select("row", covered.cast("long").alias("n_hit"), "item_ids")


def row_key(row_id: str, text: str) -> Column:
    """Tells rows apart that repeat an identifier with another text."""
    return F.struct(F.coalesce(F.col(row_id).cast("string"), F.lit("")).alias("id"), F.xxhash64(text).alias("h"))


def judge(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    row_id: str = "doc_id",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``docs`` without its text, with ``n_words, n_hit, n_items, item_ids``
    and ``contaminated``, which replace columns of these names."""
    found = hits(docs, items, text, row_id, item_id, item_text)
    others = [c for c in docs.columns if c not in (text, "n_words", "n_hit", "n_items", "item_ids", "contaminated")]
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(others)],
        row_key(row_id, text).alias("row"),
        F.size(words(F.col(text))).cast("long").alias("n_words"),
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(found, "row", "left").select(
        *[F.col(f"in_{i}").alias(c) for i, c in enumerate(others)],
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (n_hit * MIN_SHARE >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """The documents that are not contaminated, with all their columns. Only
    those that a Bloom filter of the contaminated ones passes are shuffled."""
    found = hits(docs, items, text, row_id)
    source = docs.select(row_key(row_id, text).alias("row"), F.size(words(F.col(text))).alias("n_words"))
    bad = source.join(found, "row").where(F.col("n_hit") * MIN_SHARE >= F.col("n_words")).select("row").distinct()
    gone = written(bad.select(F.xxhash64("row.id", "row.h").alias(KEYS[0]), F.col("row.h").alias(KEYS[1])), "contaminated")

    def keys(at) -> tuple[Column, Column]:
        text_hash = F.xxhash64(at(text))
        return F.xxhash64(F.coalesce(at(row_id).cast("string"), F.lit("")), text_hash), text_hash

    return drop_rows(docs, gone, keys)
