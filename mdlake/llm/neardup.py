"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct five-word shingles. Each of M registers
holds the truncated logarithm of the least exponential variate of the
shingles: ``K = floor(1 - log_B(min))``. Registers merge by maximum, and two
sets agree in one with a probability near their similarity. Bands of R
registers give candidates, the likelihood of the registers that are equal,
larger and smaller drops hopeless ones, and the rest is verified on the full
sets.

Sets are first grouped by a 64-bit fingerprint of the whole set, the node, so
only one representative of each distinct set is compared: copies cost one row
each. In a bucket not all pairs are made. Each bucket is linked to its pivot,
the member that sits in the most crowded buckets, which for a group of near
copies is the text they come from. Partners of a pivot that the verified links
have not joined to one component are compared afterwards, in blocks that return
only links, so whatever pairs the bands find are either joined or verified, and
none are emitted.

With B = 1.001, R = 4 and 32 bands a pair of similarity 0.75 or more shares
no bucket with a probability under 6e-6.

Defined cases: a null or empty text has an empty set and is linked with
nothing, not even with its like; a text of one to four words has one shingle,
all of it; each row is a document of its own, so rows that repeat an
identifier with one text have one verdict, and :func:`keep_first` chooses one of
those kept; a null identifier is larger than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdlake.llm import _kernel as k
from mdlake.llm._shared import bounded_batches, drop_written, groups, salted_join, written
from mdlake.llm.bloom import KEYS, drop_rows, parted, possible
from mdlake.llm.graph import components

SHINGLE_WORDS = 5
#: Documents are linked if PERCENT_UNION * union <= 100 * intersection.
PERCENT = 75
#: Registers, and registers in a band.
M, R = 128, 4
#: Base and rate of SetSketch, and its largest register value.
B, A, Q = 1.001, 20.0, (1 << 16) - 2
#: Pairs whose likeliest similarity is below this are dropped before
#: verification: six standard deviations of the estimate below 0.75.
MIN_ESTIMATE = 0.5
#: Partners of a pivot in a part, and their shingles in all, about.
PARTNERS, PART_SHINGLES = 256, 1_000_000
#: Sketches of a block, on each side.
SKETCHES = 256

_rng = np.random.default_rng(71)
_MULTIPLY = _rng.integers(0, 1 << 31, M, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, M, dtype=np.int64).astype(np.uint32)
_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of a chunk, and their offsets."""
    data = k.LOWER[data]
    starts, ends, at = k.words(data, offsets)
    w = k.Spans.of(data).hash(starts, ends)
    n = len(offsets) - 1
    count = np.diff(at)
    short = (count > 0) & (count < SHINGLE_WORDS)
    h = np.zeros(len(w), dtype=_U)
    if len(w) >= SHINGLE_WORDS:
        size = len(w) - SHINGLE_WORDS + 1
        acc = w[:size]
        for i in range(1, SHINGLE_WORDS):
            acc = k.mix(acc) + w[i : i + size]
        h[:size] = k.mix(acc)
    sets = []
    for i in range(n):
        if short[i]:
            acc = _U(count[i])
            for x in w[at[i] : at[i + 1]]:
                acc = k.mix(np.array([acc], dtype=_U))[0] ^ x
            sets.append(k.mix(np.array([acc], dtype=_U)))
        else:
            sets.append(np.unique(h[at[i] : max(at[i], at[i + 1] - SHINGLE_WORDS + 1)]))
    size = np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64)))
    return np.concatenate(sets) if sets else np.zeros(0, _U), size


def registers(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SetSketch registers of the non-empty sets that begin at ``starts``: M rows.

    The least variate comes from the least 32-bit hash, as the exponential's
    quantile is monotone: it is taken and truncated once, after the minimum.
    """
    x = (shingles >> _U(32)).astype(np.uint32)
    least = np.empty((M, len(starts)), dtype=np.uint32)
    for i in range(M):
        y = x * _MULTIPLY[i] + _ADD[i]
        y ^= y >> np.uint32(16)
        y *= np.uint32(0x85EBCA6B)
        y ^= y >> np.uint32(13)
        least[i] = np.minimum.reduceat(y, starts)
    variate = -np.log1p(-(least + 0.5) / 2.0**32) / A
    return np.clip(np.floor(1 - np.log(variate) / np.log(B)), 0, Q + 1).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Keys of the M / R bands: R registers of 16 bits are the key, mixed with
    the number of the band."""
    wide = regs.reshape(M // R, R, -1).astype(_U)
    key = np.zeros((M // R, regs.shape[1]), dtype=_U)
    for i in range(R):
        key = (key << _U(16)) | wide[:, i]
    return k.mix(key ^ k.mix(np.arange(M // R, dtype=_U) + _U(1))[:, None])


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Likeliest similarity of pairs, from registers and set sizes jointly.

    For sets of relative sizes u and v, a register is larger in the first with
    the probability p(u - v J), in the second with p(v - u J), where p(x) =
    -log_B(1 - x (B - 1) / B), and equal otherwise. The likelihood of the three
    counts is maximized over J by a grid and one refinement.
    """
    up, down = (a > b).sum(1), (a < b).sum(1)
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    scale = -1 / np.log(B)

    def likelihood(j: np.ndarray) -> np.ndarray:
        one = np.maximum(scale * np.log1p(-(u - v * j) * (B - 1) / B), 1e-9)
        two = np.maximum(scale * np.log1p(-(v - u * j) * (B - 1) / B), 1e-9)
        return up * np.log(one) + down * np.log(two) + (M - up - down) * np.log(np.maximum(1 - one - two, 1e-9))

    best, width = most / 2, most / 2
    for steps in (16, 8):
        tries = np.array([np.clip(best + width * s / steps, 0, most) for s in range(-steps, steps + 1)])
        best = tries[np.array([likelihood(j) for j in tries]).argmax(0), np.arange(len(up))]
        width = width / steps
    return best


_SKETCH = "id string, text_hash long, n_shingles long, node long, sketch binary, bands array<long>"


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes, texts = batch.columns
        for row, data, offsets in k.chunks(texts):
            shingles, at = shingle_sets(data, offsets)
            n = np.diff(at)
            full = np.flatnonzero(n)
            node = np.zeros(len(n), _U)
            sketch, bands = [None] * len(n), [None] * len(n)
            if len(full):
                starts = at[full]
                node[full] = k.mix(np.add.reduceat(k.mix(shingles), starts) ^ n[full].astype(_U))
                regs = registers(shingles, starts)
                keys = band_keys(regs).view(np.int64).T
                raw = np.ascontiguousarray(regs.T)
                for j, i in enumerate(full):
                    sketch[i], bands[i] = raw[j].tobytes(), keys[j]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(row, len(n)),
                    hashes.slice(row, len(n)),
                    pa.array(n, pa.int64()),
                    pa.array(node.view(np.int64)),
                    pa.array(sketch, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["id", "text_hash", "n_shingles", "node", "sketch", "bands"],
            )
        k.release()


def _rows(docs: DataFrame, text: str, row_id: str) -> DataFrame:
    """``id, text_hash, t``; identifier and hash tell rows apart that repeat an identifier."""
    return docs.select(F.col(row_id).cast("string").alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("t"))


def sketches(docs: DataFrame, text: str, row_id: str) -> DataFrame:
    """Set size, node (the set's fingerprint), registers and band keys of each row."""
    return _rows(bounded_batches(docs), text, row_id).mapInArrow(_sketch_batches, _SKETCH)


def _set_of(data: np.ndarray) -> np.ndarray:
    return shingle_sets(data, np.array([0, len(data)]))[0]


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingle sets of texts, one after the other."""
    for _, data, offsets in k.chunks(texts):
        shingles, at = shingle_sets(data, offsets)
        for i in range(len(at) - 1):
            yield shingles[at[i] : at[i + 1]]


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partners of each pivot that are similar to it, on full sets. Rows come
    sorted by pivot and part, the pivot's own text first: one set is held."""
    pivot = None
    for batch in batches:
        a, first, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        out = []
        for i, own in enumerate(_sets(batch.column(3))):
            if first[i]:
                pivot = own.copy()
            elif _similar(pivot, own):
                out.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(a[out], pa.int64()), pa.array(node[out], pa.int64())], names=["a", "b"])
        k.release()


def _verified(texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of representatives whose full sets are similar. Each
    text goes to the parts of the pivots that it is a partner of, and as a
    pivot to each of its own parts."""
    own = F.when(F.col("parts").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.col("node").alias("a"), i.alias("part"))))
    none = F.array().cast("array<struct<a:bigint,part:int>>")
    both = F.concat(
        F.transform(F.coalesce(own, none), lambda g: F.struct(g["a"].alias("a"), g["part"].alias("part"), F.lit(True).alias("first"))),
        F.transform(F.coalesce("partner_of", none), lambda g: F.struct(g["a"].alias("a"), g["part"].alias("part"), F.lit(False).alias("first"))),
    )
    dealt = texts.select("node", "t", F.explode(both).alias("g")).select("g.a", "g.part", "g.first", "node", "t")
    dealt = dealt.repartition("a", "part").sortWithinPartitions("a", "part", F.desc("first"))
    return dealt.select("a", "first", "node", "t").mapInArrow(_verify_batches, "a long, b long")


def _estimated(pairs: DataFrame) -> DataFrame:
    """Pairs that may reach the threshold by the likelihood of their registers."""

    def likely(sketch_a: pa.Array, sketch_b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
        if not len(sketch_a):
            return pa.array([], pa.bool_())
        a, b = (np.frombuffer(b"".join(x.to_pylist()), dtype=np.uint16).reshape(-1, M) for x in (sketch_a, sketch_b))
        sizes = [x.to_numpy(zero_copy_only=False).astype(float) for x in (n_a, n_b)]
        return pa.array(similarity(a, b, *sizes) >= MIN_ESTIMATE)

    return pairs.where(F.arrow_udf(likely, "boolean")("sketch_a", "sketch_b", "size_a", "size_b"))


def links(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``(rows, roots)``: ``id, text_hash, n_shingles, node`` of each row, and
    ``node, root`` of the nodes that are linked with others."""
    rows = written(sketches(docs, text, row_id), "sketches")
    full = rows.where("n_shingles > 0")

    # Buckets of two or more nodes: the least and the largest differ. All others go before a second shuffle.
    members = full.select("node", F.explode("bands").alias("bucket"))
    crowded = members.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("bucket")
    crowded = written(crowded, "crowded")
    members = possible(members, F.col("bucket"), crowded, "bucket").distinct()
    members = written(members.join(crowded, "bucket", "left_semi"), "members")
    drop_written(crowded)

    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"))
    weight = members.join(sizes, "bucket").groupBy("node").agg(F.sum("n").alias("w"))
    pivots = members.join(weight, "node").groupBy("bucket").agg(F.max_by("node", F.struct("w", "node")).alias("a"))
    pairs = members.join(pivots, "bucket").where("a != node").select("a", F.col("node").alias("b")).distinct()
    pairs = written(pairs, "pairs")

    nodes = written(members.select("node").distinct(), "nodes")
    reps = possible(full.select("node", "n_shingles", "sketch", "id", "text_hash"), F.col("node"), nodes, "node")
    reps = written(reps.dropDuplicates(["node"]).join(nodes, "node", "left_semi"), "reps")
    drop_written(members, nodes)
    likely = written(_likely(pairs, reps), "likely")
    texts = _texts(docs, reps, likely, text, row_id)
    found = written(_verified(texts), "links")
    drop_written(likely)
    roots = written(components(found), "roots")
    drop_written(found)
    more = written(_leftovers(pairs, roots, reps, texts), "leftovers")
    drop_written(pairs, reps, texts)
    if more.limit(1).count():
        star = roots.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = written(components(star.union(more)), "roots")
    drop_written(more)
    return rows, roots


def _row_hash(row_id: Column, text_hash: Column) -> Column:
    """One key of an identifier and the hash of its text."""
    return F.xxhash64(row_id.cast("string"), text_hash)


def _texts(docs: DataFrame, reps: DataFrame, likely: DataFrame, text: str, row_id: str) -> DataFrame:
    """``node, t, partner_of, parts`` of representatives: their texts, the parts
    of pivots to verify them with, and the number of parts of their own.

    The partners of a pivot are dealt to parts of about ``PARTNERS`` texts and
    ``PART_SHINGLES`` shingles; a node has as many pivots as bands at most. Of
    the rows, only those that a Bloom filter passes are shuffled, once.
    """
    parts = F.ceil(F.greatest(F.count("*") / PARTNERS, F.sum("size_b") / PART_SHINGLES)).cast("int")
    own = likely.groupBy("a").agg(parts.alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")
    partner = likely.join(own, "a").groupBy(F.col("b").alias("node")).agg(F.collect_list(F.struct("a", part.alias("part"))).alias("partner_of"))
    wanted = reps.select("node", _row_hash(F.col("id"), F.col("text_hash")).alias("row_hash"), "text_hash")
    wanted = written(wanted.join(partner, "node", "left").join(own.withColumnRenamed("a", "node"), "node", "left"), "wanted")
    source = _rows(docs, text, row_id).select(_row_hash(F.col("id"), F.col("text_hash")).alias("row_hash"), "text_hash", "t")
    # Rows that repeat both identifier and text are one text.
    source = possible(source, F.col("row_hash"), wanted, "row_hash").dropDuplicates(["row_hash", "text_hash"])
    out = written(source.join(wanted, ["row_hash", "text_hash"]).select("node", "t", "partner_of", "parts"), "texts")
    drop_written(wanted)
    return out


def _leftovers(pairs: DataFrame, roots: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``a, b`` among the partners of a pivot that it did not join.

    Two nodes of a bucket are partners of its pivot, or one is the pivot and
    the pair is verified. So for each pivot, its partners outside the group's
    largest component, the stragglers, are compared with all its partners of
    another component: first by their sketches, which leaves the nodes that may
    have a link, then these on full sets. Both go in blocks; a task of the first
    returns nodes, and of the second no more links than join its nodes.
    """
    group = pairs.select(F.col("a").alias("p"), F.col("b").alias("node")).join(roots, "node", "left")
    group = written(group.select("p", "node", F.coalesce("root", "node").alias("root")), "groups")
    sketch = reps.select("node", "n_shingles", "sketch")
    blocks = _blocks(group, SKETCHES).join(sketch, "node").repartition("p", "l", "r").sortWithinPartitions("p", "l", "r")
    alive = blocks.select("p", "l", "r", "node", "root", "left", "n_shingles", "sketch").mapInArrow(_alive_batches, "p long, node long")
    alive = written(alive.distinct(), "alive")
    blocks = _blocks(group.join(alive, ["p", "node"], "left_semi"), PARTNERS)
    texts = possible(texts.select("node", "t"), F.col("node"), alive, "node")
    blocks = blocks.join(texts, "node").repartition("p", "l", "r").sortWithinPartitions("p", "l", "r")
    out = written(blocks.select("p", "l", "r", "node", "root", "left", "t").mapInArrow(_link_batches, "a long, b long"), "found")
    drop_written(group, alive)
    return out


def _blocks(group: DataFrame, size: int) -> DataFrame:
    """``p, l, r, node, root, left``: the stragglers of each pivot's group (left)
    against all of it, in blocks of about ``size`` by ``size``. A node is in as
    many blocks as the other side has parts."""
    shares = group.groupBy("p", "root").agg(F.count("*").alias("n"))
    shares = shares.groupBy("p").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    mixed = shares.where("all > most").select(
        "p", "main", F.ceil((F.col("all") - F.col("most")) / size).cast("int").alias("lefts"), F.ceil(F.col("all") / size).cast("int").alias("rights")
    )
    rows = salted_join(group, mixed, "p", "node", "inner")  # a pivot may have a third of all rows
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("root != main").select("p", block("lefts").alias("l"), every("rights").alias("r"), "node", "root", F.lit(True).alias("left"))
    return left.union(rows.select("p", every("lefts"), block("rights"), "node", "root", F.lit(False)))


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of the left and the right of a block, and all nodes and roots."""
    left = table["left"].to_numpy()
    return np.flatnonzero(left), np.flatnonzero(~left), table["node"].to_numpy(), table["root"].to_numpy()


def _alive_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of blocks that may have a link, by the likelihood of their registers."""
    for table in groups(batches, 3):
        left, right, node, root = _sides(table)
        regs = np.frombuffer(b"".join(table["sketch"].to_pylist()), dtype=np.uint16).reshape(-1, M)
        size = table["n_shingles"].to_numpy().astype(float)
        alive = np.zeros(len(node), dtype=bool)
        one, two = [], []
        for n, i in enumerate(left, 1):
            small, large = np.minimum(size[i], size[right]), np.maximum(size[i], size[right])
            some = right[(root[right] != root[i]) & (100 * small >= PERCENT * large)]
            some = some[(regs[some] == regs[i]).sum(1) * 4 >= M]  # far below what such a similarity leaves equal
            one.append(np.full(len(some), i))
            two.append(some)
            if n == len(left) or sum(map(len, two)) > 1 << 14:  # many pairs at a time
                a, b = np.concatenate(one), np.concatenate(two)
                if len(a):
                    good = similarity(regs[a], regs[b], size[a], size[b]) >= MIN_ESTIMATE
                    alive[a[good]] = alive[b[good]] = True
                one, two = [], []
        yield pa.RecordBatch.from_arrays([table["p"].combine_chunks().filter(pa.array(alive)), pa.array(node[alive])], names=["p", "node"])


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists: a matrix product
    over the shingles that both lists have, some columns at a time."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    sides = []
    for sets in (left, right):
        sides.append((np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
    shared = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]), assume_unique=True)
    columns = 4096
    for at in range(0, len(shared), columns):
        some = shared[at : at + columns]
        parts = []
        for (values, rows), sets in zip(sides, (left, right), strict=True):
            where = np.searchsorted(some, values)
            where[where == len(some)] = 0
            hit = some[where] == values
            part = np.zeros((len(sets), len(some)), dtype=np.float32)
            part[rows[hit], where[hit]] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return np.rint(out).astype(np.int64)


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between nodes of different components, as few as join them."""
    for table in groups(batches, 3):
        out = _block_links(table)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
    k.release()


def _block_links(table: pa.Table) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    left, right, node, root = _sides(table)
    if not len(left) or not len(right):
        return out
    sets = list(_sets(table["t"]))
    one, two = [sets[i] for i in left], [sets[i] for i in right]
    both = intersections(one, two)
    union = np.array([len(x) for x in one])[:, None] + np.array([len(x) for x in two])[None] - both
    linked = (100 * both >= PERCENT * union) & (root[left][:, None] != root[right][None])
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = x = top[top[x]]
        return x

    for i, j in np.argwhere(linked):
        x, y = find(int(root[left[i]])), find(int(root[right[j]]))
        if x != y:
            top[x] = y
            out.append((int(node[left[i]]), int(node[right[j]])))
    return out


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """``a, b, size_b`` of the pairs that may reach the threshold."""
    one = reps.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"), F.col("n_shingles").alias("size_a"))
    two = reps.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"), F.col("n_shingles").alias("size_b"))
    fits = (100 * F.least("size_a", "size_b")) >= (PERCENT * F.greatest("size_a", "size_b"))
    return _estimated(pairs.join(two, "b").join(one, "a").where(fits)).select("a", "b", "size_b")


def judge(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row.

    ``component_id`` is the smallest identifier reachable over links, and a
    row is kept if it is its own.
    """
    return _judged(docs, text, row_id).drop("text_hash", "root").withColumnRenamed("id", row_id)


def _judged(docs: DataFrame, text: str, row_id: str) -> DataFrame:
    """``id, text_hash, root, n_shingles, component_id, kept``; the root is null
    for a text without words.

    Identifiers are reduced by node, so that copies are one row, then by
    component; labels go back to nodes and to rows by salted joins, as one
    component or one text may hold a third of all.
    """
    kind = docs.schema[row_id].dataType
    rows, roots = links(docs, text, row_id)
    # Identifiers compare as their own type, not as strings.
    rows = rows.select(F.col("id").cast(kind).alias("id"), "text_hash", "n_shingles", "node")
    nodes = rows.where("n_shingles > 0").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    nodes = written(nodes.join(roots, "node", "left"), "nodes")
    linked = nodes.where("root IS NOT NULL")
    components_ = linked.groupBy("root").agg(F.min("least").alias("component"))
    labels = salted_join(linked.select("node", "root"), components_, "root", "node", "inner").select("node", "root", "component")
    alone = nodes.where("root IS NULL AND n > 1").select("node", F.col("node").alias("root"), F.col("least").alias("component"))
    labels = written(labels.unionByName(alone), "labels")
    out = salted_join(rows.withColumn("row_hash", F.xxhash64("id", "text_hash")), labels, "node", "row_hash").select(
        "id", "text_hash", F.when(F.col("n_shingles") > 0, F.coalesce("root", "node")).alias("root"), "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One document of each component, with all its columns; a text without
    words has none and stays.

    It is the one of the smallest identifier. Among rows that share it, or of a
    component whose identifiers are all null, it is the one of the least hash of
    the text; among rows equal in both, the one of the least columns as JSON.

    Only rows that a Bloom filter of those to go passes are shuffled.
    """
    lazy = _judged(docs, text, row_id)
    judged = written(lazy, "judged")
    drop_written(lazy)  # sketches and labels
    held = judged.where(F.col("kept") & F.col("root").isNotNull()).groupBy("root", "id", "text_hash").agg(F.count("*").alias("rows"))
    # Few components have several rows of the least identifier.
    least = held.groupBy("root").agg(F.count("*").alias("kinds"), F.max("rows").alias("most"), F.min("text_hash").alias("least"))
    held = written(held.join(least.where("kinds > 1 OR most > 1"), "root"), "held")
    keyed = [_row_hash(F.col("id"), F.col("text_hash")).alias(KEYS[0]), F.col("text_hash").alias(KEYS[1])]
    again = held.where("text_hash = least AND rows > 1").select(*keyed, F.lit(True).alias("repeated"))
    gone = judged.where(~F.col("kept")).select(*keyed).union(held.where("text_hash != least").select(*keyed))
    gone = written(gone.distinct().withColumn("repeated", F.lit(False)).unionByName(again), "gone")
    drop_written(judged, held)

    def keys(at) -> tuple[Column, Column]:
        return _row_hash(at(row_id), F.xxhash64(at(text))), F.xxhash64(at(text))

    out = drop_rows(docs, gone, keys)
    repeated = gone.where("repeated")
    if not repeated.limit(1).count():
        return out
    # Rows that repeat both identifier and text, and are the ones to keep: one of each.
    _, hits, names = parted(docs, repeated, keys)
    every = F.struct(*names)
    one = hits.join(repeated, KEYS, "left_semi").groupBy(*KEYS).agg(F.min_by(every, F.to_json(every)).alias("row"))
    return out.unionByName(one.select("row.*").toDF(*docs.columns))
