"""Minimax contiguous partition of ordered atomic groups into shards.

Rows of equal text form one atomic group. Groups are ordered by a 60-bit hash
of the text, and the ordered groups are cut into contiguous shards so that the
largest shard is as small as possible: the smallest feasible capacity is found
by binary search, and feasibility is checked greedily. The greedy walk's own
cuts would fill the first shards to the capacity, and with one very large group
leave the last ones empty. So a cut is taken nearest to an even share between
two bounds: not so late that its shard exceeds the capacity, and not so early
that what follows can't be held by the shards that are left, which the same
walk from the end says. With these bounds no shard exceeds the capacity, as
with the greedy cuts, and the largest is as small as can be.

The group sizes stay distributed. The driver holds an outline of them: ranges
of the order key with their sums, ``2**BITS`` equal ones at first. Each round
brackets the capacity between a walk that may stop anywhere within a range
and one that stops only at its end, and splits only the ranges in which a walk
with a capacity in the bracket can stop. It ends when both walks agree on the
capacity, which then is the exact optimum. A round brings about
``OUTLINE_ROWS`` sums to the driver, at any number of groups.

Native: DataFrame functions only. Defined cases: null texts form one group of
size 1 a row, as do empty ones; repeated rows stay together and get a slot
each; an empty table gives no rows; other columns are kept, but for those named
as a result, which the results replace. Two texts whose 60-bit hashes collide
count as one group.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mdlake.llm._shared import written

#: Leading bits of the order key that the first outline tells apart.
BITS = 12
#: Rows that a round of refinement brings to the driver, about.
OUTLINE_ROWS = 1 << 16
KEY_BITS = 60
#: Rows that one task numbers, about.
CELL_ROWS = 200_000


@dataclass(frozen=True)
class Range:
    """Groups whose keys agree in the leading bits: ``key >> shift == prefix``."""

    prefix: int
    shift: int
    total: int
    largest: int
    groups: int

    @property
    def start(self) -> int:
        return self.prefix << self.shift

    @property
    def end(self) -> int:
        return (self.prefix + 1) << self.shift


def order_key(text: Column) -> Column:
    """The place of a text's group in the order, 0 to 2**60 - 1."""
    return F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS)


def _ranges(groups: DataFrame, shift: int, inside: list[Range] | None) -> list[Range]:
    """Sums of the ranges of width ``2**shift``, within the given ones if any."""
    prefix = F.shiftright("key", shift)
    if inside is not None:
        wider = inside[0].shift
        groups = groups.where(F.shiftright("key", wider).isin([r.prefix for r in inside]))
    rows = (
        groups.groupBy(prefix.alias("prefix"))
        .agg(F.sum("size").alias("total"), F.max("size").alias("largest"), F.count("*").alias("groups"))
        .collect()
    )
    return sorted((Range(r["prefix"], shift, r["total"], r["largest"], r["groups"]) for r in rows), key=lambda r: r.start)


def _forward(outline: list[Range], ends: list[int], capacity: int, shards: int, upper: bool) -> list[int]:
    """Where the greedy walk's shards end. It may stop at the ends of ranges
    and, for the upper bound, anywhere in a range of several groups."""
    stops, at = [], 0
    for _ in range(shards):
        limit = at + capacity
        i = bisect_right(ends, limit)
        if i == len(ends):
            at = ends[-1]
        elif upper and outline[i].groups > 1:
            at = limit
        else:
            at = max(at, ends[i - 1] if i else 0)
        stops.append(at)
    return stops


def _least(outline: list[Range], ends: list[int], low: int, shards: int, upper: bool) -> int:
    """Binary search of the smallest capacity with which the walk gets to the end."""
    a, b = low, ends[-1]
    while a < b:
        c = (a + b) // 2
        a, b = (a, c) if _forward(outline, ends, c, shards, upper)[-1] >= ends[-1] else (c + 1, b)
    return a


def outline_of(groups: DataFrame, shards: int) -> tuple[int, list[Range]]:
    """The optimal capacity, and an outline fine enough to cut with it.

    ``groups`` has ``key`` and ``size`` of each group, one row a key.
    """
    outline = _ranges(groups, KEY_BITS - BITS, None)
    while outline:
        ends = list(accumulate(r.total for r in outline))
        low = max(max(r.largest for r in outline), -(-ends[-1] // shards))
        floor, roof = (_least(outline, ends, low, shards, upper) for upper in (True, False))
        if floor == roof:
            return roof, outline
        # With the optimum between them, the k-th shard is filled up to a place between these two.
        early = [0, *_forward(outline, ends, floor, shards, False)]
        late = [0, *_forward(outline, ends, roof, shards, True)]
        split: dict[int, list[Range]] = {}
        for i in sorted(
            {
                i
                for e, l in zip(early[: shards - 1], late, strict=False)
                for i in range(bisect_right(ends, e + floor), min(bisect_right(ends, l + roof), len(ends) - 1) + 1)
                if outline[i].groups > 1
            }
        ):
            split.setdefault(outline[i].shift, []).append(outline[i])
        bits = max(2, (OUTLINE_ROWS // sum(map(len, split.values()))).bit_length() - 1)
        gone = {r for ranges in split.values() for r in ranges}
        fine = [r for wide, ranges in split.items() for r in _ranges(groups, max(0, wide - bits), ranges)]
        outline = sorted([r for r in outline if r not in gone] + fine, key=lambda r: r.start)
    return 0, outline


def cut_keys(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The optimal capacity, and the first keys of the shards after the first.

    Any cuts that keep to the capacity are optimal; of these, each is taken
    nearest to an even share of what is left, so that shards stay near equal
    where one large group sets the capacity.
    """
    capacity, outline = outline_of(groups, shards)
    if not outline:
        return 0, []
    ends = [0, *accumulate(r.total for r in outline)]
    # needed[k]: from here on at the latest, the last k shards must hold the rest.
    needed = [ends[-1]]
    for _ in range(shards - 1):
        needed.append(ends[bisect_left(ends, max(0, needed[-1] - capacity))])
    cuts, at = [], 0
    for left in range(shards, 1, -1):
        low = max(at, needed[left - 1])
        high = ends[bisect_right(ends, at + capacity) - 1]
        even = at + (ends[-1] - at) / left
        i = bisect_left(ends, even)
        best = min((ends[j] for j in (i - 1, i) if 0 <= j < len(ends)), key=lambda x: abs(x - even))
        at = min(max(best, low), high)
        i = bisect_left(ends, at)
        cuts.append(outline[i].start if i < len(outline) else 1 << KEY_BITS)
    return capacity, cuts


def shard_rows(docs: DataFrame, shards: int = 16, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``docs`` without its text, with ``size``, ``text_crc32``, ``shard`` and
    ``slot``: each row's place in its shard, gapless from 0.

    One pass writes the narrow columns; groups are summed before the shuffle,
    so a hot text costs one row a task. Slots are numbered in cells: parts of
    a shard by a hash of the row's identifier, each a task of about
    ``CELL_ROWS`` rows whatever the group, after the sizes of the cells
    before it.
    """
    others = [c for c in docs.columns if c != text]
    at = others.index(row_id)
    narrow = written(
        docs.select(
            *[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(others)],
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(F.coalesce(F.col(text).cast("binary"), F.lit(b""))).alias("text_crc32"),
            order_key(F.col(text)).alias("key"),
        ),
        "sizes",
    )
    groups = written(narrow.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("rows")), "groups")
    _, cuts = cut_keys(groups, shards)
    shard = F.lit(0)
    for i, key in enumerate(cuts):
        shard = F.when(F.col("key") >= key, i + 1).otherwise(shard)
    rows = groups.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    cells = max(16, -(-rows // CELL_ROWS))
    placed = narrow.withColumn("shard", shard.cast("int")).withColumn(
        "cell", F.pmod(F.xxhash64(f"in_{at}", "key"), F.lit(cells)).cast("int")
    )
    # A row for each CELL_ROWS rows: it is joined on what the rows are dealt by anyway.
    before = (
        placed.groupBy("shard", "cell")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(W.partitionBy("shard").orderBy("cell")) - F.col("n"))
        .drop("n")
    )
    number = F.row_number().over(W.partitionBy("shard", "cell").orderBy(f"in_{at}", "key"))
    return (
        placed.withColumn("number", number)
        .join(before, ["shard", "cell"])
        .select(
            *[F.col(f"in_{i}").alias(c) for i, c in enumerate(others) if c not in ("size", "text_crc32", "shard", "slot")],
            "size",
            "text_crc32",
            "shard",
            (F.col("before") + F.col("number") - 1).cast("long").alias("slot"),
        )
    )
