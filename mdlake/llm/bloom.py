"""Blocked Bloom filters as tables: 512 bits a block, one block a key.

A filter has at most ``MAX_BLOCKS`` blocks however many keys it holds, so
broadcasting it has a proven bound, 8 MiB. It says surely that a row's key is
not among the keys, so that such a row needs no join; the others are possible
hits, for an exact join to decide. Up to about ``MAX_BLOCKS * KEYS_PER_BLOCK``
keys few others pass; beyond, more do, and at worst all rows go to the join.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of 512 bits, 64 bytes each: 8 MiB at most.
MAX_BLOCKS = 1 << 17
#: Keys that share a block at the filter's intended load: 16 bits each.
KEYS_PER_BLOCK = 32
#: Bits that a key sets, one in each of the block's 64-bit words.
WORDS = 8


def probe(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key and its bit in each word of the block."""
    one, two = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    block = F.pmod(one, F.lit(blocks)).cast("int")
    places = [F.shiftrightunsigned(two, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]
    return block, [F.call_function("shiftleft", F.lit(1).cast("long"), at) for at in places]


def blocks_for(keys: int, most: int = MAX_BLOCKS) -> int:
    return max(1, min(most, -(-keys // KEYS_PER_BLOCK)))


def filter_blocks(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """``block, w0 .. w7``: the filter of a column, one row a block that is not
    empty. Bits are merged before the shuffle."""
    block, bits = probe(F.col(column), blocks)
    return (
        keys.select(block.alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits)])
        .groupBy("block")
        .agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
    )


def passes(bits: list[Column]) -> Column:
    """Whether a key's bits are all set in the block that was joined to its row."""
    return F.coalesce(reduce(Column.__and__, [F.col(f"w{i}").bitwiseAND(b) == b for i, b in enumerate(bits)]), F.lit(False))


def flagged(rows: DataFrame, key: Column, keys: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: whether ``key`` may be among the written
    ``keys``. A null key never is. ``rows`` has no columns ``block, w0 .. w7``."""
    blocks = blocks_for(keys.count())
    block, bits = probe(key, blocks)
    # At most MAX_BLOCKS rows of 68 bytes.
    out = rows.withColumn("block", F.when(key.isNotNull(), block)).join(F.broadcast(filter_blocks(keys, column, blocks)), "block", "left")
    return out.withColumn(name, passes(bits)).drop("block", *[f"w{i}" for i in range(WORDS)])


def possible(rows: DataFrame, key: Column, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose ``key`` may be among the written ``keys``."""
    names = rows.columns
    return flagged(rows, key, keys, column, "possible").where("possible").select(*names)


#: The two 64-bit keys by which rows are told apart.
KEYS = ["key_a", "key_b"]


def parted(docs: DataFrame, gone: DataFrame, keys: Callable[[Callable[[str], Column]], tuple[Column, Column]]) -> tuple[DataFrame, DataFrame, list[str]]:
    """``(stay, hits, names)``: the rows of ``docs`` that are surely not among
    the written ``gone`` (columns ``KEYS``), the others, and the names that the
    columns have in both. ``keys`` gets a function from a column's name to the
    column, and gives the row's keys. ``hits`` have them too."""
    names = [f"in_{i}" for i in range(len(docs.columns))]
    a, b = keys(lambda c: F.col(names[docs.columns.index(c)]))
    rows = flagged(docs.toDF(*names).withColumns({KEYS[0]: a, KEYS[1]: b}), F.col(KEYS[0]), gone, KEYS[0], "hit")
    return rows.where(~F.col("hit")).select(*names), rows.where("hit").drop("hit"), names


def drop_rows(docs: DataFrame, gone: DataFrame, keys: Callable[[Callable[[str], Column]], tuple[Column, Column]]) -> DataFrame:
    """``docs`` without the rows among ``gone``; only possible ones are shuffled."""
    stay, hits, names = parted(docs, gone, keys)
    left = hits.join(gone.select(*KEYS), KEYS, "left_anti").select(*names)
    return stay.unionByName(left).toDF(*docs.columns)
