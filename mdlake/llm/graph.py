"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdlake.llm._shared import drop_written, written


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges`` (columns ``a, b``, of one
    orderable type): ``root`` is the smallest node of its component.

    Alternates large-star and small-star steps: each step links nodes to the
    smallest neighbour they know, so that the number of rounds grows with the
    logarithm of the component's size. Each round is written to the shared
    folder. Minima are partial before the shuffle, and the joins are
    plain equi-joins whose hot keys may be split.
    """
    edges = written(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    while True:
        # Large star: the larger neighbours of a node are linked to the smallest of its neighbours and itself.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        )
        large = written(large, "large")
        # Small star: a node's smaller neighbours and itself are linked to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        small = written(small.where("a != b").distinct(), "small")
        drop_written(large)
        # Done when each node hangs at one root that hangs nowhere.
        hanging = small.groupBy("a").agg(F.count("*").alias("n"))
        open_ = small.join(hanging.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count() or (
            hanging.where("n > 1").limit(1).count()
        )
        drop_written(edges)
        edges = small
        if not open_:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
