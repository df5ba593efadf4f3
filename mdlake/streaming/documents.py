"""New documents as a stream: parse and validate in append mode.

Parse and contract operators are stateless row transforms, so they run on a
stream unchanged; resolution needs a snapshot and joins each batch with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdlake.operators import corpus, parse


def texts(spark: SparkSession, folder: str, glob: str = "*.md", max_files: int = 1000) -> DataFrame:
    """``path, raw`` of the files that arrive in a folder."""
    d = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    d = d.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(folder)
    return d.select("path", F.col("content").cast("string").alias("raw"))


def parsed(sources: DataFrame) -> DataFrame:
    """``path, key, type, n_sections`` of arriving documents."""
    d = corpus.documents(sources)
    return d.select("path", "key", "type", F.size(parse.section_array(F.col("body"))).alias("n_sections"))


def resolve_each(snapshot: DataFrame, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: the references of a batch against a snapshot and the batch itself."""

    def run(batch: DataFrame, number: int) -> None:
        new = corpus.documents(batch)
        edges = corpus.resolve(snapshot.unionByName(new))
        sink(edges.join(new.select(F.col("key").alias("source")), "source", "left_semi"), number)

    return run
