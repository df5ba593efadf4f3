"""The corpus pipeline: five stages over ``documents``, each written as
Parquet in the shared folder and read again as the next one's input.

All stages but the last return the columns of ``documents``: quality rules,
language identification, near-duplicate removal and benchmark decontamination
only filter rows. The last returns the encoded corpus.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mdlake.llm import decontam, langid, neardup, pieces, quality
from mdlake.llm._shared import drop_path, scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host isn't rejected."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language. The model is fitted on a bounded
    sample of them; ``lang`` is the declaration, ``source`` the host."""
    return langid.keep_identified(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each near-duplicate component; one without words
    is in none and stays. Of rows that repeat an identifier one stays, and a
    null identifier is larger than any other."""
    return neardup.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate. A null or empty text is
    clean; items without text or identifier contaminate nothing."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as piece identifiers, with the proof that they decode. A null
    text has null pieces, an empty one none; any other is encoded whole."""
    return pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("language id", language_id),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL can't express the language model, so tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            drop_path(spark, before)  # the stage after it is written
        before = path
    return docs
