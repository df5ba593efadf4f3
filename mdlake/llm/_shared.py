"""What several operators share: tables in the shared folder, bounded Arrow
batches, groups of a sorted stream, and joins whose hot keys are salted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdlake.shared import drop_path, drop_written, scratch_path, shared_dir, written

__all__ = ["bounded_batches", "drop_path", "drop_written", "groups", "salted_join", "scratch_path", "shared_dir", "written"]

#: Rows of an Arrow batch for Python functions over whole texts: memory of a
#: worker, and of Arrow in the JVM, grows with it.
BATCH_ROWS = 1000
#: Parts that :func:`salted_join` deals each key to.
SALTS = 16


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after the Arrow batches of its whole session are bounded to ``BATCH_ROWS``."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of a stream that is sorted by its first ``keys`` columns, one
    after the other: only one is held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        begins = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(begins, begins[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def salted_join(rows: DataFrame, labels: DataFrame, key: str, spread: str, how: str = "left") -> DataFrame:
    """``rows`` joined with ``labels``, which has one row a ``key``: a hot key's
    rows are dealt to ``SALTS`` tasks by the hash of ``spread``, and each label
    is copied to all of them."""
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    copies = labels.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return rows.withColumn("salt", salt).join(copies, [key, "salt"], how).drop("salt")
