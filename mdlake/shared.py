"""Tables in the folder that the driver and all executors share.

Lineage is cut by writing a table there, never by ``localCheckpoint``: a
written table survives the loss of any executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder: ``spark.checkpoint.dir`` of the session.

    A local session that names none gets a temporary folder. On a cluster each
    executor would write to its own disk and later reads would miss files, so
    there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="mdlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/mdlake-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made[path] = spark
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`written`."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            for path in [p for p in _made if p.rpartition("/")[2] == folder.rpartition("/")[2]]:
                drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what stands at a path made by :func:`scratch_path`."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _made.pop(path, None)


def _clean() -> None:
    for path, spark in list(_made.items()):
        try:
            if spark.sparkContext._jsc is not None:
                drop_path(spark, path)
        except Exception:  # the session may be gone at exit; files stay for the cluster's own cleaning
            pass
    _made.clear()
