"""Intermediate tables in the folder that the whole cluster shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it
again, so a lost executor costs the tasks it ran and no upstream recomputation.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder, as in tests on one machine.
LOCAL_DEFAULT = "file:///tmp/checkpoints"

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; LOCAL_DEFAULT on a local master."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return LOCAL_DEFAULT


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return a DataFrame that reads it."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Texts can be long: hold the rows of an Arrow batch, and with them a Python worker's memory, down."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def mark() -> set[str]:
    """The paths written so far, for ``release``."""
    return set(_written)


def last() -> str:
    """The path written last."""
    return next(reversed(_written))


def release(keep: set[str]) -> None:
    """Delete what was written since ``keep = mark()``; nothing may still read it."""
    for path in [p for p in _written if p not in keep]:
        _delete(path)


def _delete(path: str) -> None:
    spark = _written.pop(path)
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the session may be gone already
            _written.pop(path, None)
