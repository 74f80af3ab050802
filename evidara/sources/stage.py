"""Cuts in long lineages: a table in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULT = "file:///tmp/checkpoints"

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; on a local master without one, LOCAL_DEFAULT."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or LOCAL_DEFAULT).rstrip("/")


def give_back(spark: SparkSession) -> bool:
    """Lets the driver's JVM return memory that is free but kept by the C library, most of it left by the compiler of plans' code; False if the JVM cannot."""
    sc = spark.sparkContext
    java, new = sc._jvm.java.lang, sc._gateway.new_array
    try:
        # By the interface: the server's own class is not open to reflection.
        of = java.Class.forName("javax.management.MBeanServerConnection")
        invoke = next(m for m in of.getMethods() if m.getName() == "invoke")
        given = new(java.Object, 4)
        given[0], given[1] = sc._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return False
    return True


def cut(df: DataFrame) -> DataFrame:
    """df, written and read again: later plans begin here, and a lost executor costs no more than its own tasks."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    _written[path] = df.sparkSession
    df.write.parquet(path)
    give_back(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for path, spark in _written.items():
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone already
            pass
