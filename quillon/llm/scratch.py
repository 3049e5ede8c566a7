"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one is set in local mode, and on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class _Written(threading.local):
    """Paths of the tables that cut() wrote in this thread and that are still there, in order."""

    def __init__(self):
        self.paths: list[str] = []


_WRITTEN = _Written()


def _delete(spark: SparkSession, path: str, on_exit: bool) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(target) if on_exit else files.delete(target, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it again: its lineage ends there, and lost executors lose nothing.

    The files go when the JVM ends, or with settled()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.paths.append(path)
    _delete(spark, path, on_exit=True)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table of what make() returns; tables that make() wrote on the way are deleted, as nothing reads them any more."""
    before = len(_WRITTEN.paths)
    out = cut(make(), name)
    for path in _WRITTEN.paths[before:-1]:
        _delete(out.sparkSession, path, on_exit=False)
    del _WRITTEN.paths[before:-1]
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
