"""The folder that driver and executors share, and tables that are worked out once there."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []
_open = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is named, a fresh local one if all of Spark runs on this
    machine; on a cluster that is an error."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="gridextract-")
        sc.setCheckpointDir(at)
    return at


def once(df: DataFrame, outer: bool = False) -> DataFrame:
    """df as Parquet in the shared folder, for what several branches of a plan read. Removed when the driver ends, or with
    working_tables(); outer: with those around the innermost, for a result that outlives the tables it is made of."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/once-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(_clear)
    _WRITTEN.append((spark, path))
    scopes = getattr(_open, "made", [])
    for made in scopes[-2:-1] if outer else scopes[-1:]:
        made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def working_tables() -> Iterator[None]:
    """What once() writes inside of it, in this thread, is removed at its end; read results before."""
    stack = _open.made = getattr(_open, "made", [])
    stack.append([])
    try:
        yield
    finally:
        for item in stack.pop():
            _remove(*item)
            _WRITTEN.remove(item)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clear() -> None:
    for spark, path in _WRITTEN:
        try:
            _remove(spark, path)
        except Exception:  # the session may have stopped; the folder is then left for the cluster's clean-up
            return
