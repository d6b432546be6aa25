"""Written intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_ROOTS: list[tuple[SparkSession, str]] = []
#: Of each thread: what was written inside of each settled() that it is in.
_open = threading.local()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Where the session names none, a fresh local one is set if all of
    Spark runs on this machine, as in tests; on a cluster that is an error."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="gridextract-ckpt-")
        sc.setCheckpointDir(at)
    return at


def written(df: DataFrame) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: lineage ends there, so a lost executor costs
    only the tasks it ran. The folder is removed when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/gridextract/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _ROOTS:
        atexit.register(_clear)
    _ROOTS.append((spark, path))
    for made in getattr(_open, "made", [])[-1:]:
        made.append(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner remove the shuffle files of the finished step
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def discard(df: DataFrame) -> None:
    """Remove the files of a table from written() once nothing reads it any more."""
    _remove(df.sparkSession, df._scratch_path)
    _ROOTS.remove((df.sparkSession, df._scratch_path))


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """written(make()); the tables that make() wrote on its way, in this thread, are removed, so nothing else may read them
    later."""
    stack = _open.made = getattr(_open, "made", [])
    stack.append([])
    try:
        out = written(make())
    finally:
        made = stack.pop()
    for path in made:
        if path != out._scratch_path and (out.sparkSession, path) in _ROOTS:
            _remove(out.sparkSession, path)
            _ROOTS.remove((out.sparkSession, path))
    for outer in stack[-1:]:
        outer.append(out._scratch_path)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clear() -> None:
    for spark, path in _ROOTS:
        try:
            _remove(spark, path)
        except Exception:  # the session may have stopped; the folder is then left for the cluster's clean-up
            return
