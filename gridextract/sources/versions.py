"""Tables that change together: each change is a folder of its own, and a manifest that is written last names the tables
that count. Readers see all of a change or nothing of it, and a change that fails leaves what was there."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another change was made since the version that a change was based on."""


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and a function from text to its paths."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, of = file_system(spark, path)
    at = of(f"{path}/manifest")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def _manifest(spark: SparkSession, path: str, version: int | None) -> dict:
    have = _versions(spark, path)
    if not have:
        return {"version": 0, "tables": {}, "about": {}}
    name = f"{path}/manifest/{have[-1] if version is None else version:010d}.json"
    # a manifest is one line
    return json.loads(spark.read.text(name).first()[0])


def version(spark: SparkSession, path: str) -> int:
    """The number of the last change; 0 before the first."""
    return (_versions(spark, path) or [0])[-1]


def about(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """What the change said of itself."""
    return _manifest(spark, path, version)["about"]


def read(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables as of the last change, or of that version."""
    return {name: spark.read.parquet(at) for name, at in _manifest(spark, path, version)["tables"].items()}


def commit(spark: SparkSession, path: str, tables: dict[str, DataFrame], *, based_on: int | None = None, about: dict | None = None) -> int:
    """Writes tables, keeps the others of the last change, and makes this the last change; its number. based_on: the version
    that tables were made from; Conflict if it is not the last one any more. Writers that finish at the same moment are told
    apart where a rename fails if its target is there, as on HDFS."""
    fs, of = file_system(spark, path)
    last = _manifest(spark, path, None)
    if based_on is not None and based_on != last["version"]:
        raise Conflict(f"version {based_on} was changed to {last['version']}")
    number, folder = last["version"] + 1, f"{path}/change-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    kept = last["tables"] | {name: f"{folder}/{name}" for name in tables}
    text = json.dumps({"version": number, "tables": kept, "about": about or {}})
    fs.mkdirs(of(f"{path}/manifest"))
    draft, name = of(f"{path}/manifest/.{uuid.uuid4().hex}"), of(f"{path}/manifest/{number:010d}.json")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(name) or not fs.rename(draft, name):
        raise Conflict(f"version {number} was made by someone else")
    return number
