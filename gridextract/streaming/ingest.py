"""Files that arrive month by month, as a stream of page texts with a state for each file.

An arrival is one upload of a file: all of its pages, or an error in place of them. The state of a file has the number of
its last arrival, the hash of what it held, how often that has changed (its version) and its first arrival, which is its
place among the files. So a file that comes again as it was costs nothing, one that comes again without any rows, or that
cannot be read, takes its former rows away, and nothing of earlier batches is read to tell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from gridextract.plans.extract import extract

#: One row for each page of an upload: arrival grows from upload to upload; pages is the number of pages of this one. An
#: upload without pages, or that cannot be read (error), is one row of page 0.
ARRIVAL = "file_name string, arrival long, page int, pages int, text string, error string"
NEW, REPEATED, FAILED = "new", "repeated", "failed"
_CHANGE = "file_name string, version long, first long, arrival long, status string, error string, page_count int, page int, text string"
_STATE = "version long, hash string, first long, arrival long, waiting long, pages array<int>, texts array<string>"


def _advance(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The latest complete arrival of a file as one row for each page, and one of page 0. Pages of an arrival may come in
    several batches; they wait in the state until all are there. What is older than an arrival that was taken is left out."""
    version, was, first, taken, waiting, numbers, texts = state.get if state.exists else (0, "", None, -1, -1, [], [])
    held, done = dict(zip(numbers, texts, strict=True)), None
    there = lambda x: x is not None and x == x
    # plain rows: a file has few pages, on which frames would cost more than the work
    rows = (row for part in parts for row in zip(*(part[c].tolist() for c in ("arrival", "page", "pages", "text", "error")), strict=True))
    new = sorted((row for row in rows if row[0] > max(taken, waiting - 1)), key=lambda row: row[0])
    for arrival, group in groupby(new, key=lambda row: row[0]):
        own = list(group)
        held = held if arrival == waiting else {}
        waiting = int(arrival)
        failed = [error for *_, error in own if there(error)]
        held |= {} if failed else {int(page): text if there(text) else None for _, page, _, text, _ in own}
        if failed or len(held.keys() - {0}) >= int(max(pages for _, _, pages, _, _ in own if there(pages))):
            done = (waiting, min(failed) if failed else None, {} if failed else {k: held[k] for k in sorted(held) if k})
            taken, held = waiting, {}
    if done is not None:
        arrival, error, pages = done
        now = hashlib.sha256(repr((error, sorted(pages.items()))).encode()).hexdigest()
        first = arrival if first is None else first
        status = REPEATED if now == was else NEW if error is None else FAILED
        version, was = version + (now != was), now
        shown = [(0, None), *(pages.items() if status == NEW else ())]
        yield pd.DataFrame([(*key, version, first, arrival, status, error, len(pages), *x) for x in shown], columns=[c.split()[0] for c in _CHANGE.split(", ")])
    state.update((version, was, first, taken, waiting if held else -1, list(held), list(held.values())))


def changes(arrivals: DataFrame) -> DataFrame:
    """The changes of files (a stream of ARRIVAL): of each file that has changed in a batch one row of page 0 and, unless it is
    repeated or failed, its pages. The metric "arrivals" of each batch counts files by status, and pages."""
    known = arrivals.groupBy("file_name").applyInPandasWithState(_advance, _CHANGE, _STATE, "append", GroupStateTimeout.NoTimeout)
    head = F.col("page") == 0
    return known.observe("arrivals", *(F.count_if(head & (F.col("status") == s)).alias(s) for s in (NEW, REPEATED, FAILED)), F.count_if(~head).alias("pages"))


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, *, max_files: int | None = None, read: Callable[[DataFrame], DataFrame] = extract) -> StreamingQuery:
    """Takes in all arrivals (Parquet of ARRIVAL below source) that are new since the last call, and ends. max_files: files of
    source in one batch. read: rows (file_name, ...) of page texts.

    Below target, each batch has its folders: rows, what was read of the changed files with their version, and then files,
    without which the rows do not count. A batch that runs twice after a failure replaces its own folders."""
    stream = spark.readStream.schema(ARRIVAL).option("recursiveFileLookup", True)
    stream = stream.option("maxFilesPerTrigger", max_files) if max_files else stream

    def write(batch: DataFrame, number: int) -> None:
        at = f"{target}/changes/batch={number}"
        batch.write.mode("overwrite").parquet(at)  # the states advance once, here
        got = batch.sparkSession.read.schema(_CHANGE).parquet(at)
        pages, heads = got.where("page > 0"), got.where("page = 0").drop("page", "text")
        rows = read(pages.select("file_name", "page", "text")).join(heads.select("file_name", "version"), "file_name")
        rows.write.mode("overwrite").parquet(f"{target}/rows/batch={number}")
        n = batch.sparkSession.read.parquet(f"{target}/rows/batch={number}").groupBy("file_name").agg(F.count(F.lit(1)).alias("n_rows"))
        heads.join(n, "file_name", "left").fillna(0, ["n_rows"]).write.mode("overwrite").parquet(f"{target}/files/batch={number}")

    query = changes(stream.parquet(source)).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return query.trigger(availableNow=True).start()


def progress(query: StreamingQuery) -> list[dict[str, int]]:
    """The metrics of each batch of a query: files by status, and pages."""
    return [{"batch": p["batchId"], **p["observedMetrics"]["arrivals"].asDict()} for p in query.recentProgress if "arrivals" in p["observedMetrics"]]


def files(spark: SparkSession, target: str) -> DataFrame:
    """The files as they stand: file_name, first (the arrival that gives its place), arrival, version, status (new or failed;
    a repeated file is what it was), error, page_count, n_rows, batch (of its rows)."""
    d = spark.read.parquet(f"{target}/files")
    last = d.groupBy("file_name").agg(F.max("arrival").alias("arrival"))
    changed = d.where(F.col("status") != REPEATED).drop("arrival")
    latest = Window.partitionBy("file_name").orderBy(F.desc("version"))
    return changed.withColumn("_nth", F.row_number().over(latest)).where("_nth = 1").drop("_nth").join(last, "file_name")


def current(spark: SparkSession, target: str) -> DataFrame:
    """The rows of all files as they stand, with the place of their file (first)."""
    live = files(spark, target).where("n_rows > 0").select("file_name", "version", "batch", "first")
    return spark.read.parquet(f"{target}/rows").join(live, ["file_name", "version", "batch"])


def failures(spark: SparkSession, target: str) -> DataFrame:
    """file_name, error, first of the files whose last arrival could not be read."""
    return files(spark, target).where(F.col("status") == FAILED).select("file_name", "error", "first")


def arrivals_of(pages: DataFrame, arrival: int) -> DataFrame:
    """ARRIVAL from the pages of one upload of several files (file_name, page, text and, from a reader, error)."""
    error = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    n = F.count_if(F.col("page") > 0).over(Window.partitionBy("file_name"))
    return pages.select("file_name", F.lit(arrival).cast("long").alias("arrival"), "page", n.cast("int").alias("pages"), "text", error.alias("error"))
