"""Pages of documents as a data source of Spark: a reader that is plugged in, ranges of pages as partitions, and filters on
file names and page numbers that reach it, so that a range without a wanted page is never opened.

    read_pages(spark, MyReader("hdfs://..."), span=16).where("page between 3 and 5")
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

PAGES = "file_name string, page int, text string, error string"


class Reader(Protocol):
    """How documents are found and read; pickled to the tasks, so it opens nothing before it is used there."""

    def documents(self) -> Iterable[tuple[str, int]]:
        """Names of files and their numbers of pages."""

    def texts(self, file_name: str, first: int, last: int) -> Iterable[str]:
        """The texts of pages first to last (from 1)."""


@dataclass
class PageRange(ds.InputPartition):
    file_name: str
    first: int
    last: int


class _Pages(ds.DataSourceReader):
    def __init__(self, reader: Reader, span: int, glob: str):
        self.reader, self.span, self.glob = reader, span, glob
        self.low, self.high, self.files, self.pages, self.ends = 1, 1 << 31, None, None, []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            if not self._takes(f):
                yield f

    def _takes(self, f: ds.Filter) -> bool:
        """Narrows what is read by a filter; False if Spark has to apply it."""
        column = getattr(f, "attribute", None)
        value: Any = getattr(f, "value", None)
        if column == ("page",):
            if isinstance(f, ds.EqualTo):
                self.low, self.high = max(self.low, value), min(self.high, value)
            elif isinstance(f, ds.GreaterThan | ds.GreaterThanOrEqual):
                self.low = max(self.low, value + isinstance(f, ds.GreaterThan))
            elif isinstance(f, ds.LessThan | ds.LessThanOrEqual):
                self.high = min(self.high, value - isinstance(f, ds.LessThan))
            elif isinstance(f, ds.In):
                self.pages = set(value) if self.pages is None else self.pages & set(value)
            else:
                return isinstance(f, ds.IsNotNull)
        elif column == ("file_name",):
            if isinstance(f, ds.EqualTo | ds.In):
                some = set(value) if isinstance(f, ds.In) else {value}
                self.files = some if self.files is None else self.files & some
            elif isinstance(f, ds.StringStartsWith | ds.StringEndsWith):
                self.ends.append((isinstance(f, ds.StringStartsWith), value))
            else:
                return isinstance(f, ds.IsNotNull)
        else:
            return False
        return True

    def _wanted(self, name: str) -> bool:
        return fnmatchcase(name.lower(), self.glob) and (self.files is None or name in self.files) and all(name.startswith(x) if start else name.endswith(x) for start, x in self.ends)

    def partitions(self) -> list[PageRange]:
        out = []
        for name, n in self.reader.documents():
            if self._wanted(name):
                for first in range(1, n + 1, self.span):
                    low, high = max(first, self.low), min(first + self.span - 1, n, self.high)
                    if low <= high and (self.pages is None or any(low <= p <= high for p in self.pages)):
                        out.append(PageRange(name, low, high))
        return out

    def read(self, partition: PageRange) -> Iterator[tuple]:
        if partition is None:  # nothing is wanted
            return
        try:
            for page, text in enumerate(self.reader.texts(partition.file_name, partition.first, partition.last), partition.first):
                if self.pages is None or page in self.pages:
                    yield partition.file_name, page, text, None
        except Exception as e:  # one bad file is a row, not a failed job
            yield partition.file_name, partition.first, None, f"Failed to parse: {e}"


def page_source(reader: Reader) -> type[ds.DataSource]:
    """A data source for spark.dataSource.register. Options: span (pages of one partition), glob (of lower-cased names)."""

    class PageSource(ds.DataSource):
        @classmethod
        def name(cls) -> str:
            return "document_pages"

        def schema(self) -> str:
            return PAGES

        def reader(self, schema) -> ds.DataSourceReader:
            return _Pages(reader, int(self.options.get("span", "16")), self.options.get("glob", "*.pdf"))

    return PageSource


def read_pages(spark: SparkSession, reader: Reader, *, span: int = 16, glob: str = "*.pdf") -> DataFrame:
    """file_name, page, text, error of the pages of all documents of a reader. A range that cannot be read is a row with its
    error under its first page, and what was read of it before. Filters on page and file_name are pushed to the ranges."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(page_source(reader))
    return spark.read.format("document_pages").option("span", span).option("glob", glob).load()
