"""Page sources: documents as files of bytes, page texts and word boxes as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_TEXT = "file_name string, page int, text string"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """file_name, content of the PDF files below a path."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return d.select(F.col("path").alias("file_name"), "content")


def read_page_texts(spark: SparkSession, path: str, page_break: str = "\f") -> DataFrame:
    """file_name, page, text of plain text files whose pages are parted by form feeds."""
    d = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file_name"), "value")
    return d.select("file_name", F.posexplode(F.split("value", page_break)).alias("page", "text")).withColumn("page", F.col("page") + 1)


def extract_pages(documents: DataFrame, reader: Callable[[bytes], list[str]]) -> DataFrame:
    """file_name, page, text, error: pages by a reader of one document's bytes. What a reader raises becomes the error of
    its file and touches no other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["file_name"], batch["content"], strict=True):
                try:
                    rows += [(name, i + 1, text, None) for i, text in enumerate(reader(content))]
                except Exception as e:  # one bad file is a row, not a failed job
                    rows.append((name, 0, None, f"Failed to parse: {e}"))
            yield pd.DataFrame(rows, columns=["file_name", "page", "text", "error"])

    return documents.select("file_name", "content").mapInPandas(run, f"{PAGE_TEXT}, error string")
