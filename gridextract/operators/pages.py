"""Which pages of a file are read as tables: from page_text(file_name, page, text) and the number of pages of each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridextract.functions.pages import page_kind


def classified(page_text: DataFrame) -> DataFrame:
    return page_text.withColumn("kind", page_kind(F.coalesce("text", F.lit(""))))


def usual_pages(page_count: Column) -> Column:
    """Where tables are if no page says so: pages 3 to 6 and the three before the last, as far as they exist."""
    places = F.array(*(F.lit(i) for i in (3, 4, 5, 6)), page_count - 3, page_count - 2, page_count - 1)
    return F.array_sort(F.array_distinct(F.filter(places, lambda p: (p >= 1) & (p <= page_count))))


def target_pages(pages: DataFrame, files: DataFrame) -> DataFrame:
    """file_name, page, role of the pages to read. pages: file_name, page, kind; files: file_name, page_count.

    A full page takes the page after it along, an overflow page the one before it, unless that is a legend; without any,
    the usual pages are read. Legends never are. The first full page (else the first of all) is main, others overflow.
    The page numbers of a file, by kind, are one row."""
    of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("page"))).alias(kind)
    each = files.join(pages.groupBy("file_name").agg(of("full"), of("overflow"), of("legend")), "file_name", "left")
    none = F.array().cast("array<int>")
    full, overflow, legend = (F.coalesce(F.col(c).cast("array<int>"), none) for c in ("full", "overflow", "legend"))
    near = F.array_union(F.flatten(F.transform(full, lambda p: F.array(p, p + 1))), F.flatten(F.transform(overflow, lambda p: F.array(p, p - 1))))
    near = F.filter(near, lambda p: (p >= 1) & (p <= F.col("page_count")))
    each = each.select("file_name", full.alias("full"), F.array_except(near, legend).alias("near"), F.array_except(usual_pages(F.col("page_count").cast("int")), legend).alias("usual"))
    each = each.select("file_name", "full", F.when(F.size("near") > 0, F.col("near")).otherwise(F.col("usual")).alias("wanted"))
    main = F.coalesce(F.array_min(F.array_intersect("wanted", "full")), F.array_min("wanted"))
    each = each.select("file_name", main.alias("main"), F.explode("wanted").alias("page"))
    return each.select("file_name", "page", F.when(F.col("page") == F.col("main"), "main").otherwise("overflow").alias("role"))
