"""From page texts to reconciled rows: one shuffle key, the file, all along."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridextract.operators import dedupe, match, meta, pages, quality, rows
from gridextract.sources.shared import once


def table_pages(page_text: DataFrame) -> DataFrame:
    """file_name, page, role of the pages that are read as tables."""
    kinds = pages.classified(page_text)
    files = page_text.groupBy("file_name").agg(F.max("page").alias("page_count"))
    return pages.target_pages(kinds.select("file_name", "page", "kind"), files)


def extract(page_text: DataFrame) -> DataFrame:
    """members(file_name, row_index, ...) of all table pages of each file."""
    wanted = table_pages(page_text).select("file_name", "page")
    return dedupe.members_of(rows.page_rows(page_text.join(wanted, ["file_name", "page"], "left_semi")))


def page_warnings(page_text: DataFrame) -> DataFrame:
    """file_name, warning: the main pages of files of which no row is read. Only these pages are parsed."""
    main = table_pages(page_text).where("role = 'main'").select("file_name", "page")
    read = rows.page_rows(page_text.join(main, ["file_name", "page"], "left_semi")).select("file_name", "page").distinct()
    text = F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" looks like Membership Detail but no subscriber rows were read."))
    return main.join(read, ["file_name", "page"], "left_anti").select("file_name", text.alias("warning"))


def headers(page_text: DataFrame) -> DataFrame:
    return meta.merged_header(meta.header_fields(page_text))


def reconcile(members: DataFrame, roster: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The row of each roster name, and the rows that belong to none. Runs when it is called: the pairs and the rows are
    tables that both results read, to the end of the driver or of shared.working_tables()."""
    pairs = once(match.assign(roster, members))
    matched = match.apply_roster(roster, members, pairs)
    unused = match.unused_rows(roster, members, pairs)
    filled = once(match.fill_from_leftover(matched, unused))
    return filled, match.leftover_report(filled, unused)


def warnings(filled: DataFrame, leftover: DataFrame) -> DataFrame:
    return quality.not_found_warning(filled).unionByName(quality.ignored_warning(leftover))
