"""Lists of names from delimited or plain text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridextract.functions import names
from gridextract.functions.text import trimmed
from gridextract.operators.edits import merge_roster
from gridextract.sources import versions


def cells(line: Column) -> Column:
    """Cells of a line parted by commas or tabs, without quotes and outer blanks."""
    found = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(r'((?:"(?:[^"]|"")*"|[^,\t"])*)[,\t]'), 1)
    plain = lambda c: F.replace(F.regexp_replace(F.replace(c, F.lit('""'), F.lit("\0")), '"', ""), F.lit("\0"), F.lit('"'))
    return F.transform(found, lambda c: trimmed(plain(c)))


def is_roster_file(name: Column) -> Column:
    return F.lower(name).rlike(r"\.(csv|txt|tsv)\z")


def parse_roster(files: DataFrame) -> DataFrame:
    """file_name, ord, name: the distinct people of lists (files: file_name, text), in the order in which they first come.
    A first line with a cell Name says which cell is read; else a line that looks like a person, or its first such cell."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "^﻿", "")
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), trimmed), lambda x: x != "")
    d = files.select("file_name", lines.alias("lines")).withColumn("at", F.array_position(F.transform(cells(F.get("lines", F.lit(0))), F.lower), "name"))
    d = d.select("file_name", "at", F.posexplode("lines").alias("ord", "line")).where("not (at > 0 and ord = 0)").withColumn("cells", cells(F.col("line")))
    guess = F.get(F.filter("cells", names.person_like), F.lit(0))
    of_column = F.nullif(F.get("cells", F.col("at").cast("int") - 1), F.lit(""))
    raw = F.when(F.col("at") > 0, F.coalesce(of_column, guess)).when(names.person_like(F.col("line")), F.col("line")).otherwise(guess)
    d = d.select("file_name", "ord", raw.alias("raw")).where(names.person_like(F.col("raw"))).select("file_name", "ord", names.roster_name(F.col("raw")).alias("name"))
    first = d.groupBy("file_name", "name").agg(F.min("ord").alias("ord"))
    return first.select("file_name", F.row_number().over(Window.partitionBy("file_name").orderBy("ord")).alias("ord"), "name")


def read_rosters(spark: SparkSession, path: str) -> DataFrame:
    """Lists below a path, one row a file, whatever the case of their endings."""
    d = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file_name"), F.col("value").alias("text"))
    return parse_roster(d.where(is_roster_file(F.col("file_name"))))


def save_roster(roster: DataFrame, path: str, version: int) -> None:
    """The list, one row a name, as a change of its own (sources.versions), with the version of its form."""
    spark = roster.sparkSession
    versions.commit(spark, path, {"names": roster.select("name").distinct()}, about={"version": version})


def stored_roster(spark: SparkSession, path: str, patch: DataFrame, version: int) -> DataFrame:
    """The names of a saved list in capitals; names of patch (name) join a list that was saved under an older version.
    A list with a blank name is not valid, and gives no name of its own. A path without a list has no names."""
    names_ = versions.read(spark, path).get("names")
    if names_ is None:
        return patch.select("name").limit(0)
    blank = F.col("name").isNull() | (trimmed(F.col("name")) == "")
    valid = names_.where(blank).isEmpty()
    own = (names_ if valid else names_.limit(0)).select(F.upper(trimmed(F.col("name"))).alias("name")).distinct()
    old = versions.about(spark, path)["version"] < version
    return merge_roster(own, patch.select("name")) if old else own
