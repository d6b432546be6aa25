"""The export table and its CSV lines."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridextract.functions.money import fixed2
from gridextract.operators.match import NOT_FOUND
from gridextract.sources.versions import file_system

# Header of the export.
HEADER = ("Name", "Family Count", "Coverage", "Status", "Medical Plan", "Medical current charge", "Statement ID", "File Name", "Bill Period")
FIELDS = ("name", "family_count", "coverage", "status", "medical_plan", "charge", "statement_id", "file_name", "bill_period")


def escaped(value: Column) -> Column:
    """A CSV cell: quoted if it holds a comma, quote or line end; null is blank."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(value.rlike('[,"\n]'), quoted).otherwise(value), F.lit(""))


def export_rows(members: DataFrame, headers: DataFrame) -> DataFrame:
    """FIELDS as text, and row_index. Excluded rows and members that were not found are left out; a file without any
    member is a row of its header only (row_index null)."""
    d = headers.select("file_name", "statement_id", "bill_period").join(members, "file_name", "left")
    d = d.where(F.col("name").isNull() | (~F.coalesce("excluded", F.lit(False)) & ~F.array_contains("flags", NOT_FOUND)))
    text = {"charge": fixed2(F.col("charge")), "family_count": F.col("family_count").cast("string")}
    return d.select(*(F.coalesce(text.get(c, F.col(c)), F.lit("")).alias(c) for c in FIELDS), "row_index")


def csv_lines(rows: DataFrame) -> DataFrame:
    """file_name, row_index, line of each row of an export."""
    return rows.select("file_name", "row_index", F.array_join(F.array(*(escaped(F.col(c)) for c in FIELDS)), ",").alias("line"))


def write_csv(rows: DataFrame, path: str) -> None:
    """The export as one CSV file, in the order of files and rows: byte order mark, header, lines parted by \\n, none at the
    end. Spark sorts the lines and writes them in parts; these are joined as bytes, so no task or driver holds the export.
    The file appears under its name when it is whole: a failed task or join leaves nothing, and an older file as it was."""
    spark = rows.sparkSession
    fs, of = file_system(spark, path)
    work = f"{path}.{uuid.uuid4().hex}"
    try:
        csv_lines(rows).orderBy("file_name", "row_index").select("line").write.text(f"{work}/parts")
        parts = sorted((x for x in fs.listStatus(of(f"{work}/parts")) if x.getPath().getName().startswith("part-") and x.getLen()), key=lambda x: x.getPath().getName())
        whole = of(f"{work}/whole")
        out = fs.create(whole, False)
        try:
            out.write(bytearray(("\ufeff" + ",".join(HEADER)).encode()))
            for part in parts:
                # what Spark ends each line with stands before each here
                out.write(bytearray(b"\n"))
                lines = fs.open(part.getPath())
                some = spark.sparkContext._jvm.org.apache.commons.io.input.BoundedInputStream(lines, part.getLen() - 1)
                spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(some, out, 1 << 16, False)
                lines.close()
        finally:
            out.close()
        fs.delete(of(path), True)
        if not fs.rename(whole, of(path)):
            raise OSError(f"{path} could not be written")
    finally:
        fs.delete(of(work), True)
