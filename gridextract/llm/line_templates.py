"""Line dedup by a log-template tree of fixed depth, with DataFrame functions only.

A line walks down the tree by its number of tokens, then by its first `depth` tokens; a token with a digit counts as
the variable <*>. In the leaf it reaches, a token that as many as min_docs lines of documents have at its place is part
of the template, any other is <*>. A template found in min_docs documents or more is recurring: its lines are dropped from
all documents but the one with the smallest id, so the corpus keeps each of them once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import settled, unused, written

#: White space inside a line, as blanks.
BLANKS = ("\t\r\f\x0b", "    ")


def squeezed(line: Column) -> Column:
    """Tokens of a line with one blank between any two."""
    other = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\f")) | F.contains(line, F.lit("\x0b"))
    return F.trim(F.when(other | F.contains(line, F.lit("  ")), F.regexp_replace(F.translate(line, *BLANKS), " +", " ")).otherwise(line))


def n_tokens(line: Column) -> Column:
    """Tokens of a squeezed line."""
    return F.when(line == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def masked(line: Column) -> Column:
    """A squeezed line whose tokens with a digit are <*>."""
    return F.regexp_replace(line, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*", "<*>")


def recurring_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, min_docs: int = 5, min_tokens: int = 1, min_fixed: float = 0.5) -> DataFrame:
    """id, raw_hash (xxhash64 of a line as it stands), template: each line that is to be dropped from a document.

    A template must have min_fixed of its tokens fixed. Blank lines and lines of fewer than min_tokens tokens are never
    dropped. A line shorter than depth is in the leaf of its count and all its tokens.
    """
    lines = docs.select(F.col(id_col).alias("id"), F.explode(F.split(F.col(text_col).cast("string"), "\n")).alias("raw")).where("id is not null")
    lines = lines.withColumn("x", squeezed(F.col("raw"))).where(F.col("x") != "")
    if min_tokens > 1:
        lines = lines.where(F.substring_index("x", " ", min_tokens - 1) != F.col("x"))
    lines = lines.select("id", "raw", F.xxhash64(n_tokens(F.col("x")), masked(F.substring_index("x", " ", depth))).alias("leaf"))
    leaves = lines.select("leaf", "id").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("leaf")
    # what is joined back to the rows it was made from is a table of its own here and below: the join then deals out both
    # sides anew, and Spark splits the rows of one hot key
    leaves = written(leaves)
    # from here on a line is named by its leaf and a hash, 128 bits together; only one copy of its text goes along
    found = lines.join(leaves, "leaf").withColumn("line", masked(squeezed(F.col("raw"))))
    found = written(found.select("leaf", F.xxhash64("line").alias("h"), "id", F.xxhash64("raw").alias("raw_hash"), "line"))
    times = found.select("leaf", "h", "id").distinct().groupBy("leaf", "h").agg(F.count(F.lit(1)).alias("n"))
    kinds = written(found.groupBy("leaf", "h").agg(F.min("line").alias("line")).join(times, ["leaf", "h"]))

    words = kinds.select("leaf", "h", "n", F.posexplode(F.split("line", " ")).alias("at", "token"))
    fixed = words.where("token <> '<*>'").groupBy("leaf", "at", "token").agg(F.sum("n").alias("s")).where(F.col("s") >= min_docs).select("leaf", "at", "token", F.lit(True).alias("fixed"))
    fixed = written(fixed)
    shape = words.join(fixed, ["leaf", "at", "token"], "left").groupBy("leaf", "h").agg(
        F.array_sort(F.collect_list(F.struct("at", F.when(F.col("fixed"), F.col("token")).otherwise("<*>").alias("t")))).alias("t"), F.count("fixed").alias("fixed"))
    shape = written(shape.where(F.col("fixed") >= min_fixed * F.size("t")).select("leaf", "h", F.array_join(F.col("t")["t"], " ").alias("template")))
    # the number of tokens and the first ones are part of a template, so it lies in one leaf
    held = written(found.select("leaf", "h", "id", "raw_hash").join(shape, ["leaf", "h"]))
    again = held.select("leaf", "template", "id").distinct().groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where(F.col("n") >= min_docs)
    again = written(again)
    return held.join(again, ["leaf", "template"]).where("id <> first").select("id", "raw_hash", "template")


def drop_recurring_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_lines: str | None = None, n_dropped: str | None = None, **params) -> DataFrame:
    """docs with text_col rewritten, in the same columns, and counts of lines in the columns named by n_lines and
    n_dropped.

    A text of which all lines go is empty; the row stays. Null texts stay null with 0 lines. Lines of rows with a null
    id are neither counted nor dropped. Rows of one id are one document. Empty table: no rows.
    """
    own, set_, kept_ = (unused(docs, c) for c in ("id_", "gone_", "kept_"))
    gone = settled(lambda: recurring_lines(docs, id_col=id_col, text_col=text_col, **params).groupBy("id").agg(F.collect_set("raw_hash").alias(set_)).withColumnRenamed("id", own))
    # one kind of plan at every size: what is to go grows with docs, so texts are shuffled to it and it is never broadcast
    out = docs.join(gone.hint("merge"), F.col(id_col) == F.col(own), "left")
    lines = F.split(F.col(text_col).cast("string"), "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(set_), F.xxhash64(x)))
    out = out.withColumn(kept_, F.when(F.col(set_).isNull(), lines).otherwise(kept))
    count = lambda c: F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0)).cast("long")
    extra = [*([count(lines).alias(n_lines)] if n_lines else []), *([(count(lines) - count(F.col(kept_))).alias(n_dropped)] if n_dropped else [])]
    text = F.when(F.col(set_).isNull(), F.col(text_col).cast("string")).otherwise(F.array_join(kept_, "\n"))
    return out.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns), *extra)
