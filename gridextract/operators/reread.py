"""A second look at members that no row was found for: where on a table their name may stand, and what is read there.

words(file_name, page, text, x0, y0, x1, y1) come from the first reading; tables(file_name, page, width, height) are the
images they lie on. The second reading itself is a parameter (see sources.images).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridextract.functions import money
from gridextract.functions.text import collapsed, dealt, kept, let, trimmed
from gridextract.operators import dedupe, layout, match, rows

# Share of a table's width that names stand in; least score of a last name alone.
NAME_SIDE, LAST_ALONE = 0.42, 0.85


def line_texts(words: DataFrame, tables: DataFrame) -> DataFrame:
    """file_name, page, line_no, texts (the words at the left, else all), y0, y1 of each line of a table."""
    lines = layout.word_rows(words, ["file_name", "page"]).join(tables.select("file_name", "page", "width"), ["file_name", "page"])
    each = lines.select("file_name", "page", "width", F.posexplode("lines").alias("line_no", "line"))
    by_x = F.array_sort(F.transform("line", lambda w, i: F.struct(w["x0"].alias("x0"), i.alias("i"), w["text"].alias("text"))))
    left = F.filter(by_x, lambda w: w["x0"] < F.col("width") * NAME_SIDE)
    pick = let(left, lambda part: F.when(F.size(part) > 0, part).otherwise(by_x))
    return each.select("file_name", "page", "line_no", pick["text"].alias("texts"), F.array_min(F.col("line")["y0"]).alias("y0"), F.array_max(F.col("line")["y1"]).alias("y1"))


def name_hints(missing: DataFrame, words: DataFrame, tables: DataFrame) -> DataFrame:
    """file_name, row_index, name, page, hint, score, y0, y1: the line that fits each missing member best (of equal ones
    that of the first page, then the topmost). Members choose in their order; a line that overlaps one chosen before is
    left to that. missing: file_name, row_index, name."""
    # words are few bytes and their scores much work: dealt, or Spark scores all files in one task
    lines, missing = line_texts(dealt(words, "file_name"), tables), dealt(missing, "file_name")
    hint, known = F.array_join("texts", " "), F.col("known")
    lines = dealt(lines, "file_name").select("file_name", "page", "line_no", "y0", "y1", hint.alias("hint"), match.read_parts(hint).alias("whole"), F.transform("texts", match.read_parts).alias("words"))
    alone = F.array_max(F.transform("words", lambda w: match.last_score(known, w)))
    fits = missing.select("file_name", F.col("row_index").cast("int").alias("row_index"), "name", match.known_parts(F.col("name")).alias("known")).join(lines, "file_name")
    score = F.greatest(match.pair_score(known, F.col("whole")), match.last_score(known, F.col("whole")), alone)
    fits = fits.select("file_name", "row_index", "name", "page", "line_no", "y0", "y1", "hint", score.alias("score"))
    fits = fits.select(*(c for c in fits.columns if c != "score"), kept(F.col("score"), F.col("score") >= match.HINT).alias("score"))
    option = F.struct("row_index", (-F.col("score")).alias("less"), "page", "line_no", "y0", "y1", "hint", "name")
    each = fits.groupBy("file_name").agg(F.array_sort(F.collect_list(option)).alias("options"))
    kind = each.schema["options"].dataType.simpleString()

    def taken(held, x):
        return F.exists(held, lambda h: (h["row_index"] == x["row_index"]) | layout.overlap(h["y0"], h["y1"], x["y0"], x["y1"]))

    chosen = F.aggregate("options", F.array().cast(kind), lambda held, x: F.when(taken(held, x), held).otherwise(F.concat(held, F.array(x))))
    return each.select("file_name", F.explode(chosen).alias("c")).select("file_name", "c.row_index", "c.name", "c.page", "c.hint", (-F.col("c.less")).alias("score"), "c.y0", "c.y1")


def crops(hints: DataFrame, tables: DataFrame) -> DataFrame:
    """hints with the boxes of name, codes and amount of the strip of the table that is to be read again."""
    d = hints.join(tables.select("file_name", "page", "width", "height"), ["file_name", "page"])
    strip = layout.strip_rect(F.col("y0"), F.col("y1"), F.col("width"), F.col("height"))
    return d.select(*hints.columns, let(strip, layout.strip_crops).alias("crops"))


def recovered(reread: DataFrame) -> DataFrame:
    """file_name, row_index and the fields of a row for each member whose second reading holds it. reread: file_name,
    row_index, name, page, name_text, rest_text. A parsed row whose name fits counts; else the name alone must fit, and
    the first amount is the charge."""
    line = trimmed(F.concat_ws(" ", "name_text", "rest_text"))
    # each reading is parsed as a page of its own, numbered by its member
    text = reread.select("file_name", F.col("row_index").cast("int").alias("page"), line.alias("text"))
    parsed = dedupe.dedupe(rows.page_rows(text), ["file_name", "page"], ["pass", "ord"]).withColumnRenamed("row_index", "nth")
    parsed = parsed.withColumnRenamed("page", "row_index").withColumnRenamed("name", "read")
    fits = parsed.join(reread.select("file_name", F.col("row_index").cast("int").alias("row_index"), "name"), ["file_name", "row_index"]).where(match.match_score(F.col("name"), F.col("read")) >= match.MATCH)
    fields = ("read", "family_count", "coverage", "status", "medical_plan", "charge", "flags")
    first = fits.groupBy("file_name", "row_index").agg(F.min_by(F.struct(*fields), "nth").alias("row"))
    d = reread.withColumn("row_index", F.col("row_index").cast("int")).join(first, ["file_name", "row_index"], "left")
    alone = (match.match_score(F.col("name"), F.col("name_text")) >= match.MATCH) | (match.last_name_score(match.last_name(F.col("name")), F.col("name_text")) >= LAST_ALONE)
    d = d.withColumn("hit", F.col("row").isNotNull()).where("hit or name_text is not null").where(F.col("hit") | alone)
    charge = F.when(F.col("hit"), F.col("row.charge")).otherwise(F.get(money.in_line(F.coalesce("rest_text", F.lit(""))), F.lit(0)))
    flags = F.when(F.col("hit"), match.hit_flags(F.col("row.flags"), F.col("row.charge"))).when(charge.isNull(), F.array(F.lit(match.NO_CHARGE))).otherwise(F.array().cast("array<string>"))
    blank = lambda c: F.coalesce(F.col(f"row.{c}"), F.lit("")).alias(c)
    return d.select("file_name", "row_index", "name", F.col("row.family_count").alias("family_count"), blank("coverage"), blank("status"), blank("medical_plan"), charge.alias("charge"), "page", flags.alias("flags"), F.coalesce("row.read", collapsed(F.col("name_text"))).alias("ocr_name"))


def second_look(matched: DataFrame, words: DataFrame, tables: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """matched (see match.apply_roster) with what a second reading recovers in the place of placeholders. read: from
    crops() to the same rows with name_text and rest_text; rows it leaves out or cannot read stay placeholders."""
    missing = matched.where(match.is_missing(F.col("flags"))).select("file_name", "row_index", "name")
    found = recovered(read(crops(name_hints(missing, words, tables), tables)))
    found = found.select(*(F.col(c) if c in found.columns else F.lit(None).cast(matched.schema[c].dataType).alias(c) for c in matched.columns))
    return matched.join(found.select("file_name", "row_index"), ["file_name", "row_index"], "left_anti").unionByName(found)
