"""Geometry of pages: lines from positioned words, bands and columns of tables, rows from ink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridextract.functions.pages import merged_text
from gridextract.functions.text import let, trimmed

# Columns of a table as shares of its width, and its place on a page.
COLUMNS = {"name": (0.004, 0.275), "codes": (0.25, 0.56), "amount": (0.54, 0.73)}
CROP = {"main": (0.008, 0.08, 0.984, 0.905), "overflow": (0.0, 0.03, 1.0, 0.955)}
#: Bands of a table, and of one that is lower than LOW of its width.
BANDS, LOW_BANDS, LOW = 6, 3, 0.55
BAND_OVERLAP, ROW_PAD, STRIP_PAD = 0.22, 0.18, 0.45
MIN_INK, MAX_GAP, DARK = 0.018, 3, 210


def group_lines(words: DataFrame, keys: list[str], *, share: float, least_height: float, descending: bool = False) -> DataFrame:
    """keys, lines: array (top to bottom) of arrays of the words of one line. words: keys, text, x, y (centre), h, and any
    other columns. A word joins the line before it if its centre lies within share * max(mean height, least_height) of
    the mean centre of that line. Words of a page are folded together in the order of their centres."""
    fields = [c for c in words.columns if c not in keys]
    y = -F.col("y") if descending else F.col("y")
    d = words.where(trimmed(F.col("text")) != "").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(y.alias("_y"), F.col("x").alias("_x"), F.struct(*fields).alias("w"))))["w"].alias("words"))
    word = d.schema["words"].dataType.elementType.simpleString()
    empty = F.array().cast(f"array<array<{word}>>")
    mean = lambda line, f: F.aggregate(line, F.lit(0.0), lambda s, w: s + w[f].cast("double")) / F.size(line)

    def add(lines: Column, w: Column) -> Column:
        last = F.get(lines, F.size(lines) - 1)
        near = lambda line: F.abs(w["y"] - mean(line, "y")) <= F.greatest(mean(line, "h"), F.lit(float(least_height))) * share
        joined = F.concat(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.concat(last, F.array(w))))
        return F.when((F.size(lines) > 0) & near(last), joined).otherwise(F.concat(lines, F.array(F.array(w))))

    return d.select(*keys, F.aggregate("words", empty, add).alias("lines"))


def line_text(line: Column) -> Column:
    """The words of a line from left to right."""
    parts = F.array_sort(F.transform(line, lambda w, i: F.struct(w["x"].alias("x"), i.alias("i"), w["text"].alias("t"))))["t"]
    return F.trim(F.regexp_replace(F.array_join(parts, " "), r"[ \t]+", " "))


def lines_from_items(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text: lines of the embedded text of a page (x, y upwards, h: columns of items; y may be null)."""
    placed = items.select(*keys, "text", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"), F.coalesce("h", F.lit(8.0)).alias("h"))
    d = group_lines(placed, keys, share=0.6, least_height=6, descending=True)
    return d.select(*keys, F.array_join(F.filter(F.transform("lines", line_text), lambda t: t != ""), "\n").alias("text"))


def boxed(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words with boxes (x0, y0, x1, y1) with the columns that group_lines needs."""
    return words.select(*keys, trimmed(F.col("text")).alias("text"), "x0", "y0", "x1", "y1", F.col("x0").alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), F.greatest(F.lit(1.0), F.col("y1") - F.col("y0")).alias("h"))


def word_rows(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lines: the rows of a table from the boxes of its words."""
    return group_lines(boxed(words, keys), keys, share=0.7, least_height=10)


def lines_from_words(words: DataFrame, keys: list[str]) -> DataFrame:
    return word_rows(words, keys).select(*keys, F.array_join(F.transform("lines", line_text), "\n").alias("text"))


def shifted(words: Column, top: Column) -> Column:
    """Boxes of a band moved to their place on the page; blank words left out."""
    moved = F.transform(words, lambda w: F.struct(trimmed(w["text"]).alias("text"), w["x0"].alias("x0"), (w["y0"] + top).alias("y0"), w["x1"].alias("x1"), (w["y1"] + top).alias("y1")))
    return F.filter(moved, lambda w: w["text"] != "")


def zip_columns(left: Column, right: Column) -> Column:
    """Two columns that were read apart, as lines. About equally long: line by line; else the next value goes to each line
    that has a word of four letters."""
    lines = lambda x: F.transform(F.split(x, "\n"), trimmed)
    ls = F.filter(lines(left), lambda x: F.char_length(x) > 2)
    rs = F.filter(lines(right), lambda x: x.rlike(r"\$|[\d,]+\.\d{2}|\d{3,}"))

    def joined(p: Column) -> Column:
        a, b = p["l"], p["r"]
        n = F.greatest(F.size(a), F.size(b))
        close = (F.size(b) > 0) & (F.abs(F.size(a) - F.size(b)) <= F.greatest(F.lit(4), F.floor(n * 0.4)))
        even = F.zip_with(a, b, lambda x, y: F.trim(F.concat(F.coalesce(x, F.lit("")), F.lit(" "), F.coalesce(y, F.lit("")))))
        is_row = lambda x: x.rlike("[A-Za-z]{4,}")
        nth = lambda i: F.size(F.filter(F.slice(a, 1, i), is_row))
        odd = F.transform(a, lambda x, i: F.when(is_row(x) & (nth(i) < F.size(b)), F.concat(x, F.lit(" "), F.get(b, nth(i)))).otherwise(x))
        return F.when(F.size(a) == 0, F.lit("")).otherwise(F.array_join(F.when(close, even).otherwise(odd), "\n"))

    return let(F.struct(ls.alias("l"), rs.alias("r")), joined)


def band_ranges(height: Column, bands: Column, overlap: float = BAND_OVERLAP) -> Column:
    """top and bottom of overlapping slices of a page."""
    n = F.greatest(F.lit(1), bands)
    step = F.lit(1.0) / n
    one = lambda i: F.struct(
        F.greatest(F.lit(0.0), (i * step - F.when(i == 0, F.lit(0.0)).otherwise(overlap * step)) * height).alias("top"),
        F.least(height.cast("double"), ((i + 1) * step + F.when(i == n - 1, F.lit(0.0)).otherwise(overlap * step)) * height).alias("bottom"))
    return F.transform(F.sequence(F.lit(0), n - 1), one)


def table_bands(tables: DataFrame, keys: list[str]) -> DataFrame:
    """keys, band, top, bottom: the overlapping slices in which a table is read (tables: keys, width, height): three where
    it is low, else six."""
    n = F.when(F.col("height") < F.col("width") * LOW, LOW_BANDS).otherwise(BANDS)
    return tables.select(*keys, F.posexplode(band_ranges(F.col("height"), n)).alias("band", "r")).select(*keys, "band", "r.top", "r.bottom")


def banded_scan(tables: DataFrame, keys: list[str], read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """keys, text, words: what is read from the slices of each table, from top to bottom. read: from table_bands() to the
    same rows with text and words (boxes in their slice); words are moved to their place on the table."""
    part = F.struct("band", "text", shifted(F.col("words"), F.col("top")).alias("words"))
    each = read(table_bands(tables, keys)).groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return each.select(*keys, merged_text(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit("")))).alias("text"), F.flatten(F.transform("parts", lambda p: p["words"])).alias("words"))


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def table_rect(width: Column, height: Column, role: Column) -> Column:
    """Where the table lies on a page."""
    part = lambda i: F.when(role == "overflow", F.lit(CROP["overflow"][i])).otherwise(F.lit(CROP["main"][i]))
    return rect(width * part(0), height * part(1), width * part(2), height * part(3))


def column_rect(row: Column, column: str) -> Column:
    left, right = COLUMNS[column]
    return rect(row["x"] + row["w"] * left, row["y"], row["w"] * (right - left), row["h"])


def padded(row: Column, table: Column, pad: float = ROW_PAD) -> Column:
    """A row with some space above and below it, inside its table."""
    y = F.greatest(table["y"], row["y"] - row["h"] * pad)
    bottom = F.least(table["y"] + table["h"], row["y"] + row["h"] + row["h"] * pad)
    return rect(row["x"], y, row["w"], F.greatest(F.lit(1.0), bottom - y))


def strip_rect(y0: Column, y1: Column, width: Column, height: Column) -> Column:
    """The strip of a table in which a row that was found lies."""
    pad = F.greatest(y1 - y0, F.lit(12.0)) * STRIP_PAD
    y = F.greatest(F.lit(0.0), y0 - pad)
    return rect(F.lit(0.0), y, width, F.greatest(F.lit(1.0), F.least(height, y1 + pad) - y))


def strip_crops(strip: Column) -> Column:
    return F.struct(*(column_rect(strip, c).alias(c) for c in COLUMNS))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column, pad: float = 8) -> Column:
    return (a0 < b1 + pad) & (b0 < a1 + pad)


def ink_profile(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, ink: share of dark pixels of each line of an image (pixels: keys, x, y, r, g, b)."""
    dark = (F.col("r") + F.col("g") + F.col("b")) / 3 < DARK
    return pixels.groupBy(*keys, "y").agg(F.avg(F.when(dark, 1.0).otherwise(0.0)).alias("ink"))


def ink_runs(profile: DataFrame, keys: list[str], *, min_ink: float = MIN_INK, max_gap: int = MAX_GAP) -> DataFrame:
    """keys, start, end (past the last line) of dark runs; runs max_gap lines apart or less are one."""
    order = Window.partitionBy(*keys).orderBy("y")
    on = profile.where(F.col("ink") >= min_ink)
    gap = F.col("y") - (F.lag("y").over(order) + 1) > max_gap
    on = on.withColumn("run", F.sum(F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0)).over(order))
    return on.groupBy(*keys, "run").agg(F.min("y").alias("start"), (F.max("y") + 1).alias("end")).drop("run")


def visual_rows(runs: DataFrame, heights: DataFrame, keys: list[str]) -> DataFrame:
    """Runs that can be rows: not thin against the (upper) median height, and not thin at the foot of the table.
    heights: keys, table_height."""
    h = F.col("end") - F.col("start")
    each = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(h)).alias("hs"))
    middle = each.select(*keys, F.get("hs", F.floor(F.size("hs") / 2).cast("int")).alias("m")).withColumn("median", F.when(F.col("m") == 0, 16).otherwise(F.col("m"))).drop("m")
    d = runs.join(middle, keys).join(heights, keys)
    thin = (h < F.greatest(F.lit(8.0), F.col("median") * 0.38)) | ((F.col("start") > F.col("table_height") * 0.97) & (h < F.col("median") * 0.8))
    return d.where(~thin).select(*keys, "start", "end")


def row_rects(runs: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row: the padded box of each run on its page (tables: keys, table)."""
    d = runs.join(tables, keys)
    t = F.col("table")
    local = rect(F.lit(0.0), F.lit(0.0), t["w"], t["h"])
    row = padded(rect(F.lit(0.0), F.col("start").cast("double"), t["w"], F.greatest(F.lit(1.0), (F.col("end") - F.col("start")).cast("double"))), local)
    return d.select(*keys, "start", let(row, lambda r: rect(t["x"] + r["x"], t["y"] + r["y"], r["w"], r["h"])).alias("row"))
