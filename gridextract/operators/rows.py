"""Typed rows from the text of pages: table functions over page_text(file_name, page, text)."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridextract.functions import money, names
from gridextract.functions.text import at, cleaned_line, dealt, kept, let, normalized, trimmed, words

KEYS = ("file_name", "page")
FIELDS = ("name", "family_count", "coverage", "status", "medical_plan", "charge", "flags")
OTHER_MONTH = r"(?i)MEDICAL|\d{2}/\d{4}"
#: Tokens after a name that its row can take in a stream of tokens, and how many of them the next search skips.
STREAM_REST, STREAM_SKIP = 16, 4


def _first(cells: Column, start: Column, test: Callable[[Column], Column]) -> Column:
    """Index of the first cell from start on that passes the test, else the number of cells."""
    hit = F.array_position(F.transform(F.slice(cells, start + 1, F.size(cells)), test), True).cast("int")
    return let(hit, lambda p: F.when(p == 0, F.size(cells)).otherwise(start + p - 1))


def _later(cells: Column, start: Column, k: int, field: str) -> Column:
    """First value of a field in the k cells from start on."""
    return at(F.filter(F.slice(cells, start + 1, k)[field], lambda x: x.isNotNull()), 0)


def _heads(cells: Column) -> Column:
    """Of each cell, whether it and the next one are a name, with the comma at the end of the first."""
    t = cells["t"]
    return F.zip_with(t, F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: a.endswith(",") & names.is_name(F.concat_ws(" ", a, b)))


def _until_name(cells: Column, heads: Column, n: Column) -> Column:
    """How many cells after the first n come before the next name, STREAM_REST at most. heads: those of the cells (see _heads).
    A name is seen if both of its cells are there."""
    end = F.least(F.size(cells), n + STREAM_REST)
    next_name = F.array_position(F.slice(heads, n + 1, F.least(F.lit(STREAM_REST), 5 + STREAM_REST - n)), True).cast("int")
    return let(next_name, lambda p: F.when(p == 0, end - n).otherwise(p - 1))


def _has_code(c: Column) -> Column:
    return c["coverage"].isNotNull() | c["status"].isNotNull() | c["plan"].isNotNull() | c["amount"].isNotNull()


def row_of(cells: Column, raw: Column, *, heads: Column | None = None) -> Column:
    """The row that classified tokens (see names.classes) make up, as struct of name_tokens, FIELDS and own (there are amounts
    among its tokens), or null if they make up none that is usable. raw: the line itself, or '' where there is none; heads: where tokens run on into other rows,
    where names begin (see _heads); it takes STREAM_REST tokens after its own at most, and none from the next name on.

    After the name a cursor moves forward only: family count, Y or N, masked id, coverage, status, plan, amounts up to the
    first mark of another month. A status or plan that is not at its place is looked for in the next tokens."""

    def codes(c: Column, i: Column, family: Column, name: Column) -> Column:
        """From the place after the family count on."""
        skip = lambda i, field: i + F.when(F.coalesce(at(c, i)[field], F.lit(False)), 1).otherwise(0)
        past = lambda i, field: i + F.when(at(c, i)[field].isNotNull(), 1).otherwise(0)
        start = let(let(skip(i, "yn"), lambda i: skip(i, "id")), lambda i: _first(c, i, _has_code))
        cover = lambda i: F.struct(F.coalesce(at(c, i)["coverage"], F.lit("")).alias("coverage"), past(i, "coverage").alias("i"))
        state = lambda s: F.struct(s["coverage"].alias("coverage"), F.coalesce(at(c, s["i"])["status"], _later(c, s["i"], 6, "status"), F.lit("")).alias("status"), past(s["i"], "status").alias("i"))
        two = lambda i: names.plan(F.concat(at(c, i)["t"], F.coalesce(at(c, i + 1)["t"], F.lit(""))))

        def planned(s: Column) -> Column:
            found = F.struct(two(s["i"]).alias("two"), at(c, s["i"])["plan"].alias("one"))
            next_i = lambda f: s["i"] + F.when(f["two"].isNotNull(), 2).when(f["one"].isNotNull(), 1).otherwise(0)
            return let(found, lambda f: F.struct(s["coverage"].alias("coverage"), s["status"].alias("status"), F.coalesce(f["two"], f["one"]).alias("plan"), next_i(f).alias("i")))

        def charged(s: Column) -> Column:
            end = _first(c, s["i"], lambda x: x["other_month"])
            own = lambda end: F.filter(F.slice(c, s["i"] + 1, F.greatest(F.lit(0), end - s["i"]))["amount"], lambda x: x.isNotNull())
            head = F.regexp_extract(raw, r"(?is)^(.*?)(?:MEDICAL|\d{2}/\d{4}|\z)", 1)
            amounts = lambda a: F.when((F.size(a) == 0) & (raw != ""), money.in_line(head)).otherwise(a)
            paid = lambda end, a: F.struct((F.size(a) > 0).alias("own"), money.current_charge(amounts(a), s["status"], (end < F.size(c)) | raw.rlike(OTHER_MONTH)).alias("charge"))
            charge = let(end, lambda end: let(own(end), lambda a: paid(end, a)))
            return finished(F.struct(name["n"].alias("name_tokens"), name["name"].alias("name"), family.alias("family_count"), s["coverage"].alias("coverage"), s["status"].alias("status"), F.coalesce(s["plan"], _later(c, s["i"], 8, "plan"), F.lit("")).alias("medical_plan"), charge.alias("paid")))

        return let(let(let(let(start, cover), state), planned), charged)

    def finished(row: Column) -> Column:
        def flagged(r: Column) -> Column:
            charge = r["paid"]["charge"]
            flags = missing_flags(r["coverage"], r["status"], r["medical_plan"], charge, r["family_count"])
            some_code = F.concat(r["coverage"], r["status"], r["medical_plan"]) != ""
            fields = F.struct(*(r[f].alias(f) for f in ("name_tokens", *FIELDS[:-2])), charge.alias("charge"), flags.alias("flags"), r["paid"]["own"].alias("own"))
            return F.when(charge.isNotNull() | (r["family_count"].isNotNull() & some_code), fields)

        return let(row, flagged)

    def named(name: Column) -> Column:
        tail = F.slice(cells, name["n"] + 1, F.size(cells) if heads is None else _until_name(cells, heads, name["n"]))
        first = lambda c: _first(c, F.lit(0), lambda x: x["family"].isNotNull() | x["id"] | _has_code(x))
        family = lambda c, i: let(at(c, i)["family"], lambda f: codes(c, i + F.when(f.isNotNull(), 1).otherwise(0), f, name))
        return F.when(name.isNotNull() & ~names.junk_name(name["name"]), let(tail, lambda c: let(first(c), lambda i: family(c, i))))

    return let(names.leading_name(cells), named)


def missing_flags(coverage: Column, status: Column, plan: Column, charge: Column, family: Column) -> Column:
    # The flags and their order.
    flags = F.array(
        F.when(coverage == "", "Missing coverage"), F.when(status == "", "Missing status"), F.when(plan == "", "Missing medical plan"),
        F.when(charge.isNull(), "Missing medical current charge"), F.when(family.isNull(), "Missing family count"))
    return F.filter(flags, lambda x: x.isNotNull())


def _cleaned(text: Column) -> Column:
    """The lines of a page, cleaned."""
    return F.transform(F.split(normalized(F.coalesce(text, F.lit(""))), "\n"), lambda x: money.glued(trimmed(x)))


def _told(line: Column) -> Column:
    """Whether a line is neither blank nor a column label."""
    return (line != "") & ~line.rlike(names.LABEL_LINE)


def text_lines(page_text: DataFrame) -> DataFrame:
    """file_name, page, line_no, line: the lines of pages, without blank ones and column labels."""
    # cleaned before they are rows: a filter on a line would be worked out from all of its expression, each time it names it
    lines = page_text.select(*KEYS, F.posexplode(_cleaned(F.col("text"))).alias("line_no", "line"))
    return lines.where(_told(F.col("line")))


def line_rows(lines: DataFrame) -> DataFrame:
    """A row for each line that holds one; lines of totals hold none."""
    d = lines.where(~F.col("line").rlike(names.TOTAL_LINE)).select(*KEYS, "line_no", "line", F.transform(names.tokens(F.col("line")), names.classes).alias("cells"))
    d = d.select(*KEYS, "line_no", row_of(F.col("cells"), F.col("line")).alias("r"))
    d = d.select(*KEYS, "line_no", kept(F.col("r"), F.col("r").isNotNull()).alias("r"))
    return d.select(*KEYS, F.lit(0).alias("pass"), F.col("line_no").alias("ord"), *(f"r.{f}" for f in FIELDS))


def _own(x: Column, i: Column) -> Column:
    """What a row that begins at the i-th token can look at."""
    return F.slice(x, i + 1, 6 + STREAM_REST)


def _stream(cells: Column, heads: Column, starts: Column, known: Column | None = None) -> Column:
    """The rows of a stream of classified tokens, as structs of ord (the place of their first token) and r. Every place where
    a name can begin is tried by itself; of the rows that are found, one that starts before the end of the row before it (its
    name and four tokens) is left out. heads, starts: of the cells (_heads, names.starts). known: at the places of the cells, n and r of a line whose n tokens begin there and, if
    a row takes these and no more, make up r; else null."""

    def row(x: Column, i: Column) -> Column:
        tried = lambda: let(_own(x["cells"], i), lambda c: row_of(c, F.lit(""), heads=_own(x["heads"], i)))
        if known is None:
            return tried()

        def ends(k: Column) -> Column:
            """Whether the row takes the tokens of the line: the next name begins where the line ends, or the page ends there.
            Both must lie where _until_name sees them."""
            n, own = k["n"], k["r"]["name_tokens"]
            name = F.array_position(F.slice(x["heads"], i + own + 1, n - own + 1), True)
            return (n <= own + STREAM_REST - 1) & (n <= 4 + STREAM_REST) & let(name, lambda p: (p == n - own + 1) | ((p == 0) & (i + n == F.size(x["cells"]))))

        return let(F.get(x["known"], i), lambda k: F.when(k.isNotNull() & ends(k), k["r"]).otherwise(tried()))

    def taken(rows: Column) -> Column:
        """The places of those that are not left out."""
        state = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("kept"))
        step = lambda s, x: F.when(x["ord"] >= s["next"], F.struct((x["ord"] + x["r"]["name_tokens"] + STREAM_SKIP).alias("next"), F.concat(s["kept"], F.array(x["ord"])).alias("kept"))).otherwise(s)
        return let(F.aggregate(rows, state, step, lambda s: s["kept"]), lambda kept: F.filter(rows, lambda x: F.array_contains(kept, x["ord"])))

    parts = {"cells": cells, "heads": heads, "starts": starts} | ({} if known is None else {"known": known})
    found = lambda x: F.transform(x["starts"], lambda i: F.struct(i.alias("ord"), row(x, i).alias("r")))
    rows = let(F.struct(*(c.alias(n) for n, c in parts.items())), lambda x: F.array_sort(F.filter(found(x), lambda f: f["r"].isNotNull())))
    return let(rows, taken)


def stream_rows(lines: DataFrame) -> DataFrame:
    """Rows that run over line ends: the lines of a page as one stream of tokens (see _stream)."""
    whole = lines.groupBy(*KEYS).agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"], " ").alias("line"))
    whole = whole.select(*KEYS, F.transform(names.tokens(F.col("line")), names.classes).alias("cells"))
    whole = whole.select(*KEYS, "cells", _heads(F.col("cells")).alias("heads"), names.starts(F.col("cells")).alias("starts"))
    d = whole.select(*KEYS, F.explode(_stream(F.col("cells"), F.col("heads"), F.col("starts"))).alias("k"))
    return d.select(*KEYS, F.lit(1).alias("pass"), "k.ord", *(f"k.r.{f}" for f in FIELDS))


def _read(x: Column) -> Column:
    """A line (line_no, line) with its classified tokens as the stream has them (cells; with_comma, at the beginning of a page)."""

    def read(v: Column) -> Column:
        comma = let(names.comma_put(v), lambda put: F.when(put.isNotNull(), F.transform(names.parted(put), names.classes)))
        return F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), F.transform(names.parted(v), names.classes).alias("cells"), comma.alias("with_comma"), F.size(words(v)).alias("n_words"))

    return let(cleaned_line(x["line"]), read)


def _told_row(x: Column) -> Column:
    """A line of _read with its row r and whether a stream that takes its tokens and no more would find the same row (same)."""

    def result(r: Column) -> Column:
        stops = F.exists(F.slice(x["cells"], 2, 5), lambda cell: cell["stop"])
        other_month = x["line"].rlike(OTHER_MONTH) | F.exists(x["cells"], lambda cell: cell["other_month"])
        same = r.isNotNull() & x["with_comma"].isNull() & F.coalesce(r["own"] & stops & ~other_month, F.lit(False))
        return F.struct(*(x[f].alias(f) for f in ("line_no", "line", "cells", "with_comma", "n_words")), r.alias("r"), same.alias("same"))

    own = let(F.coalesce(x["with_comma"], x["cells"]), lambda cells: row_of(cells, x["line"]))
    return let(F.when(~x["line"].rlike(names.TOTAL_LINE), own), result)


def _streamed(d: Column) -> Column:
    """The stream of the lines of a page (see _told_row), as struct of cells and known (see _stream)."""
    first = F.get(d, F.lit(0))
    row = lambda x, fits: F.when(fits, F.struct(F.size(x["cells"]).alias("n"), x["r"].alias("r")))
    begun = lambda x, j: F.when((j == 0) & x["with_comma"].isNotNull(), x["with_comma"]).otherwise(x["cells"])
    # the first line may have other tokens than in the stream
    known = lambda x, j: let(F.struct(begun(x, j).alias("c"), (x["same"] & (j > 0)).alias("same")), lambda b: F.transform(b["c"], lambda _, i: row(x, b["same"] & (i == 0))))
    # tokens of lines are those of the whole page, unless blanks of other kinds were cut off, or its beginning is over several lines
    odd = (first["n_words"] < 3) | F.exists(d, lambda x: x["line"].rlike(r"(?U)[^\S\x00-\x7F]"))
    joined = F.transform(names.tokens(F.array_join(F.transform(d, lambda x: x["line"]), " ")), names.classes)
    of = lambda cells, known: F.struct(cells.alias("cells"), known.alias("known"))
    none = F.transform(F.array().cast("array<int>"), lambda _: row(first, F.lit(False)))
    return F.when(odd, of(joined, none)).otherwise(of(F.flatten(F.transform(d, begun)), F.flatten(F.transform(d, known))))


def _passes(own: Column, stream: Column) -> Column:
    """The rows of both passes, as structs of pass, ord and r."""
    shown = lambda n, x: F.struct(F.lit(n).alias("pass"), x["ord"].alias("ord"), F.struct(*(x["r"][f].alias(f) for f in FIELDS)).alias("r"))
    return F.concat(F.transform(own, lambda x: shown(0, x)), F.transform(stream, lambda x: shown(1, x)))


@lru_cache(maxsize=1)
def _page_steps(_context: SparkContext) -> tuple[dict[str, Column], ...]:
    """The columns of the steps of page_rows, each from those of the step before it. They take seconds to put together and are
    kept for one context."""
    cells, done = F.col("cells"), F.col("lines")
    own = F.transform(F.filter(done, lambda x: x["r"].isNotNull()), lambda x: F.struct(x["line_no"].alias("ord"), x["r"].alias("r")))
    return (
        {"lines": F.transform("lines", _read)},
        {"lines": F.transform("lines", _told_row)},
        {"own": own, "stream": _streamed(done)},
        {"own": F.col("own"), "cells": F.col("stream.cells"), "known": F.col("stream.known")},
        {"own": F.col("own"), "cells": cells, "known": F.col("known"), "heads": _heads(cells), "starts": names.starts(cells)},
        {"k": F.explode(_passes(F.col("own"), _stream(cells, F.col("heads"), F.col("starts"), F.col("known"))))},
    )


def page_rows(page_text: DataFrame) -> DataFrame:
    """Rows of both passes, in the order (file_name, page, pass, ord) in which dedupe takes them: those of line_rows and of
    stream_rows."""
    numbered = lambda t: F.filter(F.transform(_cleaned(t), lambda x, i: F.struct(i.alias("line_no"), x.alias("line"))), lambda x: _told(x["line"]))
    d = dealt(page_text, *KEYS).groupBy(*KEYS).agg(F.collect_list(F.coalesce("text", F.lit(""))).alias("texts"))
    d = d.select(*KEYS, F.array_sort(F.flatten(F.transform("texts", numbered))).alias("lines"))
    # tokens are read once for both passes, and the stream takes over rows of lines that it would find again
    for step in _page_steps(page_text.sparkSession.sparkContext):
        d = d.select(*KEYS, *(c.alias(n) for n, c in step.items()))
    return d.select(*KEYS, "k.pass", "k.ord", *(f"k.r.{f}" for f in FIELDS))
