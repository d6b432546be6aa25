"""Text scalars: Column -> Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it. Needed inside lambdas of array functions,
    where Spark finds no common subexpressions. It is the end of a fold over nothing, because Spark copies all that the
    function of a transform returns, arrays and rows with all of their parts."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def dealt(d: DataFrame, *keys: str) -> DataFrame:
    """d by keys, in as many partitions as the session shuffles to. Scores and merging are much work on few bytes, so
    partitions that Spark would put together for their size are kept apart; joins and groups on these keys shuffle no more."""
    return d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def kept(value: Column, test: Column) -> Column:
    """A generator that gives value if test holds, else no row. value and test should name columns that are there
    already: other than a filter, it is never pushed below the projection that works them out, which would put all of
    their expression in place of every mention."""
    return F.explode(F.when(test, F.array(value)))


def trimmed(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def collapsed(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return trimmed(F.regexp_replace(x, r"(?U)\s+", " "))


def normalized(x: Column) -> Column:
    """No-break spaces, tabs and blanks as one blank, line ends as \\n, none at the ends."""
    x = F.regexp_replace(F.regexp_replace(x, " ", " "), r"[ \t]+", " ")
    return trimmed(F.regexp_replace(x, "\r\n", "\n"))


def letters(x: Column) -> Column:
    """Only A-Z, in capitals."""
    return F.upper(F.regexp_replace(x, "[^A-Za-z]", ""))


def letter_set(x: Column) -> Column:
    """The letters of a text of A-Z as bits of an integer; none of null."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1), F.ascii(c) - 65)
    return F.coalesce(F.aggregate(F.split(x, ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise(s.bitwiseOR(bit(c)))), F.lit(0))


def words(x: Column) -> Column:
    """Split at white space, without empty parts."""
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def name_words(x: Column) -> Column:
    """Runs of two or more letters, in capitals; dots and underscores part words."""
    return F.filter(F.split(F.upper(x), "[^A-Z]+"), lambda w: F.char_length(w) >= 2)


def at(array: Column, i: Column | int) -> Column:
    """Element i, from 0, or null outside."""
    return F.get(array, F.lit(i) if isinstance(i, int) else i)


def ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / greater length; 0 if either is empty."""
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b)))


def cleaned_line(x: Column) -> Column:
    """A read line in capitals: brackets and bars are blanks, a dot or underscore before two letters is a comma, commas
    before letters are followed by a blank."""
    x = F.regexp_replace(x, r"[\[\]{}()|]", " ")
    x = F.regexp_replace(x, r"[._](?=[A-Za-z]{2,})", ", ")
    x = F.regexp_replace(x, r",(?=[A-Za-z])", ", ")
    return F.upper(trimmed(F.regexp_replace(x, r"[ \t]+", " ")))


def percent(part: Column, whole: Column) -> Column:
    """Part of whole in per cent, rounded to a whole number; 0% of nothing."""
    return F.concat(F.when(whole == 0, F.lit(0)).otherwise(F.round(100 * part / whole)).cast("int").cast("string"), F.lit("%"))
