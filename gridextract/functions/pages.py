"""What a page is, from its text: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import letters, let, trimmed

# Phrases of the documents that are read, and bounds.
HEADING = r"(?i)Membership Detail"
LEGEND = r"(?i)Medical Plan Legend|Coverage Type|Employee Only"
USEFUL = r"(?i)Membership Detail for Group ID|Family Count|Medical current charge"
COVER = r"(?i)Consolidated Billing|Payment Summary|About Your Bill|Please pay this Amount|Total Amount Due|Medical Plan Legend"
OVERFLOW = r"(?i)Bill Group ID\s*7001|Subtotal for Bill Group|Page\s*4\s*of"
SUBSCRIBER = r"[A-Z]{4,}\s*,\s*[A-Z]{3,}"
FEW_LETTERS, BLANK_INK = 80, 0.004
FULL_NAMES, OVERFLOW_NAMES = 8, 6


def _flat(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def needs_ocr(text: Column) -> Column:
    """Fewer letters in the embedded text than a page has."""
    return F.char_length(letters(text)) < FEW_LETTERS


def is_blank(ink: Column) -> Column:
    return ink < BLANK_INK


def looks_useful(text: Column) -> Column:
    return text.rlike(USEFUL)


def looks_readable(text: Column) -> Column:
    return (F.char_length(letters(text)) >= 120) & (F.regexp_count(text, F.lit("[A-Za-z]{4,}")) >= 8)


def try_more_orientations(text: Column) -> Column:
    """Whether a page should be read turned as well: it has no heading and is no readable cover page."""
    return ~looks_useful(text) & ~(looks_readable(text) & text.rlike(COVER))


def read_score(text: Column) -> Column:
    """How good a reading of a page is; -1 for none."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    score = F.when(text.rlike(HEADING), 100).otherwise(0) + 4 * (count(r"\$[\d,]*\.\d{2}") + count(r"\$\d{3,}")) + 3 * count(SUBSCRIBER)
    return F.when(trimmed(text) == "", -1).otherwise(score)


def best_text(texts: Column) -> Column:
    """The best of several readings of a page, the first of equal ones."""
    scored = F.transform(texts, lambda t, i: F.struct(read_score(t).alias("score"), (-i).alias("i"), t.alias("t")))
    return F.array_max(scored)["t"]


def merged_text(texts: Column) -> Column:
    """Readings that are not blank, one after the other."""
    return F.array_join(F.filter(texts, lambda t: trimmed(t) != ""), "\n")


def is_legend(text: Column) -> Column:
    return let(_flat(text), lambda t: ~t.rlike(HEADING) & t.rlike(LEGEND))


def is_detail(text: Column) -> Column:
    """The heading of the table, or all three of its column labels."""
    labels = lambda t: t.rlike(r"(?i)\bName\b") & t.rlike("(?i)Family Count") & t.rlike("(?i)Medical current charge")
    return let(_flat(text), lambda t: ~(~t.rlike(HEADING) & t.rlike(LEGEND)) & (t.rlike(HEADING) | labels(t)))


def subscriber_names(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SUBSCRIBER))


def is_overflow(text: Column) -> Column:
    """A page with the last few rows of a table and its totals."""
    return (subscriber_names(text) <= OVERFLOW_NAMES) & text.rlike(OVERFLOW)


def is_full_table(text: Column) -> Column:
    return ~is_legend(text) & ~is_overflow(text) & ((subscriber_names(text) >= FULL_NAMES) | is_detail(text))


def page_kind(text: Column) -> Column:
    """legend, full, overflow or other."""
    return F.when(is_legend(text), "legend").when(is_full_table(text), "full").when(is_overflow(text), "overflow").otherwise("other")
