"""Classes of tokens and the recognition of person names: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import codes, money
from .text import at, cleaned_line, collapsed, let, letters, trimmed, words

# Patterns and words of the documents that are read.
NAME = r"^[A-Z][A-Z'./ -]+,\s+[A-Z][A-Z'./ -]*\z"
PERIOD = r"^\d{2}/\d{4}\z"
LABEL_LINE = r"(?i)^(name|family count|medicare|subscriber|coverage|status|medical plan|medical current|retro activity|period|code|amount|total due|subtotal|membership detail|current coverage month|any activity processed|page \d+ of|kaiser|consolidated billing|statement id|invoice date|bill period|n/a)\z"
TOTAL_LINE = r"(?i)^(subtotal|total (current|retro|charges|due))"
NO_NAME = r"(?i)DETAIL|GROUP|KAISER|PAGE|SUBTOTAL|MEMBERSHIP|BILLING|PERMANENTE|SACRAMENTO|EMPLOYEE|COVERAGE|STATUS|MEDICAL|LEGEND|ACTIVITY|PLEASE|BALANCE|PAYMENT|AMOUNT|PREVIOUS|ACCOUNTS|INCLUDED|SUMMARY|CONSOLIDATED"
INVOICE_WORD = r"(?i)^(PLEASE|PAY|AMOUNT|BALANCE|BALA|NCE|EMPLO|YEE|EMPLOYEE|PREVIOUS|PAYMENT|TOTAL|DUE|ACCOUNTS|INCLUDED|SUMMARY|CURRENT|ACTIVITY|RETRO|STD)\z"
NON_MEMBER = r"^(NAME|FAMILY COUNT|SUBTOTAL|TOTAL |PAGE |N/A|NA|MEMBERSHIP DETAIL|CURRENT COVERAGE|STD\b)"
VOWEL = "(?i)[AEIOUY]"


def coverage(token: Column) -> Column:
    return codes.lookup(codes.COVERAGE_READ, letters(token))


def status(token: Column) -> Column:
    return codes.lookup(codes.STATUS_READ, letters(token))


def plan(token: Column) -> Column:
    """The plan a token stands for, or null: the same letters, a worn DHMO, or one edit away from a plan of four letters
    or more; MEDICAL itself is the code of another column."""
    return F.when(~token.rlike(r"[$\d]"), let(letters(token), _plan))


def _plan(t: Column) -> Column:
    """plan of a token without digits and $, from its letters."""
    squeezed = {p.replace(" ", ""): p for p in codes.PLANS}
    # a set of literals is looked up at once, a map key by key
    known = F.when(t.isin([k for k, p in squeezed.items() if k == p]), t)
    for k, p in squeezed.items():
        known = known.when(t == k, p) if k != p else known

    def read(n: Column) -> Column:
        marks = sum(t.contains(c).cast("int") for c in "DHMO")
        near = {i: [F.lit(k) for k in squeezed if len(k) >= 4 and abs(len(k) - i) <= 1] for i in range(4, 11)}
        near_plans = F.when(F.lit(False), F.array().cast("array<string>"))
        for i, plans in near.items():
            near_plans = near_plans.when(n == i, F.array(*plans)) if plans else near_plans
        close = at(F.filter(near_plans, lambda p: F.levenshtein(t, p, 1) >= 0), 0)
        return F.when(n.between(3, 10) & (t != "MEDICAL"), F.coalesce(known, F.when((n <= 5) & t.contains("M") & (marks >= 2), F.lit("DHMO")), F.when(n >= 4, codes.lookup(squeezed, close))))

    return let(F.char_length(t), read)


def subscriber_id(token: Column) -> Column:
    t = F.upper(token)
    return t.contains("XX") & ((t.rlike("X{2,}") & t.rlike(r"\d")) | t.rlike(r"X{2,3}[-.\s]?X{2}") | t.rlike(r"^\d{0,3}X{2,}"))


def family_count(token: Column) -> Column:
    """1 or 2 digits, maybe after a letter that was read for a line; 20 at most."""
    n = F.when(token.rlike(r"^[A-Z]?\d{1,2}\z"), F.regexp_extract(token, r"(\d{1,2})\z", 1).cast("int"))
    return F.when(n <= 20, n)


def yes_no(token: Column) -> Column:
    return letters(token).isin("N", "Y")


def is_name(value: Column) -> Column:
    """Whether a text is LAST, FIRST of a person."""

    def parts(v: Column) -> Column:
        last, first = trimmed(F.substring_index(v, ",", 1)), trimmed(F.substring_index(v, ",", -1))
        return F.struct(last.alias("last"), letters(last).alias("letters"), at(F.split(first, r"\s+"), 0).alias("first"), F.filter(F.split(v, r"[\s,]+"), lambda p: p != "").alias("all"))

    def fits(p: Column) -> Column:
        short = F.size(F.filter(p["all"], lambda x: F.char_length(letters(x)) <= 2))
        return (
            (F.char_length(p["letters"]) >= 3) & p["letters"].rlike(VOWEL) & (F.char_length(letters(p["first"])) >= 2)
            & ~p["letters"].isin("E", "ES", "ED", "ESD", "EA", "EE", "NA")
            & ~((F.size(p["all"]) >= 3) & (short / F.size(p["all"]) >= 0.6)) & (F.size(F.split(p["last"], " ")) <= 4)
        )

    shaped = lambda v: F.char_length(v).between(7, 70) & v.rlike(NAME) & ~v.rlike(NO_NAME)
    # nothing else is looked at where there is no comma, or nothing after it
    return F.when(value.contains(",") & ~value.endswith(","), let(collapsed(value), lambda v: F.when(shaped(v), let(parts(v), fits)).otherwise(F.lit(False)))).otherwise(F.lit(False))


def junk_name(name: Column) -> Column:
    """Whether a name is a label, a subtotal or a code that was taken for one."""
    first_word = lambda x: at(F.split(trimmed(x), r"\s+"), 0)

    def junk(n: Column) -> Column:
        after = F.when(n.contains(","), F.substring_index(F.substring_index(n, ",", 2), ",", -1)).otherwise(F.lit(""))
        return (
            n.isin("N/A", "NA", "N / A") | n.startswith("SUBTOTAL") | n.startswith("STD") | n.rlike(r"\b(DHMO|MEDICAL|SUBTOTAL|PAGE|ESD|ESP)\b")
            | first_word(F.substring_index(n, ",", 1)).rlike(INVOICE_WORD) | first_word(after).rlike(INVOICE_WORD)
        )

    return let(F.upper(trimmed(name)), junk)


def non_member_label(name: Column) -> Column:
    return F.upper(trimmed(name)).rlike(NON_MEMBER)


def name_word(token: Column, least: int) -> Column:
    return (F.char_length(letters(token)) >= least) & letters(token).rlike(VOWEL)


def unfused(token: Column) -> Column:
    """LAST, FIRST from one token without comma or blank, cut where lengths look most like names; null if no cut does."""

    def best(t: Column) -> Column:
        n = F.char_length(t)

        def cut(i: Column) -> Column:
            last, first = F.substring(t, F.lit(1), i), F.substring(t, i + 1, n)
            score = -F.abs(i - 6) - F.abs(F.least(n - i, F.lit(8)) - 5) + F.when(i.between(5, 8), 2).otherwise(0) + F.when(first.rlike("^[BCDFGHJKLMNPQRSTVWXYZ]"), 1).otherwise(0)
            return F.struct(score.alias("score"), (-i).alias("at"), F.concat(last, F.lit(", "), first).alias("name"), (n - i).alias("rest"))

        cuts = F.sequence(F.lit(4), F.least(F.lit(12), n - 3))
        return F.when(n.between(7, 22), F.array_max(F.filter(F.transform(cuts, cut), lambda c: (c["rest"] <= 12) & is_name(c["name"])))["name"])

    return F.when(~token.rlike(r"[$,\d]") & ~subscriber_id(token), let(F.regexp_replace(F.upper(token), "[^A-Z'-]", ""), best))


def comma_put(line: Column) -> Column:
    """A line whose first three tokens hold no comma gets one after the last name, if it starts with a name; else null."""

    def found(t: Column) -> Column:
        head, rest = at(t, 0), F.array_join(F.slice(t, 2, F.greatest(F.size(t), F.lit(1))), " ")
        two = (F.size(t) >= 2) & name_word(head, 4) & name_word(at(t, 1), 3)
        return F.when(~F.array_join(F.slice(t, 1, 3), " ").contains(","), F.when(two, F.concat(head, F.lit(", "), rest)).otherwise(trimmed(F.concat(unfused(head), F.lit(" "), rest))))

    return let(words(line), found)


def with_comma(line: Column) -> Column:
    """comma_put of a line, or the line."""
    return let(line, lambda x: F.coalesce(comma_put(x), x))


def parted(line: Column) -> Column:
    """Tokens of a cleaned line, amounts set apart."""
    return words(F.regexp_replace(line, r"(\$?-?[\d,]+\.\d{2})", " $1 "))


def tokens(line: Column) -> Column:
    """Tokens of a read line, amounts set apart."""
    return parted(with_comma(cleaned_line(line)))


def classes(token: Column) -> Column:
    """All classes of one token, each read once; stop: it cannot be part of a name."""
    first = F.struct(letters(token).alias("w"), token.rlike(r"\d").alias("digit"))
    code = lambda table, w: F.when(w != "", F.when(F.char_length(w) <= max(map(len, table)), codes.lookup(table, w)))

    def read(x: Column) -> Column:
        """What holds digits is no plan, and what holds none is neither a count, an amount nor a period."""
        w, digit = x["w"], x["digit"]
        return F.struct(
            w.alias("w"), F.when(digit, family_count(token)).alias("family"), subscriber_id(token).alias("id"), code(codes.COVERAGE_READ, w).alias("coverage"), code(codes.STATUS_READ, w).alias("status"),
            F.when(~digit & ~token.contains("$"), _plan(w)).alias("plan"), F.when(digit, money.extracted(token)).alias("amount"), (digit & token.rlike(PERIOD)).alias("period"))

    def cell(r: Column) -> Column:
        w, n, yn = r["w"], F.char_length(r["w"]), r["w"].isin("N", "Y")
        first_name = (n >= 4) & w.rlike(VOWEL) & ~w.contains("O") & ~w.startswith("DH") & (w != "HMO")
        stop = r["family"].isNotNull() | yn | r["id"] | r["amount"].isNotNull() | r["period"] | ((n >= 2) & (r["coverage"].isNotNull() | (r["plan"].isNotNull() & ~first_name)))
        return F.struct(
            token.alias("t"), n.alias("n"), r["family"].alias("family"), yn.alias("yn"), r["id"].alias("id"), r["coverage"].alias("coverage"), r["status"].alias("status"),
            r["plan"].alias("plan"), r["amount"].alias("amount"), (r["period"] | ((w == "MEDICAL") & token.rlike(r"(?i)^MEDICAL\z"))).alias("other_month"), stop.alias("stop"))

    return let(let(first, read), cell)


def shape_score(name: Column) -> Column:
    """How much the part after the comma looks like given names."""

    def score(w: Column) -> Column:
        n, size = F.size(w), lambda i: F.char_length(letters(at(w, i)))
        return (
            F.when((n == 2) & (size(1) <= 2), 20).when((n == 2) & at(w, 1).rlike(VOWEL) & (size(1) <= 8), 18)
            .when(n == 1, 16).when((n == 3) & (size(2) <= 2), 15).otherwise(F.greatest(F.lit(0), 5 - n))
        )

    return let(words(F.substring_index(name, ",", -1)), score)


def leading_name(cells: Column) -> Column:
    """The name at the start of classified tokens (see classes), as struct of name and n (its tokens), or null.

    Up to six tokens before the first stop are looked at. Long last tokens are dropped while what stays is a name; of the
    beginnings that are names, the best shape wins, then the shorter."""
    first = F.slice(cells, 1, 6)
    head = F.struct(first["t"].alias("t"), first["n"].alias("n"), F.array_position(F.slice(first["stop"], 2, 5), True).cast("int").alias("stop"))

    def options(h: Column) -> Column:
        """Each beginning: its text, whether it is a name, letters of its last token."""
        most = F.when(h["stop"] == 0, F.size(h["t"])).otherwise(h["stop"])
        option = lambda k, text: F.struct(text.alias("text"), is_name(text).alias("ok"), at(h["n"], k - 1).alias("n"))
        return F.transform(F.sequence(F.lit(1), most), lambda k: let(F.array_join(F.slice(h["t"], 1, k), " "), lambda text: option(k, text)))

    def best(o: Column) -> Column:
        shorter = lambda k, _: F.when((k >= 3) & (at(o, k - 1)["n"] >= 3) & at(o, k - 2)["ok"], k - 1).otherwise(k)
        kept = F.aggregate(F.array(*(F.lit(i) for i in range(4))), F.size(o), shorter)
        scored = lambda k: F.transform(F.slice(o, 2, F.greatest(k - 1, F.lit(0))), lambda x, i: F.when(x["ok"], F.struct(shape_score(x["text"]).alias("score"), (-i - 2).alias("less"), collapsed(x["text"]).alias("name"))))
        return F.array_max(let(kept, scored))

    found = F.when(F.size(cells) >= 2, let(let(head, options), best))
    return let(found, lambda b: F.when(b.isNotNull(), F.struct(b["name"].alias("name"), (-b["less"]).alias("n"))))


def can_begin(cells: Column, i: Column) -> Column:
    """Whether leading_name can find a name at the i-th token (from 0): it needs two tokens or more, none but the first a
    stop, and a letter at its beginning."""
    return (i + 1 < F.size(cells)) & ~F.coalesce(at(cells, i + 1)["stop"], F.lit(False)) & at(cells, i)["t"].rlike("^[A-Za-z]")


def starts(cells: Column) -> Column:
    """The places where a name can begin: those of can_begin with a comma in one of their first five tokens and no stop up
    to it."""
    is_comma = lambda i: at(cells, i)["t"].contains(",")
    commas = F.filter(F.sequence(F.lit(0), F.greatest(F.size(cells) - 1, F.lit(0))), is_comma)
    free = lambda i, p: ~F.exists(F.slice(cells, i + 2, p - i), lambda c: c["stop"])
    before = lambda p: F.filter(F.sequence(F.greatest(p - 4, F.lit(0)), p), lambda i: can_begin(cells, i) & free(i, p))
    return F.array_distinct(F.flatten(F.transform(commas, before)))


def person_like(value: Column) -> Column:
    """Whether a cell of a list looks like a person: LAST, FIRST or two words."""
    v = collapsed(value)
    return F.char_length(v).between(5, 80) & ~v.rlike(r"(?i)^(file name|bill period|statement id|name|family count)\z") & v.rlike("[A-Za-z]{3,}") & (v.rlike(r"[A-Za-z].*,\s*[A-Za-z]") | (F.size(F.split(v, " ")) >= 2))


def roster_form(value: Column) -> Column:
    """LAST, FIRST in capitals; null without a comma or with a part under two characters."""
    v = F.upper(collapsed(value))
    comma = F.instr(v, ",")
    last, first = trimmed(F.substring(v, F.lit(1), comma - 1)), trimmed(F.substring(v, comma + 1, F.char_length(v)))
    return F.when((F.char_length(v) >= 5) & (comma >= 3) & (F.char_length(last) >= 2) & (F.char_length(first) >= 2), F.concat(last, F.lit(", "), first))


def roster_name(value: Column) -> Column:
    return F.coalesce(roster_form(value), F.upper(collapsed(value)))
