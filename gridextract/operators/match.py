"""One-to-one matching of read rows with a roster of known names, within each file.

roster(file_name, ord, name); members(file_name, row_index, name, ...). The file is an equality key of every join here, so
scores are worked out for the names of one file only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridextract.functions.text import dealt, kept, let, letter_set, letters, name_words, ratio, trimmed
from gridextract.operators.dedupe import completeness
from gridextract.sources.shared import once, working_tables

# Bounds of scores, flags.
MATCH, LEFTOVER, LEFTOVER_LAST, HINT = 0.58, 0.5, 0.88, 0.56
NOT_FOUND, ADDED = "Not found on this invoice", "Added row"
NO_CHARGE = "Missing medical current charge"


def _clean(name: Column) -> Column:
    return trimmed(F.regexp_replace(F.upper(name), "[._]", " "))


def _before(name: Column) -> Column:
    return F.substring_index(_clean(name), ",", 1)


def last_name(name: Column) -> Column:
    return letters(_before(name))


def first_name(name: Column) -> Column:
    c = _clean(name)
    comma = F.instr(c, ",")
    return F.when(comma > 0, letters(F.substring(c, comma + 1, F.char_length(c)))).otherwise(F.lit(""))


def last_name_guesses(name: Column) -> list[Column]:
    """What the last name of a noisy name may be: its last word, its last two words, all of it; null where it is none or
    one of those before."""
    w = name_words(_before(name))
    n = F.size(w)
    two = F.array_join(F.slice(w, F.greatest(n - 1, F.lit(1)), 2), "")
    one, all_ = F.when(n >= 1, F.element_at(w, -1)), last_name(name)
    said = F.coalesce(all_ == one, F.lit(False)) | (F.coalesce(n, F.lit(0)) >= 2) & F.coalesce(all_ == two, F.lit(False))
    return [F.when(F.char_length(x) >= 2, x) for x in (one, F.when(n >= 2, two), F.when(~said, all_))]


def known_parts(name: Column) -> Column:
    """What scores need of a known name: work it out once for a name, before any join."""
    return F.struct(last_name(name).alias("last"), first_name(name).alias("first"), letters(name).alias("all"))


def read_parts(name: Column) -> Column:
    """What scores need of a read name."""
    guesses = (x.alias(f"guess_{i}") for i, x in enumerate(last_name_guesses(name)))
    return F.struct(first_name(name).alias("first"), letters(name).alias("all"), *guesses)


def last_score(known: Column, read: Column) -> Column:
    """0 to 1: how well the last name of known_parts fits read_parts."""
    last, whole = known["last"], read["all"]
    n = F.char_length(last)

    def fit(guess: Column) -> Column:
        g = F.char_length(guess)
        inside = (n >= 4) & (F.contains(guess, last) | (F.contains(last, guess) & (g >= 5)))
        begins = (n >= 5) & (g >= 4) & (F.startswith(last, guess) | F.startswith(guess, F.substring(last, 1, 5)))
        return F.greatest(ratio(last, guess), F.when(inside, F.lit(0.9)), F.when(begins, F.lit(0.82)))

    top = F.greatest(F.lit(0.0), F.when((n >= 4) & F.contains(whole, last), F.lit(0.92)), *(fit(read[f"guess_{i}"]) for i in range(3)))
    # as a lambda: the code that Spark would generate for it is too long for the JVM to compile, and three times slower
    return F.when((n < 3) | (F.char_length(whole) < 3), F.lit(0.0)).otherwise(let(top, lambda x: x))


def pair_score(known: Column, read: Column, least: float = 0.0) -> Column:
    """match_score of known_parts and read_parts. A score that the last names alone keep under `least` may be given as 0,
    without a look at the rest."""
    k_last, k_first, r_first, k, r = known["last"], known["first"], read["first"], known["all"], read["all"]
    no_first = (r_first == "") & (F.char_length(k_last) >= 4)
    last = F.greatest(
        last_score(known, read), F.when(no_first & F.contains(r, k_last), F.lit(0.94)),
        F.when(no_first, ratio(k_last, F.substring(r, F.lit(1), F.char_length(k_last)))))
    n = F.least(F.lit(8), F.greatest(F.char_length(k_first), F.char_length(r_first), F.lit(1)))
    first = ratio(F.substring(k_first, F.lit(1), n), F.substring(r_first, F.lit(1), n))
    total = lambda x: x * F.lit(0.62) + first * F.lit(0.23) + ratio(k, r) * F.lit(0.15)
    none = (F.char_length(k) < 4) | (F.char_length(r) < 3)
    enough = lambda x: F.when(x * F.lit(0.62) + F.lit(0.23 + 0.15 + 1e-9) >= least, total(x)).otherwise(F.lit(0.0))
    return F.when(none, F.lit(0.0)).otherwise(let(last, enough))


def known_bits(known: Column) -> Column:
    """What score_bounds needs of known_parts: letters and lengths."""
    last, first = known["last"], F.substring(known["first"], 1, 8)
    sets = (letter_set(x).alias(n) for x, n in ((last, "last"), (F.substring(last, 1, 5), "begin"), (first, "first"), (known["all"], "all")))
    return F.struct(*sets, F.char_length(last).alias("n_last"), F.char_length(first).alias("n_first"), F.char_length(known["all"]).alias("n_all"))


def read_bits(read: Column) -> Column:
    """What score_bounds needs of read_parts."""
    first = F.substring(read["first"], 1, 8)
    sets = (letter_set(x).alias(n) for x, n in ((first, "first"), (read["all"], "all"), *((read[f"guess_{i}"], f"guess_{i}") for i in range(3))))
    return F.struct(*sets, *(F.char_length(read[f"guess_{i}"]).alias(f"n_{i}") for i in range(3)), F.char_length(first).alias("n_first"), F.char_length(read["all"]).alias("n_all"))


def score_bounds(k: Column, r: Column) -> tuple[Column, Column]:
    """What pair_score and last_score are at most, from known_bits and read_bits: an edit is needed for each letter that
    only one of two texts has, and a text that holds another one has all of its letters."""
    lacks = lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b)))
    like = lambda a, b, n, m: F.lit(1.0) - F.greatest(lacks(a, b), lacks(b, a)) / F.greatest(n, m, F.lit(1))
    # without a first name, the last name may stand anywhere among the letters
    whole = lacks(k["last"], r["all"])
    loose = F.when((whole == 0) | (k["n_last"] < 3), F.lit(1.0)).when(r["n_first"] == 0, F.lit(1.0) - whole / k["n_last"]).otherwise(F.lit(0.0))

    def fit(i: int) -> Column:
        g = r[f"guess_{i}"]
        held = (lacks(k["begin"], g) == 0) | (lacks(g, k["last"]) == 0)
        return F.when(r[f"n_{i}"].isNull(), F.lit(0.0)).when(held, F.lit(1.0)).otherwise(like(k["last"], g, k["n_last"], r[f"n_{i}"]))

    last = F.greatest(loose, *(fit(i) for i in range(3)))
    first, both = like(k["first"], r["first"], k["n_first"], r["n_first"]), like(k["all"], r["all"], k["n_all"], r["n_all"])
    return last * F.lit(0.62) + first * F.lit(0.23) + both * F.lit(0.15) + F.lit(1e-9), last + F.lit(1e-9)


def _near_pairs(known: DataFrame, rows: DataFrame, full: float, last: float | None, *carried: str) -> DataFrame:
    """file_name, ord, row_index, known, read, carried of the pairs of one file that may score at least `full`, or `last` by
    the last name alone. known: file_name, ord, name; rows: file_name, row_index, name, carried.

    Pairs that cannot score enough are left out by their letters, before any edit is counted. Bits are made of parts that
    are dealt already: otherwise Spark puts the whole expression of the parts in place of every mention."""
    known = dealt(known.select("file_name", "ord", known_parts(F.col("name")).alias("known")), "file_name").withColumn("k", known_bits(F.col("known")))
    rows = dealt(rows.select("file_name", "row_index", *carried, read_parts(F.col("name")).alias("read")), "file_name").withColumn("r", read_bits(F.col("read")))
    most, most_last = score_bounds(F.col("k"), F.col("r"))
    pairs = known.join(rows, "file_name").where((most >= full) if last is None else (most >= full) | (most_last >= last))
    return pairs.select("file_name", "ord", "row_index", *carried, "known", "read")


def last_name_score(last: Column, read: Column) -> Column:
    """0 to 1: how well a known last name fits a read name."""
    return let(F.struct(F.struct(last.alias("last")).alias("k"), read_parts(read).alias("r")), lambda x: last_score(x["k"], x["r"]))


def match_score(known: Column, read: Column) -> Column:
    """0 to 1: 0.62 of the last name, 0.23 of the first name, 0.15 of all letters."""
    return let(F.struct(known_parts(known).alias("k"), read_parts(read).alias("r")), lambda x: pair_score(x["k"], x["r"]))


def _greedy_fold(pairs: DataFrame) -> DataFrame:
    """greedy with the pairs of one file folded together."""
    state = F.struct(F.array().cast("array<int>").alias("ords"), F.array().cast("array<int>").alias("rows"))
    pair = lambda s, x: F.struct(F.concat(s["ords"], F.array(x["ord"])).alias("ords"), F.concat(s["rows"], F.array(x["row_index"])).alias("rows"))
    used = lambda s, x: F.array_contains(s["ords"], x["ord"]) | F.array_contains(s["rows"], x["row_index"])
    taken = F.aggregate("p", state, lambda s, x: F.when(used(s, x), s).otherwise(pair(s, x)))
    each = pairs.groupBy("file_name").agg(F.array_sort(F.collect_list("rank")).alias("p"))
    both = F.zip_with(F.col("t.ords"), F.col("t.rows"), lambda o, r: F.struct(o.alias("ord"), r.alias("row_index")))
    return each.select("file_name", taken.alias("t")).select("file_name", F.explode(both).alias("b")).select("file_name", "b.ord", "b.row_index")


def _round(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs that are the best of both their sides, and those of which no side is taken by these."""
    best = lambda side: pairs.groupBy("file_name", side).agg(F.min("rank").alias("rank")).select("file_name", "rank")
    taken = once(best("ord").join(best("row_index"), ["file_name", "rank"]).select("file_name", "rank.ord", "rank.row_index"))
    rest = pairs.join(taken.select("file_name", "ord"), ["file_name", "ord"], "left_anti").join(taken.select("file_name", "row_index"), ["file_name", "row_index"], "left_anti")
    return taken, rest


#: Pairs of a file up to which they are folded together.
FOLDED_PAIRS = 4096


def greedy(pairs: DataFrame, most: int = FOLDED_PAIRS) -> DataFrame:
    """file_name, ord, row_index of the pairs taken: best score first, then quality, then the order of both; each side
    once. pairs: file_name, ord, row_index, score, quality, each pair once.

    Runs when it is called. In a file with more than `most` pairs, those that are the best of both their sides are taken at
    once: no other pair could come before them. What they leave goes to the next round, until at most `most` pairs are left,
    which are folded together."""
    rank = F.struct((-F.col("score")).alias("s"), (-F.col("quality")).alias("q"), "ord", "row_index").alias("rank")
    left = pairs.select("file_name", F.col("ord").cast("int"), F.col("row_index").cast("int"), "score", "quality").select("file_name", "ord", "row_index", rank)
    with working_tables():
        left, done = once(left), []
        while True:
            many = left.groupBy("file_name").count().where(F.col("count") > most).select("file_name")
            if many.isEmpty():
                break
            many = once(many)
            few = left.join(many, "file_name", "left_anti")
            if not done or not few.isEmpty():
                done.append(_greedy_fold(few))
            taken, rest = _round(left.join(many, "file_name", "left_semi"))
            done.append(taken)
            left = once(rest)
        return once(reduce(DataFrame.unionByName, done, _greedy_fold(left)), outer=True)


def assign(roster: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs of roster names and rows that belong together. Runs when it is called (see greedy)."""
    quality = completeness({c: F.col(c) for c in ("charge", "family_count", "coverage", "status", "medical_plan")})
    pairs = _near_pairs(roster.select("file_name", "ord", "name"), members.select("file_name", "row_index", "name", quality.alias("quality")), MATCH, None, "quality")
    pairs = pairs.select("file_name", "ord", "row_index", "quality", pair_score(F.col("known"), F.col("read"), MATCH).alias("score"))
    return greedy(pairs.select("file_name", "ord", "row_index", "quality", kept(F.col("score"), F.col("score") >= MATCH).alias("score")))


def hit_flags(flags: Column, charge: Column) -> Column:
    """Flags of a matched row: those of names are settled; a missing charge is said again."""
    rest = F.filter(flags, lambda f: ~f.rlike("(?i)name") & (f != NOT_FOUND))
    return F.concat(rest, F.when(charge.isNull(), F.array(F.lit(NO_CHARGE))).otherwise(F.array().cast("array<string>")))


def _project(slots: DataFrame, hits: DataFrame) -> DataFrame:
    """slots(file_name, ord, name) with the row that was found for each, or a placeholder on page 0."""
    found = hits.withColumn("hit", F.lit(True)).withColumnRenamed("name", "read").withColumnRenamed("row_index", "source_index")
    d = slots.join(found, ["file_name", "ord"], "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    flags = F.when(F.col("hit"), hit_flags(F.col("flags"), F.col("charge"))).otherwise(F.array(F.lit(NOT_FOUND)))
    return d.select("file_name", F.col("ord").cast("int").alias("row_index"), "name", "family_count", blank("coverage"), blank("status"), blank("medical_plan"), "charge", F.coalesce("page", F.lit(0)).alias("page"), flags.alias("flags"), F.coalesce("read", F.lit("")).alias("ocr_name"), "source_index")


def apply_roster(roster: DataFrame, members: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """A row for each roster name, in its order; names without a row get a placeholder. pairs: assign() of both, where it
    is there already."""
    hits = (assign(roster, members) if pairs is None else pairs).join(members, ["file_name", "row_index"])
    return _project(roster, hits)


def unused_rows(roster: DataFrame, members: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """The rows that no roster name took."""
    return members.join(assign(roster, members) if pairs is None else pairs, ["file_name", "row_index"], "left_anti")


def is_missing(flags: Column) -> Column:
    return F.array_contains(flags, NOT_FOUND)


def fill_from_leftover(matched: DataFrame, leftover: DataFrame) -> DataFrame:
    """matched, with placeholders filled from the leftover rows at a lower bound, or on the last name alone."""
    missing = matched.where(is_missing(F.col("flags"))).select("file_name", F.col("row_index").alias("ord"), "name")
    pairs = _near_pairs(missing, leftover.select("file_name", "row_index", "name"), LEFTOVER, LEFTOVER_LAST)
    pairs = pairs.select("file_name", "ord", "row_index", pair_score(F.col("known"), F.col("read"), LEFTOVER).alias("full"), last_score(F.col("known"), F.col("read")).alias("last"))
    near = (F.col("full") >= LEFTOVER) | (F.col("last") >= LEFTOVER_LAST)
    taken = greedy(pairs.select("file_name", "ord", "row_index", kept(F.greatest("full", "last"), near).alias("score"), F.lit(0).alias("quality")))
    filled = _project(missing.join(taken, ["file_name", "ord"], "left_semi"), taken.join(leftover, ["file_name", "row_index"]))
    rest = matched.join(filled.select("file_name", "row_index"), ["file_name", "row_index"], "left_anti")
    return rest.unionByName(filled)


def leftover_report(matched: DataFrame, leftover: DataFrame) -> DataFrame:
    """Leftover rows that no matched row took or is near to."""
    used = matched.select(F.col("file_name").alias("f"), known_parts(F.col("name")).alias("known"), "ocr_name")
    rows = dealt(leftover, "file_name").withColumn("parts", read_parts(F.col("name")))
    scored = (pair_score(F.col("known"), F.col("parts"), MATCH) >= MATCH) | (last_score(F.col("known"), F.col("parts")) >= LEFTOVER_LAST)
    near = (F.col("f") == rows["file_name"]) & ((F.col("ocr_name") == rows["name"]) | scored)
    return rows.join(used, near, "left_anti").drop("parts")
