"""Merging of rows whose names are nearly the same. Groups are the rows of a page, then of a file. A small group is folded
as it is; of a large one, only rows whose names are linked by near names come together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridextract.functions.money import merged_charge
from gridextract.functions.text import dealt, let, letters
from gridextract.operators.linked import components
from gridextract.sources.shared import once, working_tables

FIELDS = ("name", "family_count", "coverage", "status", "medical_plan", "charge", "flags", "page")


def same_letters(x: Column, y: Column) -> Column:
    """same_person of names of which only the letters are left. Spark stops counting edits at the bound it is given, and
    does not count at all where the test before them fails."""
    edits = lambda most: F.levenshtein(x, y, most) >= 0
    near = F.when(F.substring(x, 1, 8) == F.substring(y, 1, 8), edits(3)).otherwise(edits(1))
    return (x == y) | ((F.char_length(x) >= 8) & (F.char_length(y) >= 8) & (F.abs(F.char_length(x) - F.char_length(y)) <= 3) & near)


def same_person(a: Column, b: Column) -> Column:
    """Equal letters; or long names one edit apart, or up to three with the same first eight letters."""
    return let(F.struct(letters(a).alias("x"), letters(b).alias("y")), lambda k: same_letters(k["x"], k["y"]))


def same_key(x: Column, y: Column) -> Column:
    """same_letters of two keys (see key). Equal letters, letters with the same first eight, and long ones one edit apart all
    share their first four or their last four letters, so nothing else is asked of the other pairs, which are nearly all."""
    return ((x["head"] == y["head"]) | (x["tail"] == y["tail"])) & same_letters(x["letters"], y["letters"])


def key(name: Column) -> Column:
    """The letters of a name, with the first four and the last four of them."""
    return let(letters(name), lambda x: F.struct(x.alias("letters"), F.substring(x, 1, 4).alias("head"), F.right(x, F.lit(4)).alias("tail")))


def completeness(row) -> Column:
    """How much of a row is filled in; the charge counts most."""
    score = F.when(row["charge"].isNotNull(), 8).otherwise(0) + F.when(row["family_count"].isNotNull(), 1).otherwise(0)
    for c in ("coverage", "status", "medical_plan"):
        score = score + F.when(row[c] != "", 2).otherwise(0)
    return score


def merged(a: Column, b: Column) -> Column:
    """One row of two (FIELDS and key, that of the name): the more complete one (a, of equal ones), its gaps filled from the other, its settled flags gone."""
    first = completeness(a) >= completeness(b)
    both = lambda f: F.when(f, F.struct(a.alias("win"), b.alias("lose"))).otherwise(F.struct(b.alias("win"), a.alias("lose")))

    def filled(p: Column) -> Column:
        """The fields of both that depend on both, each worked out once."""
        win, lose = p["win"], p["lose"]
        text = (F.when(win[f] != "", win[f]).otherwise(lose[f]).alias(f) for f in ("coverage", "status", "medical_plan"))
        family, charge = F.coalesce(win["family_count"], lose["family_count"]), merged_charge(win["charge"], lose["charge"])
        return let(F.struct(win.alias("win"), family.alias("family_count"), *text, charge.alias("charge")), settled)

    def settled(r: Column) -> Column:
        win = r["win"]
        tests = {
            "Missing medical current charge": r["charge"].isNotNull(), "Missing coverage": r["coverage"] != "", "Missing status": r["status"] != "",
            "Missing medical plan": r["medical_plan"] != "", "Missing family count": r["family_count"].isNotNull(),
        }
        gone = F.filter(F.array(*(F.when(test, F.lit(flag)) for flag, test in tests.items())), lambda x: x.isNotNull())
        flags = F.when(F.size(win["flags"]) == 0, win["flags"]).otherwise(F.array_except(win["flags"], gone))
        own = {"name": win["name"], "flags": flags, "page": win["page"], "key": win["key"]}
        return F.struct(*((own[f] if f in own else r[f]).alias(f) for f in (*FIELDS, "key")))

    return let(let(first, both), filled)


def _folded(rows: DataFrame, by: list[str], order: list[str], *carried: str) -> DataFrame:
    """by, done: the rows of each group, taken in order, each merged into the first one so far whose name is nearly the same,
    or added at the end. carried: columns that a merged row keeps from the first of its rows."""
    row = F.struct(*FIELDS, key(F.col("name")).alias("key"), *carried)
    each = dealt(rows, *by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, row.alias("row"))))["row"].alias("rows"))
    kind = each.schema["rows"].dataType.simpleString()

    def both(a: Column, b: Column) -> Column:
        if not carried:
            return merged(a, b)
        return let(merged(a, b), lambda m: F.struct(*(m[f].alias(f) for f in (*FIELDS, "key")), *(a[c].alias(c) for c in carried)))

    def add(done: Column, row: Column) -> Column:
        # 0 if there is none
        like = F.array_position(F.transform(done, lambda d: same_key(d["key"], row["key"])), True)
        joined = lambda at: let(F.struct(F.get(done, at - 1).alias("a"), row.alias("b")), lambda p: both(p["a"], p["b"]))
        put = lambda at: F.concat(F.slice(done, F.lit(1), at - 1), F.array(joined(at)), F.slice(done, at + 1, F.size(done)))
        # the place is worked out once for a row
        return let(like.cast("int"), lambda at: F.when(at == 0, F.concat(done, F.array(row))).otherwise(put(at)))

    return each.select(*by, F.aggregate("rows", F.array().cast(kind), add).alias("done"))


def dedupe(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, row_index (from 1), FIELDS. Rows are taken in order; each is merged into the first row so far whose name is
    nearly the same, or is added at the end. All rows of a group are folded in one task: for groups of a page's size."""
    d = _folded(rows, keys, order).select(*keys, F.posexplode("done").alias("_at", "_row"))
    return d.select(*keys, (F.col("_at") + 1).alias("row_index"), *(f"_row.{f}" for f in FIELDS if f not in keys))


def name_links(names: DataFrame) -> DataFrame:
    """a, b: links by which names that same_letters holds for reach each other. names: group, letters, node.

    Long names share their first eight letters, or, one edit apart, a string that is left when at most one letter is taken
    out of each. Each name is linked with the least of those that share such a string, so a string in very many names makes
    one link a name and no pairs. Other names may be linked too: that only makes a component larger."""
    gap = lambda x: F.transform(F.sequence(F.lit(1), F.char_length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.char_length(x))))
    x = F.col("letters")
    shared = F.concat(F.array(F.concat(F.lit("^"), F.substring(x, 1, 8)), x), gap(x))
    keyed = names.where(F.char_length("letters") >= 8).select("node", F.explode(F.array_distinct(F.transform(shared, lambda s: F.xxhash64("group", s)))).alias("key"))
    keyed = once(keyed)
    least = once(keyed.groupBy("key").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "b"))
    return keyed.join(least, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


#: Rows of a group up to which it is folded as it is.
SMALL = 512


def dedupe_large(rows: DataFrame, keys: list[str], order: list[str], small: int = SMALL) -> DataFrame:
    """dedupe for groups of any size, with the same rows. Runs when it is called: rows are written, and if a group has more
    than `small` of them, so are the components of its names.

    A row can only be merged into one whose name is near, and a merged row has the name of one of its rows; so rows of
    different components of near names never meet, and each component is folded by itself. What is numbered over a whole
    group is sorted, not held."""
    group = F.xxhash64(*keys)
    rows = once(rows.select(*dict.fromkeys([*keys, *order, *FIELDS]))).withColumn("_group", group)
    many = rows.groupBy("_group").count().where(F.col("count") > small).select("_group")
    if many.isEmpty():
        return dedupe(rows, keys, order)
    x = letters(F.col("name"))
    node = F.xxhash64("_group", x)
    with working_tables():
        many = once(many)
        large = rows.join(many, "_group", "left_semi")
        names = large.select(F.col("_group").alias("group"), x.alias("letters"), node.alias("node")).distinct()
        parts = components(name_links(names))
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *FIELDS)).alias("_nth")
        numbered = large.select(*dict.fromkeys([*keys, *FIELDS]), node.alias("node"), nth).join(parts, "node", "left")
        done = _folded(numbered.withColumn("_part", F.coalesce("component", "node")), [*keys, "_part"], ["_nth"], "_nth")
        each = done.select(*keys, F.explode("done").alias("_row"))
        at = F.row_number().over(Window.partitionBy(*keys).orderBy("_row._nth"))
        got = each.select(*keys, at.alias("row_index"), *(f"_row.{f}" for f in FIELDS if f not in keys))
        return once(got.unionByName(dedupe(rows.join(many, "_group", "left_anti"), keys, order)), outer=True)


def members_of(page_rows: DataFrame) -> DataFrame:
    """file_name, row_index, FIELDS: the rows of each page merged, then those of each file, page by page. Runs when it is
    called (see dedupe_large)."""
    by_page = dedupe(page_rows, ["file_name", "page"], ["pass", "ord"])
    return dedupe_large(by_page, ["file_name"], ["page", "row_index"])
