"""Corrections and other changes of rows, as tables that are applied to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridextract.functions import money, names
from gridextract.operators.match import ADDED, NOT_FOUND
from gridextract.operators.quality import flags_after_edit, ignored_warning


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both by key: the latest of each (greatest order), at the place of its first (column first_order)."""
    both = old.unionByName(new)
    own = Window.partitionBy(key)
    d = both.withColumn("first_order", F.min(order).over(own)).withColumn("_n", F.row_number().over(own.orderBy(F.col(order).desc())))
    return d.where("_n = 1").drop("_n")


def family_input(text: Column) -> Column:
    """A typed family count: a whole number from 0 to 20, else null."""
    n = F.trim(text).try_cast("int")
    return F.when(n.between(0, 20), n)


def apply_edits(members: DataFrame, edits: DataFrame) -> DataFrame:
    """members with the last edit of each field. edits: file_name, row_index, field, value (text), seq."""
    known = ["name", "family_count", "coverage", "status", "medical_plan", "charge", *(["excluded"] if "excluded" in members.columns else [])]
    last = edits.groupBy("file_name", "row_index").pivot("field", known).agg(F.max_by(F.struct("value"), "seq"))
    fields = [c for c in last.columns if c not in ("file_name", "row_index")]
    d = members.join(last.select("file_name", "row_index", F.lit(True).alias("_edited"), *(F.col(c).alias(f"_{c}") for c in fields)), ["file_name", "row_index"], "left")
    for c in fields:
        text = F.col(f"_{c}.value")
        value = {"family_count": family_input(text), "charge": money.amount_input(text), "excluded": F.coalesce(text.try_cast("boolean"), F.lit(False))}.get(c, text)
        d = d.withColumn(c, F.when(F.col(f"_{c}").isNotNull(), value).otherwise(F.col(c)))
    flags = flags_after_edit(F.col("flags"), F.col("charge"), F.col("family_count"), F.concat("coverage", "status", "medical_plan"))
    return d.withColumn("flags", F.when(F.col("_edited"), flags).otherwise(F.col("flags"))).select(*members.columns)


def add_rows(members: DataFrame, added: DataFrame) -> DataFrame:
    """members with leftover rows (added: the columns of members) behind those of their file, under new numbers, with the
    flag of added rows. Where members have ocr_name, it keeps the name as it was read."""
    most = members.groupBy("file_name").agg(F.max("row_index").alias("_most"))
    nth = F.row_number().over(Window.partitionBy("file_name").orderBy("row_index", "name"))
    d = added.withColumn("_nth", nth).join(most, "file_name", "left").withColumn("row_index", F.coalesce("_most", F.lit(0)) + F.col("_nth"))
    flags = F.concat(F.filter("flags", lambda f: f != NOT_FOUND), F.array(F.lit(ADDED)))
    d = d.withColumn("ocr_name", F.col("name")) if "ocr_name" in members.columns and "ocr_name" not in added.columns else d
    d = d.withColumn("name", names.roster_name(F.col("name"))).withColumn("flags", flags)
    return members.unionByName(d.select(*members.columns))


def add_blank_rows(members: DataFrame, new_names: DataFrame) -> DataFrame:
    """members with an empty row for each name (new_names: file_name, name) that is LAST, FIRST and not there yet."""
    d = new_names.select("file_name", names.roster_form(F.col("name")).alias("name")).where("name is not null").distinct()
    d = d.join(members.select("file_name", "name"), ["file_name", "name"], "left_anti").withColumn("row_index", F.lit(0))
    empty = {"coverage": "", "status": "", "medical_plan": "", "page": 0}
    blank = d.select(*(F.col(c) if c in d.columns else F.lit(empty.get(c)).cast(members.schema[c].dataType).alias(c) if c != "flags" else F.array().cast("array<string>").alias(c) for c in members.columns))
    return add_rows(members, blank)


def merge_roster(roster: DataFrame, extra: DataFrame) -> DataFrame:
    """Names of both, each extra one only if it is not there yet; see in_language_order for where they are shown."""
    added = extra.where("name <> ''").join(roster, "name", "left_anti")
    return roster.select("name").unionByName(added.select("name"))


def add_to_roster(roster: DataFrame, typed: DataFrame) -> DataFrame:
    """roster with the typed names that are LAST, FIRST and not there yet."""
    return merge_roster(roster, typed.select(names.roster_form(F.col("name")).alias("name")).where("name is not null").distinct())


def rename_in_roster(roster: DataFrame, changes: DataFrame) -> DataFrame:
    """roster with names changed (changes: name, new_name; one row a name); a change that is not LAST, FIRST, or leads to
    a name that is there already, is left out; of several that lead to one name the least counts. Changes are judged on the
    roster as it stands."""
    d = changes.select("name", names.roster_form(F.col("new_name")).alias("_new")).where("_new is not null")
    d = d.join(roster.select(F.col("name").alias("_new")), "_new", "left_anti").groupBy("_new").agg(F.min("name").alias("name"))
    return roster.join(d, "name", "left").select(F.coalesce("_new", "name").alias("name"))


def remove_from_roster(roster: DataFrame, gone: DataFrame) -> DataFrame:
    return roster.join(gone.select("name"), "name", "left_anti").select("name")


def in_language_order(roster: DataFrame) -> DataFrame:
    """The names in the order of the language: a global sort, for where a list is shown or saved."""
    return roster.orderBy(F.collate("name", "UNICODE"))


def cleared(table: DataFrame) -> DataFrame:
    """The table without its rows."""
    return table.limit(0)


def next_index(members: DataFrame) -> DataFrame:
    """file_name, next_index: the number of the next row of each file."""
    return members.groupBy("file_name").agg((F.max("row_index") + 1).alias("next_index"))


def move_leftovers(tables: dict[str, DataFrame], picked: DataFrame) -> dict[str, DataFrame]:
    """The change that takes leftover rows (picked: file_name, row_index, name) among the members of their files, as a whole:
    members get them, leftovers lose them, the warning of a file about ignored rows is made anew from what is left, and
    names that are LAST, FIRST join the roster. tables: members, leftovers (the columns of members but for ocr_name),
    warnings (file_name, warning), roster (name). What is returned belongs together: see sources.versions.commit."""
    members, leftovers, warnings, roster = (tables[t] for t in ("members", "leftovers", "warnings", "roster"))
    keys = ["file_name", "row_index", "name"]
    taken = leftovers.join(picked.select(*keys).distinct(), keys, "left_semi")
    left = leftovers.join(taken.select(*keys), keys, "left_anti")
    touched = taken.select("file_name").distinct()
    stale = warnings.where(F.col("warning").rlike("(?i)did not match the member list")).join(touched, "file_name", "left_semi")
    kept = warnings.join(stale, ["file_name", "warning"], "left_anti")
    return {
        "members": add_rows(members, taken),
        "leftovers": left,
        "warnings": kept.unionByName(ignored_warning(left.join(touched, "file_name", "left_semi"))),
        "roster": add_to_roster(roster, taken.select("name")),
    }


def replay(log: DataFrame, uploads: DataFrame) -> DataFrame:
    """The members (file_name, row_index, ..., and first, the place of their file) that a log of changes leaves, in whatever
    order its rows come. log: seq, kind, file_name, upload, row_index, field, value. uploads: upload and the columns of
    members, excluded included.

    upsert: the rows of an upload replace all that the file held, edits and added rows, too; the file keeps the place of
    its first upsert. add: an empty row for the name in value, behind those of the file, if it is LAST, FIRST and no row
    has that name as uploaded or added. edit: a field of a row (excluded is one: true or false). clear: all files go, and
    places begin anew. Nothing is folded row by row: what counts follows from the last clear and each file's last upsert."""
    start = log.where("kind = 'clear'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_start"))
    # the one row of the last clear
    live = log.join(F.broadcast(start), F.col("seq") > F.col("_start")).drop("_start")
    last = live.where("kind = 'upsert'").groupBy("file_name").agg(F.max("seq").alias("_since"), F.max_by("upload", "seq").alias("upload"), F.min("seq").alias("first"))
    columns = [c for c in uploads.columns if c != "upload"]
    base = uploads.join(last.select("file_name", "upload"), ["file_name", "upload"], "left_semi").select(*columns)
    since = live.join(last.select("file_name", "_since"), "file_name").where("seq > _since")
    new = since.where("kind = 'add'").select("file_name", names.roster_form(F.col("value")).alias("name"), "seq").where("name is not null")
    new = new.groupBy("file_name", "name").agg(F.min("seq").alias("seq")).join(base.select("file_name", "name"), ["file_name", "name"], "left_anti")
    most = base.groupBy("file_name").agg(F.max("row_index").alias("_most"))
    nth = F.row_number().over(Window.partitionBy("file_name").orderBy("seq"))
    new = new.withColumn("_nth", nth).join(most, "file_name", "left").withColumn("row_index", (F.coalesce("_most", F.lit(0)) + F.col("_nth")).cast(base.schema["row_index"].dataType))
    empty = {"coverage": F.lit(""), "status": F.lit(""), "medical_plan": F.lit(""), "page": F.lit(0), "excluded": F.lit(False), "flags": F.array(F.lit(ADDED))}
    rows = base.withColumn("_from", F.lit(-1).cast("long")).unionByName(new.select(*(F.col(c) if c in ("file_name", "name", "row_index") else empty.get(c, F.lit(None)).cast(base.schema[c].dataType).alias(c) for c in columns), F.col("seq").alias("_from")))
    # an edit reaches a row only if it was there
    edits = since.where("kind = 'edit'").select("file_name", "row_index", "field", "value", "seq").join(rows.select("file_name", "row_index", "_from"), ["file_name", "row_index"]).where("seq > _from")
    return apply_edits(rows.drop("_from"), edits.drop("_from")).join(last.select("file_name", "first"), "file_name")
