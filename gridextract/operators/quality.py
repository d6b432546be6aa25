"""Evidence of fields, flags, completeness and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridextract.functions import money
from gridextract.functions.text import collapsed, letters, let
from gridextract.operators.match import NO_CHARGE, NOT_FOUND

# Least confidence of a name and of an amount.
NAME_SURE, AMOUNT_SURE = 65, 70


def name_field(raw: Column, confidence: Column) -> Column:
    """raw, value, confidence, status (missing, needs-review, ok) of a name that was read."""
    sure = confidence.isNull() | (confidence >= NAME_SURE)

    def read(c: Column) -> Column:
        n = F.char_length(letters(c))
        status = F.when(c == "", "missing").when((n >= 6) & sure & c.contains(","), "ok").otherwise("needs-review")
        return F.struct(c.alias("raw"), F.upper(c).alias("value"), confidence.alias("confidence"), status.alias("status"))

    return let(collapsed(raw), read)


def amount_field(raw: Column, confidence: Column) -> Column:
    sure = confidence.isNull() | (confidence >= AMOUNT_SURE)

    def read(c: Column) -> Column:
        value = F.coalesce(money.extracted(c), money.parsed(c))
        status = lambda v: F.when(c == "", "missing").when(v.isNotNull() & money.plausible(v) & sure, "ok").otherwise("needs-review")
        return let(value, lambda v: F.struct(c.alias("raw"), v.alias("value"), confidence.alias("confidence"), status(v).alias("status")))

    return let(collapsed(raw), read)


def row_flags(name: Column, amount: Column, coverage: Column, status: Column, plan: Column, family: Column) -> Column:
    """Flags of a row, in their order, from the status of its fields and its codes."""
    flags = F.array(
        F.when(name == "missing", "Missing name").when(name == "needs-review", "Name needs review"),
        F.when(amount == "missing", NO_CHARGE).when(amount == "needs-review", "Charge needs review"),
        F.when(coverage == "", "Missing coverage"), F.when(status == "", "Missing status"), F.when(plan == "", "Missing medical plan"),
        F.when(family.isNull(), "Missing family count"))
    return F.filter(flags, lambda x: x.isNotNull())


def flags_after_edit(flags: Column, charge: Column, family: Column, codes: Column) -> Column:
    """Flags of a row after a correction; codes: coverage, status and plan together."""
    monthly = family.isNotNull() | (codes != "") | charge.isNotNull()
    kept = F.filter(flags, lambda f: (f != NO_CHARGE) & ~(monthly & (f == NOT_FOUND)))
    return F.array_distinct(F.concat(kept, F.when(charge.isNull(), F.array(F.lit(NO_CHARGE))).otherwise(F.array().cast("array<string>"))))


def completeness_warnings(visual: Column, named: Column, priced: Column, total: Column, due: Column) -> Column:
    """Texts on what a file lacks: rows seen, rows with a name, rows with a charge, sum of charges, total due."""
    n = lambda x: x.cast("string")
    texts = F.array(
        F.when((visual > 0) & (named < visual), F.concat(F.lit("Detected "), n(visual), F.lit(" visual table rows but only "), n(named), F.lit(" have a readable name — review blank/garbled rows before export."))),
        F.when((visual > 0) & (priced < visual), F.concat(n(visual - priced), F.lit(" detected row(s) have no usable current charge."))),
        F.when(due.isNotNull() & (priced > 0) & (F.abs(total - due) >= 1), F.concat(
            F.lit("Current charges sum to "), money.formatted(total), F.lit(" but the invoice total due is "), money.formatted(due),
            F.lit(". Retro activity often explains a gap — do not auto-correct; review the highlighted rows."))))
    return F.filter(texts, lambda x: x.isNotNull())


def visible(members: DataFrame) -> DataFrame:
    """Rows that are neither excluded nor missing on their invoice."""
    return members.where(~F.coalesce("excluded", F.lit(False)) & ~F.array_contains("flags", NOT_FOUND))


def issues(members: DataFrame, files: DataFrame) -> DataFrame:
    """Visible rows with a flag, or of a file with errors (files: file_name, errors)."""
    d = visible(members).join(files.select("file_name", "errors"), "file_name")
    return d.where((F.size("flags") > 0) | (F.size("errors") > 0))


def summary(members: DataFrame, files: DataFrame) -> DataFrame:
    """file_name, n_rows, n_issues, charge_total, attention of each file."""
    d = files.select("file_name", "errors").join(members, "file_name", "left")
    seen = F.col("name").isNotNull() & ~F.coalesce("excluded", F.lit(False)) & ~F.coalesce(F.array_contains("flags", NOT_FOUND), F.lit(False))
    return d.groupBy("file_name").agg(
        F.count_if(seen).alias("n_rows"), F.count_if(seen & ((F.size("flags") > 0) | (F.size("errors") > 0))).alias("n_issues"),
        F.coalesce(F.sum(F.when(seen, F.coalesce("charge", F.lit(0.0)))), F.lit(0.0)).alias("charge_total"),
        ((F.max(F.size("errors")) > 0) | (F.count("name") == 0)).alias("attention"))


def not_found_warning(members: DataFrame) -> DataFrame:
    """file_name, warning: the members that a file lacks, by name."""
    d = members.where(F.array_contains("flags", NOT_FOUND)).groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct("row_index", "name")))["name"].alias("names"))
    n = F.size("names")
    return d.select("file_name", F.concat(n.cast("string"), F.when(n == 1, " member").otherwise(" members"), F.lit(" on the list were not found on this invoice: "), F.array_join("names", "; ")).alias("warning"))


def ignored_warning(rows: DataFrame) -> DataFrame:
    """file_name, warning: rows that no member took, by name."""
    d = rows.groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct("row_index", "name")))["name"].alias("names"))
    n = F.size("names")
    one = lambda a, b: F.when(n == 1, a).otherwise(b)
    return d.select("file_name", F.concat(n.cast("string"), one(" OCR row", " OCR rows"), F.lit(" did not match the member list and "), one("was", "were"), F.lit(" ignored: "), F.array_join("names", "; ")).alias("warning"))


def file_error(warnings: Column) -> Column:
    """What to say of a file without rows: that pages were blank, that reading failed, or that it holds no table."""
    blank = F.exists(warnings, lambda w: w.rlike("(?i)rendered blank"))
    failed = F.get(F.filter(warnings, lambda w: w.rlike("(?i)OCR failed")), F.lit(0))
    return (
        F.when(blank, "The scanned pages could not be decoded.").when(failed.isNotNull(), F.concat(F.lit("Could not read this scan ("), failed, F.lit("). Reload and try again.")))
        .otherwise("No membership rows found.")
    )


def match_warnings(files: DataFrame) -> DataFrame:
    """file_name, warning: of all warnings (files: file_name, warnings) those on members that were not found."""
    return files.select("file_name", F.explode("warnings").alias("warning")).where(F.col("warning").rlike("(?i)not found on this invoice"))


def with_leftovers(leftover: DataFrame) -> DataFrame:
    """file_name, n_rows of the files that have rows which no member took."""
    return leftover.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_rows"))


def unread_files(files: DataFrame, members: DataFrame) -> DataFrame:
    """file_name, reason, warnings (three at most) of files without rows. files: file_name, errors, warnings."""
    d = files.join(members.select("file_name").distinct(), "file_name", "left_anti")
    return d.select("file_name", F.coalesce(F.get("errors", F.lit(0)), F.lit("No membership rows found.")).alias("reason"), F.slice("warnings", 1, 3).alias("warnings"))


def hydrated(members: DataFrame) -> DataFrame:
    """members with every column of a full row: fields of evidence (name_field, amount_field) win over plain values, what
    is absent gets its default."""
    has = set(members.columns)
    plain = {"family_count": "int", "coverage": "string", "status": "string", "medical_plan": "string", "charge": "double", "page": "int", "ocr_name": "string"}
    d = members.withColumns({c: F.lit(None).cast(t) for c, t in plain.items() if c not in has})
    name = F.coalesce(F.nullif(F.col("name_field.value"), F.lit("")), "name") if "name_field" in has else F.col("name")
    charge = F.coalesce("amount_field.value", "charge") if "amount_field" in has else F.col("charge")
    empty = {c: F.coalesce(c, F.lit("")) for c, t in plain.items() if t == "string"}
    flags = F.coalesce("flags", F.array().cast("array<string>")) if "flags" in has else F.array().cast("array<string>")
    nth = F.row_number().over(Window.partitionBy("file_name").orderBy("page", "name"))
    row_index = F.coalesce("row_index", nth) if "row_index" in has else nth
    excluded = F.coalesce("excluded", F.lit(False)) if "excluded" in has else F.lit(False)
    return d.withColumns({"name": name, "charge": charge, **empty, "page": F.coalesce("page", F.lit(0)), "flags": flags, "excluded": excluded, "row_index": row_index})
