"""Header fields of invoices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridextract.functions import money
from gridextract.functions.text import normalized

# The labels as they are printed, what may stand between a label and its value, and how values look.
NUMBER, DAY, MONTH, AMOUNT = r"\d{6,}", r"\d{1,2}/\d{1,2}/\d{2,4}", r"[A-Za-z]+ \d{4}", r"[\d,]+\.\d{2}"
BILLING = "Consolidated Billing ID"
FIELDS = {
    "billing_id": ((BILLING,), r"[:\s]*", NUMBER),
    "statement_id": (("Statement ID",), r"[:.\s]*", NUMBER),
    "invoice_date": (("Invoice Date",), r"[:\s]*", DAY),
    "bill_period": (("Bill Period",), r"[:\s]*", MONTH),
    "due_date": (("Due Date", "Due Before"), r"[:\s]*", DAY),
}
TOTALS = ("Please pay this Amount", "Total Amount Due", "Total Charges")
# A customer is what begins a line with a letter and goes on with such characters, 6 to 61 in all, at most
# REACH characters (and blanks) before the label of the billing number.
CUSTOMER, REACH = r"[A-Za-z][A-Za-z0-9 .,'&/-]{5,60}", 80
#: Characters before the label that such a line is looked for in: room for a customer, REACH, and blank lines between them.
TAIL = 61 + REACH + 259
HEADER = ("customer_name", *FIELDS)


def value_after(text: Column, labels: tuple[str, ...], between: str, value: str) -> Column:
    """The value behind the first of these labels, in any case of letters, that has one; '' if none has."""
    behind = F.slice(F.split(text, f"(?i)(?:{'|'.join(labels)})"), 2, 1 << 20)
    found = F.transform(behind, lambda part: F.regexp_extract(part, f"(?i)^{between}({value})", 1))
    return F.trim(F.coalesce(F.get(F.filter(found, lambda v: v != ""), F.lit(0)), F.lit("")))


def customer_before(text: Column, label: str = BILLING) -> Column:
    """The first line beginning before a label that is a customer and near enough to it; '' if there is none. Labels are
    looked for first; each is then judged by the lines that stand shortly before it."""
    parts = F.split(text, f"(?i){label}")

    def before(nth: Column) -> Column:
        end = F.char_length(F.array_join(F.slice(parts, 1, nth), label))
        begin = F.greatest(F.lit(0), end - TAIL)
        lines = F.split(F.substring(text, begin + 1, end - begin), "\n")
        # what is cut off at its left begins no line
        at = F.sequence(F.when(begin > 0, F.lit(2)).otherwise(F.lit(1)), F.greatest(F.size(lines), F.lit(2)))
        return F.get(F.filter(F.transform(at, lambda i: named(F.array_join(F.slice(lines, i, TAIL), "\n"))), lambda v: v != ""), F.lit(0))

    def named(rest: Column) -> Column:
        run = F.regexp_extract(rest, f"^{CUSTOMER}", 0)
        gap = F.char_length(F.regexp_replace(F.substring(rest, F.char_length(run) + 1, F.lit(TAIL)), r"^\s+", ""))
        return F.when((run != "") & (gap <= REACH), run).otherwise("")

    found = F.transform(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda k: k < F.size(parts)), before)
    return F.trim(F.coalesce(F.get(F.filter(found, lambda v: v.isNotNull()), F.lit(0)), F.lit("")))


def header_fields(page_text: DataFrame) -> DataFrame:
    """file_name, page, HEADER ('' if absent) and total_amount_due (null if absent) of each page."""
    d = page_text.select("file_name", "page", normalized(F.coalesce("text", F.lit(""))).alias("text"))
    text = F.col("text")
    totals = [F.nullif(value_after(text, (label,), r"[:\s]*\$?", AMOUNT), F.lit("")) for label in TOTALS]
    values = (value_after(text, *how).alias(c) for c, how in FIELDS.items())
    return d.select("file_name", "page", customer_before(text).alias("customer_name"), *values, money.parsed(F.coalesce(*totals)).alias("total_amount_due"))


def merged_header(fields: DataFrame) -> DataFrame:
    """One header for each file: of every field the first page that has it."""
    first = lambda c, has: F.min_by(F.when(has, F.col(c)), F.when(has, F.col("page")))
    return fields.groupBy("file_name").agg(
        *(F.coalesce(first(c, F.col(c) != ""), F.lit("")).alias(c) for c in HEADER), first("total_amount_due", F.col("total_amount_due").isNotNull()).alias("total_amount_due"))


