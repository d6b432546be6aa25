"""Code tables of the documents that are read, and their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes and labels as the documents print them; of two plans that fit a token, the first counts.
COVERAGE = {
    "E": "Employee Only",
    "ES": "Employee and Spouse",
    "ESD": "Employee, Spouse and Dependent(s)",
    "ED": "Employee and Dependent(s)",
    "EA": "Employee and Adult dependent",
}
STATUS = {"A": "Active", "R": "Retiree", "C": "Cobra", "T": "Terminated"}
PLANS = (
    "HMO PLUS", "SRADDHMO", "MSPSRADV", "SL&FIT", "SR ADV", "CHAC", "CHIRO", "ACCU", "DEPO", "DHMO", "DENTAL", "VISION", "MEDICAL", "HMO", "PPO",
    "EPO", "POS", "HSA", "HRA", "BZS", "BZ", "GDR", "GD", "SLS", "PT", "OOA", "CAT", "FIT", "SL",
)
# What codes turn into on worn prints.
COVERAGE_READ = {"ESD": "ESD", "ESB": "ESD", "ESP": "ESD", "ESO": "ESD", "ED": "ED", "EP": "ED", "ES": "ES", "EA": "EA", "E": "E", "EE": "E"}
STATUS_READ = {"A": "A", "R": "R", "C": "C", "T": "T", "TV": "T", "TT": "T", "AA": "A"}


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a small fixed table, null for other keys."""
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def coverage_label(code: Column) -> Column:
    """Label of a coverage code; an unknown code stays, a blank one is blank."""
    return F.coalesce(lookup(COVERAGE, code), code)


def status_label(code: Column) -> Column:
    return F.coalesce(lookup(STATUS, code), code)


def plan_options(current: Column) -> Column:
    """All plans, after the current one if it is none of them."""
    known = F.array(*(F.lit(p) for p in PLANS))
    return F.when((current == "") | current.isNull() | F.array_contains(known, current), known).otherwise(F.concat(F.array(current), known))


def plan_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(PLANS)), "ord int, plan string")
