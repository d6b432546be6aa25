"""Scalar operators on literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from gridextract.functions import money, names, pages
from gridextract.functions.text import cleaned_line, collapsed, let
from gridextract.operators import dedupe, layout, match, rows
from gridextract.sources import csv_export, roster


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("token", "amount"),
    [("$1,196.00}", 1196.0), ("$221600", 2216.0), ("$1.357", 1357.0), ("$1.24600", 1246.0), ("1.234.56", 1234.56), ("$1.35", None), ("$0.00", 0.0), ("$2160", 2160.0), ("2160", None), ("$-1,072.00", -1072.0), ("ABC", None), ("", None)],
)
def test_amount_of_token(spark, token, amount):
    assert value(spark, money.extracted(F.lit(token))) == amount


def test_amounts_of_line(spark):
    assert value(spark, money.in_line(F.lit("X $ 1 , 800.00 ~~ $1,800.00 and 94.50"))) == [1800.0, 94.5]


@pytest.mark.parametrize(("text", "amount"), [("(5.50)", -5.5), ("$1,000", 1000.0), ("-", None), (".", None), ("1d", None), ("", None)])
def test_parsed_amount(spark, text, amount):
    assert value(spark, money.parsed(F.lit(text))) == amount


@pytest.mark.parametrize(("token", "plan"), [("owmo", "DHMO"), ("PPO", "PPO"), ("MEDICAL", None), ("MEDICA", "MEDICAL"), ("HMOPLUS", "HMO PLUS"), ("D3MO", None), ("PP", None), ("SRADV", "SR ADV")])
def test_plan(spark, token, plan):
    assert value(spark, names.plan(F.lit(token))) == plan


@pytest.mark.parametrize(("name", "ok"), [("BARBERG, ALICE", True), ("SUBTOTAL, ALICE", False), ("BXR, ALICE", False), ("BAR, A", False), ("ESD, ALICE", False), ("BARBERG ALICE", False), ("VAN DER BARBERG, ALICE M", True)])
def test_is_name(spark, name, ok):
    assert value(spark, names.is_name(F.lit(name))) is ok


def test_fused_name_is_cut(spark):
    assert value(spark, names.unfused(F.lit("CELTANFIONA"))) == "CELTAN, FIONA"
    assert value(spark, names.unfused(F.lit("XXX-XX-0001"))) is None


def test_line_cleaning(spark):
    assert value(spark, cleaned_line(F.lit("[Dunfield.Carla | 1]"))) == "DUNFIELD, CARLA 1"
    assert value(spark, collapsed(F.lit("  a \t b\n"))) == "a b"
    assert value(spark, let(F.lit(2), lambda x: x * x)) == 4


def test_pages(spark):
    kind = lambda t: value(spark, pages.page_kind(F.lit(t)))
    assert kind("Medical Plan Legend") == "legend"
    assert kind("Membership Detail Coverage Type") == "full"
    assert kind("Page 4 of 9") == "overflow"
    assert kind("") == "other"
    assert value(spark, pages.best_text(F.array(F.lit(" "), F.lit("a"), F.lit("b")))) == "a"


def test_match_scores(spark):
    score = lambda a, b: value(spark, match.match_score(F.lit(a), F.lit(b)))
    assert score("BARBERG, ALICE", "BARBERG, ALICE") == pytest.approx(1.0)
    assert score("BARBERG, ALICE", "EE BARBERG, ALICE") > 0.9
    assert score("BARBERG, ALICE", "CELCASTER, BRUNO") < 0.5
    assert score("ABC", "BARBERG, ALICE") == 0
    assert value(spark, match.last_name_score(match.last_name(F.lit("BARBERG, ALICE")), F.lit("BARBRG"))) > 0.8


def test_same_person(spark):
    same = lambda a, b: value(spark, dedupe.same_person(F.lit(a), F.lit(b)))
    assert same("BARBERG, ALICE", "BARBERG ALICE")
    assert same("BARBERG, ALICE", "BARBERG, ALICES")
    assert not same("ABC, DE", "ABC, DF")
    assert not same("BARBERG, ALICE", "BARLAND, ALICE")


def test_noisy_page(spark):
    text = "BARBERG, ALICE 1 N XXX-XX-0001 E A DHMO $783.00\n08/2026 MEDICAL $-1,072.00\n[DUNFIELD, CARLA [1 | N | xxXx0003 | ED [A] owmo | $ 1 , 800.00]\nSubtotal $2,583.00"
    d = spark.createDataFrame([("f", 1, text), ("g", 1, None), ("h", 1, "")], rows_schema)
    got = [(r.file_name, r.row_index, r.name, r.charge) for r in dedupe.members_of(rows.page_rows(d)).orderBy("file_name", "row_index").collect()]
    assert got == [("f", 1, "BARBERG, ALICE", 783.0), ("f", 2, "DUNFIELD, CARLA", 1800.0)]
    assert dedupe.members_of(rows.page_rows(d.limit(0))).count() == 0


rows_schema = "file_name string, page int, text string"


def test_zip_columns(spark):
    assert value(spark, layout.zip_columns(F.lit("BARBERG\nLANDER"), F.lit("$5.00\n$6.00"))) == "BARBERG $5.00\nLANDER $6.00"
    assert value(spark, layout.zip_columns(F.lit(""), F.lit("$5.00"))) == ""


def test_csv_cells(spark):
    assert value(spark, roster.cells(F.lit('a,"b ""q"", c"\t d'))) == ["a", 'b "q", c', "d"]
    assert value(spark, csv_export.escaped(F.lit('a"b'))) == '"a""b"'
    assert value(spark, csv_export.escaped(F.lit(None).cast("string"))) == ""


def test_names_are_only_found_where_one_can_begin(spark):
    rng = random.Random(4)
    tokens = ["BARBERG,", "ALICE", "CEL", "CASTER,", "O'NEIL,", "B", "1", "N", "XXX-XX-0001", "E", "ESD", "A", "T", "DHMO", "$783.00", "08/2026", "MEDICAL", "-", "Subtotal", "Moss,Kim", "$78300]"]
    d = spark.createDataFrame([(" ".join(rng.choice(tokens) for _ in range(rng.randint(1, 14))),) for _ in range(150)], "line string")
    cells = d.select("line", F.transform(names.tokens(F.col("line")), names.classes).alias("cells")).where("size(cells) > 0")
    each = cells.select("line", F.explode(F.transform(F.sequence(F.lit(0), F.size("cells") - 1), lambda i: F.struct(names.can_begin(F.col("cells"), i).alias("can"), F.slice("cells", i + 1, 22).alias("rest")))).alias("x"))
    got = each.select("x.can", names.leading_name(F.col("x.rest")).isNotNull().alias("found")).groupBy("can").agg(F.count_if("found").alias("found"), F.count(F.lit(1)).alias("n")).collect()
    seen = {r["can"]: (r["found"], r["n"]) for r in got}
    assert seen[False][0] == 0 and seen[True][0] > 50 and seen[False][1] > seen[True][1]
