"""The page source, the export file, tables that change together, the change log and header fields."""

import os

import pytest
from pyspark.sql import functions as F

from gridextract.operators import edits, meta
from gridextract.operators.match import ADDED
from gridextract.sources import csv_export, page_source, roster, shared, versions

MEMBER = "file_name string, row_index int, name string, family_count int, coverage string, status string, medical_plan string, charge double, page int, flags array<string>"


class Counting:
    """Three documents; each call leaves a file that tells it."""

    def __init__(self, at):
        self.at = str(at)

    def documents(self):
        return [("a.pdf", 40), ("b.PDF", 5), ("c.txt", 9)]

    def texts(self, file_name, first, last):
        with open(f"{self.at}/{file_name}-{first}-{last}", "w"):
            pass
        for page in range(first, last + 1):
            if (file_name, page) == ("b.PDF", 4):
                raise ValueError("torn")
            yield f"{file_name} {page}"


def test_pages_are_read_by_ranges_and_filters_reach_them(spark, tmp_path):
    d = page_source.read_pages(spark, Counting(tmp_path), span=10)
    calls = lambda: sorted(os.listdir(tmp_path))
    got = {(r.file_name, r.page): (r.text, r.error) for r in d.where("page between 12 and 13 or page = 12").where("page >= 12 and page < 14").collect()}
    assert got == {("a.pdf", 12): ("a.pdf 12", None), ("a.pdf", 13): ("a.pdf 13", None)} and calls() == ["a.pdf-12-13"]
    assert [r.text for r in d.where("file_name = 'a.pdf' and page in (3, 25)").orderBy("page").collect()] == ["a.pdf 3", "a.pdf 25"]
    assert calls() == ["a.pdf-1-10", "a.pdf-12-13", "a.pdf-21-30"]
    assert d.where("page > 100").count() == 0 and len(calls()) == 3
    rows = d.where("file_name like 'b%'").collect()
    assert [r.text for r in rows if r.error is None] == ["b.PDF 1", "b.PDF 2", "b.PDF 3"] and [r.error for r in rows if r.error] == ["Failed to parse: torn"]
    assert d.where("file_name like 'a%' and page > 0").count() == 40


def export(spark, rows):
    return spark.createDataFrame(rows, f"{', '.join(f'{c} string' for c in csv_export.FIELDS)}, row_index int")


def test_export_is_one_file_of_known_bytes(spark, tmp_path):
    at = f"{tmp_path}/out.csv"
    cells = [(f"f{i % 3}", i) for i in range(50)]
    rows = [(f'N{i}, "A"', "1", "E", "A", "DHMO", "1.00", "77\n8", f, "", i) for f, i in cells]
    csv_export.write_csv(export(spark, rows).repartition(7), at)
    want = ["Name,Family Count,Coverage,Status,Medical Plan,Medical current charge,Statement ID,File Name,Bill Period"]
    want += [f'"N{i}, ""A""",1,E,A,DHMO,1.00,"77\n8",{f},' for f, i in sorted(cells)]
    with open(at, "rb") as f:
        assert f.read() == ("﻿" + "\n".join(want)).encode()
    csv_export.write_csv(export(spark, []), at)
    with open(at, "rb") as f:
        assert f.read() == ("﻿" + want[0]).encode()


def test_export_that_fails_leaves_the_older_file(spark, tmp_path):
    at = f"{tmp_path}/out.csv"
    good = export(spark, [("N", "1", "E", "A", "DHMO", "1.00", "7", "f", "", 1)])
    csv_export.write_csv(good, at)
    with open(at, "rb") as f:
        before = f.read()
    with pytest.raises(Exception, match="worn"):
        csv_export.write_csv(good.withColumn("name", F.raise_error(F.lit("worn")).cast("string")), at)
    with open(at, "rb") as f:
        assert f.read() == before
    assert sorted(x for x in os.listdir(tmp_path) if not x.endswith(".crc")) == ["out.csv"]


def test_versions_are_seen_whole_or_not_at_all(spark, tmp_path):
    at, n = str(tmp_path), lambda k: spark.range(k)
    assert versions.version(spark, at) == 0 and versions.read(spark, at) == {}
    assert versions.commit(spark, at, {"a": n(1), "b": n(2)}, about={"x": 1}) == 1
    seen = versions.read(spark, at)
    with pytest.raises(Exception, match="worn"):  # a is written, b is not
        versions.commit(spark, at, {"a": n(5), "b": n(5).select(F.raise_error(F.lit("worn")).alias("id"))})
    assert {t: d.count() for t, d in versions.read(spark, at).items()} == {"a": 1, "b": 2} and versions.version(spark, at) == 1
    assert versions.commit(spark, at, {"b": n(7)}, based_on=1) == 2
    assert {t: d.count() for t, d in versions.read(spark, at).items()} == {"a": 1, "b": 7}
    assert {t: d.count() for t, d in seen.items()} == {"a": 1, "b": 2} and versions.about(spark, at, 1) == {"x": 1}
    with pytest.raises(versions.Conflict):
        versions.commit(spark, at, {"a": n(3)}, based_on=1)


def test_working_tables_go_at_the_end(spark):
    from pathlib import Path

    with shared.working_tables():
        outer = shared.once(spark.range(3))
        with shared.working_tables():
            inner = shared.once(spark.range(4))
            files = [Path(f.removeprefix("file:")) for f in inner.inputFiles()]
            assert inner.count() == 4 and all(f.exists() for f in files)
        assert outer.count() == 3 and not any(f.exists() for f in files)


def test_a_list_of_many_names(spark, tmp_path):
    names = spark.range(1_000_000).select(F.concat(F.lit("LAST"), F.col("id").cast("string"), F.lit(", FIRST")).alias("name"))
    roster.save_roster(names, str(tmp_path), 3)
    got = roster.stored_roster(spark, str(tmp_path), names.limit(0), 3)
    assert got.count() == 1_000_000 and got.join(names, "name", "left_anti").isEmpty()


def member(f, i, name, **more):
    row = {"file_name": f, "row_index": i, "name": name, "family_count": 1, "coverage": "E", "status": "A", "medical_plan": "DHMO", "charge": 100.0, "page": 1, "flags": []} | more
    return tuple(row[c.split()[0]] for c in MEMBER.split(", "))


def test_moving_leftovers_changes_four_tables(spark):
    kept = spark.createDataFrame([(*member("f", 4, "MOSS, KIM"), "MOSS,KIM"), (*member("g", 1, "BO, AL"), "x")], f"{MEMBER}, ocr_name string")
    left = spark.createDataFrame([member("f", 1, "barberg, alice"), member("f", 2, "Nocomma"), member("g", 3, "Zed Al")], MEMBER)
    warnings = spark.createDataFrame([("f", "2 OCR rows did not match the member list and were ignored: barberg, alice; Nocomma"), ("f", "1 member on the list was not found"), ("g", "1 OCR row did not match the member list and was ignored: Zed Al")], "file_name string, warning string")
    names = spark.createDataFrame([("MOSS, KIM",)], "name string")
    picked = spark.createDataFrame([("f", 1, "barberg, alice")] * 2, "file_name string, row_index int, name string")
    got = edits.move_leftovers({"members": kept, "leftovers": left, "warnings": warnings, "roster": names}, picked)
    new = [r for r in got["members"].collect() if r.file_name == "f" and r.row_index == 5]
    assert [(r.name, r.ocr_name, r.flags) for r in new] == [("BARBERG, ALICE", "barberg, alice", [ADDED])] and got["members"].count() == 3
    assert sorted(r.name for r in got["leftovers"].collect()) == ["Nocomma", "Zed Al"]
    assert sorted(r.warning for r in got["warnings"].collect()) == ["1 OCR row did not match the member list and was ignored: Nocomma", "1 OCR row did not match the member list and was ignored: Zed Al", "1 member on the list was not found"]
    assert sorted(r.name for r in got["roster"].collect()) == ["BARBERG, ALICE", "MOSS, KIM"]


def test_replay_of_a_change_log(spark):
    uploads = spark.createDataFrame([(u, *member(f, i, n), False) for u, f, i, n in ((1, "f", 1, "A, AA"), (1, "f", 2, "B, BB"), (2, "f", 1, "C, CC"), (3, "g", 1, "D, DD"), (4, "h", 1, "E, EE"))], f"upload long, {MEMBER}, excluded boolean")
    log = [
        (0, "upsert", "h", 4, None, None, None), (1, "clear", None, None, None, None, None), (2, "upsert", "f", 1, None, None, None), (3, "edit", "f", None, 1, "charge", "5"),
        (4, "upsert", "g", 3, None, None, None), (5, "upsert", "f", 2, None, None, None), (6, "edit", "f", None, 1, "name", "X, XX"), (7, "edit", "f", None, 2, "status", "T"),
        (8, "add", "f", None, None, None, "moss, kim"), (9, "add", "f", None, None, None, "nocomma"), (10, "edit", "f", None, 2, "charge", "$7.50"), (11, "edit", "g", None, 1, "excluded", "true"), (12, "add", "f", None, None, None, "MOSS, KIM"),
    ]
    log = spark.createDataFrame(log, "seq long, kind string, file_name string, upload long, row_index int, field string, value string").orderBy(F.rand(3))
    got = sorted((r.file_name, r.row_index, r.name, r.charge, r.status, r.excluded, r["first"]) for r in edits.replay(log, uploads).collect())
    assert got == [("f", 1, "X, XX", 100.0, "A", False, 2), ("f", 2, "MOSS, KIM", 7.5, "", False, 2), ("g", 1, "D, DD", 100.0, "A", True, 4)]


def test_two_names_that_change_to_one(spark):
    base = spark.createDataFrame([("B, BB",), ("A, AA",), ("C, CC",)], "name string")
    change = spark.createDataFrame([("B, BB", "new, one"), ("A, AA", "NEW, ONE")], "name string, new_name string")
    assert sorted(r.name for r in edits.rename_in_roster(base, change).collect()) == ["B, BB", "C, CC", "NEW, ONE"]


CUSTOMERS = {
    "ACME WORKS\nConsolidated Billing ID: 123456": "ACME WORKS",
    "x\nAcme & Sons, Inc.\n\n\n 12 Main St\nconsolidated billing id 1": "x\nAcme & Sons, Inc.".split("\n")[1],
    "ACME WORKS Consolidated Billing ID: 123456": "ACME WORKS",
    "ACME WORKS\n" + "." * 81 + "\nConsolidated Billing ID": "",
    "ACME WORKS\n" + "." * 78 + "\nConsolidated Billing ID": "ACME WORKS",
    "ACME\n#1234567\nConsolidated Billing ID": "",
    "A" * 70 + "\nConsolidated Billing ID": "A" * 61,
    "ACME WORKS\nno label": "",
    "FIRST LINE\nSECOND LINE\nConsolidated Billing ID": "FIRST LINE\nSECOND LINE".split("\n")[0],
}


@pytest.mark.parametrize("text", list(CUSTOMERS))
def test_customer_is_judged_from_the_label(spark, text):
    d = spark.createDataFrame([("f", 1, text)], "file_name string, page int, text string")
    assert meta.header_fields(d).first().customer_name == CUSTOMERS[text]
