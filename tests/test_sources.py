"""Images, second readings, stored lists and views on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridextract.operators import edits, match, quality, reread
from gridextract.sources import images, pages, roster


def picture(width, height, dark=()):
    """White, with dark boxes x, y, w, h."""
    a = np.full((height, width, 4), 255, np.uint8)
    for x, y, w, h in dark:
        a[y : y + h, x : x + w, :3] = 0
    return a


def frame(spark, rows):
    return spark.createDataFrame([(f, p, a.shape[1], a.shape[0], bytearray(a.tobytes())) for f, p, a in rows], "file_name string, page int, width int, height int, rgba binary")


def test_pixel_helpers():
    a = picture(40, 20, [(0, 0, 20, 20)])
    assert images.ink_share(picture(40, 20)) == 0 and images.ink_share(a) == pytest.approx(0.5, abs=0.1)
    assert images.ink_share(np.zeros((0, 0, 4), np.uint8)) == 0
    grey = np.array([[[150, 150, 150, 255], [210, 210, 210, 255], [100, 100, 100, 255]]], np.uint8)
    assert images.prepared(grey).tolist() == [[150, 255, 0]]
    assert images.prepared(grey, "binary").tolist() == [[0, 255, 0]]
    assert images.prepared(grey, "raw").tolist() == [[150, 210, 100]]
    with pytest.raises(ValueError, match="unknown mode"):
        images.prepared(grey, "other")
    assert images.cropped(a, 10, 5, 0.2, 7.9).shape == (7, 1, 4)
    assert images.turned(np.array([[1, 2], [3, 4]]), 90).tolist() == [[3, 1], [4, 2]]
    assert images.narrowed(picture(2200, 100)).shape == (50, 1100, 4) and images.narrowed(a) is a


def test_ink_of_images(spark):
    d = frame(spark, [("f", 1, picture(32, 6, [(0, 2, 32, 2)])), ("f", 2, picture(32, 4))])
    assert {r.page: r.ink > 0 for r in images.ink(d).collect()} == {1: True, 2: False}
    assert [r.ink for r in images.pixel_rows(d.where("page = 1"), ["file_name", "page"]).orderBy("y").collect()] == [0, 0, 1, 1, 0, 0]
    assert images.pixel_rows(d.limit(0), ["file_name", "page"]).count() == 0


def test_pages_are_turned_until_a_heading_is_read(spark):
    tall, wide, bad = picture(20, 60, [(0, 0, 20, 30)]), picture(60, 20, [(0, 0, 60, 10)]), picture(61, 20, [(0, 0, 60, 10)])

    def recognise(image, kind):
        if image.shape[1] == 61:
            raise RuntimeError("no luck")
        return "Membership Detail for Group ID" if image.shape[0] > image.shape[1] else "x"

    d = frame(spark, [("f", 1, tall), ("f", 2, wide), ("f", 3, picture(30, 30)), ("g", 1, bad)])
    got = {(r.file_name, r.page): (r.text, r.error) for r in images.locate_text(d, recognise).collect()}
    assert got[("f", 1)] == got[("f", 2)] == ("Membership Detail for Group ID", None)
    assert got[("f", 3)] == ("", "Page 3 rendered blank")
    assert got[("g", 1)] == (None, "Page 1 OCR failed: no luck")


def test_each_page_is_read_once_and_as_it_is_shown(spark, tmp_path):
    calls = str(tmp_path)

    def recognise(image, kind):
        with open(f"{calls}/calls", "a") as f:
            f.write(f"{image.shape[0]}x{image.shape[1]}\n")
        return "Membership Detail for Group ID"

    rows = [("f", p, picture(20, 60 + p, [(0, 0, 20, 30)]), turn) for p, turn in ((1, 0), (2, 90), (3, 180))]
    d = spark.createDataFrame([(f, p, a.shape[1], a.shape[0], bytearray(a.tobytes()), turn) for f, p, a, turn in rows], "file_name string, page int, width int, height int, rgba binary, rotation int")
    assert images.locate_text(d, recognise).where("text is not null").count() == 3
    with open(f"{calls}/calls") as f:
        assert sorted(f.read().split()) == ["61x20", "62x20", "63x20"]


def test_second_look_reads_boxes(spark):
    words = spark.createDataFrame([("f", 4, "BARBERG,", 10.0, 100.0, 90.0, 112.0), ("f", 4, "ALICE", 100.0, 101.0, 150.0, 113.0), ("f", 4, "$5.00", 600.0, 100.0, 640.0, 112.0)], "file_name string, page int, text string, x0 double, y0 double, x1 double, y1 double")
    tables = spark.createDataFrame([("f", 4, 1000.0, 400.0)], "file_name string, page int, width double, height double")
    names = spark.createDataFrame([("f", 1, "BARBERG, ALICE"), ("f", 2, "BARBERG, ALINA"), ("f", 3, "QUINTO, ZOE")], "file_name string, ord int, name string")
    empty = spark.createDataFrame([], "file_name string, row_index int, name string, family_count int, coverage string, status string, medical_plan string, charge double, page int, flags array<string>")
    matched = match.apply_roster(names, empty)
    hints = reread.name_hints(matched.select("file_name", "row_index", "name"), words, tables).collect()
    assert [(r.row_index, r.hint, r.y0, r.y1) for r in hints] == [(1, "BARBERG, ALICE", 100.0, 113.0)]
    answers = {"name": "BARBERG, ALICE", "line": "3 N XXX-XX-0001 ES A PPO", "amount": "$750.00"}
    reader = images.field_reader(frame(spark, [("f", 4, picture(1000, 400))]), lambda image, kind: answers[kind])
    got = {r.row_index: r for r in reread.second_look(matched, words, tables, reader).collect()}
    assert sorted(got) == [1, 2, 3] and got[2].flags == got[3].flags == [match.NOT_FOUND]
    assert (got[1].coverage, got[1].status, got[1].medical_plan, got[1].charge, got[1].page, got[1].flags) == ("ES", "A", "PPO", 750.0, 4, [])
    alone = spark.createDataFrame([("f", 1, "BARBERG, ALICE", 4, " BARBERG  ALICE", "nothing"), ("f", 2, "QUINTO, ZOE", 4, None, None)], "file_name string, row_index int, name string, page int, name_text string, rest_text string")
    assert [(r.row_index, r.ocr_name, r.charge, r.flags) for r in reread.recovered(alone).collect()] == [(1, "BARBERG ALICE", None, [match.NO_CHARGE])]
    failing = images.field_reader(frame(spark, [("f", 4, picture(10, 10))]), lambda image, kind: 1 / 0)
    assert reread.second_look(matched, words, tables, failing).where(match.is_missing(F.col("flags"))).count() == 3


def test_bad_documents_are_rows(spark):
    d = spark.createDataFrame([("a", bytearray(b"one\x0ctwo")), ("b", bytearray(b"\xff"))], "file_name string, content binary")
    got = [(r.file_name, r.page, r.text, r.error is None) for r in pages.extract_pages(d, lambda b: b.decode().split("\f")).orderBy("file_name", "page").collect()]
    assert got == [("a", 1, "one", True), ("a", 2, "two", True), ("b", 0, None, False)]


def names_of(d):
    return [r.name for r in edits.in_language_order(d).collect()]


def test_roster_store_and_changes(spark, tmp_path):
    people = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    at = f"file://{tmp_path}/list"
    roster.save_roster(people("zed, al ", "Barberg, Alice"), at, 1)
    assert names_of(roster.stored_roster(spark, at, people("NEW, ONE"), 2)) == ["BARBERG, ALICE", "NEW, ONE", "ZED, AL"]
    assert names_of(roster.stored_roster(spark, at, people("NEW, ONE"), 1)) == ["BARBERG, ALICE", "ZED, AL"]
    roster.save_roster(people("BARBERG, ALICE", " "), at, 2)
    assert names_of(roster.stored_roster(spark, at, people(), 2)) == []
    base = people("BARBERG, ALICE", "ZED, AL")
    assert names_of(edits.add_to_roster(base, people("moss, kim", "nocomma", "zed, al"))) == ["BARBERG, ALICE", "MOSS, KIM", "ZED, AL"]
    change = spark.createDataFrame([("ZED, AL", "amis, bo"), ("BARBERG, ALICE", "zed, al")], "name string, new_name string")
    assert names_of(edits.rename_in_roster(base, change)) == ["AMIS, BO", "BARBERG, ALICE"]
    assert names_of(edits.remove_from_roster(base, people("ZED, AL"))) == ["BARBERG, ALICE"]
    assert edits.cleared(base).count() == 0


def test_views(spark):
    files = spark.createDataFrame([("a", [], ["1 member on the list were not found on this invoice: X", "other"]), ("b", ["bad"], ["1", "2", "3", "4"]), ("c", [], [])], "file_name string, errors array<string>, warnings array<string>")
    members = spark.createDataFrame([("a", "BARBERG, ALICE")], "file_name string, name string")
    assert [r.file_name for r in quality.match_warnings(files).collect()] == ["a"]
    assert [(r.file_name, r.reason, r.warnings) for r in quality.unread_files(files, members).orderBy("file_name").collect()] == [("b", "bad", ["1", "2", "3"]), ("c", "No membership rows found.", [])]
    assert quality.with_leftovers(members).first().n_rows == 1
    row = quality.hydrated(members).first()
    assert (row.row_index, row.coverage, row.charge, row.flags, row.excluded, row.page) == (1, "", None, [], False, 0)
    assert edits.next_index(quality.hydrated(members)).first().next_index == 2
