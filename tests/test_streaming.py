"""Files as a stream: replaced, emptied, repeated, failing and split arrivals."""

import uuid

import pytest
from pyspark.sql import functions as F

from gridextract.plans.fixtures import HEADING
from gridextract.streaming import ingest

LINE = "BARBERG, ALICE 1 N XXX-XX-0001 E A DHMO $783.00"
OTHER = "CELCASTER, BRUNO 4 N XXX-XX-0002 ESD A DHMO $912.00"


def page(*lines):
    return "\n".join([HEADING, *lines, "Subtotal $1.00"])


def read(pages):
    """The names of lines, in place of the whole parser."""
    d = pages.select("file_name", F.explode(F.split("text", "\n")).alias("line")).where("line like '%XXX-XX-%'")
    return d.select("file_name", F.regexp_extract("line", r"^\S+ \S+", 0).alias("name"))


@pytest.fixture
def stream(spark, tmp_path):
    """Uploads one batch of arrivals (file_name, arrival, page, pages, text, error) and tells rows, files and metrics."""

    def upload(*rows, **options):
        spark.createDataFrame(rows, ingest.ARRIVAL).write.mode("append").parquet(f"{tmp_path}/in/{uuid.uuid4().hex}")
        run = ingest.ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", read=read, **options)
        run.awaitTermination()
        names = sorted((r.file_name, r.name) for r in ingest.current(spark, f"{tmp_path}/out").collect())
        files = {r.file_name: (r.version, r.status, r.error, r.n_rows, r["first"]) for r in ingest.files(spark, f"{tmp_path}/out").collect()}
        return names, files, ingest.progress(run)

    return upload


def test_a_file_that_comes_again_without_rows_loses_its_rows(stream):
    names, files, seen = stream(("f", 1, 1, 1, page(LINE), None), ("g", 2, 1, 1, page(OTHER), None))
    assert names == [("f", "BARBERG, ALICE"), ("g", "CELCASTER, BRUNO")] and seen == [{"batch": 0, "new": 2, "repeated": 0, "failed": 0, "pages": 2}]
    names, files, _ = stream(("f", 3, 1, 1, page(), None))
    assert names == [("g", "CELCASTER, BRUNO")] and files["f"] == (2, "new", None, 0, 1)
    names, files, _ = stream(("f", 4, 0, 0, None, None))
    assert files["f"] == (3, "new", None, 0, 1)
    names, files, seen = stream(("f", 5, 1, 1, page(LINE, OTHER), None), ("g", 6, 1, 1, page(OTHER), None))
    assert names == [("f", "BARBERG, ALICE"), ("f", "CELCASTER, BRUNO"), ("g", "CELCASTER, BRUNO")]
    assert files == {"f": (4, "new", None, 2, 1), "g": (1, "new", None, 1, 2)} and seen[0] | {"batch": 0} == {"batch": 0, "new": 1, "repeated": 1, "failed": 0, "pages": 1}


def test_a_failing_file_is_a_row_and_touches_no_other(spark, stream, tmp_path):
    stream(("f", 1, 1, 1, page(LINE), None))
    names, files, seen = stream(("f", 2, 0, 0, None, "Failed to parse: torn"), ("g", 2, 1, 1, page(OTHER), None))
    assert names == [("g", "CELCASTER, BRUNO")] and files["f"] == (2, "failed", "Failed to parse: torn", 0, 1)
    assert seen[0] | {"batch": 0} == {"batch": 0, "new": 1, "repeated": 0, "failed": 1, "pages": 1}
    assert [(r.file_name, r.error) for r in ingest.failures(spark, f"{tmp_path}/out").collect()] == [("f", "Failed to parse: torn")]
    assert stream(("f", 3, 0, 0, None, "Failed to parse: torn"))[2][0]["repeated"] == 1
    names, files, _ = stream(("f", 4, 1, 1, page(LINE), None))
    assert ("f", "BARBERG, ALICE") in names and files["f"] == (3, "new", None, 1, 1)


def test_pages_of_one_upload_in_two_batches_and_late_uploads(stream):
    names, files, _ = stream(("f", 1, 1, 1, page(LINE), None))
    names, files, seen = stream(("f", 3, 1, 2, page(OTHER), None))
    assert names == [("f", "BARBERG, ALICE")] and seen[0]["new"] == 0  # waits for its second page
    names, files, _ = stream(("f", 2, 1, 1, page(), None))
    assert names == [("f", "BARBERG, ALICE")]  # older than what is waited for
    names, files, _ = stream(("f", 3, 2, 2, page(LINE), None))
    assert names == [("f", "BARBERG, ALICE"), ("f", "CELCASTER, BRUNO")] and files["f"] == (2, "new", None, 2, 1)
    names, files, _ = stream(("f", 2, 1, 1, page(), None))
    assert len(names) == 2
    names, files, _ = stream(("f", 4, 1, 1, page(LINE), None), ("f", 5, 1, 1, page(OTHER), None))
    assert names == [("f", "CELCASTER, BRUNO")]  # the last of two in one batch


def test_batches_of_few_files(stream):
    names, files, seen = stream(*((f"f{i}", i, 1, 1, page(LINE), None) for i in range(6)), max_files=1)
    assert len(names) == 6 and sum(s["new"] for s in seen) == 6 and len(seen) > 1
