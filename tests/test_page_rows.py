"""Both passes over a page at once: the rows of each by itself, and columns that are put together once."""

import pytest

from gridextract.functions import names
from gridextract.operators import rows
from gridextract.plans.fixtures import HEADING

LINE, NEXT = "BARBERG, ALICE 1 N XXX-XX-0001 E A DHMO $783.00", "CELCASTER, BRUNO 4 N XXX-XX-0002 ESD A PPO $912.00"
PAGES = {
    "plain": f"{HEADING}\n{LINE}\n{NEXT}\nSubtotal $1.00",
    "a row over two lines": f"{HEADING}\nBARBERG, ALICE 1 N XXX-XX-0001\nE A DHMO $783.00\n{NEXT}",
    "amounts of other months, in the line and after it": f"{HEADING}\n{LINE} 07/2026 MEDICAL $-72.00\n{NEXT}\n07/2026 MEDICAL $-1,072.00\n{LINE}",
    "no amount but in the next line": f"{HEADING}\n{LINE.replace(' $783.00', '')}\n$55.00 HSA\n{NEXT}",
    "an amount in a token with a code": f"{HEADING}\n{LINE.replace(' E A ', ' E$100.00 A ')}\n{NEXT}",
    "no comma": f"{HEADING}\n{LINE.replace(',', '')}\n{NEXT.replace(', ', '.')}",
    "a row in the first line": f"{LINE}\n{NEXT}",
    "a beginning of one word": f"BARBERG\nALICE 1 N\n{LINE}\n{NEXT}",
    "no stop in the line": f"{HEADING}\nBARBERG, ALICE\n1 N XXX-XX-0001 E A DHMO $783.00\n{NEXT}",
    "two rows in a line, and a long one": f"{HEADING}\n{LINE} {NEXT}\n{LINE} AND MORE WORDS THAN A ROW CAN TAKE FROM A STREAM UNTIL $55.00\n{NEXT}",
    "blanks of other kinds": f"{HEADING}\n(  {LINE}\n{NEXT}",
    "empty": "",
    "none": None,
}


@pytest.fixture
def pages(spark):
    twice = [("plain", 1, PAGES["a row in the first line"])]
    return spark.createDataFrame([(name, 1, text) for name, text in PAGES.items()] + twice, "file_name string, page int, text string")


def test_both_passes_at_once_give_the_rows_of_each(pages):
    shown = lambda d: sorted(map(str, d.collect()))
    lines = rows.text_lines(pages)
    want = rows.line_rows(lines).unionByName(rows.stream_rows(lines))
    got = rows.page_rows(pages)
    assert got.dtypes == want.dtypes and shown(got) == shown(want) and len(got.where("pass = 1").collect()) > 15


def test_columns_of_a_page_are_put_together_once(pages, monkeypatch):
    """A stream reads the pages of each batch; it took 8 seconds of the driver each time."""
    rows.page_rows(pages)
    calls, real = [], names.classes
    monkeypatch.setattr(names, "classes", lambda token: calls.append(1) or real(token))
    rows.page_rows(pages)
    assert not calls
