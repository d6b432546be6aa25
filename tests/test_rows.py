"""Rows of pages, where single functions do not show what goes wrong."""

from gridextract.operators import dedupe, rows
from gridextract.plans.fixtures import HEADING


def test_row_without_amount_takes_none_of_the_next_name(spark):
    """103 and 1,022 would pass for one amount with a digit lost."""
    lines = "BARBERG, ALICE 2 N XXX-XX-0001 ESD A PPO $10300", "BARBERG, ALICES 2 N XXX-XX-0000 E", "CELCASTER, BRUNO 3 N XXX-XX-0002 ED A DHMO $1,022.00", "DUN FIELD, CARLA 1 N XXX-XX-0003 E", "FALLAND, ERIK 1 N XXX-XX-0004 E A HSA $75.00"
    text = spark.createDataFrame([("f", 1, "\n".join((HEADING, *lines)))], "file_name string, page int, text string")
    stream = {r["name"]: (r.family_count, r.coverage, r.charge) for r in rows.stream_rows(rows.text_lines(text)).collect()}
    assert stream == {"BARBERG, ALICE": (2, "ESD", 103.0), "BARBERG, ALICES": (2, "E", None), "CELCASTER, BRUNO": (3, "ED", 1022.0), "DUN FIELD, CARLA": (1, "E", None), "FALLAND, ERIK": (1, "E", 75.0)}
    members = {r["name"]: r.charge for r in dedupe.members_of(rows.page_rows(text)).collect()}
    assert members == {"BARBERG, ALICE": 103.0, "CELCASTER, BRUNO": 1022.0, "DUN FIELD, CARLA": None, "FALLAND, ERIK": 75.0}
