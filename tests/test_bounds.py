"""What is left out before the work on it, and how the work is spread."""

import random

from pyspark.sql import functions as F

from gridextract import catalog
from gridextract.functions import names
from gridextract.operators import match
from tests.conftest import SF


def test_bounds_of_scores_hold_and_leave_most_pairs_out(spark):
    rng = random.Random(4)
    part = lambda: "".join(rng.choice(("BAR", "BERG", "CEL", "LAND", "O", "WICKE", "Q", "ß", "")) for _ in range(rng.randint(1, 3)))
    made = [rng.choice(("{}, {}", "{} {}, {}", "{}.{}", "{}{}", ",{}", "{}")).replace("{}", "%s") for _ in range(90)]
    made = [m % tuple(part() for _ in range(m.count("%s"))) for m in made] + ["", ",", "AB, C", None]
    d = spark.createDataFrame([(x,) for x in made], "name string")
    known, read = d.select(F.col("name").alias("a"), match.known_parts(F.col("name")).alias("known")), d.select(F.col("name").alias("b"), match.read_parts(F.col("name")).alias("read"))
    most, most_last = match.score_bounds(match.known_bits(F.col("known")), match.read_bits(F.col("read")))
    pairs = known.crossJoin(read).select("a", "b", most.alias("most"), most_last.alias("most_last"), match.pair_score(F.col("known"), F.col("read")).alias("full"), match.last_score(F.col("known"), F.col("read")).alias("last"))
    rows = pairs.collect()
    assert [r for r in rows if (r.full or 0) > (r.most if r.most is not None else -1) and r.full or (r.last or 0) > (r.most_last if r.most_last is not None else -1) and r.last] == []

    known = catalog.roster(spark, SF)
    rows = catalog._read(spark, SF, strangers=True).select("file_name", "row_index", "name")
    n = known.join(rows.select("file_name"), "file_name").count()
    assert match._near_pairs(known, rows, match.MATCH, None).count() < n / 3


def test_names_are_only_tried_where_a_comma_can_follow(spark):
    line = "BARBERG, ALICE 1 N XXX-XX-0001 E A DHMO $1,783.00 DE LA CRUZ, ANA MARIA 2 N XXX-XX-0002 E A HSA $5.00"
    cells = spark.range(1).select(F.transform(names.tokens(F.lit(line)), names.classes).alias("cells"))
    got = cells.select(F.transform(names.starts(F.col("cells")), lambda i: F.get(F.col("cells"), i)["t"]).alias("s")).first().s
    assert got == ["BARBERG,", "DE", "LA", "CRUZ,"]


def test_work_on_few_bytes_is_spread(spark):
    """The table is one split."""
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert catalog.fused_name_split(spark, SF).rdd.getNumPartitions() == wanted
    assert catalog.comma_names(spark, SF).rdd.getNumPartitions() == wanted
