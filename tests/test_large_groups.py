"""Merging and assignment of large groups give what folding them whole gives."""

import random

import pytest
from pyspark.sql import functions as F

from gridextract.operators import dedupe, linked, match

SCHEMA = "file_name string, page int, row_index int, name string, family_count int, coverage string, status string, medical_plan string, charge double, flags array<string>"
KEYS, ORDER = ["file_name"], ["page", "row_index"]


def typed(rng, name):
    """name, some of the time with an edit or two."""
    for _ in range(rng.choice((0, 0, 1, 1, 2))):
        i, c = rng.randrange(len(name)), rng.choice("ABE")
        name = rng.choice((name[:i] + c + name[i + 1 :], name[:i] + name[i + 1 :], name[:i] + c + name[i:]))
    return name


def random_rows(seed, n, people):
    rng = random.Random(seed)
    known = [f"{rng.choice(('BARBERG', 'CELCASTER', 'ABELANDER', 'MO'))}{''.join(rng.choice('ABE') for _ in range(rng.randint(0, 3)))}, {rng.choice(('ALICE', 'BRUNO', 'ED', ''))}" for _ in range(people)]
    known += ["", "17", "A", None]
    out = []
    for i in range(n):
        name = rng.choice(known)
        name = typed(rng, name) if name and len(name) > 3 else name
        charge, flags = rng.choice((None, 0.0, 100.0, 250.0)), rng.choice(([], ["Missing coverage"], None))
        # places repeat: rows of one place are taken by what they hold
        out.append((rng.choice(("f", "f", "g", None)), i // 7, i % 5, name, rng.choice((None, 1, 2)), rng.choice(("", "E")), rng.choice(("", "A")), rng.choice(("", "DHMO")), charge, flags))
    return out


def found(d):
    return sorted((str(tuple(r)) for r in d.select("file_name", "row_index", *dedupe.FIELDS).collect()))


@pytest.mark.parametrize("seed, small", [(0, 0), (1, 90), (2, 1000)])
def test_large_groups_are_merged_as_small_ones(spark, seed, small):
    d = spark.createDataFrame(random_rows(seed, 260, 40), SCHEMA)
    want = found(dedupe.dedupe(d, KEYS, ORDER))
    assert 20 < len(want) < 240
    assert found(dedupe.dedupe_large(d, KEYS, ORDER, small=small)) == want


def test_no_rows_and_extra_columns(spark):
    d = spark.createDataFrame(random_rows(5, 30, 4), SCHEMA).withColumns({"node": F.lit("x"), "component": F.lit(1), "_part": F.lit(2), "key": F.lit(3)})
    assert found(dedupe.dedupe_large(d, KEYS, ORDER, small=0)) == found(dedupe.dedupe(d, KEYS, ORDER))
    assert dedupe.dedupe_large(d.limit(0), KEYS, ORDER, small=0).count() == 0


def test_one_file_of_a_hundred_thousand_rows(spark):
    """Every person twice, the second time with a letter more and the charge that the first lacks; a third of all rows is one person."""
    n = 33_334
    k = F.col("id")
    word = lambda salt: F.translate(F.substring(F.md5(F.concat(k.cast("string"), F.lit(salt))), 1, 9), "0123456789", "ghijklmnop")
    person = spark.range(n).withColumn("name", F.upper(F.concat(word("a"), F.lit(", "), word("b"))))
    one = person.select(k.alias("row_index"), "name", F.lit(None).cast("double").alias("charge"))
    two = person.select((k + n).alias("row_index"), F.concat("name", F.lit("S")).alias("name"), F.lit(5.0).alias("charge"))
    hot = spark.range(n).select((k + 2 * n).alias("row_index"), F.lit("BARBERG, ALICE").alias("name"), F.lit(None).cast("double").alias("charge"))
    d = one.union(two).union(hot).select(
        F.lit("f").alias("file_name"), F.lit(1).alias("page"), F.col("row_index").cast("int").alias("row_index"), "name", F.lit(1).alias("family_count"), F.lit("E").alias("coverage"),
        F.lit("A").alias("status"), F.lit("DHMO").alias("medical_plan"), "charge", F.array().cast("array<string>").alias("flags"))
    got = dedupe.dedupe_large(d, KEYS, ORDER)
    s = got.agg(F.count(F.lit(1)), F.count_if(F.col("charge") == 5.0), F.count_if(F.col("name").endswith("S")), F.min("row_index"), F.max("row_index"), F.count_distinct("row_index")).first()
    assert tuple(s) == (n + 1, n, n, 1, n + 1, n + 1)
    assert got.where("name = 'BARBERG, ALICE'").first()["row_index"] == n + 1


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)] + [(200, 200)]
    of = {x: x for a, b in links for x in (a, b)}
    for _ in of:
        for a, b in links:
            of[a] = of[b] = min(of[a], of[b])
    linked_nodes = {x for a, b in links if a != b for x in (a, b)}
    got = {(r.node, r.component) for r in linked.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(x, of[x]) for x in linked_nodes}
    assert linked.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_greedy(pairs):
    """Best score, quality, then the order of both; each side of a file once."""
    taken, ords, rows = set(), set(), set()
    for f, o, r, _, _ in sorted(pairs, key=lambda p: (-p[3], -p[4], p[1], p[2])):
        if (f, o) not in ords and (f, r) not in rows:
            taken.add((f, o, r))
            ords.add((f, o))
            rows.add((f, r))
    return taken


PAIRS = "file_name string, ord int, row_index int, score double, quality int"


@pytest.mark.parametrize("most", [0, 60, 10_000])
def test_rounds_take_the_pairs_that_one_fold_takes(spark, most):
    rng = random.Random(most)
    pairs = list({(f, o, r): (f, o, r, rng.choice((0.6, 0.7, 0.8, 0.9)), rng.choice((0, 8))) for f in ("f", "g") for o, r in ((rng.randrange(20), rng.randrange(25)) for _ in range(120 if f == "f" else 40))}.values())
    # a chain: each pair waits for the one before it
    pairs += [("chain", i // 2, (i + 1) // 2, 0.9 - i / 1000, 0) for i in range(9)]
    got = {(r.file_name, r.ord, r.row_index) for r in match.greedy(spark.createDataFrame(pairs, PAIRS), most).collect()}
    assert got == plain_greedy(pairs)


def test_no_pairs(spark):
    assert match.greedy(spark.createDataFrame([], PAIRS), 0).count() == 0


def test_query_of_one_large_file_against_plain_greedy(spark, duck):
    from gridextract import catalog
    from tests.conftest import SF

    pairs = duck.sql("select 'all', l_orderkey, l_partkey, max(l_discount), cast(max(l_quantity) as int) from lineitem group by all").fetchall()
    assert len(pairs) > match.FOLDED_PAIRS
    assert {("all", r.ord, r.row_index) for r in catalog.assign_large(spark, SF).collect()} == plain_greedy(pairs)
