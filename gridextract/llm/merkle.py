"""A Merkle manifest of a table and the proofs of its rows, by coordinate lookup.

The rows of a group are the leaves of a tree, the roots of the groups those of one tree above. A node is named by its tree,
level and index. From its index and the size of its tree a leaf tells the coordinates of all siblings on its way up; these
are exploded, joined to the written table of nodes, ordered, concatenated and folded.

Levels are taken in bands: `band` levels at once, so that one shuffle brings the BLOCK leaves of a block together and
folds them to its top node, and the tops are the leaves of the next band. A leaf looks up siblings in its own block only,
the rest of its way is that of the top of its block, which looks it up once for all. So no node is asked for by more than
BLOCK others, wherever it stands, and the work is the number of leaves times `band`, and not the depth.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import written

#: Leaves of one block at most (as long as the fan-out is not larger).
BLOCK = 64


def encoded(value: Column) -> Column:
    """A value as text that no other sequence of values can be taken for: '-' for null, else its bytes in UTF-8, ':', it."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*fields: Column) -> Column:
    """The digest of a row."""
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _digest_of_run(nodes: Column, fanout: int):
    return lambda i: F.unhex(F.sha2(F.array_join(F.transform(F.slice(nodes, i * fanout + 1, fanout), _hex), ""), 256))


def _at_level(level: int):
    return lambda place: F.struct(F.lit(level).alias("level"), place.alias("place"))


def _is_level(level: int):
    return lambda x: x["level"] == level


def _is_before(index: Column):
    return lambda x: x["place"] < index


def _is_after(index: Column):
    return lambda x: x["place"] > index


def _joined(found: Column) -> Column:
    """Digests in the order of their places; none: an empty text."""
    return F.coalesce(F.array_join(F.transform(F.array_sort(found), lambda x: _hex(x["h"])), ""), F.lit(""))


def _level_size(n: Column, fanout: int, level: int) -> Column:
    """Nodes of a level above n nodes."""
    for _ in range(level):
        n = F.floor((n + (fanout - 1)) / fanout)
    return n


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows (a written table) with index (from 0, by order within the group, null first), n (rows of the group) and tree
    (from 0, groups by their value, null first). Spark sorts by ranges; only a row for each group and range is summed up, and
    ranges part the rows of a hot group and rows that are equal, too."""
    key = encoded(F.col(group))
    by = [F.asc_nulls_first(c) for c in dict.fromkeys([group, *order, "row"])]
    d = rows.withColumn("row", F.monotonically_increasing_id())
    d = written(d.repartitionByRange(*by).sortWithinPartitions(*by).drop("row").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    own = Window.partitionBy("key")
    runs = d.groupBy(key.alias("key"), part.alias("part")).agg(F.first(group).alias("value"), F.count(F.lit(1)).alias("n"), F.min("at").alias("begins"))
    runs = written(runs.select("key", "part", "value", "begins", F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"), F.col("n").alias("own_n"), F.sum("n").over(own).alias("n")))
    if group == "all":
        trees = runs.select("key").distinct().withColumn("tree", F.lit(0).cast("long"))
    else:
        values = written(runs.groupBy(F.col("key").alias("name")).agg(F.first("value").alias("value"), F.lit("").alias("all")))
        trees = numbered(values, "all", ["value"]).select(F.col("name").alias("key"), F.col("index").alias("tree"))
    runs = runs.join(trees, "key").select("key", "part", "tree", "n", (F.col("upto") - F.col("own_n") - F.col("begins")).alias("shift"))
    d = d.withColumn("key", key).withColumn("part", part).join(runs, ["key", "part"])
    return d.withColumn("index", F.col("at") + F.col("shift")).drop("key", "part", "shift", "at")


class Band(NamedTuple):
    """nodes: tree, index, n, h (the lowest level of the band, h binary); blocks: tree, n, block, levels (the nodes of the
    block by level up to its top)."""

    nodes: DataFrame
    blocks: DataFrame


class Forest(NamedTuple):
    """Trees over leaves: their bands from the leaves up, and their roots (tree, root)."""

    bands: list[Band]
    roots: DataFrame
    fanout: int
    levels: int

    def ended(self) -> Column:
        """Whether a tree ends in the band in which it has n nodes at the bottom."""
        return _level_size(F.col("n"), self.fanout, self.levels) <= 1

    def proofs(self, above: DataFrame) -> DataFrame:
        """tree, index, steps, and the columns of above (tree, steps, ...: what comes after a tree's root) of each leaf."""
        keep = [c for c in above.columns if c not in ("tree", "steps")]
        done = None
        for band in reversed(self.bands):
            upper = band.blocks.where(self.ended()).select("tree", "block").join(above, "tree")
            if done is not None:
                upper = upper.unionByName(done.withColumnRenamed("index", "block"))
            own = band.nodes.select("tree", "index", "n").join(self._siblings(band), ["tree", "index"], "left")
            own = own.select("tree", "index", F.floor(F.col("index") / self.fanout**self.levels).alias("block"), self._steps().alias("own"))
            done = own.join(upper, ["tree", "block"]).select("tree", "index", F.concat("own", "steps").alias("steps"), *keep)
            if band is not self.bands[0]:
                done = written(done)
        return done

    def _siblings(self, band: Band) -> DataFrame:
        """tree, index, found: level, place (index there) and h of all siblings of a node on its way to the top of its block."""
        f = self.fanout
        wanted = []
        for level in range(self.levels):
            size = _level_size(F.col("n"), f, level)
            me = F.floor(F.col("index") / f**level)
            first = me - me % f
            run = F.sequence(first, F.least(first + (f - 1), size - 1))
            wanted.append(F.when(size > 1, F.transform(F.array_remove(run, me), _at_level(level))))
        empty = F.array().cast("array<struct<level:int,place:bigint>>")
        asked = band.nodes.select("tree", "index", F.explode(F.concat(*(F.coalesce(x, empty) for x in wanted))).alias("at")).select("tree", "index", "at.level", "at.place")
        nodes = band.blocks.select("tree", "block", F.posexplode("levels").alias("level", "hs")).where(F.col("level") < self.levels)
        width = F.lit(f).cast("double") ** (F.lit(self.levels) - F.col("level"))
        nodes = nodes.select("tree", "level", F.posexplode("hs").alias("nth", "h"), (F.col("block") * width).cast("long").alias("from"))
        nodes = nodes.select("tree", "level", (F.col("from") + F.col("nth")).alias("place"), "h")
        return asked.join(nodes, ["tree", "level", "place"]).groupBy("tree", "index").agg(F.collect_list(F.struct("level", "place", "h")).alias("found"))

    def _steps(self) -> Column:
        """One step for each level: the digests before and after a node in its run, both empty where it is alone."""
        steps = []
        for level in range(self.levels):
            me = F.floor(F.col("index") / self.fanout**level)
            found = F.filter("found", _is_level(level))
            step = F.struct(_joined(F.filter(found, _is_before(me))).alias("before"), _joined(F.filter(found, _is_after(me))).alias("after"))
            steps.append(F.when(_level_size(F.col("n"), self.fanout, level) > 1, step))
        return F.filter(F.array(*steps), lambda s: s.isNotNull())


def grown(leaves: DataFrame, fanout: int = 2) -> Forest:
    """The trees over leaves (written: tree, index, n, h as hexadecimal text). While a level has more than one node, each
    run of fanout consecutive nodes becomes the digest of their digests, the last run of fewer, even of one, too."""
    levels = 1
    while fanout ** (levels + 1) <= BLOCK:
        levels += 1
    size = fanout**levels
    now, bands = leaves.select("tree", "index", "n", F.unhex("h").alias("h")), []
    roots = []
    while True:
        blocks = now.groupBy("tree", "n", F.floor(F.col("index") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("index", "h")))["h"].alias("l0"))
        for level in range(1, levels + 1):
            below = F.col(f"l{level - 1}")
            runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / fanout).cast("int"))
            blocks = blocks.withColumn(f"l{level}", F.when(_level_size(F.col("n"), fanout, level - 1) > 1, F.transform(runs, _digest_of_run(below, fanout))))
        blocks = written(blocks.select("tree", "n", "block", F.filter(F.array(*(f"l{i}" for i in range(levels + 1))), lambda x: x.isNotNull()).alias("levels")))
        bands.append(Band(now, blocks))
        tops = blocks.select("tree", F.col("block").alias("index"), _level_size(F.col("n"), fanout, levels).alias("n"), F.element_at("levels", -1)[0].alias("h"))
        roots.append(tops.where("n <= 1").select("tree", _hex(F.col("h")).alias("root")))
        now = tops.where("n > 1")
        if now.isEmpty():
            break
    out = roots[0]
    for more in roots[1:]:
        out = out.union(more)
    return Forest(bands, out, fanout, levels)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the steps of a proof give."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof_text(steps: Column) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(docs: DataFrame, fields: list[str], *, id_col: str = "doc_id", group_col: str = "lang", fanout: int = 2, claimed: Column | None = None) -> DataFrame:
    """id_col, leaf, claimed, subroot, root, steps of each row of docs.

    leaf: digest of fields; leaves of a group ascend by id_col (null first), rows of one id by their leaf. Groups ascend by
    group_col (null first, text by bytes); a null group is a group. subroot: root of the group's tree; root: of the tree over
    all subroots. steps: the proof of the row, from its leaf to the root, as digests before and after it at each level
    (folded, proof_text). claimed: another leaf to carry along, as a digest of docs' columns, which no tree is made from.
    Repeated rows are leaves each, in any order, as their leaves are equal. Empty texts are texts of no bytes. Columns beside
    fields, id_col and group_col are not read; only digests are shuffled, so long texts cost one reading. An empty table gives
    no rows.
    """
    rows = written(docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), leaf_of(*map(F.col, fields)).alias("h"), (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed")))
    leaves = written(numbered(rows, "group", ["id", "h", "claimed"]).select("tree", "index", "n", "id", "h", "claimed"))
    trees = grown(leaves, fanout)
    subroots = written(trees.roots.withColumn("all", F.lit(0).cast("long")))
    n = subroots.count()
    above = grown(subroots.select(F.col("all").alias("tree"), F.col("tree").alias("index"), F.lit(n).cast("long").alias("n"), F.col("root").alias("h")), fanout)
    none = F.array().cast("array<struct<before:string,after:string>>")
    over = above.proofs(above.roots.select("tree", none.alias("steps"), "root"))
    context = written(over.select(F.col("index").alias("tree"), "steps", F.col("root").alias("whole")).join(trees.roots, "tree").select("tree", "steps", F.col("root").alias("subroot"), F.col("whole").alias("root")))
    proofs = trees.proofs(context)
    return leaves.join(proofs, ["tree", "index"]).select(F.col("id").alias(id_col), F.col("h").alias("leaf"), "claimed", "subroot", "root", "steps")
