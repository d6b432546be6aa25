"""Benchmark decontamination by greedy string tiling over Karp-Rabin seeds.

Tokens are runs of letters and digits, lower-cased. Documents and benchmark items are joined on the hashes of all their
runs of `seed` tokens; seeds of a pair that follow each other are one match. Of these, the longest one whose tokens are
still free on both sides becomes a tile and is marked, again and again until no match of `seed` free tokens is left. An item is leaked if its tiles cover
min_cover of its tokens, in whatever order they come in the document.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .scratch import unused
from .tokens import as_long, blocks, ngrams

#: Multipliers of the two hashes of a seed.
KARP_RABIN, CHECK = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
#: Distinct seeds of the benchmark up to which tasks get them all (8 bytes each) to test membership before the join.
MEMBERS = 1 << 21


def _seeds(seed: int, among):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if among is None else among.value
        for batch in batches:
            for w in blocks(pc.utf8_lower(batch.column("text")), letters=True):
                words = w.hashes()
                h, at = ngrams(words, w.doc, seed, KARP_RABIN)
                check = ngrams(words, w.doc, seed, CHECK)[0]
                if known is not None:
                    near = np.minimum(np.searchsorted(known, h), len(known) - 1) if len(known) else np.zeros(len(h), np.int64)
                    hit = known[near] == h if len(known) else np.zeros(len(h), bool)
                    h, at, check = h[hit], at[hit], check[hit]
                doc = w.doc[at]
                row = pa.array(doc + w.first)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(row), batch.column("v").take(row), pa.array((at - w.word_starts()[doc]).astype(np.int32)),
                    pa.array(w.n[doc].astype(np.int32)), pa.array(as_long(h)), pa.array(as_long(check))], ["id", "v", "at", "n", "seed", "check"])

    return run


def seeds(rows: DataFrame, id_col: str, text_col: str, seed: int, among=None) -> DataFrame:
    """id, v (hash of the text, which tells rows of one id apart), at, n (tokens of the text), seed and check: two hashes of
    the same tokens, 128 bits together. among: a broadcast of sorted seeds; only these are given."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    longs = ("v", T.LongType()), ("at", T.IntegerType()), ("n", T.IntegerType()), ("seed", T.LongType()), ("check", T.LongType())
    schema = T.StructType([T.StructField("id", rows.schema[id_col].dataType), *(T.StructField(*x) for x in longs)])
    return rows.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("v"), text.alias("text")).mapInArrow(_seeds(seed, among), schema)


def tiles(item_at: np.ndarray, doc_at: np.ndarray, n: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of maximal matches (first token in the item, in the document, tokens): the same of each tile.
    Of equally long matches that first in the item, then in the document, goes first."""
    if not len(n):
        return []
    heap = list(zip((-n).tolist(), item_at.tolist(), doc_at.tolist(), strict=True))
    heapq.heapify(heap)
    least = int(doc_at.min())
    in_item, in_doc, out = np.zeros(int((item_at + n).max()), bool), np.zeros(int((doc_at + n).max()) - least, bool), []
    while heap:
        k, a, b = heapq.heappop(heap)
        k = -k
        taken = in_item[a : a + k] | in_doc[b - least : b - least + k]
        if not taken.any():
            in_item[a : a + k] = in_doc[b - least : b - least + k] = True
            out.append((a, b, k))
            if in_item.all():
                break
            continue
        # what is still free of it goes back
        edge = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]])))
        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if y - x >= seed:
                heapq.heappush(heap, (x - y, a + x, b + x))
    return out


def matches(hits: DataFrame, seed: int) -> DataFrame:
    """id, v, item, item_v, item_n, item_at, doc_at, tokens: the maximal matches that common seeds make up. Seeds of one
    pair that lie on one diagonal, one behind the other, are one match; diagonals are dealt out by themselves, so a pair of
    texts that repeat themselves is the work of many tasks, and only its matches come together."""
    pair = ("id", "v", "item", "item_v", "item_n")
    d = hits.select(*pair, "item_at", (F.col("item_at") - F.col("at")).alias("diagonal"))
    # repeated rows have equal ranks
    d = d.withColumn("run", F.col("item_at") - F.dense_rank().over(Window.partitionBy(*pair, "diagonal").orderBy("item_at")))
    d = d.groupBy(*pair, "diagonal", "run").agg(F.min("item_at").alias("item_at"), (F.max("item_at") - F.min("item_at") + seed).alias("tokens"))
    return d.select(*pair, "item_at", (F.col("item_at") - F.col("diagonal")).alias("doc_at"), "tokens")


def leaked_items(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed: int = 5, min_cover: float = 0.5) -> DataFrame:
    """id_col, v, item_col, coverage, n_tiles, longest, tiles: one row for each document and item that it leaks.

    v is the hash of the document's text, so rows of one id are told apart; repeated rows give one. Items or documents
    of fewer than `seed` tokens, null and empty texts match nothing. Null ids are ids like any other. An empty table on
    either side gives no rows. The benchmark may be of any size: small ones are also used to test seeds before the join.
    The work on one document and one item is the number of places at which their seeds agree.
    """
    spark = docs.sparkSession
    test = seeds(benchmark, item_col, item_text_col, seed).select(F.col("id").alias("item"), F.col("v").alias("item_v"), F.col("at").alias("item_at"), F.col("n").alias("item_n"), "seed", "check").distinct()
    distinct = test.select("seed").distinct().limit(MEMBERS + 1)
    few = distinct.count() <= MEMBERS
    among = spark.sparkContext.broadcast(np.sort(distinct.toArrow()["seed"].to_numpy().view(np.uint64))) if few else None
    hits = seeds(docs, id_col, text_col, seed, among).join(F.broadcast(test) if few and test.count() <= MEMBERS else test, ["seed", "check"])
    pairs = matches(hits, seed).groupBy("id", "v", "item", "item_v", "item_n").agg(F.collect_list(F.struct("item_at", "doc_at", "tokens")).alias("hits"), F.sum("tokens").alias("most"))
    pairs = pairs.where(F.col("most") >= min_cover * F.col("item_n"))
    tile = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("item_at", "doc_at", "n")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for own in batch.column("hits"):
                own = own.values
                found.append(tiles(*(own.field(c).to_numpy() for c in ("item_at", "doc_at", "tokens")), seed))
            kinds = pa.list_(pa.struct([("item_at", pa.int32()), ("doc_at", pa.int32()), ("n", pa.int32())]))
            as_rows = pa.array([[dict(zip(("item_at", "doc_at", "n"), t, strict=True)) for t in x] for x in found], kinds)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "v", "item", "item_n")), as_rows], ["id", "v", "item", "item_n", "tiles"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("v", T.LongType()), T.StructField("item", benchmark.schema[item_col].dataType), T.StructField("item_n", T.IntegerType()), T.StructField("tiles", tile)])
    tiled = pairs.select("id", "v", "item", "item_n", "hits").mapInArrow(run, schema)
    covered = F.aggregate("tiles", F.lit(0), lambda s, x: s + x["n"])
    out = tiled.select(F.col("id").alias(id_col), "v", F.col("item").alias(item_col), (covered / F.col("item_n")).alias("coverage"), F.size("tiles").alias("n_tiles"), F.array_max(F.col("tiles")["n"]).alias("longest"), "tiles")
    return out.where(F.col("coverage") >= min_cover)


def drop_leaking(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """docs without the documents that leak an item; the columns of docs."""
    own, v = unused(docs, "id_"), unused(docs, "v_")
    bad = leaked_items(docs, benchmark, id_col=id_col, text_col=text_col, **params).select(F.col(id_col).alias(own), F.col("v").alias(v)).distinct()
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.join(bad, docs[id_col].eqNullSafe(bad[own]) & (F.xxhash64(text) == bad[v]), "left_anti")
