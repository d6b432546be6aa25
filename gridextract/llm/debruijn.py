"""Exact substring dedup over a compacted De Bruijn graph of word k-mers.

Windows of k words are the edges of the graph, windows of k - 1 words its nodes. Only windows that can repeat are
built: a window is named by its minimizer (the least hash of its m-word parts), equal windows have equal minimizers, so
windows whose minimizer occurs once are left out exactly. Every repeated window gets its source coordinates (its first
start, by document and word). Two windows that always follow each other, and as often, lie on a path without branches;
their first starts follow each other in one document, so such paths are compacted to runs of coordinates. Only the head
of a path is joined with its other occurrences, and covers all of the path there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .scratch import discard, settled, written
from .tokens import Words, as_long, blocks, mixed, ngrams

#: Multipliers of the rolling hashes: of minimizers, and two independent ones that name a window with 128 bits.
MINIMIZER, FIRST, SECOND = 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_MOST = np.uint64((1 << 64) - 1)


def _windows(w: Words, h: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of k words: its first word, and the first word and hash of its minimizer (the leftmost of equal
    ones)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    parts, at = ngrams(h, w.doc, m, MINIMIZER)
    full = np.full(len(h), _MOST, np.uint64)
    full[at] = parts
    least, where = full[:n].copy(), np.arange(n)
    for j in range(1, k - m + 1):
        less = np.flatnonzero(full[j : n + j] < least)
        least[less] = full[less + j]
        where[less] = less + j
    inside = w.doc[:n] == w.doc[k - 1 :]
    return np.flatnonzero(inside), where[inside], least[inside]


def _lists(doc: np.ndarray, n: int, values: np.ndarray) -> pa.ListArray:
    """values, ordered by doc, as one list for each of n documents."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pa.array(as_long(values)))


def _minimizers(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in blocks(batch.column("text")):
                h = w.hashes()
                nth = (np.arange(len(h)) - w.word_starts()[w.doc]).astype(np.uint64)
                whole = np.zeros((2, len(w.n)), np.uint64)
                full = np.flatnonzero(w.n)
                if len(h):
                    whole[0, full] = np.add.reduceat(mixed(h + nth * np.uint64(FIRST)), w.word_starts()[full])
                    whole[1, full] = np.add.reduceat(mixed(h ^ nth * np.uint64(SECOND)), w.word_starts()[full])
                _, where, least = _windows(w, h, k, m)
                at, one = np.unique(where, return_index=True)
                doc, least = w.doc[at], least[one]
                order = np.lexsort((least, doc))
                doc, least = doc[order], least[order]
                repeat = np.append(False, (doc[1:] == doc[:-1]) & (least[1:] == least[:-1]))[: len(doc)]
                rows = batch.slice(w.first, w.last - w.first)
                yield pa.RecordBatch.from_arrays([
                    rows.column("id"), rows.column("v"), *(pa.array(as_long(x)) for x in whole), pa.array(w.n.astype(np.int64)),
                    _lists(doc[~repeat], len(w.n), least[~repeat]), _lists(doc[repeat], len(w.n), least[repeat])],
                    ["id", "v", "c1", "c2", "n_words", "minis", "twice"])

    return run


def _edges(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("minis")
            flat, cut = known.values.to_numpy(zero_copy_only=False).view(np.uint64), known.offsets.to_numpy()
            for w in blocks(batch.column("text")):
                h = w.hashes()
                at, _, least = _windows(w, h, k, m)
                if not len(at):
                    continue
                doc = w.doc[at]
                ends = np.searchsorted(doc, np.arange(len(w.n) + 1))
                live = np.zeros(len(at), bool)
                for d in np.unique(doc):
                    live[ends[d] : ends[d + 1]] = np.isin(least[ends[d] : ends[d + 1]], flat[cut[w.first + d] : cut[w.first + d + 1]])
                h1, h2 = ngrams(h, w.doc, k, FIRST)[0], ngrams(h, w.doc, k, SECOND)[0]
                after = np.zeros(len(at), np.uint64)  # 0: the end of the document
                follows = np.flatnonzero(doc[1:] == doc[:-1])
                after[follows] = h1[follows + 1]
                start = (at - w.word_starts()[doc]).astype(np.int32)
                live = np.flatnonzero(live)
                for lo in range(0, len(live), 1 << 17):
                    i = live[lo : lo + (1 << 17)]
                    begins = np.flatnonzero(np.append(True, (np.diff(i) != 1) | (np.diff(doc[i]) != 0)))
                    cut_at = pa.array(np.append(begins, len(i)).astype(np.int32))
                    row = pa.array(doc[i[begins]] + w.first)
                    last = after[i[np.append(begins[1:], len(i)) - 1]]
                    yield pa.RecordBatch.from_arrays([
                        batch.column("id").take(row), batch.column("v").take(row), pa.array(start[i[begins]]),
                        *(pa.ListArray.from_arrays(cut_at, pa.array(as_long(x[i]))) for x in (h1, h2)), pa.array(as_long(last))], ["id", "v", "at", "h1", "h2", "last"])

    return run


def _versions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text (null: empty) and v, which tells rows of one id and different texts apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("v"))


def _on(a: DataFrame, b: DataFrame):
    return a["id"].eqNullSafe(b["id"]) & (a["v"] == b["v"])


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 20, m: int = 8) -> DataFrame:
    """id, v, at, n, first_id, first_at: the n words of a text from word `at` on also start at word first_at of
    first_id, which is earlier: a smaller id (null is the smallest), or the same id further left. v is the text's hash.

    Together the spans cover exactly the words of all windows of k words that also start earlier. Of texts with the
    same words, that with the smallest id is searched; each other is one span if it has k words.
    """
    source = _versions(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType
    field = lambda name, of: T.StructField(name, of)
    longs = lambda *names: [field(c, T.LongType()) for c in names]
    key = [field("id", kind), *longs("v")]

    many = T.ArrayType(T.LongType())
    minis = written(source.mapInArrow(_minimizers(k, m), T.StructType([*key, *longs("c1", "c2", "n_words"), field("minis", many), field("twice", many)])).where(F.col("n_words") >= k))
    # rows of the same words are told by c1 and c2, 128 bits; a minimizer that only such rows share does not repeat
    names = minis.select("id", "v", "c1", "c2", "n_words")
    # what is joined back to the rows it was made from is a table of its own here and below: the join then deals out
    # both sides anew, and Spark splits the rows of one hot key
    copied = written(names.groupBy("c1", "c2").agg(F.min(F.struct("id")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    placed = written(names.join(copied, ["c1", "c2"], "left"))
    is_first = F.col("least").isNull() | F.col("id").eqNullSafe(F.col("least.id"))
    seen = minis.select("c1", F.explode("minis").alias("mini"), F.lit(False).alias("twice")).union(minis.select("c1", F.explode("twice"), F.lit(True)))
    again = seen.groupBy("mini").agg(F.min("c1").alias("lo"), F.max("c1").alias("hi"), F.max("twice").alias("twice")).where("twice or lo <> hi").select("mini")
    again = written(again)
    by_row = minis.select("id", "v", F.explode("minis").alias("mini")).join(again, "mini").groupBy("id", "v").agg(F.collect_set("mini").alias("minis"))
    own = placed.where(is_first).select("id", "v").distinct()
    by_row = written(by_row.join(own, _on(by_row, own), "left_semi"))
    discard(minis)

    edges = source.join(by_row, _on(source, by_row)).select(source["id"], source["v"], "text", "minis")
    # a row for each run of windows in a document, so that what comes after a window is in the row
    runs = written(edges.mapInArrow(_edges(k, m), T.StructType([*key, field("at", T.IntegerType()), field("h1", many), field("h2", many), *longs("last")])))
    after = F.concat(F.slice("h1", 2, F.size("h1")), F.array("last"))
    edges = runs.select("id", "v", F.col("at").alias("run_at"), F.posexplode(F.arrays_zip("h1", "h2", after.alias("next"))).alias("nth", "e"))
    edges = edges.select("id", "v", (F.col("run_at") + F.col("nth")).alias("at"), "e.h1", "e.h2", "e.next")
    repeated = edges.groupBy("h1").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "at")).alias("first"), F.min("next").alias("next"), F.max("next").alias("other")).where("n > 1")
    repeated = repeated.select("h1", "n", F.col("first.id").alias("first_id"), F.col("first.at").alias("first_at"), F.when(F.col("next") == F.col("other"), F.col("next")).alias("next"))

    # compaction: the window before, at the source, is always followed by this one, and as often as this one occurs
    along = Window.partitionBy("first_id").orderBy("first_at", "h1")
    joined = (F.lag("first_at").over(along) == F.col("first_at") - 1) & (F.lag("next").over(along) == F.col("h1")) & (F.lag("n").over(along) == F.col("n"))
    paths = repeated.withColumn("path", F.sum(F.when(joined, 0).otherwise(1)).over(along))
    heads = paths.groupBy("first_id", "path").agg(F.count(F.lit(1)).alias("windows"), F.min(F.struct("first_at", "h1")).alias("head"))
    heads = written(heads.select("head.h1", "windows"))
    # verification: of windows whose first hashes agree, those whose second ones do, too, have one source. A window whose
    # first hash stood for two has two successors, so it is a path by itself
    found = written(edges.select("h1", "h2", "id", "v", "at").join(heads, "h1"))
    first = written(found.groupBy("h1", "h2").agg(F.min(F.struct("id", "at")).alias("first")))
    spans = found.join(first, ["h1", "h2"]).where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("at") == F.col("first.at"))))
    spans = spans.select("id", "v", "at", (F.col("windows") + (k - 1)).cast("int").alias("n"), F.col("first.id").alias("first_id"), F.col("first.at").alias("first_at"))
    copies = placed.where(~is_first).select("id", "v", F.lit(0).alias("at"), F.col("n_words").cast("int").alias("n"), F.col("least.id").alias("first_id"), F.lit(0).alias("first_at"))
    return spans.union(copies)


def drop_repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 20) -> DataFrame:
    """id_col, n_words, n_removed, kept, kept_sha256 for each row of docs; kept: the words outside all repeated spans,
    joined by a space.

    Windows are judged on the input. Null texts have no words. Rows with equal id and text are one place, so neither is
    a copy of the other; rows with an id in common but different texts repeat each other only at different words. A
    null id comes before all others. Other columns are not read. Empty table: no rows.
    """
    source = _versions(docs, id_col, text_col)
    span = F.shiftleft(F.col("at").cast("long"), 32) + F.col("n")
    spans = settled(lambda: repeated_spans(docs, id_col=id_col, text_col=text_col, k=k).groupBy("id", "v").agg(F.collect_set(span).alias("spans")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans").fill_null([])
            flat, at = spans.values.to_numpy(zero_copy_only=False), spans.offsets.to_numpy()
            for w in blocks(batch.column("text")):
                starts, kept, digests, removed = w.word_starts(), [], [], []
                data = w.buf.tobytes()
                for d in range(len(w.n)):
                    own, lo, hi = flat[at[w.first + d] : at[w.first + d + 1]], int(starts[d]), int(starts[d + 1])
                    stay = np.ones(hi - lo, bool)
                    if len(own):
                        edge = np.zeros(hi - lo + 1, np.int64)
                        np.add.at(edge, own >> 32, 1)
                        np.add.at(edge, (own >> 32) + (own & 0xFFFFFFFF), -1)
                        stay = np.cumsum(edge[:-1]) == 0
                    i = np.flatnonzero(stay) + lo
                    text = b" ".join([data[a:b] for a, b in zip(w.start[i].tolist(), w.end[i].tolist(), strict=True)])
                    kept.append(text.decode())
                    digests.append(hashlib.sha256(text).hexdigest())
                    removed.append(hi - lo - len(i))
                rows = batch.slice(w.first, w.last - w.first)
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(w.n.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(digests, pa.string())], [id_col, "n_words", "n_removed", "kept", "kept_sha256"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("kept_sha256", T.StringType())])
    return source.join(spans, _on(source, spans), "left").select(source["id"], "text", "spans").mapInArrow(cut, schema)
