"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Terms are all lower-cased words (runs of letters and digits) of all examples. A term weighs (1 + log of its count) * idf.
Inverse document frequencies count all documents; norms are those of whole texts; terms that no example has count in them
as terms of a single document. Search and evidence know no labels.

Common terms are scored for all examples at once. Examples lie in blocks; the greatest weight of each other term in each
block bounds what it can add there, so only blocks that can still reach the k best are searched for them, and the result is
exact. Equal cosines go by the ids of the examples.

The votes of the nearest examples are weighted by distance, and by what a cosine is made of, as that of long texts tells
their language more than their tone: a term is telling by z if its share of the examples of label 1 lies z standard
deviations over that of label 0 (at least TELLING). A vote for label 1 counts 1 + the mean z of the terms that make up its
cosine; a vote for label 0 counts less the more telling terms the text has. The result is calibrated leave-one-out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import platt, sample, sigmoid
from .scratch import discard, unused, written
from .tokens import Words, as_long, blocks

#: Rows of a batch that are worked on at once.
PART = 512
#: Examples of one block of the index, texts that are searched together, postings that are added up at once, and the share
#: of the examples that have a common term.
BLOCK, TOGETHER, POSTINGS, COMMON = 512, 128, 1 << 19, 0.1
#: Standard deviations from which a term is telling, and tasks for each core that count the terms of all documents.
TELLING, TASKS = 4, 8


def _terms(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of texts: document, hash of a term and how often, by document."""
    h = w.hashes()
    order = np.lexsort((h, w.doc))
    doc, term = w.doc[order], h[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (term[1:] != term[:-1]))[: len(doc)])
    return doc[first], term[first], np.diff(np.append(first, len(doc)))


def _known(vocabulary: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which terms are in the sorted vocabulary, and the numbers of these."""
    at = np.searchsorted(vocabulary, term)
    at[at == len(vocabulary)] = 0
    hit = vocabulary[at] == term if len(vocabulary) else np.zeros(len(term), bool)
    return hit, at[hit]


def _text_blocks(column: pa.Array) -> Iterator[Words]:
    """Blocks of lower-cased texts; few texts of a batch are copied at once."""
    for at in range(0, len(column), PART):
        for w in blocks(pc.utf8_lower(column.slice(at, PART)), letters=True):
            yield w._replace(first=w.first + at, last=w.last + at)


def _emit_examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w in _text_blocks(batch.column("text")):
            doc, term, n = _terms(w)
            cut = pa.array(np.searchsorted(doc, np.arange(len(w.n) + 1)).astype(np.int32))
            rows = batch.slice(w.first, w.last - w.first)
            lists = (pa.ListArray.from_arrays(cut, pa.array(x)) for x in (as_long(term), n.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("y"), *lists], ["id", "y", "term", "n"])


def _emit_counts(vocabulary):
    """term (its number; -1: all texts) and the number of texts of a partition that have it, where there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(vocabulary.value), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for w in _text_blocks(batch.column("text")):
                total += np.bincount(_known(vocabulary.value, _terms(w)[1])[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(total[some], n))], ["term", "n"])

    return run


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (n numbers each), one after the other."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


@dataclass
class Index:
    """vocabulary: sorted hashes; weight: idf of each term; unknown: idf of all other terms; ids (as text), y and rank (by
    id) of the examples; telling: z of each term, 0 if it is not telling. Each term has entries, one for each block that holds it, entry_start[t] to entry_start[t + 1]: block,
    greatest weight there, and its postings (example, weight) from entry_post[e] to entry_post[e + 1]."""

    vocabulary: np.ndarray
    weight: np.ndarray
    unknown: float
    ids: np.ndarray
    y: np.ndarray
    entry_start: np.ndarray
    entry_block: np.ndarray
    entry_bound: np.ndarray
    entry_post: np.ndarray
    example: np.ndarray
    posting: np.ndarray
    neighbours: int
    prior: float
    telling: np.ndarray
    rank: np.ndarray
    dense: tuple[np.ndarray, np.ndarray] | None = None

    def vectors(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a block of texts: document, number of a term and its weight in the text's vector of length 1."""
        doc, term, n = _terms(w)
        hit, at = _known(self.vocabulary, term)
        x = np.full(len(doc), self.unknown)
        x[hit] = self.weight[at]
        x *= 1 + np.log(n)
        norm = np.sqrt(np.bincount(doc, x * x, len(w.n)))
        return doc[hit], at, x[hit] / norm[doc[hit]]

    def common(self) -> tuple[np.ndarray, np.ndarray]:
        """The terms of COMMON of the examples or more, as a matrix of terms by examples (filled up to whole blocks), and
        the row of each term (-1: none). Made once in each worker."""
        if self.dense is None:
            n = np.diff(self.entry_post[self.entry_start])
            row = np.full(len(n), -1)
            terms = np.flatnonzero(n >= max(1, COMMON * len(self.y)))
            row[terms] = np.arange(len(terms))
            matrix = np.zeros((len(terms), -(-len(self.y) // BLOCK) * BLOCK))
            at = _ranges(self.entry_post[self.entry_start[terms]], n[terms])
            matrix[np.repeat(np.arange(len(terms)), n[terms]), self.example[at]] = self.posting[at]
            self.dense = matrix, row
        return self.dense

    def search(self, doc: np.ndarray, term: np.ndarray, q: np.ndarray, n: int, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For texts 0 to n - 1 of these terms and weights: text, example, cosine and what telling terms have in it (each by
        its z) of its k nearest examples of a cosine over 0, the nearest first (equal ones by rank). own: the example that a
        text itself is, to be left out.

        What common terms give is worked out for all examples at once; it is a lower bound of the k best. Only blocks in
        which the greatest weights of the other terms can lift an example to it are searched for these."""
        matrix, row_of = self.common()
        width = matrix.shape[1]
        row = row_of[term]
        held = np.zeros((n, len(matrix)))
        held[doc[row >= 0], row[row >= 0]] = q[row >= 0]
        score = held @ matrix
        if own is not None:
            score[np.arange(n), own] = 0
        least = lambda: np.partition(score, width - k, axis=1)[:, width - k, None] if width >= k else np.zeros((n, 1))
        best = least()
        told = self._told(doc, term, q, n, width)

        doc, term, q = (x[row < 0] for x in (doc, term, q))
        entries = self.entry_start[term + 1] - self.entry_start[term]
        e = _ranges(self.entry_start[term], entries)
        of, weight = np.repeat(doc, entries), np.repeat(q, entries)
        cell = of * (width // BLOCK) + self.entry_block[e]
        bound = score.reshape(n, -1, BLOCK).max(2) + np.bincount(cell, weight * self.entry_bound[e], n * (width // BLOCK)).reshape(n, -1)
        need = bound >= best - 1e-9
        i = np.flatnonzero(need.reshape(-1)[cell])
        e, of, weight = e[i], of[i], weight[i]
        length = self.entry_post[e + 1] - self.entry_post[e]
        upto = np.cumsum(length)
        lo = 0
        while lo < len(e):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + POSTINGS, "right")))
            some = length[lo:hi]
            at = _ranges(self.entry_post[e[lo:hi]], some)
            score += np.bincount(np.repeat(of[lo:hi] * width, some) + self.example[at], np.repeat(weight[lo:hi], some) * self.posting[at], n * width).reshape(n, width)
            lo = hi
        score *= np.repeat(need, BLOCK, axis=1)
        if own is not None:
            score[np.arange(n), own] = 0
        text, near = np.nonzero((score > 0) & (score >= least()))
        order = np.lexsort((self.rank[near], -score[text, near], text))
        text, near = text[order], near[order]
        top = np.arange(len(text)) - np.searchsorted(text, text) < k
        return text[top], near[top], score[text[top], near[top]], told[text[top], near[top]]

    def _told(self, doc: np.ndarray, term: np.ndarray, q: np.ndarray, n: int, width: int) -> np.ndarray:
        """For n texts and all examples: the part of the cosine that comes from telling terms, each by its z."""
        some = self.telling[term] > 0
        doc, term, q = doc[some], term[some], q[some] * self.telling[term[some]]
        first = self.entry_post[self.entry_start[term]]
        k = self.entry_post[self.entry_start[term + 1]] - first
        at = _ranges(first, k)
        return np.bincount(np.repeat(doc * width, k) + self.example[at], np.repeat(q, k) * self.posting[at], n * width).reshape(n, width)

    def nearest(self, w: Words, own: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """search() for a block of texts, TOGETHER at once: the first of them, text, example and cosine of their nearest, and
        the share() of each text."""
        doc, term, q = self.vectors(w)
        for lo in range(0, len(w.n), TOGETHER):
            a, b = np.searchsorted(doc, [lo, lo + TOGETHER])
            n = min(TOGETHER, len(w.n) - lo)
            *found, told = self.search(doc[a:b] - lo, term[a:b], q[a:b], n, self.neighbours, None if own is None else own[lo : lo + n])
            mass = np.bincount(doc[a:b] - lo, q[a:b] * self.telling[term[a:b]], n)
            yield lo, *found, self.share(*found, told, mass)

    def share(self, text: np.ndarray, example: np.ndarray, cosine: np.ndarray, told: np.ndarray, mass: np.ndarray) -> np.ndarray:
        """Share of label 1 among the neighbours of each text, each weighted by cosine over distance, by 1 + told / cosine
        for label 1, and by 1 / (1 + mass) for label 0, where mass is the sum of the text's weights, each by its z. The
        prior counts as much as one of a cosine of 0.05."""
        y = self.y[example]
        w = cosine / (1.05 - np.minimum(cosine, 1)) * np.where(y == 1, 1 + told / cosine, 1 / (1 + mass[text]))
        return (np.bincount(text, w * y, len(mass)) + 0.05 * self.prior) / (np.bincount(text, w, len(mass)) + 0.05)


def _log_odds(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return np.log(share / (1 - share))


def telling(with_1: np.ndarray, with_0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """z of terms that are in with_1 of n1 and in with_0 of n0 examples; 0 if it is under TELLING."""
    n1, n0 = max(n1, 1), max(n0, 1)
    p = (with_1 + with_0) / (n1 + n0)
    z = (with_1 / n1 - with_0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    return np.where(z >= TELLING, z, 0)


def fit_index(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 6000, max_terms: int = 1 << 24, neighbours: int = 50) -> tuple[Index, tuple[float, float]]:
    """Index of at most max_rows labelled examples (labelled.sample), with all of their terms, and the scale that turns
    votes into probabilities. What the driver holds are the terms of these examples, each counted once for an example, of
    which max_terms is the bound: beyond it, a ValueError asks for a smaller max_rows. Document frequencies count all rows of
    docs; they are added up by Spark, in TASKS tasks for each core at most, so that what is shuffled does not grow with the
    number of partitions."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    train = sample(docs, labels, label, max_rows, id_col=id_col, text_col=text_col).select("id", "y", "text")
    lists = [T.StructField("term", T.ArrayType(T.LongType())), T.StructField("n", T.ArrayType(T.IntegerType()))]
    cut = written(train.mapInArrow(_emit_examples, T.StructType([T.StructField("id", kind), T.StructField("y", T.IntegerType()), *lists])))
    if (held := cut.agg(F.sum(F.size("term"))).first()[0] or 0) > max_terms:
        raise ValueError(f"the examples have {held} terms, which is over max_terms: take a smaller max_rows")
    got = cut.orderBy("id").toArrow()
    discard(cut)
    y = got["y"].to_numpy().astype(float)
    term, n = (got[c].combine_chunks() for c in ("term", "n"))
    of = np.repeat(np.arange(len(y)), np.diff(term.offsets.to_numpy()))
    vocabulary, term = np.unique(term.values.to_numpy(zero_copy_only=False).view(np.uint64), return_inverse=True)
    n1 = int(y.sum())
    counts = [np.bincount(term[y[of] == v], minlength=len(vocabulary)) for v in (1, 0)]

    shared = spark.sparkContext.broadcast(vocabulary)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    few = docs.select(text).coalesce(TASKS * spark.sparkContext.defaultParallelism)
    df = few.mapInArrow(_emit_counts(shared), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    number, times = df["term"].to_numpy(), df["n"].to_numpy()
    n_docs, frequency = int(times[number < 0].sum()), np.zeros(len(vocabulary))
    frequency[number[number >= 0]] = times[number >= 0]
    shared.destroy()
    weight = np.log((1 + n_docs) / (1 + frequency)) + 1

    # examples whose commonest and heaviest terms are the same lie in the same blocks, so that bounds are tight
    common, heavy = np.full(len(y), -1), np.full(len(y), -1)
    for out, value in ((common, frequency), (heavy, weight)):
        order = np.lexsort((term, value[term], of))
        out[of[order]] = term[order]  # the last one of each example stays
    place = np.empty(len(y), np.int64)
    order = np.lexsort((np.arange(len(y)), heavy, common))
    place[order] = np.arange(len(y))
    x = weight[term] * (1 + np.log(n.values.to_numpy(zero_copy_only=False)))
    x /= np.sqrt(np.bincount(of, x * x, len(y)))[of]
    by_term = np.lexsort((place[of], term))
    term, example, x = term[by_term], place[of][by_term], x[by_term]
    first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (example[1:] // BLOCK != example[:-1] // BLOCK))[: len(term)])
    index = Index(
        vocabulary, weight, float(np.log((1 + n_docs) / 2) + 1), np.array([str(i) for i in got["id"].to_pylist()], object)[order], y[order],
        np.searchsorted(term[first], np.arange(len(vocabulary) + 1)), (example[first] // BLOCK).astype(np.int32), np.maximum.reduceat(x, first) if len(x) else x,
        np.append(first, len(term)).astype(np.int32), example.astype(np.int32), x, neighbours, (n1 + 1) / (len(y) + 2), telling(*counts, n1, len(y) - n1), order)

    shared = spark.sparkContext.broadcast((index, {i: int(p) for i, p in zip(got["id"].to_pylist(), place, strict=True)}))

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, number = shared.value
        for batch in batches:
            for w in _text_blocks(batch.column("text")):
                rows = batch.slice(w.first, w.last - w.first)
                own = np.array([number[i] for i in rows.column("id").to_pylist()], np.int64)
                parts = [share for *_, share in index.nearest(w, own)]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.concatenate([np.zeros(0), *parts]))], ["place", "share"])

    got = train.mapInArrow(left_out, "place long, share double").orderBy("place").toArrow()
    shared.destroy()
    return index, platt(_log_odds(got["share"].to_numpy()), index.y[got["place"].to_numpy()])


def score(docs: DataFrame, fitted: tuple[Index, tuple[float, float]], *, text_col: str = "text", score_col: str = "score", evidence_col: str | None = "evidence", evidence: int = 3, drop_from: float | None = None) -> DataFrame:
    """docs with score_col (0 to 1) and evidence_col (the nearest examples: id as text, cosine, label).

    Whole texts are scored; a null, empty or unrelated text gets the calibrated prior, without evidence. drop_from: only
    rows with a lower score are kept, in the columns of docs. Every row, repeated or with a null id, is scored by itself;
    existing columns of these names are replaced. Empty table: no rows. Without labelled examples every score is the prior.
    """
    index, scale = fitted
    shared = docs.sparkSession.sparkContext.broadcast(index)
    keep = [f for f in docs.schema if drop_from is not None or f.name not in (score_col, evidence_col)]
    near = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())]))
    added = [] if drop_from is not None else [T.StructField(score_col, T.DoubleType()), *([T.StructField(evidence_col, near)] if evidence_col else [])]
    names = [f.name for f in keep]
    with_evidence = drop_from is None and evidence_col

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Few rows at once, so that what is held besides a batch stays small."""
        for batch in batches:
            yield from (batch.slice(at, PART) for at in range(0, batch.num_rows, PART))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in parts(batches):
            share, rows, best, cosines = np.full(batch.num_rows, index.prior), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for w in _text_blocks(batch.column(batch.num_columns - 1)):
                for lo, text, example, cosine, some in index.nearest(w):
                    share[w.first + lo : w.first + lo + len(some)] = some
                    top = np.arange(len(text)) - np.searchsorted(text, text) < evidence
                    for held, x in ((rows, text[top] + w.first + lo), (best, example[top]), (cosines, cosine[top])):
                        held.append(x)
            value = sigmoid(scale[0] * _log_odds(share) + scale[1])
            own = batch.columns[: len(names)]
            if drop_from is not None:
                yield pa.RecordBatch.from_arrays(own, names).filter(pa.array(value < drop_from))
                continue
            if with_evidence:
                row, example = np.concatenate(rows), np.concatenate(best)
                told = pa.StructArray.from_arrays([pa.array(index.ids[example], pa.string()), pa.array(np.concatenate(cosines)), pa.array(index.y[example].astype(np.int32))], ["id", "cosine", "label"])
                own = [*own, pa.array(value), pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)), told)]
            else:
                own = [*own, pa.array(value)]
            yield pa.RecordBatch.from_arrays(own, [*names, *(f.name for f in added)])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(unused(docs, "text_"))
    return docs.select(*(F.col(n) for n in names), text).mapInArrow(run, T.StructType([*keep, *added]))
