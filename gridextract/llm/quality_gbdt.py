"""Quality rules: document statistics, base limits on them, and gradient-boosted trees with monotonic constraints,
flattened into numpy node arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import sample, sigmoid
from .scratch import unused
from .tokens import SPACE, blocks, mixed, ngrams

_U = np.uint64
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees and their constraints: -1, a greater value never raises the score.
FEATURES = {
    "words_log": 0, "mean_word_chars": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "again_share": -1,
    "distinct_share": 0, "upper_share": -1, "digit_share": 0, "mark_share": 0, "words_per_line": 0,
}
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"


def _mask(*codes: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[*codes]] = True
    return out


_WORD_START = ~SPACE & ~_mask(*range(0x80, 0xC0))  # first bytes of characters that are no white space
_CLASSES = {"word_chars": _WORD_START, "n_symbols": _mask(*SYMBOLS), "upper": _mask(*range(65, 91)), "digits": _mask(*range(48, 58)), "marks": _mask(*b"!?.,;:-_()[]{}'\"/\\=+~^`@")}


def _sum_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _dup_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and lines with a word."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines)), len(lines)


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text: the columns BASE (int64), and the FEATURES (float64)."""
    base, extra = [np.zeros((0, len(BASE)), np.int64)], [np.zeros((0, len(FEATURES)))]
    for w in blocks(column):
        n, h, starts = w.n.astype(np.int64), w.hashes(), w.word_starts()
        c = {k: _sum_by(m[w.buf], w.bounds) for k, m in _CLASSES.items()}
        data = w.buf.tobytes()
        dup, lines = np.array([_dup_lines(data[a:b]) for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)], np.int64).reshape(-1, 2).T

        def twice(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Order of the keys; whether each, in that order, equals the one before."""
            order = np.argsort(key)
            return order, np.append(False, key[order][1:] == key[order][:-1])[: len(key)]

        by_doc = mixed(w.doc.astype(np.uint64) + _U(1))
        eight, at = ngrams(h, w.doc, 8, 0xE7037ED1A0B428DB)
        order, same = twice(mixed(eight ^ by_doc[at]))
        repeated = same | np.append(same[1:], False)[: len(same)]
        edge = np.zeros(len(h) + 1, np.int64)
        hit = at[order[repeated]]
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + 8, -1)
        repeat_words = _sum_by(np.cumsum(edge[:-1]) > 0, starts)
        order, same = twice(mixed(h ^ by_doc))
        distinct = np.bincount(w.doc[order[~same]], minlength=len(n))
        again = np.append(False, (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1]))[: len(h)]
        again = _sum_by(again, starts)

        base.append(np.stack([n, c["word_chars"], c["n_symbols"], dup, repeat_words], 1))
        one, chars = np.maximum(n, 1), np.maximum(c["word_chars"], 1)
        extra.append(np.stack([
            np.log1p(n), c["word_chars"] / one, c["n_symbols"] / chars, dup / np.maximum(lines, 1), repeat_words / one, again / one,
            distinct / one, c["upper"] / chars, c["digits"] / chars, c["marks"] / chars, n / np.maximum(lines, 1)], 1))
    return np.concatenate(base), np.concatenate(extra)


@dataclass
class Trees:
    """All trees in arrays, root of each at roots: a node sends x[feature] <= threshold to left, else to right; leaves
    point to themselves and have values."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return sigmoid(total)


def boost(x: np.ndarray, y: np.ndarray, constraints: list[int], *, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, min_weight: float = 2.0, penalty: float = 1.0) -> Trees:
    """Newton boosting of logistic loss on histograms. A split on a constrained feature must put the leaf values in
    order, and their middle bounds all leaves below on either side, so the sum of trees is monotonic."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    share = (y.sum() + 1) / (len(y) + 2)
    out = Trees(*(np.zeros(0),) * 6, depth, float(np.log(share / (1 - share))))
    nodes: list[list] = []
    roots, margin = [], np.full(len(y), out.start)

    def grow(rows: np.ndarray, level: int, low: float, high: float, g: np.ndarray, h: np.ndarray) -> int:
        me = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + penalty), low, high))
        nodes.append([0, np.inf, me, me, value * rate])
        best = (1e-6, None)
        if level < depth:
            own = g[rows].sum() ** 2 / (h[rows].sum() + penalty)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                gs = np.cumsum(np.bincount(binned[rows, f], g[rows], len(c) + 1))
                hs = np.cumsum(np.bincount(binned[rows, f], h[rows], len(c) + 1))
                gl, hl, gr, hr = gs[:-1], hs[:-1], gs[-1] - gs[:-1], hs[-1] - hs[:-1]
                vl, vr = np.clip(-gl / (hl + penalty), low, high), np.clip(-gr / (hr + penalty), low, high)
                gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - own
                gain[(hl < min_weight) | (hr < min_weight) | (constraints[f] * (vr - vl) < 0)] = -1
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], (f, i, (vl[i] + vr[i]) / 2))
        if best[1] is None:
            margin[rows] += value * rate
            return me
        f, i, middle = best[1]
        goes_left = binned[rows, f] <= i
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[constraints[f]]
        nodes[me][0], nodes[me][1] = f, cuts[f][i]
        nodes[me][2] = grow(rows[goes_left], level + 1, *bounds[0], g, h)
        nodes[me][3] = grow(rows[~goes_left], level + 1, *bounds[1], g, h)
        return me

    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = sigmoid(margin)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf, p - y, p * (1 - p)))
    flat = list(zip(*nodes, strict=True)) or [()] * 5
    out.roots = np.array(roots, np.int64)
    out.feature, out.left, out.right = (np.array(flat[i], np.int64) for i in (0, 2, 3))
    out.threshold, out.value = np.array(flat[1], float), np.array(flat[4], float)
    return out


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 8000, **params) -> Trees:
    """Trees over FEATURES from at most max_rows labelled rows (labelled.sample). With one class only there are no trees
    and the score is its share."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column("text"))[1]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), *(pa.array(c) for c in x.T)], ["id", "y", *FEATURES])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("y", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in FEATURES)])
    got = sample(docs, labels, label, max_rows, id_col=id_col, text_col=text_col).select("id", "y", "text").mapInArrow(features, schema).orderBy("id").toArrow()
    x = np.stack([got[c].to_numpy() for c in FEATURES], 1)
    return boost(x, got["y"].to_numpy().astype(float), list(FEATURES.values()), **params)


def judge(docs: DataFrame, trees: Trees, *, text_col: str = "text", min_score: float = 0.3, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """docs with the columns BASE, base_failed (fewer than min_words words, or more than max_repeat_percent % of them in
    repeated windows), score and kept (base not failed, and score >= min_score).

    Whole texts are judged; null is empty, and an empty text fails the base. Existing columns of these names are
    replaced. Repeated rows and null ids are rows like any other. Empty table: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    added = [*(T.StructField(c, T.LongType()) for c in BASE), T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    keep = [f for f in docs.schema if f.name not in {a.name for a in added}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            base, x = statistics(batch.column(batch.num_columns - 1))
            failed = (base[:, 0] < min_words) | (100 * base[:, 4] > max_repeat_percent * base[:, 0])
            score = trees.score(x)
            cols = [*batch.columns[: len(keep)], *(pa.array(c) for c in base.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= min_score))]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in (*keep, *added)])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(unused(docs, "text_"))
    return docs.select(*(F.col(f.name) for f in keep), text).mapInArrow(run, T.StructType([*keep, *added]))
