"""Quality by Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, and a linear model with
hinge loss fitted by dual coordinate descent.

N-grams are runs of 3 bytes of the text, single words and pairs of words; a word that repeats the word before it counts
as the mark <again>. They are hashed to `buckets` indicators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import platt, sample, sigmoid
from .scratch import unused
from .tokens import blocks, mixed

AGAIN = np.uint64(0x5851F42D4C957F2D)


def _documents(column: pa.Array, buckets: int) -> Iterator[np.ndarray]:
    """The indicators that are on, ascending by place in the text, for each text of a column."""
    last = np.empty(buckets, np.int64)
    top = np.uint64(buckets - 1)
    for w in blocks(column):
        h = w.hashes()
        if len(h):
            same = np.append(False, (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1]))
            h = np.where(same, AGAIN, h)
        pair = mixed(h[:-1] * np.uint64(3) + h[1:])[w.doc[1:] == w.doc[:-1]] if len(h) > 1 else h[:0]
        at, pairs = w.word_starts(), np.maximum(w.n - 1, 0)
        pair_at = np.concatenate([[0], np.cumsum(pairs)])
        b = w.buf.astype(np.uint64)
        three = mixed(b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]) if len(b) > 2 else h[:0]
        for d in range(len(w.n)):
            lo, hi = int(w.bounds[d]), int(w.bounds[d + 1])
            f = np.concatenate([three[lo : max(lo, hi - 2)], h[at[d] : at[d + 1]], pair[pair_at[d] : pair_at[d + 1]]]) & top
            f = f.astype(np.int64)
            nth = np.arange(len(f))
            last[f] = nth
            yield f[last[f] == nth]


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, buckets: int, alpha: float = 1.0) -> np.ndarray:
    p, q = np.full(buckets, alpha), np.full(buckets, alpha)
    for f, label in zip(rows, y, strict=True):
        (p if label else q)[f] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, *, cost: float, rounds: int, seed: int = 0) -> tuple[np.ndarray, float]:
    """Linear support vectors with the hinge loss (Hsieh et al., 2008) on rows x = ratio at each indicator, of length 1,
    and a bias input of 1. Positive and negative rows weigh the same together. Ends when no projected gradient of a round
    is over 0.001, or after `rounds`."""
    rng, sign = np.random.default_rng(seed), np.where(y == 1, 1.0, -1.0)
    size = np.array([np.sqrt((ratio[f] ** 2).sum()) or 1.0 for f in rows])
    share = np.where(y == 1, len(y) / max(1, 2 * (y == 1).sum()), len(y) / max(1, 2 * (y == 0).sum()))
    most, alpha, w, bias = cost * share, np.zeros(len(rows)), np.zeros_like(ratio), 0.0
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            f, s = rows[i], size[i]
            r = ratio[f]
            g = sign[i] * ((w[f] * r).sum() / s + bias) - 1
            worst = max(worst, abs(g) if 0 < alpha[i] < most[i] else max(0.0, -g if alpha[i] == 0 else g))
            new = min(max(alpha[i] - g / ((r * r).sum() / (s * s) + 1), 0.0), most[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[f] += step * r / s
                bias += step
                alpha[i] = new
        if worst < 1e-3:
            break
    return w, bias


def margin(f: np.ndarray, ratio: np.ndarray, w: np.ndarray, bias: float) -> float:
    r = ratio[f]
    return float((w[f] * r).sum() / (np.sqrt((r * r).sum()) or 1.0) + bias)


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 3000, buckets: int = 1 << 18, cost: float = 1.0, rounds: int = 20, folds: int = 4) -> tuple[np.ndarray, np.ndarray, float, tuple[float, float]]:
    """ratio, w, bias and scale from at most max_rows labelled rows (labelled.sample). The scale is fitted on margins of
    rows that the model at hand has not learned from. With one class only, every margin is 0 and the score its share."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("y", T.IntegerType()), T.StructField("on", T.ArrayType(T.IntegerType()))])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [f.astype(np.int32) for f in _documents(batch.column("text"), buckets)]
            at = np.concatenate([[0], np.cumsum([len(f) for f in rows])]).astype(np.int32)
            on = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), on], ["id", "y", "on"])

    got = sample(docs, labels, label, max_rows, id_col=id_col, text_col=text_col).select("id", "y", "text").mapInArrow(features, schema).orderBy("id").toArrow()
    y = got["y"].to_numpy().astype(int)
    on = got["on"].combine_chunks()
    flat, at = on.values.to_numpy(zero_copy_only=False), on.offsets.to_numpy()
    rows = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def train(use: np.ndarray):
        ratio = log_count_ratios([rows[i] for i in use], y[use], buckets)
        return ratio, *dual_coordinate_descent([rows[i] for i in use], y[use], ratio, cost=cost, rounds=rounds)

    out = np.zeros(len(rows))
    part = np.arange(len(rows)) % folds
    for fold in range(folds):
        use, test = np.flatnonzero(part != fold), np.flatnonzero(part == fold)
        if len(set(y[use])) == 2:
            model = train(use)
            out[test] = [margin(rows[i], *model) for i in test]
    scale = platt(out, y)
    if len(set(y)) < 2:
        return np.zeros(buckets), np.zeros(buckets), 0.0, scale
    return *train(np.arange(len(rows))), scale


def score(docs: DataFrame, model: tuple, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col, 0 to 1, of every whole text; null is empty, and an empty text has the bias as its margin.
    An existing score_col is replaced. Repeated rows and null ids are rows like any other. Empty table: no rows."""
    shared = docs.sparkSession.sparkContext.broadcast((*(x.astype(np.float32) for x in model[:2]), *model[2:]))
    keep = [f for f in docs.schema if f.name != score_col]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, w, bias, (a, b) = shared.value
        for batch in batches:
            m = np.array([margin(f, ratio, w, bias) for f in _documents(batch.column(batch.num_columns - 1), len(ratio))], float)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sigmoid(a * m + b))], [*names, score_col])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(unused(docs, "text_"))
    return docs.select(*(F.col(n) for n in names), text).mapInArrow(run, T.StructType([*keep, T.StructField(score_col, T.DoubleType())]))
