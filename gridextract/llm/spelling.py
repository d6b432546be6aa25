"""Spelling variants of a corpus' words, by forward and reversed sorted dictionaries.

One edit leaves the first or the last half of a word as it is. So of two words of which the shorter has m code points and
that differ by one edit, both begin with the same m // 2 code points or both end with the same. The words are sorted once
as they are and once reversed; words that share such a beginning (or end) are a block, a range of consecutive rows, that is
scanned. A block with too many pairs is subdivided: what its words do not share yet is halved once more, and again the edit
leaves the first or the last half of it. That ends where they share all but one code point, so no block is large: it holds
at most the alphabet of words of m code points.

A pair is found once: where both halves are shared, the first half counts; `bound` tells a block of an end to leave out
pairs that share a beginning of that length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, settled, written
from .tokens import BLOCK_BYTES, LOWER, buffers

#: Pairs of a block that is not subdivided, distinct words a task holds while it counts, and code points compared at once.
MOST_PAIRS, HELD, AT_ONCE = 1 << 13, 1 << 17, 1 << 23
_BLOCK = ["m", "bound", "head", "tail"]
_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True


def runs(column: pa.Array) -> Iterator[list[bytes]]:
    """The maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF (two bytes, from 0xC3 on) of each text, A-Z
    lower-cased. Texts are read in blocks of about BLOCK_BYTES; null has none."""
    data, bounds = buffers(column)
    i, total = 0, len(bounds) - 1
    while i < total:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + BLOCK_BYTES, "right")) - 1)
        buf = data[bounds[i] : bounds[j]]
        letter = _ASCII[buf]
        lead = np.flatnonzero(buf == 0xC3)
        letter[lead] = letter[lead + 1] = True
        text = np.where(letter, LOWER[buf], np.uint8(0x20)).tobytes()
        at = (bounds[i : j + 1] - bounds[i]).tolist()
        for lo, hi in zip(at, at[1:], strict=False):
            yield text[lo:hi].split()
        i = j


def dictionary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3, slip_every: int | None = None) -> DataFrame:
    """word, n: the runs of letters of all texts that have at least `shortest` code points and occur at least `least` times.

    slip_every: put a slip of the pen into some runs before they count: where it divides the unsigned crc32 h of
    "<id>:<run>", the code point h % length goes. Rows with a null id have no slips. Repeated rows count each.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        crc32 = zlib.crc32
        for batch in batches:
            for key, found in zip(batch.column(0).to_pylist(), runs(batch.column(1)), strict=True):
                own = Counter([w for w in found if len(w) >= shortest])
                if slip_every and key is not None:
                    start = crc32(f"{key}:".encode())
                    for word in [w for w in own if not crc32(w, start) % slip_every]:
                        letters, n = word.decode(), own.pop(word)
                        at = crc32(word, start) % len(letters)
                        held[(letters[:at] + letters[at + 1 :]).encode()] += n
                held.update(own)
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    parts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return parts.where(F.char_length("word") >= shortest).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _halves(rows: DataFrame) -> DataFrame:
    """Rows of blocks (word, n, m, bound, head, tail), each in the two blocks in which it shares a half more."""
    p, s = F.char_length("head"), F.char_length("tail")
    half = F.floor((F.col("m") - p - s) / 2).cast("int")
    first = F.struct(F.col("bound"), F.substring("word", F.lit(1), p + half).alias("head"), F.col("tail"))
    last = F.struct(F.least("bound", p + half).alias("bound"), F.col("head"), F.substring(F.reverse("word"), F.lit(1), s + half).alias("tail"))
    return rows.select("word", "n", "m", F.explode(F.array(first, last)).alias("b")).select("word", "n", "m", "b.bound", "b.head", "b.tail")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs one edit apart of sorted blocks. Rows: m, bound, head, tail, word, n; in a block the words of m code points come
    before those of m + 1, so a word's partners are all that follow it there."""
    rest = None

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        same = np.ones(max(rows.num_rows - 1, 0), bool)
        for c in _BLOCK:
            same &= pc.equal(rows[c][1:], rows[c][:-1]).to_numpy()
        begins = np.flatnonzero(np.append(True, ~same))
        end = np.repeat(np.append(begins[1:], rows.num_rows), np.diff(np.append(begins, rows.num_rows)))
        words, m, bound = rows["word"].combine_chunks(), rows["m"].to_numpy(), rows["bound"].to_numpy()
        size = pc.utf8_length(words).to_numpy().astype(np.int64)
        codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4")
        start = np.cumsum(size) - size
        partners = np.where(size == m, end - np.arange(len(end)) - 1, 0)
        upto, lo = np.cumsum(partners * (m + 1)), 0
        while lo < len(partners):
            # one row's partners at a time at least
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + AT_ONCE, "right")))
            k = partners[lo:hi]
            a = np.repeat(np.arange(lo, hi), k)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
            near = np.zeros(len(a), bool)
            for width in np.unique(m[a]):
                of = np.flatnonzero(m[a] == width)
                x, y, at = a[of], b[of], np.arange(width)
                ahead = codes[start[x, None] + at] != codes[start[y, None] + at]
                behind = codes[start[x, None] + size[x, None] - 1 - at] != codes[start[y, None] + size[y, None] - 1 - at]
                head = np.where(ahead.any(1), ahead.argmax(1), width)
                tail = np.where(behind.any(1), behind.argmax(1), width)
                near[of] = (head + tail >= size[y] - 1) & (head < bound[x])
            x, y = pa.array(a[near]), pa.array(b[near])
            yield pa.RecordBatch.from_arrays([words.take(x), words.take(y), rows["n"].combine_chunks().take(x), rows["n"].combine_chunks().take(y)], ["a", "b", "n_a", "n_b"])
            lo = hi

    for batch in batches:
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        # the last block may go on in the next batch
        last = {c: rows[c][-1] for c in _BLOCK}
        inside = np.ones(rows.num_rows, bool)
        for c in _BLOCK:
            inside &= pc.equal(rows[c], last[c]).to_numpy()
        cut = int(inside.argmax())
        rest = rows.slice(cut)
        if cut:
            yield from pairs(rows.slice(0, cut))
    if rest is not None:
        yield from pairs(rest)


def near_pairs(words: DataFrame, *, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """a, b, n_a, n_b: each pair of the distinct words (written: word, n) that differ by exactly one inserted, deleted or
    replaced code point, once. The empty word has no partners here. Blocks of over most_pairs pairs are subdivided, by
    rounds, of which there are as many as the longest word can be halved."""
    length = F.char_length("word")
    whole = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).where("m > 0")
    blocks = written(_halves(whole.select("word", "n", "m", (F.col("m") + 2).alias("bound"), F.lit("").alias("head"), F.lit("").alias("tail"))))
    ready = []
    while True:
        short = F.count_if(F.char_length("word") == F.col("m"))
        size = blocks.groupBy(*_BLOCK).agg(short.alias("s"), F.count(F.lit(1)).alias("all")).where("s > 0 and all > 1")
        pairs = F.col("s") * (F.col("s") - 1) / 2 + F.col("s") * (F.col("all") - F.col("s"))
        # a table of its own, so that Spark splits the rows of a hot block in the join
        size = written(size.select(*_BLOCK, ((pairs > most_pairs) & (F.col("m") - F.char_length("head") - F.char_length("tail") > 1)).alias("large")))
        placed = written(blocks.join(size, _BLOCK))
        discard(size)
        discard(blocks)
        ready.append(placed.where("not large").select(*_BLOCK, "word", "n"))
        large = placed.where("large")
        if large.isEmpty():
            break
        blocks = written(_halves(large.select("word", "n", *_BLOCK)))
    every = ready[0]
    for more in ready[1:]:
        every = every.union(more)
    sorted_ = every.repartitionByRange(*_BLOCK).sortWithinPartitions(*_BLOCK, F.char_length("word"), "word")
    return sorted_.mapInArrow(_scan, "a string, b string, n_a long, n_b long")


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each of the distinct words (word, n).

    Two words are near if they differ by exactly one inserted, deleted or replaced code point; n_near: how many are near.
    form: the near word of largest n, of several the least by code points, if its n (form_n) is 2 n or more, else null. root:
    the last word that forms lead to, the word itself where it has none. An empty table gives no rows.
    """
    words = written(words.select("word", "n"))

    def formed() -> DataFrame:
        both = F.explode(F.array(*(F.struct(F.col(x).alias("word"), (-F.col(f"n_{y}")).alias("less"), F.col(y).alias("other")) for x, y in ("ab", "ba"))))
        near = near_pairs(words).select(both.alias("e")).select("e.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct("less", "other")).alias("best"))
        d = words.join(near, "word", "left")
        fits = -F.col("best.less") >= 2 * F.col("n")
        return d.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))

    rows = settled(formed)
    # n at least doubles with each step, so few rounds lead all words to their roots
    to = written(rows.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        step = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(to.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(to)
        to = after
        if to.where("moved").isEmpty():
            break
    return rows.join(to.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
