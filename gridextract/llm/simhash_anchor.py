"""SimHash near-duplicates by anchor-point covering.

The 64 bits of a fingerprint are split into blocks, and the anchors of a block are the words of a linear covering code. Of
two fingerprints at distance d or less one block differs in few bits: with blocks that are given t_1, t_2, ... bits, where
the sum of all t + 1 is over d, in some block they differ in its t bits or fewer. There, the anchor next to the first lies
within the covering radius + t of the second. So each fingerprint goes to every anchor within radius + t, is at home at its
nearest, and homes are compared with all that came to the anchor: no link is lost, whatever the data.

COARSE has three blocks: the perfect Golay code (radius 3) for 23 bits, twice, and Hamming [15,11] with the 3-bit
repetition code (radius 2) for 18, 4096 anchors each. The others have two blocks of 32 bits: FINE is Golay, Hamming [7,4] and
two bits as they are (radius 4), 2^18 anchors each; FINER is Golay and nine bits as they are (radius 3), 2^21; FINEST is
Hamming [31,26] and one bit (radius 1), 2^27. A finer layout sends a fingerprint to more anchors and compares a smaller
share of the pairs: for 4 bits it goes to 26, 85, 138 or 188 anchors, and 0.006, 0.0003, 0.00007 or 0.0000014 of the pairs
meet. So the layout follows the number of distinct fingerprints (FROM), and the work on one of them stays within bounds
however many there are. All layouts find all links.

A fingerprint only estimates a similarity. For near duplicates by similarity, candidates are linked by any of several
independent fingerprints of the set of words, each within few bits, if a longer one of five-word shingles agrees, and
similar_pairs holds the documents of a component of such links against each other by their sets of shingles, whatever links
brought them there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .scratch import settled, unused, written
from .tokens import LOWER, SPACE, Words, blocks, mixed, ngrams

#: The generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
#: Homes and visitors of one cell at most; larger anchors are split into a grid of cells.
CELL_HOMES, CELL_VISITORS = 2048, 8192


def _golay_syndromes() -> list[int]:
    """Syndrome of each of the 23 bits: x^i modulo the generator."""
    out = []
    for i in range(23):
        x = 1 << i
        for b in range(22, 10, -1):
            if x >> b & 1:
                x ^= GOLAY << (b - 11)
        out.append(x)
    return out


_HALF = (32, 4, [*_golay_syndromes(), *(x << 11 for x in range(1, 8)), 0, 0])
#: Of each block of a layout: its lowest bit, number of bits, covering radius and the syndromes of its bits.
COARSE = ((0, 23, 3, _golay_syndromes()), (23, 23, 3, _golay_syndromes()), (46, 18, 2, [*range(1, 16), 16, 32, 48]))
FINE = ((0, *_HALF), (32, *_HALF))
FINER = tuple((low, 32, 3, [*_golay_syndromes(), *[0] * 9]) for low in (0, 32))
FINEST = tuple((low, 32, 1, [*range(1, 32), 0]) for low in (0, 32))
#: Distinct fingerprints from which each layout is used; for more bits than DISTANCE only COARSE pays.
FROM, DISTANCE = ((1 << 28, FINEST), (1 << 26, FINER), (1 << 22, FINE), (0, COARSE)), 4
#: Anchors of a layout up to which their sizes are broadcast.
FEW_ANCHORS = 1 << 20
#: Multiplier of the rolling hash of shingles, and what parts the hashes of independent fingerprints: odd numbers.
_ROLL, _APART = 0xD6E8FEB86659FD93, np.uint64(0xA0761D6478BD642F)
#: Shingles of one side of a cell of exact comparisons, on average; larger groups are split into a grid of cells.
CELL_SHINGLES = 1 << 19
_tables: dict[tuple, tuple] = {}


def shares(distance: int, layout: tuple) -> list[int]:
    """The bits t of each block: as even as can be, the sum of all t + 1 being distance + 1."""
    rest = distance + 1 - len(layout)
    if rest < 0:
        return [0] * len(layout)
    return [rest // len(layout) + (i < rest % len(layout)) for i in range(len(layout))]


def _table(layout: tuple, block: int, t: int) -> tuple:
    """For a block: syndrome -> error patterns of weight radius + t at most, lightest first, as first indices, counts
    and patterns; and the syndrome of each byte of the block."""
    low, n, radius, syn = layout[block]
    key = low, n, radius, t
    if key not in _tables:
        # patterns of weight w + 1 are those of weight w with one more bit above the highest
        s, e, top = np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, -1)
        every = [(s, e)]
        for _ in range(radius + t):
            more = [(np.flatnonzero(top < b), b) for b in range(n)]
            s, e, top = (np.concatenate([f(i, b) for i, b in more]) for f in (lambda i, b: s[i] ^ syn[b], lambda i, b: e[i] | 1 << b, lambda i, b: np.full(len(i), b)))
            every.append((s, e))
        s, e = (np.concatenate(x) for x in zip(*every, strict=True))
        order = np.argsort(s, kind="stable")
        count = np.bincount(s, minlength=1 << max(syn).bit_length())
        bytes_ = np.zeros((4, 256), np.int64)
        for k in range(4):
            for b in range(8):
                if 8 * k + b < n:
                    bytes_[k, np.arange(256) >> b & 1 == 1] ^= syn[8 * k + b]
        _tables[key] = np.concatenate([[0], np.cumsum(count)[:-1]]), count, e[order], bytes_
    return _tables[key]


def anchors(fp: np.ndarray, layout: tuple, block: int, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For uint64 fingerprints: number of the fingerprint, anchor, and whether it is the fingerprint's home, of every
    anchor of the block within radius + t. Every syndrome has a pattern within the radius, so each has one home."""
    first, count, pattern, by = _table(layout, block, t)
    low, n, _, _ = layout[block]
    x = (fp >> np.uint64(low)).astype(np.int64) & ((1 << n) - 1)
    s = by[0][x & 255] ^ by[1][x >> 8 & 255] ^ by[2][x >> 16 & 255] ^ by[3][x >> 24 & 255]
    k = count[s]
    row = np.repeat(np.arange(len(fp)), k)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
    return row, x[row] ^ pattern[first[s][row] + nth], nth == 0


def _sums(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How often each bit is set in the hashes (rows of 64-bit numbers) of each of n documents, in whose order they come."""
    out = np.zeros((n, 64 * h.shape[1]), np.int64)
    for lo in range(0, len(doc), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        set_ = np.unpackbits(h[part].astype("<u8").view(np.uint8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.diff(doc[part], prepend=-1))
        out[doc[part][cut]] += np.add.reduceat(set_, cut, axis=0, dtype=np.int32)
    return out


def _ones(view: memoryview, begin: list[int], end: list[int], doc: np.ndarray, n: int) -> np.ndarray:
    """How often each bit is set in the XXH64 (seed 42) of the shingles of each of n documents."""
    digest, out = xxhash.xxh64_intdigest, np.zeros((n, 64), np.int64)
    for lo in range(0, len(doc), 1 << 17):
        part = slice(lo, lo + (1 << 17))
        h = np.array([digest(view[a:b], 42) for a, b in zip(begin[part], end[part], strict=True)], np.uint64)
        out += _sums(h[:, None], doc[part], n)
    return out


def _normal(w: Words) -> tuple[memoryview, np.ndarray, np.ndarray]:
    """The bytes of a block, A-Z lower-cased and with one blank between two words, and the bounds of its words there."""
    gap = SPACE[w.buf]
    keep = ~gap
    after = w.end[w.end < len(w.buf)]
    keep[after] = True
    at = np.cumsum(keep) - keep
    norm = LOWER[w.buf]
    norm[gap] = 0x20
    return memoryview(norm[keep].tobytes()), at[w.start], at[w.end - 1] + 1


def _shingles(w: Words, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles by document, and of each shingle its document, its first and its last word."""
    n = np.where(w.n > 0, np.maximum(w.n - words + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(w.word_starts()[:-1], n)
    return n, doc, i, i + np.minimum(words, w.n[doc]) - 1


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """id_col, fingerprint (long; the bits of the unsigned value) of each row of docs.

    Words are runs without ASCII white space, A-Z lower-cased; shingles of `shingle` words, repeats included, joined by
    a space, are hashed by XXH64 with seed 42. A bit is 1 if set in over half of the hashes. Fewer words: the whole
    sequence is the one shingle; null, empty or blank texts: 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for w in blocks(batch.column(1)):
                if len(w.start):
                    view, start, end = _normal(w)
                    n, doc, i, j = _shingles(w, shingle)
                    ones = _ones(view, start[i].tolist(), end[j].tolist(), doc, len(n))
                    out[w.first : w.last] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], [id_col, "fingerprint"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fingerprint", T.LongType())])
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def sketches(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prints: int = 4, shingle: int = 5) -> DataFrame:
    """id, print_0, print_1, ... and check_1, check_2 of each row of docs: independent fingerprints of 64 bits of the set of
    its words (as in fingerprints), and one of 128 bits of its shingles of `shingle` words, repeats included; all 0 for texts
    without words. Words and shingles are hashed in whole columns."""
    names = [*(f"print_{k}" for k in range(prints)), "check_1", "check_2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, len(names)), np.uint64)
            for w in blocks(batch.column(1)):
                h = w.hashes(LOWER[w.buf])
                order = np.lexsort((h, w.doc))
                word, doc = h[order], w.doc[order]
                new = np.append(True, (word[1:] != word[:-1]) | (doc[1:] != doc[:-1]))[: len(word)]
                parts = [(word[new], doc[new], prints)]
                # texts of fewer words are one shingle each
                some = [(k, *ngrams(h, w.doc, k, _ROLL)) for k in range(1, shingle + 1)]
                some = [(x[keep], w.doc[at[keep]]) for k, x, at in some for keep in [w.n[w.doc[at]] == k if k < shingle else np.ones(len(at), bool)]]
                both, of = (np.concatenate(x) for x in zip(*some, strict=True))
                order = np.argsort(of, kind="stable")
                parts.append((both[order], of[order], 2))
                place = 0
                for x, of, times in parts:
                    ones = _sums(np.stack([mixed(x ^ _APART * np.uint64(place + k + 1)) for k in range(times)], 1), of, len(w.n))
                    half = 2 * ones > np.bincount(of, minlength=len(w.n))[:, None]
                    out[w.first : w.last, place : place + times] = np.packbits(half, axis=1, bitorder="little").view("<u8")
                    place += times
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c.copy().view(np.int64)) for c in out.T)], ["id", *names])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in names)])
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def _forest(homes: np.ndarray, visitors: np.ndarray, d: int, most: int | None = None) -> np.ndarray:
    """Edges of a spanning forest of the links between homes and visitors, as rows of numbers into the distinct rows of
    both (see np.unique), and these. Rows are linked if their first columns differ in d bits or fewer, and, where most is
    given, the others together in `most` or fewer. Never holds all pairs of a dense cell."""
    every, at = np.unique(np.concatenate([homes, visitors]), axis=0, return_inverse=True)
    at = at.reshape(-1)
    at_home, at_visitor = at[: len(homes)], at[len(homes) :]

    def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(every[a, 1:] ^ every[b, 1:]).sum(-1, dtype=np.int64) <= most

    left, right, found = [], [], 0
    for lo in range(0, len(homes), 128):
        h, v = np.nonzero(np.bitwise_count(homes[lo : lo + 128, None, 0] ^ visitors[None, :, 0]) <= d)
        h, v = at_home[lo + h], at_visitor[v]
        other = h != v
        h, v = h[other], v[other]
        if most is not None:
            near = close(h, v)
            h, v = h[near], v[near]
        left.append(h)
        right.append(v)
        found += len(h)
        if found > 4 * (len(homes) + len(visitors)):
            break
    else:
        parent = list(range(len(every)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        for x, y in zip(np.concatenate([*left, at_home[:0]]).tolist(), np.concatenate([*right, at_home[:0]]).tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                parent[p] = q
                out.append((x, y))
        return every[np.array(out, np.int64).reshape(-1, 2)]
    # dense: breadth first over what is not reached yet
    rest, out = np.arange(len(every)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(every[rest, 0] ^ every[x, 0]) <= d
            if most is not None:
                near[near] = close(rest[near], np.full(int(near.sum()), x))
            reached, rest = rest[near], rest[~near]
            out += [(int(x), int(y)) for y in reached]
            queue += list(reached)
    return every[np.array(out, np.int64).reshape(-1, 2)]


def links(prints: DataFrame, *, distance: int = 4, of: list[str] | None = None, check_distance: int | None = None) -> DataFrame:
    """a, b: a spanning forest, by cell, of all links: of two rows that differ in `distance` bits or fewer in one of the
    columns `of` (fingerprint) and, with check_distance, in that many or fewer in check_1 and check_2 together. Its
    components are those of all links. a and b name the rows: by their fingerprint, or by the hash of their check."""
    of, check = of or ["fingerprint"], ["check_1", "check_2"] if check_distance is not None else []
    names = ["value", *check]
    own = written(prints.select(*of, *check).dropna().distinct())
    n = own.count()
    layout = next(x for least, x in FROM if n >= least and (distance <= DISTANCE or x is COARSE))
    share = shares(distance, layout)
    # each row becomes many: the work is dealt out anew, as small tables come in few partitions
    own = own.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                columns = [c.to_numpy() for c in batch.slice(lo, 1024).columns]
                for k in range(len(of)):
                    for b in range(len(layout)):
                        row, anchor, home = anchors(columns[k].view(np.uint64), layout, b, share[b])
                        held = (pa.array(c[row]) for c in (columns[k], *columns[len(of) :]))
                        yield pa.RecordBatch.from_arrays([pa.array(anchor | (k * len(layout) + b) << 32), *held, pa.array(home)], ["anchor", *names, "home"])

    at = own.mapInArrow(spread, f"anchor long, {', '.join(f'{c} long' for c in names)}, home boolean")
    size = at.groupBy("anchor").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("all"))
    size = size.select("anchor", F.ceil(F.col("homes") / CELL_HOMES).cast("int").alias("nh"), F.ceil(F.col("all") / CELL_VISITORS).cast("int").alias("nv")).where("nh > 0")
    few = len(of) * sum(1 << bits - max(syn).bit_length() for _, bits, _, syn in layout) <= FEW_ANCHORS
    at = at.join(F.broadcast(size) if few else written(size), "anchor")
    whole = F.lit(0).cast("int")
    row = F.pmod(F.xxhash64(*names, F.lit(1)), F.col("nh")).cast("int")
    col = F.pmod(F.xxhash64(*names, F.lit(2)), F.col("nv")).cast("int")
    # a cell's number: its row, its column and its anchor, 13, 13 and 37 bits
    number = lambda i, j: F.shiftleft(i.cast("long"), 50).bitwiseOR(F.shiftleft(j.cast("long"), 37)).bitwiseOR(F.col("anchor"))
    cells = F.when(F.col("home"), F.transform(F.sequence(whole, F.col("nv") - 1), lambda j: F.struct(number(row, j).alias("cell"), F.lit(True).alias("home"))))
    cells = F.concat(F.coalesce(cells, F.array().cast("array<struct<cell:bigint,home:boolean>>")), F.transform(F.sequence(whole, F.col("nh") - 1), lambda i: F.struct(number(i, col).alias("cell"), F.lit(False).alias("home"))))
    placed = at.select(F.explode(cells).alias("c"), *names).select("c.cell", "c.home", *names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            home, rows = (np.concatenate(x) for x in zip(*parts, strict=True))
            both = _forest(rows[home], rows[~home], distance, check_distance).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, side, k].copy()) for side in (0, 1) for k in range(len(names))], [f"{side}_{c}" for side in "ab" for c in names])

        at, held = None, []  # rows come cell by cell; a cell may go over the end of a batch
        for batch in batches:
            cell, home = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            rows = np.stack([batch.column(k).to_numpy() for k in range(2, 2 + len(names))], 1).view(np.uint64)
            cuts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(cell)], strict=True):
                if held and cell[lo] != at:
                    yield edges(held)
                    held = []
                at = cell[lo]
                held.append((home[lo:hi].copy(), rows[lo:hi].copy()))
        if held:
            yield edges(held)

    edges = placed.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, ", ".join(f"{side}_{c} long" for side in "ab" for c in names))
    return edges.select(*((F.xxhash64(*(f"{side}_{c}" for c in check)) if check else F.col(f"{side}_value")).alias(side) for side in "ab"))


def least_ids(of: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """node and, as name, the smallest id of its component. of: node, least (smallest id of its rows); nodes: those of
    connected_components, where a node without links is not in. The rows of components go through the join by themselves,
    and what is joined to them is a table of its own, so Spark splits the rows of a very large component."""
    linked = written(of.join(nodes, "node"))
    least = written(linked.groupBy("component").agg(F.min("least").alias(name)))
    alone = of.join(nodes, "node", "left_anti").select("node", F.col("least").alias(name))
    return linked.select("node", "component").join(least, "component").select("node", name).unionByName(alone)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """id_col, fingerprint (long), component_id of each row of docs.

    component_id is the smallest id of the rows that can be reached over links, a row itself included; null only where
    all of these have a null id. Rows of equal fingerprints are one node, so copies cost nothing after a map-side
    aggregation. Repeated rows and null ids are rows like any other. Empty table: no rows.
    """
    prints = written(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    nodes = lambda: connected_components(links(prints, distance=distance))
    of = settled(lambda: least_ids(prints.groupBy(F.col("fingerprint").alias("node")).agg(F.min(id_col).alias("least")), nodes(), "component_id"))
    return prints.join(of, F.col("fingerprint") == F.col("node")).select(id_col, "fingerprint", "component_id")


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prints: int = 4, shingle: int = 5, distance: int = 4, check_distance: int = 32) -> DataFrame:
    """group, id of the rows of docs that may have near duplicates: those of one component of links, which is named by its
    smallest id. A link: at most `distance` bits in one of `prints` fingerprints of sketches, and check_distance in the check;
    rows of equal checks are one node. Rows with a null id, and those without links, are left out."""
    own = written(sketches(docs, id_col=id_col, text_col=text_col, prints=prints, shingle=shingle))
    node = F.xxhash64("check_1", "check_2").alias("node")
    nodes = lambda: connected_components(links(own, distance=distance, of=[f"print_{k}" for k in range(prints)], check_distance=check_distance))
    of = settled(lambda: least_ids(own.groupBy(node).agg(F.min("id").alias("least")), nodes(), "group"))
    found = written(own.select("id", node).join(of, "node").where("id is not null").select("group", "id").distinct())
    return found.join(written(found.where(F.col("id") > F.col("group")).select("group").distinct()), "group")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """group, id, node (what names the set), n and hashes (sorted, 64 bits each) of the set of shingles of each row of
    docs (group, id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for w in blocks(batch.column(2)):
                sets = [b""] * (w.last - w.first)
                if len(w.start):
                    view, start, end = _normal(w)
                    n, _, i, j = _shingles(w, shingle)
                    upto = np.cumsum(n).tolist()
                    for k, (lo, hi) in enumerate(zip([0, *upto], upto, strict=False)):
                        spans = zip(start[i[lo:hi]].tolist(), end[j[lo:hi]].tolist(), strict=True)
                        sets[k] = np.unique(np.array([digest(view[a:b]) for a, b in spans], "<u8")).tobytes()
                own = [c.slice(w.first, w.last - w.first) for c in batch.columns[:2]]
                node = pa.array(np.array([digest(x) for x in sets], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([*own, node, pa.array([len(x) // 8 for x in sets], pa.int64()), pa.array(sets, pa.binary())], ["group", "id", "node", "n", "hashes"])

    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in ("group", "id")] + [T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("hashes", T.BinaryType())])
    return docs.select("group", "id", "text").mapInArrow(run, schema)


def _similar(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Edges of a spanning forest of the pairs of sets of a Jaccard similarity of least or more, as rows of numbers into
    sets, breadth first over what is not reached yet."""
    n = np.array([len(x) for x in sets], np.int64)
    own = np.cumsum(n) - n
    _, value, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    holder = np.repeat(np.arange(len(sets)), n)[np.argsort(value, kind="stable")]
    first = np.cumsum(times) - times
    rest, out = np.ones(len(sets), bool), []
    for seed in range(len(sets)):
        if not rest[seed]:
            continue
        rest[seed], queue = False, [seed]
        while queue and rest.any():
            x = queue.pop()
            v = value[own[x] : own[x] + n[x]]
            k = times[v]
            at = np.arange(k.sum()) + np.repeat(first[v] - (np.cumsum(k) - k), k)
            both = np.bincount(holder[at], minlength=len(sets))
            reached = np.flatnonzero(rest & (both > 0) & (both >= least * (n[x] + n - both) - 1e-9))
            rest[reached] = False
            out += [(x, y) for y in reached.tolist()]
            queue += reached.tolist()
    return np.array(out, np.int64).reshape(-1, 2)


def similar_pairs(items: DataFrame, *, similarity: float) -> DataFrame:
    """a, b: a spanning forest, by cell, of all pairs of items (group, node, n, hashes) of one group whose sets have that
    Jaccard similarity or more. Each pair of a group meets in a cell, so the components are those of all such pairs."""
    size = items.groupBy("group").agg(F.count(F.lit(1)).alias("items"), F.ceil(F.sum("n") / CELL_SHINGLES).cast("int").alias("sides"))
    # a table of its own, so that Spark splits the rows of a large group in the join
    size = written(size.where("items > 1 and sides > 0").select("group", "sides"))
    at = items.join(size, "group").withColumn("own", F.pmod(F.xxhash64("node"), F.col("sides")).cast("int"))
    at = at.select("group", "node", "hashes", "own", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("other"))
    # cells whose hashes are equal are compared as one, which adds no pair that is not similar
    placed = at.select(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "node", "hashes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            node = np.array([x for x, _ in held], np.int64)
            both = node[_similar([x for _, x in held], similarity)]
            return pa.RecordBatch.from_arrays([pa.array(both[:, k].copy()) for k in (0, 1)], ["a", "b"])

        at, held = None, []  # rows come cell by cell; a cell may go over the end of a batch
        for batch in batches:
            for cell, node, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if held and cell != at:
                    yield edges(held)
                    held = []
                at = cell
                held.append((node, np.frombuffer(hashes.as_py(), "<u8")))
        if held:
            yield edges(held)

    return placed.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "a long, b long")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5, **params) -> DataFrame:
    """docs without the rows that have a row of a smaller id in their component; the columns of docs. Links of these
    components are pairs of rows whose sets of shingles of `shingle` words have a Jaccard similarity of `similarity` or
    more, computed, not estimated. Fingerprints only name the rows that are compared, as candidates (which has params)
    does: a similarity of 0.8 comes to 4 bits of one fingerprint of the words on average, so that four of them miss few, and
    to 19 of the 128 bits of the check; texts without shingles in common come to 64. Of repeated rows of that smallest id,
    all stay together as they came, so give each document an id of its own; rows with a null id stay and link no others."""
    found = candidates(docs, id_col=id_col, text_col=text_col, shingle=shingle, **params)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(found, "id")
    sets = written(_sets(texts, shingle))
    name = unused(docs, "gone_")

    def superfluous() -> DataFrame:
        items = written(sets.groupBy("group", "node").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes")))
        nodes = connected_components(similar_pairs(items, similarity=similarity))
        # rows of one set are one node, so copies cost nothing after a map-side aggregation
        of = written(least_ids(sets.groupBy("node").agg(F.min("id").alias("least")), nodes, "least"))
        return sets.select("id", "node").join(of, "node").where(F.col("id") > F.col("least")).select(F.col("id").alias(name)).distinct()

    gone = settled(superfluous)
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
