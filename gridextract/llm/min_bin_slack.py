"""Sequence packing by minimum bin slack.

Texts are cut into pieces of at most max_len tokens. Sequences are filled one after the other: the longest piece that is
left opens a sequence, and the fullest combination that fits into the rest is found among all lengths left, by dynamic
programming over subset sums, where a set of sums is the bits of one integer. Sums grow from the long lengths down and stop
where the sequence is full, so short pieces stay for later. A combination is taken again as long as the lengths that it
needs are left, which is what the next sequence would find, too; so the plan is worked out on the number of pieces of each
length, at most max_len numbers whatever the size of the corpus, and Spark deals its places out to the pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packing import numbered_by_length
from .scratch import written
from .tokens import BLOCK_BYTES, LOWER, SPACE, buffers

#: Words that a worker remembers the ids of, and the bytes of the longest of them.
REMEMBERED, LONGEST = 1 << 19, 64
BLANK, LETTER, DIGIT, SIGN, OTHER = range(5)
#: What the tokenizer's own rules part ASCII characters by. Apostrophes (contractions), "<" (special tokens), control
#: characters and bytes of other characters are left to the tokenizer, with all that stands between the same two blanks.
_KIND = np.full(256, OTHER, np.uint8)
_KIND[33:127] = SIGN
_KIND[48:58] = DIGIT
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[[0x27, 0x3C]] = OTHER
_KIND[SPACE] = BLANK


def parted(buf: np.ndarray, begins: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of texts that begin at `begins` with a blank before each word, digit and run of signs, letters in lower
    case; and where each text begins there. Latin letters with accents (two bytes, from 0xC3 on) count as letters."""
    kind, low = _KIND[buf], LOWER[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    if len(lead):
        after = buf[lead + 1]
        fine = (after >= 0x80) & (after < 0xC0) & (after != 0x97) & (after != 0xB7)
        lead, after = lead[fine], after[fine]
        kind[lead] = kind[lead + 1] = LETTER
        low[lead + 1] = after + 0x20 * (after < 0x9F)
    cut = np.empty(len(buf), bool)
    cut[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:])
    cut |= kind == DIGIT
    first = np.zeros(len(buf) + 1, bool)
    first[begins] = True
    first = first[:-1]
    other = np.flatnonzero(kind == OTHER)
    if len(other):
        full = kind != BLANK
        chunk = np.cumsum(full & (first | np.append(True, ~full[:-1])))
        kept = np.zeros(int(chunk[-1]) + 1, bool)
        kept[chunk[other]] = True
        kept = kept[chunk] & full
        cut &= ~kept
        low[kept] = buf[kept]
    cut |= first
    to = np.cumsum(cut)
    out = np.full(len(buf) + int(to[-1]) if len(buf) else 0, 0x20, np.uint8)
    out[to + np.arange(len(buf))] = low
    return out.tobytes(), begins + np.concatenate([[0], to])[begins]


class WordIds(dict):
    """Bytes of a word, or of a chunk of text without white space -> its ids as little-endian unsigned 32-bit numbers. As the
    tokenizer drops white space and reads each word by itself, the ids of a text are those of its words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __missing__(self, word: bytes) -> bytes:
        ids = np.array(self.tokenizer.encode(word.decode(errors="replace"), add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    def of(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a column; null is empty. Texts are read in blocks of about BLOCK_BYTES."""
        data, bounds = buffers(column)
        i, total = 0, len(bounds) - 1
        while i < total:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + BLOCK_BYTES, "right")) - 1)
            words, at = parted(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            for lo, hi in pairwise(at.tolist()):
                yield b"".join(map(self.__getitem__, words[lo:hi].split()))
            i = j


_words: dict[str, WordIds] = {}


def fullest(lengths: list[int], count: dict[int, int], room: int) -> dict[int, int]:
    """How often each length is used in the fullest combination of at most `room`; count: how many there are of each of
    the ascending lengths. Of equally full ones, the one that reaches down the least into the short lengths."""
    sums, steps = 1, []
    mask = (1 << room + 1) - 1
    for i in range(bisect_right(lengths, room) - 1, -1, -1):
        if sums >> room:
            break
        n = lengths[i]
        left, times = min(count[n], room // n), 1
        while left:
            times = min(times, left)
            steps.append((n, times, sums))
            sums |= sums << n * times & mask
            left -= times
            times *= 2
    at, used = sums.bit_length() - 1, {}
    for n, times, before in reversed(steps):
        if not before >> at & 1:
            at -= n * times
            used[n] = used.get(n, 0) + times
    return used


class Plan(NamedTuple):
    """Rows by length and first rank: pieces of that length from that rank on go to `copies` sequences from `sequence` on,
    `uses` to each, the first at `offset`."""

    length: np.ndarray
    rank: np.ndarray
    uses: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    n_sequences: int

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence and offset of pieces."""
        i = np.searchsorted(self.length << 48 | self.rank, length << 48 | rank, "right") - 1
        nth = rank - self.rank[i]
        return self.sequence[i] + nth // self.uses[i], self.offset[i] + nth % self.uses[i] * length


def plan(counts: dict[int, int], max_len: int) -> Plan:
    """counts: number of pieces of each length."""
    left, taken, rows, sequence = dict(counts), dict.fromkeys(counts, 0), [], 0
    lengths = sorted(left)
    while lengths:
        longest = lengths[-1]
        left[longest] -= 1
        used = fullest(lengths, left, max_len - longest)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        copies, offset = min(left[n] // k for n, k in used.items()), 0
        for n, k in sorted(used.items(), reverse=True):
            rows.append((n, taken[n], k, sequence, offset))
            taken[n] += k * copies
            left[n] -= k * copies
            offset += n * k
            if not left[n]:
                lengths.pop(bisect_right(lengths, n) - 1)
        sequence += copies
    return Plan(*np.array(sorted(rows), np.int64).reshape(-1, 5).T, sequence)


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", max_len: int = 4096, end_id: int = 1, emit_ids: bool = True) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset and, with emit_ids, ids.

    tokenizer_path: a file of the tokenizers library that lower-cases, drops white space, and reads words, digits and runs
    of signs one by one, as word_bpe_49k.json does. Every row of docs is a document: repeated rows are packed each, a null id stays null, a null, empty or blank
    text is the end id alone. Texts of more than max_len ids are cut into pieces of max_len, the last may be shorter. Other
    columns are not read. An empty table gives no pieces. Which of several pieces of one length comes first follows the
    partitions of docs; the number of sequences does not.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType()),
        *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if emit_ids else []),
    ])
    end = int(end_id).to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _words:
            _words[tokenizer_path] = WordIds(tokenizer_path)
        ids_of, part, ranks = _words[tokenizer_path].of, TaskContext.get().partitionId(), np.zeros(max_len + 1, np.int64).tolist()
        for batch in batches:
            rows, ids = [], []

            def flush(batch=batch, rows=rows, ids=ids):
                row, piece, start, length, crc, rank = np.array(rows, np.int64).reshape(-1, 6).T
                cols = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), *map(pa.array, (start, length, crc)), pa.array(np.full(len(row), part), pa.int32()), pa.array(rank)]
                if emit_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                rows.clear()
                ids.clear()
                return pa.RecordBatch.from_arrays(cols, [f.name for f in schema])

            for row, all_ids in enumerate(ids_of(batch.column(1))):
                all_ids += end
                for k, start in enumerate(range(0, len(all_ids) // 4, max_len)):
                    one = all_ids[4 * start : 4 * (start + max_len)]
                    n = len(one) // 4
                    rows.append((row, k, start, n, zlib.crc32(one), ranks[n]))
                    ranks[n] += 1
                    if emit_ids:
                        ids.append(one)
                if len(rows) >= (2_000 if emit_ids else 20_000):
                    yield flush()
            yield flush()

    cut = written(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(pieces, schema))
    # at most max_len rows
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(plan(counts, max_len))
    out = [f for f in schema if f.name not in ("part", "rank", "ids")] + [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")] + [f for f in schema if f.name == "ids"]
    names = [f.name for f in out]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = shared.value.places(batch["length"].to_numpy(), batch["rank"].to_numpy())
            new = {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch[c] for c in names], names)

    ranked = numbered_by_length(cut).withColumn("rank", F.col("first") + F.col("rank"))
    placed = ranked.select(*(c for c in names if c not in ("sequence_id", "offset")), "rank").mapInArrow(place, T.StructType(out))
    return placed.withColumnRenamed("doc_id", id_col)
