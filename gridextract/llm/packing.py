"""Sequence packing by power-of-two decomposition.

A document of n tokens is cut into n // max_len pieces of max_len tokens and, for what is left, one piece for each set
bit of its length, longest first. Pieces of one length form a bucket; each piece is a sequence of its own, so no
sequence crosses documents and none needs padding.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .scratch import written

_encoders: dict[str, object] = {}


def encoder(path: str):
    """text -> numpy ids. *.json: the tokenizers library; *.tiktoken: the same ids from a file of ranks, several times
    faster; special tokens are then {"<|endoftext|>": number of ranks}, recognised in texts as tokenizers does."""
    if path not in _encoders:
        if path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
            _encoders[path] = lambda text: own.encode_to_numpy(text, allowed_special="all")
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            _encoders[path] = lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32)
    return _encoders[path]


def piece_lengths(n: int, max_len: int) -> list[int]:
    """Lengths of the pieces of n tokens, longest first; max_len is a power of two."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(max_len.bit_length() - 2, -1, -1) if rest >> b & 1]


def numbered_by_length(cut: DataFrame) -> DataFrame:
    """cut (length, part, ...) with first: the rows of the same length in parts before its own. Only one row for each
    length and part is summed up, by length."""
    n = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(n.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("first")), ["length", "part"])


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", max_len: int = 1024, end_id: int = 0, emit_ids: bool = True) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset (always 0) and, with
    emit_ids, ids.

    Every row of docs is a document: repeated rows are packed each, a null id stays null, a null or empty text is the
    end id alone. Other columns are not read. An empty table gives no pieces. sequence_id numbers the pieces of the
    shortest length first, then of the next, without gaps; it follows the partitions of docs.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    kind = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("part", T.IntegerType()),
        T.StructField("rank", T.LongType()), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if emit_ids else []),
    ])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, ranks = encoder(tokenizer_path), TaskContext.get().partitionId(), dict.fromkeys(piece_lengths(2 * max_len - 1, max_len), 0)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("row", "start", "length", "crc", "tokens", "rank", "ids")}

            def flush(batch=batch):
                cols = [batch.column(0).take(pa.array(out["row"], pa.int64())), *(pa.array(out[c], pa.int64()) for c in ("start", "length", "crc", "tokens")), pa.array([part] * len(out["row"]), pa.int32()), pa.array(out["rank"], pa.int64())]
                if emit_ids:
                    flat = np.concatenate([*out["ids"], np.zeros(0, np.uint32)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(out["length"])]), pa.int32()), pa.array(flat)))
                for c in out.values():
                    c.clear()
                return pa.RecordBatch.from_arrays(cols, [f.name for f in schema])

            for row, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                start = 0
                for n in piece_lengths(len(ids), max_len):
                    out["row"].append(row)
                    out["start"].append(start)
                    out["length"].append(n)
                    out["crc"].append(zlib.crc32(ids[start : start + n].tobytes()))
                    out["tokens"].append(len(ids))
                    out["rank"].append(ranks[n])
                    out["ids"] += [ids[start : start + n]] if emit_ids else []
                    ranks[n] += 1
                    start += n
                if len(out["row"]) >= 20_000 or emit_ids and len(out["row"]) >= 2_000:
                    yield flush()
            yield flush()

    cut = written(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(pieces, schema))
    first = numbered_by_length(cut)
    # a row for each of at most 2 * log2(max_len) lengths
    sizes = sorted((r["length"], r["n"]) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect())
    begin = dict(zip((n for n, _ in sizes), np.cumsum([0, *(k for _, k in sizes)]).tolist(), strict=False))
    base = F.create_map(*(F.lit(x) for kv in begin.items() for x in kv))[F.col("length")] if begin else F.lit(0).cast("long")
    return first.select(
        F.col("doc_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", (base + F.col("first") + F.col("rank")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(["ids"] if emit_ids else []))
