"""The Merkle manifest, best-fit packing and spelling variants against plain versions, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridextract.llm import merkle, min_bin_slack, packing, queries, spelling
from tests.conftest import SF

#: A null id, null, empty and blank texts, repeated rows, an id with two texts, a long text.
ODD = [(None, None), (None, "a b c d e f"), (1, ""), (2, " \n\t "), (3, "one two three four five six"), (3, "one two three four five six"), (3, "another text of this id here"), (4, "wörd " * 30_000), (5, "x"), (6, None), (7, "one two three four five six")]


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(ODD, "doc_id long, text string")
    for c in ("id", "length", "rank", "part", "piece", "n", "word", "leaf", "root"):
        d = d.withColumn(c, F.lit("clash"))
    return d


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.WORD_TOKENIZER)


# best-fit packing


def test_ids_are_those_of_the_tokenizer(tokenizer):
    rnd = random.Random(5)
    bits = ["Hello", "it's", "'tis", "!!'s", "é", "É", "Ünder", "x×y", "÷", "Å", "3½", "12a3", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "\x1c", "\x00", "中文", " ", "\n", "\t", "ΣΑΣ", "İ", "ﬁ", "é", "1,000.5", "_-_", "ß", "Þ", "“q”", "😀"]
    texts = ["".join(rnd.choice(bits) + rnd.choice(["", "", " "]) for _ in range(rnd.randint(0, 12))) for _ in range(4_000)]
    texts += ["".join(chr(rnd.choice([rnd.randint(0, 127), rnd.randint(0, 0x2FF), rnd.randint(0, 0xD7FF)])) for _ in range(rnd.randint(0, 20))) for _ in range(4_000)]
    got = min_bin_slack.WordIds(queries.WORD_TOKENIZER).of(pa.array([*texts, None]))
    for text, ids in zip([*texts, ""], got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_words_forgotten_are_worked_out_again(monkeypatch, tokenizer):
    monkeypatch.setattr(min_bin_slack, "REMEMBERED", 2)
    ids = min_bin_slack.WordIds(queries.WORD_TOKENIZER)
    assert np.frombuffer(b"".join(ids.of(pa.array(["a b c d a b " + "x" * 100]))), "<u4").tolist() == tokenizer.encode("a b c d a b " + "x" * 100).ids and len(ids) <= 2


def test_fullest_is_the_fullest():
    rnd = random.Random(3)
    for _ in range(200):
        pool = [rnd.randint(1, 30) for _ in range(rnd.randint(1, 9))]
        room, count = rnd.randint(1, 60), Counter(pool)
        used = min_bin_slack.fullest(sorted(count), count, room)
        best = max(sum(x for i, x in enumerate(pool) if mask >> i & 1) for mask in range(1 << len(pool)) if sum(x for i, x in enumerate(pool) if mask >> i & 1) <= room)
        assert sum(n * k for n, k in used.items()) == best and all(k <= count[n] for n, k in used.items())


def plain_plan(pool, cap):
    """Sequences, one after the other: the longest piece and the fullest combination of single pieces with it."""
    pool, out = sorted(pool), 0
    while pool:
        longest = pool.pop()
        sums = {0: ()}
        for i in range(len(pool) - 1, -1, -1):
            if cap - longest in sums:
                break
            for at, items in list(sums.items()):
                sums.setdefault(at + pool[i], (*items, i)) if at + pool[i] <= cap - longest else None
        for i in sorted(sums[max(sums)], reverse=True):
            pool.pop(i)
        out += 1
    return out


@pytest.mark.parametrize("seed", range(8))
def test_plan_fills_as_single_pieces_do(seed):
    rnd = random.Random(seed)
    pool = [rnd.choice([rnd.randint(1, 100), rnd.randint(1, 12), 40, 100]) for _ in range(rnd.randint(0, 300))]
    counts = Counter(pool)
    made = min_bin_slack.plan(counts, 100)
    length = np.array(sorted(pool), np.int64)
    rank = np.array([k for n in sorted(counts) for k in range(counts[n])], np.int64)
    held = defaultdict(list)
    if pool:
        for n, s, at in zip(length, *made.places(length, rank), strict=True):
            held[s].append((at, n))
    for pieces in held.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False)) and sum(pieces[-1]) <= 100
    assert sorted(held) == list(range(made.n_sequences))
    assert -(-sum(pool) // 100) <= made.n_sequences <= plain_plan(pool, 100) + 1


def packed(rows, texts, tokenizer, cap):
    """Checks pieces against texts; returns sequences."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and [r["length"] for r in pieces] == [cap] * (len(ids) // cap) + [len(ids) % cap] * bool(len(ids) % cap)
        for r in pieces:
            assert r["start"] == r["piece"] * cap and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for pieces in by_sequence.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False)) and sum(pieces[-1]) <= cap
    return len(by_sequence)


def test_op12_query(spark, tokenizer):
    rows = queries.op12_min_bin_slack(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n = packed(rows, texts, tokenizer, 4096)
    assert n == -(-sum(r["length"] for r in rows) // 4096)  # no number of sequences could be smaller


def test_op12_odd_table(spark, odd, tokenizer):
    got = min_bin_slack.pack(odd.withColumn("sequence_id", F.lit(1)), queries.WORD_TOKENIZER, max_len=64).collect()
    want = Counter()
    for doc, text in ODD:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want.update((doc, tuple(ids[i : i + 64])) for i in range(0, len(ids), 64))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    assert min_bin_slack.pack(odd.limit(0), queries.WORD_TOKENIZER).count() == 0


def test_packing_numbers_have_no_gaps(spark, odd):
    got = packing.pack(odd, queries.TOKENIZER, max_len=8)
    assert sorted(r[0] for r in got.select("sequence_id").collect()) == list(range(got.count()))


# Merkle manifest


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_leaf(*values):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(level, fanout):
    """Root, and of each leaf the digests before and after it by level."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for leaf, i in enumerate(at):
            run, place = runs[i // fanout], i % fanout
            paths[leaf].append(("".join(run[:place]), "".join(run[place + 1 :])))
            at[leaf] = i // fanout
        level = [digest(*run) for run in runs]
    return level[0], paths


def plain_manifest(rows, fanout):
    """rows: (id, group, leaf) -> Counter of (id, leaf, subroot, root, steps)."""
    low = lambda v: (v is not None, v)
    groups = defaultdict(list)
    for i, g, leaf in rows:
        groups[g].append((i, leaf))
    made = []
    for g in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        groups[g].sort(key=lambda x: (low(x[0]), x[1]))
        made.append((g, *plain_tree([leaf for _, leaf in groups[g]], fanout)))
    root, over = plain_tree([sub for _, sub, _ in made], fanout) if made else (None, [])
    return Counter((i, leaf, sub, root, tuple(path + above)) for (g, sub, paths), above in zip(made, over, strict=True) for (i, leaf), path in zip(groups[g], paths, strict=True))


@pytest.mark.parametrize(("n", "fanout", "langs"), [(0, 2, 1), (1, 2, 1), (2, 2, 2), (65, 2, 1), (700, 2, 3), (300, 3, 2), (40, 100, 3), (130, 2, 130)])
def test_manifest_equals_plain_trees(spark, n, fanout, langs):
    rnd = random.Random(n)
    names = [None, "", "é", "z", *(f"g{i}" for i in range(langs))][: max(langs, 1) + 1]
    rows = [(None if i % 50 == 7 else i // 2, rnd.choice(names[: 1 + i % len(names)]), rnd.choice([None, "", "text é", f"t{i}"])) for i in range(n)]
    rows += rows[: n // 3]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    for c in ("id", "h", "tree", "index", "level", "key", "row", "at", "all", "group", "steps", "root"):
        d = d.withColumn(c, F.lit("clash"))
    got = merkle.manifest(d, ["doc_id", "lang", "text"], fanout=fanout).collect()
    want = plain_manifest([(i, g, plain_leaf(i, g, t)) for i, g, t in rows], fanout)
    assert Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((s["before"], s["after"]) for s in r["steps"])) for r in got) == want


def test_op11_finds_tampering(spark):
    rows = queries.op11_merkle(spark, SF).collect()
    for r in rows:
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0) == (r["folded_root"] == r["root"])
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = plain_manifest([(i, d["lang"], plain_leaf(*(d[c] for c in ("doc_id", "source", "lang", "n_chars", "text")))) for i, d in docs.items()], 2)
    assert Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in rows) == Counter((*k[:4], digest(*(a + b for a, b in k[4]))) for k in want)


def test_op11_of_odd_columns(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "s", "en", 5, "x"), (7, "s", None, None, ""), (14, "s", "en", 3, "y" * 100_000), (14, "s", "en", 3, "y" * 100_000)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_merkle(spark, str(tmp_path)).collect()
    want = plain_manifest([(r[0], r[2], plain_leaf(*r)) for r in rows], 2)
    assert Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got) == Counter((*k[:4], digest(*(a + b for a, b in k[4]))) for k in want.elements())
    for r in got:
        altered = r["doc_id"] == 14 and zlib.crc32(b"14") % 7 == 0
        assert r["verified"] != altered


# spelling variants


def plain_runs(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall("[A-Za-zÀ-ÿ]+", text or "")]


def plain_words(rows, every, shortest=5, least=3):
    n = Counter()
    for doc, text in rows:
        for run in plain_runs(text):
            h = zlib.crc32(f"{doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if doc is not None and every and h % every == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= shortest and k >= least}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    near = defaultdict(list)
    every = sorted(words)
    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            if abs(len(a) - len(b)) < 2 and one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in every:
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in every}


def variant_rows(df):
    got = df.collect()
    out = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}
    assert len(out) == len(got)
    return out


@pytest.mark.parametrize("most_pairs", [0, 3, 1 << 13])
def test_variants_of_random_words(spark, most_pairs, monkeypatch):
    rnd = random.Random(9)
    monkeypatch.setattr(spelling.near_pairs, "__kwdefaults__", {"most_pairs": most_pairs})
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 7))): rnd.randint(1, 60) for _ in range(350)}
    words |= {"x" * 4_000 + a: k for a, k in (("", 9), ("y", 4), ("yz", 1), ("q", 4))}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert variant_rows(got) == plain_variants(words)


def test_dictionary_of_odd_texts(spark, odd, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    texts = [*ODD, (8, "Straße STRASSE É×÷ÿ Ā a1b “naïve” naïve NAÏVE " * 5), (9, "éa中bÉÀ"), (10, "slips of the pen " * 40)]
    d = spark.createDataFrame(texts, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit("clash")).withColumn("id", F.lit(0))
    for every in (None, 1, 3):
        got = spelling.dictionary(d, shortest=3, least=2, slip_every=every).collect()
        assert {r["word"]: r["n"] for r in got} == plain_words(texts, every, 3, 2) and len(got) == len({r["word"] for r in got})
    assert spelling.variants(spelling.dictionary(d.limit(0))).count() == 0


def test_op13_query(spark):
    got = variant_rows(queries.op13_spelling(spark, SF))
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == plain_variants(plain_words(rows, 97))
