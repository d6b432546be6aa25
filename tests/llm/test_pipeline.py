"""Each stage of the corpus pipeline on planted cases, and the whole of it."""

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from gridextract.llm import decontaminate, simhash_anchor
from gridextract.llm.labelled import platt
from gridextract.llm.scratch import written
from tests.conftest import SF
from tests.llm.test_operators import brute_toxicity, maximal_matches


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF))
        assert out.columns == docs.columns, name
        assert out.dtypes == docs.dtypes, name
        counts.append(out.count())
        docs = out
    assert counts[0] > counts[1] == counts[2] > counts[3] > counts[4] > 0.7 * counts[0]
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.where("start = 0").count() == counts[4]


def test_stages_on_odd_tables(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b c", None, None, 5), (2, "a b c", None, None, 5), (3, "long " * 20_000, "en", "s", 100_000)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table(spark, rows), SF)
        assert 4 <= out.count() <= 5, name
        assert stage(spark, table(spark, rows).limit(0), SF).count() == 0, name


def test_stages_with_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for c in ("id", "v", "id_", "v_", "gone_", "kept_", "text_", "Gone__", "node", "component", "group", "least", "score", "evidence", "leaf", "raw", "hashes", "n"):
        docs = docs.withColumn(c, F.lit("clash"))
    docs = written(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert 0 < out.count() <= 60 and out.where("id_ <> 'clash' or Gone__ <> 'clash'").count() == 0, name


def test_toxicity_and_decontamination_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = {r.doc_id: r.text for r in docs.orderBy("doc_id").collect()}
    kept = {r.doc_id for r in stages["toxicity"](spark, docs, SF).collect()}
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    nearest, left_out = brute_toxicity(texts, y)
    odds = lambda s: np.log(np.clip(s, 1e-6, 1 - 1e-6) / (1 - np.clip(s, 1e-6, 1 - 1e-6)))
    a, b = platt(odds(np.array([left_out[i] for i in y])), np.array([y[i] for i in y], float))
    score = {i: 1 / (1 + np.exp(-a * odds(share) - b)) for i, (_, share) in nearest.items()}
    assert {i for i in texts if score[i] < 0.499} <= kept <= {i for i in texts if score[i] < 0.501} and len(kept) < len(texts)

    cut = lambda t: re.findall("[0-9a-z\\x80-\U0010ffff]+", (t or "").lower())
    items = [cut(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = set()
    for i, t in texts.items():
        doc = cut(t)
        own = {tuple(doc[k : k + 5]) for k in range(len(doc) - 4)}
        for x in items:
            if any(tuple(x[k : k + 5]) in own for k in range(len(x) - 4)):
                found = decontaminate.tiles(*np.array(maximal_matches(x, doc, 5), np.int64).reshape(-1, 3).T, 5)
                leaks |= {i} if 2 * sum(n for _, _, n in found) >= len(x) else set()
    assert {r.doc_id for r in stages["decontamination"](spark, docs, SF).collect()} == set(texts) - leaks and leaks


def test_planted_cases(spark):
    words = "alder birch cedar dogwood elm fir ginkgo hazel iron juniper kapok larch maple nutmeg oak pine quince rowan spruce teak".split()
    text = " ".join(words[(7 * i * i + i) % 20] + str(i % 13) for i in range(300))
    near = text.replace("alder0", "changed")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    clean = " ".join(words[(3 * i * i + 5 * i) % 20] + str(i % 17) for i in range(200))
    docs = table(spark, [(10, text, "en", "s", 1), (11, text, "en", "s", 1), (12, near, "en", "s", 1), (20, f"Before. {item} After.", "en", "s", 1), (30, clean, "en", "s", 1)])
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    assert ids(stages["near_dedup"](spark, docs, SF)) == [10, 20, 30]
    assert ids(stages["decontamination"](spark, docs, SF)) == [10, 11, 12, 30]
    assert 30 in ids(stages["toxicity"](spark, docs, SF))


def exact_drops(texts):
    """Ids that have a smaller one in their component of pairs of 0.8 or more of five-word shingles; every pair is tried."""
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    ids, least = sorted(sets), {i: i for i in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
    return {i for i in ids if root(i) != i}


def edited(seed, every, n=300):
    """A text, and copies of it with another word at every `every`-th place."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(5000)}" for _ in range(n)]
    return words, [f"x{seed}" if k % every == every // 2 else w for k, w in enumerate(words)]


def test_near_dedup_equals_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    # similarities of about 0.54 to 0.95, chains of them among these
    for n, every in enumerate((16, 18, 20, 25, 30, 45, 60, 100) * 6):
        a, b = edited(n, every)
        c = [f"y{n}" if k % every == 1 else w for k, w in enumerate(b)]
        texts |= {100_000 + 3 * n + k: " ".join(x) for k, x in enumerate((a, b, c))}
    table_ = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in simhash_anchor.drop_near_duplicates(table_).select("doc_id").collect()}
    got, want = set(texts) - kept, exact_drops(texts)
    assert got <= want  # none goes that has no document of 0.8
    assert len(got) >= 0.97 * len(want)


def test_split_groups_meet_in_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash_anchor, "CELL_SHINGLES", 300)
    texts = {10 * n + k: " ".join(x) for n in range(4) for k, x in enumerate(edited(n, 40 if n < 2 else 20))}
    sets = simhash_anchor._sets(spark.createDataFrame([(7, i, t) for i, t in texts.items()], "group long, id long, text string"), 5)
    node = {r.node: r.id for r in sets.select("node", "id").collect()}
    pairs = simhash_anchor.similar_pairs(sets.select("group", "node", "n", "hashes"), similarity=0.75).distinct().collect()
    assert {tuple(sorted((node[r.a], node[r.b]))) for r in pairs} == {(0, 1), (10, 11)}


def test_line_dedup_drops_short_lines(spark):
    rows = [(i, f"Les.\nAnd ornd.\n{i}\n{i} {i + 1}\n\nOwn line {'abcdef'[i]} of the text", "en", "s", 1) for i in range(6)]
    out = dict(corpus_pipeline.STAGES)["line_dedup"](spark, table(spark, rows), SF)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[0] == rows[0][1]
    assert all(texts[i] == rows[i][1].removeprefix("Les.\nAnd ornd.\n") for i in range(1, 6))
