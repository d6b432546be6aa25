"""One query for each operator, with the parameters of production, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, debruijn, decontaminate, line_templates, merkle, min_bin_slack, packing, quality_gbdt, quality_nbsvm, secrets, simhash_anchor, spelling, toxicity_knn
from .labelled import held_out

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")  # same ids as byte_bpe_50k.json


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and the benchmark item it leaks."""
    found = decontaminate.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "n_tiles", "longest")


def op2_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_nbsvm.fit(docs, table(spark, sf_dir, "labels"), label="quality")
    return quality_nbsvm.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), path_col="source")


def op4_toxicity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = toxicity_knn.fit_index(docs, table(spark, sf_dir, "labels"), label="toxic")
    return toxicity_knn.score(docs, index).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_anchor.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_chat_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    examples = chat_format.prefix_examples(turns.unionByName(extra))
    read = examples.withColumn("loss", chat_format.loss_text(examples)).groupBy("conv_id").agg(
        F.max_by("text", "example").alias("whole"), F.array_join(F.array_sort(F.collect_list(F.struct("example", "loss")))["loss"], "").alias("loss"), F.sum(F.char_length("text")).alias("formatted_chars"))
    read = read.withColumn("turns", chat_format.turns_of(F.col("whole")))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


OP6_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(4 + length(replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\e'), ':', '\c')) + 2
      + length(replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\e')) + 8) OVER w AS upto
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op7_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.drop_repeated_spans(table(spark, sf_dir, "documents"), k=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP7_SQL = r"""
WITH cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS span FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM cut)),
repeated AS (SELECT doc_id, i, row_number() OVER (PARTITION BY span ORDER BY doc_id, i) > 1 AS again FROM windows),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM cut),
judged AS (
  SELECT w.doc_id, w.i, w.word, coalesce(bool_or(r.again) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
  FROM words w LEFT JOIN repeated r ON r.doc_id = w.doc_id AND r.i = w.i)
SELECT c.doc_id, len(any_value(c.w)) AS n_words, count(j.i) FILTER (WHERE j.gone) AS n_removed,
  sha256(coalesce(string_agg(j.word, ' ' ORDER BY j.i) FILTER (WHERE NOT j.gone), '')) AS kept_sha256
FROM cut c LEFT JOIN judged j ON j.doc_id = c.doc_id GROUP BY c.doc_id
"""


def op8_quality_gbdt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality_gbdt.fit(docs, table(spark, sf_dir, "labels"), label="quality")
    return quality_gbdt.judge(docs, trees).drop("text")


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_recurring_lines(docs, n_lines="n_lines", n_dropped="n_dropped").select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, k, line, string_split_regex(regexp_replace(line, '^[ \t\r\f\v]+|[ \t\r\f\v]+$', '', 'g'), '[ \t\r\f\v]+') AS tokens
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)),
shaped AS (
  SELECT *, list_transform(tokens, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS m FROM lines),
leafed AS (SELECT *, len(tokens) || ' ' || array_to_string(m[1:3], ' ') AS leaf, array_to_string(m, ' ') AS masked FROM shaped),
leaves AS (SELECT leaf FROM leafed WHERE tokens[1] <> '' AND doc_id IS NOT NULL GROUP BY leaf HAVING count(DISTINCT doc_id) >= 5),
own AS (SELECT DISTINCT leaf, doc_id, masked, m FROM leafed SEMI JOIN leaves USING (leaf) WHERE tokens[1] <> '' AND doc_id IS NOT NULL),
kinds AS (SELECT leaf, masked, m, count(*) AS n FROM own GROUP BY ALL),
words AS (SELECT leaf, masked, n, unnest(m) AS token, generate_subscripts(m, 1) AS pos FROM kinds),
fixed AS (SELECT leaf, pos, token FROM words WHERE token <> '<*>' GROUP BY ALL HAVING sum(n) >= 5),
shape AS (
  SELECT w.leaf, w.masked, string_agg(coalesce(f.token, '<*>'), ' ' ORDER BY w.pos) AS template
  FROM words w LEFT JOIN fixed f ON w.leaf = f.leaf AND w.pos = f.pos AND w.token = f.token
  GROUP BY w.leaf, w.masked HAVING count(f.token) >= 0.5 * count(*)),
found AS (SELECT leaf, template, min(doc_id) AS first FROM own JOIN shape USING (leaf, masked) GROUP BY ALL HAVING count(DISTINCT doc_id) >= 5),
gone AS (SELECT DISTINCT o.doc_id, o.masked FROM own o JOIN shape s USING (leaf, masked) JOIN found f USING (leaf, template) WHERE o.doc_id <> f.first),
kept AS (SELECT l.doc_id, l.k, l.line, g.masked IS NOT NULL AS dropped FROM leafed l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.masked = g.masked)
SELECT d.doc_id, count(k.k) AS n_lines, count(k.k) FILTER (WHERE k.dropped) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.k) FILTER (WHERE NOT k.dropped), '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id GROUP BY d.doc_id
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, max_len=1024, end_id=0, emit_ids=False)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs are checked against tampered leaves where 7 divides the crc32 of the id."""
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    altered = merkle.leaf_of(*(F.col(c) + 1 if c == "n_chars" else F.col(c) for c in fields))
    rows = merkle.manifest(docs, fields, claimed=F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, altered))
    rows = rows.withColumn("folded_root", merkle.folded(F.coalesce("claimed", "leaf"), F.col("steps")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("steps")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
own AS (
  SELECT doc_id, lang,
    list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: xor(c // 256, t[1 + xor(c, b) % 256])) AS crc,
    coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS a,
    coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS b, coalesce(octet_length(encode(CAST(n_chars + 1 AS VARCHAR))) || ':' || n_chars + 1, '-') AS b_altered,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS c
  FROM documents, crc_table),
hashed AS (SELECT doc_id, lang, sha256(a || b || c) AS leaf, CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(a || b_altered || c) ELSE sha256(a || b || c) END AS claimed FROM own),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
tree AS (
  SELECT lang, 0 AS level, idx, leaf AS h, n FROM leaves
  UNION ALL
  SELECT lang, level + 1, idx // 2, sha256(h || coalesce(next, '')), (n + 1) // 2 FROM (SELECT *, lead(h) OVER (PARTITION BY lang ORDER BY idx) AS next FROM tree WHERE n > 1) WHERE idx % 2 = 0),
subroots AS (SELECT lang, h, level AS depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, idx, h, n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, sha256(h || coalesce(next, '')), (n + 1) // 2 FROM (SELECT *, lead(h) OVER (ORDER BY idx) AS next FROM top WHERE n > 1) WHERE idx % 2 = 0),
climb AS (
  SELECT doc_id, lang, leaf, 0 AS level, idx AS at, claimed AS h, '' AS proof, n FROM leaves
  UNION ALL
  SELECT c.doc_id, c.lang, c.leaf, c.level + 1, c.at // 2, CASE WHEN c.at % 2 = 1 THEN sha256(t.h || c.h) ELSE sha256(c.h || coalesce(t.h, '')) END, c.proof || coalesce(t.h, ''), (c.n + 1) // 2
  FROM climb c LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM c.lang AND t.level = c.level AND t.idx = xor(c.at, 1) WHERE c.n > 1),
over AS (
  SELECT c.doc_id, c.leaf, s.h AS subroot, 0 AS level, s.idx AS at, c.h, c.proof, s.n FROM climb c JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
  UNION ALL
  SELECT c.doc_id, c.leaf, c.subroot, c.level + 1, c.at // 2, CASE WHEN c.at % 2 = 1 THEN sha256(t.h || c.h) ELSE sha256(c.h || coalesce(t.h, '')) END, c.proof || coalesce(t.h, ''), (c.n + 1) // 2
  FROM over c LEFT JOIN top t ON t.level = c.level AND t.idx = xor(c.at, 1) WHERE c.n > 1)
SELECT o.doc_id, o.leaf, o.subroot, t.h AS root, sha256(o.proof) AS proof_sha256, o.h AS folded_root, o.h = t.h AS verified
FROM over o, (SELECT h FROM top WHERE n = 1) t WHERE o.n = 1
"""


def op12_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return min_bin_slack.pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER, max_len=4096, end_id=1, emit_ids=False)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.dictionary(table(spark, sf_dir, "documents"), slip_every=97))


def _crc_of_bit(bit: int) -> int:
    """What a bit of the lowest byte does to the other bits of a crc32 as that byte leaves."""
    c = 1 << bit
    for _ in range(8):
        c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
    return c


_CRC_BYTE = "c // 256"
for _bit in range(8):
    _CRC_BYTE = f"xor({_CRC_BYTE}, (xor(c, b) // {1 << _bit} % 2) * {_crc_of_bit(_bit)})"
OP13_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL HAVING length(run) >= 5),
hashed AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, unicode(x) - 64] END))), lambda c, b: {_CRC_BYTE})) AS h FROM runs),
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING sum(k) >= 3 AND length(word) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT x.word, y.word AS other, y.n FROM cut x JOIN cut y ON x.less = y.less AND x.i = y.i AND x.word <> y.word
  UNION SELECT w.word, c.word, c.n FROM words w JOIN cut c ON c.less = w.word
  UNION SELECT c.word, w.word, w.n FROM words w JOIN cut c ON c.less = w.word),
best AS (SELECT word, count(*) AS n_near, min(row(-n, other)) AS b FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 2 * w.n THEN b[2] END AS form, CAST(CASE WHEN -b[1] >= 2 * w.n THEN -b[1] END AS BIGINT) AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
walk AS (SELECT word, word AS at, form AS next FROM formed UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN formed f ON f.word = w.next)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN walk w ON w.word = f.word AND w.next IS NULL
"""


QUERIES = {
    "op1_string_tiling": op1_string_tiling,
    "op2_quality_nbsvm": op2_quality_nbsvm,
    "op3_secret_forest": op3_secret_forest,
    "op4_toxicity_knn": op4_toxicity_knn,
    "op5_simhash": op5_simhash,
    "op6_chat_prefix": op6_chat_prefix,
    "op7_debruijn": op7_debruijn,
    "op8_quality_gbdt": op8_quality_gbdt,
    "op9_line_templates": op9_line_templates,
    "op10_packing": op10_packing,
    "op11_merkle": op11_merkle,
    "op12_min_bin_slack": op12_min_bin_slack,
    "op13_spelling": op13_spelling,
}
ORACLE_SQL = {"op6_chat_prefix": OP6_SQL, "op7_debruijn": OP7_SQL, "op9_line_templates": OP9_SQL, "op11_merkle": OP11_SQL, "op13_spelling": OP13_SQL}
