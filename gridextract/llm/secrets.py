"""Secret scans: a random forest removes false positives from candidate strings.

Candidates are runs of 16 or more of [A-Za-z0-9+/=_.-] with a digit or with capitals after the first letter, and values of
any kind from 6 characters on that are assigned to a name with "pass", "pwd", "secret", "token", "key", "auth" or "cred" in
it. The forest sees the length of a candidate, how its characters follow each other (under counts of the whole corpus), how
much of it the words of the corpus cover, and how much the words before and after it on its line, and those of its
document's path, go with secrets in the labelled findings it learns from.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import Words, blocks

MIN_LENGTH, MIN_ASSIGNED = 16, 6
RUN = np.zeros(256, bool)
RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/=_-."]] = True
#: Character classes of the transition counts: a-z without case, 0-9, anything else.
CLASS = np.full(256, 36, np.int64)
CLASS[97:123] = CLASS[65:91] = np.arange(26)
CLASS[48:58] = np.arange(26, 36)
#: Names that a secret is assigned to hold one of these.
ASSIGNED = rb"(?i)(?:pass|pwd|secret|token|key|auth|cred)[a-z0-9_.-]{0,40}[\"']?[ \t]*(?::=|=>|=|:)[ \t]*(?:\"([^\"\n]{6,})\"|'([^'\n]{6,})'|([^\s\"',;]{6,}))"
#: Words of a line on either side of a candidate that count, and the letters of a line that are looked at for them.
NEAR, REACH, SIDES = 4, 160, ("nearest", "before", "after", "path")
#: Findings that a word must stand by to tell anything.
LEAST_SEEN = 5
#: Lengths of the words of the corpus that can cover part of a candidate.
SHORTEST, LONGEST = 4, 16
FEATURES = ("length", "entropy", "digits", "upper", "lower", "other", "distinct", "class_changes", "transitions", "coverage", "hex", "uuid", "longest_run", "nearest", "before", "after", "path", "assigned", "quoted", "prefix")
#: How keys of known services begin.
_PREFIX = re.compile(r"AKIA|ASIA|gh[pousr]_|xox[abp]-|sk_|pk_|eyJ|AIza|glpat-")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
_WORD = re.compile(r"[a-z]+")
_ASSIGNED = re.compile(ASSIGNED)
#: What labelled_findings makes names of.
NAMES = tuple("account address agent alert async backup batch board branch buffer button cache channel cluster column config content default device driver engine export filter folder gateway handler history image index invoice layer layout library manager matrix memory module network object option package parent player plugin policy process product profile project query region release report request resource response schema server service session source status storage stream system target template thread vector version window worker".split())


@dataclass
class Knowledge:
    """What features are worked out with: log shares of character transitions, the words of the corpus, and by word how much
    it goes with secrets: counts of findings with it (secret, not) on each of SIDES."""

    logs: np.ndarray
    words: frozenset
    seen: dict = field(default_factory=lambda: {side: {} for side in SIDES})
    totals: tuple[int, int] = (0, 0)

    def weight(self, side: str, words: set[str], own: int | None = None) -> float:
        """Sum of log ratios of the words; own: the verdict of the finding at hand, which is not counted for itself."""
        out, (n1, n0) = 0.0, self.totals
        for w in words:
            c1, c0 = self.seen[side].get(w, (0, 0))
            c1, c0 = c1 - (own == 1), c0 - (own == 0)
            if c1 + c0 > 0:
                out += float(np.log((c1 + 2) / (n1 + 4)) - np.log((c0 + 2) / (n0 + 4)))
        return out


def transition_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """37 x 37 counts of the character classes that follow each other in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(37 * 37, np.int64)
        for batch in batches:
            for w in blocks(batch.column("text")):
                c = CLASS[w.buf]
                total += np.bincount(c[:-1] * 37 + c[1:], minlength=37 * 37)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(37 * 37, dtype=np.int32)), pa.array(total)], ["pair", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(37 * 37)
    for r in rows:
        out[r.pair] = r.n
    return out.reshape(37, 37)


def log_transitions(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + 1) / (counts + 1).sum(1, keepdims=True))


def corpus_words(docs: DataFrame, text_col: str = "text", most: int = 20_000, min_docs: int = 5) -> frozenset:
    """The words of SHORTEST to LONGEST letters a-z that most documents have, at most `most`, each in min_docs documents or
    more; counted over all documents."""
    words = F.array_distinct(F.split(F.lower(F.col(text_col).cast("string")), "[^a-z]+"))
    each = docs.select(F.explode(words).alias("w")).where(F.char_length("w").between(SHORTEST, LONGEST))
    top = each.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).orderBy(F.desc("n"), "w").limit(most)
    return frozenset(top.toArrow()["w"].to_pylist())


def covered(candidate: str, words: frozenset) -> int:
    """Letters of a candidate that words cover: from the left, the longest word first."""
    low, at, out = candidate.lower(), 0, 0
    while at + SHORTEST <= len(low):
        n = next((k for k in range(min(LONGEST, len(low) - at), SHORTEST - 1, -1) if low[at : at + k] in words), 0)
        out += n
        at += n or 1
    return out


def neighbours(before: str, after: str, path: str) -> dict[str, set[str]]:
    """The word before a candidate on its line, the NEAR words before that one and after the candidate, and the words of its
    path."""
    words = _WORD.findall(before.lower())
    return {"nearest": set(words[-1:]), "before": set(words[-NEAR - 1 : -1]), "after": set(_WORD.findall(after.lower())[:NEAR]), "path": set(_WORD.findall(path.lower()))}


def features(candidate: str, before: str, after: str, path: str, known: Knowledge, own: int | None = None) -> list[float]:
    """The FEATURES of one candidate; before and after: what is on its line, REACH bytes at most on either side."""
    raw = np.frombuffer(candidate.encode(), np.uint8)
    n = len(raw)
    share = np.unique(raw, return_counts=True)[1] / n
    digit, upper, lower = ((raw >= a) & (raw <= b) for a, b in ((48, 57), (65, 90), (97, 122)))
    kind, c = digit * 1 + upper * 2 + lower * 3, CLASS[raw]
    runs = np.diff(np.flatnonzero(np.concatenate([[True], raw[1:] != raw[:-1], [True]])))
    near = neighbours(before, after, path)
    values = [
        n, -(share * np.log2(share)).sum(), digit.mean(), upper.mean(), lower.mean(), (kind == 0).mean(), len(share) / n,
        (kind[1:] != kind[:-1]).mean(), known.logs[c[:-1], c[1:]].mean(), covered(candidate, known.words) / len(candidate),
        bool(re.fullmatch(r"(?i)[0-9a-f]+", candidate)), bool(_UUID.match(candidate)), runs.max() / n,
        *(known.weight(side, near[side], own) for side in near),
        before.rstrip(" \t\"'`([{").endswith(("=", ":", "=>")), before[-1:] in ("'", '"', "`"), bool(_PREFIX.match(candidate)),
    ]
    return [float(x) for x in values]


def labelled_findings(n: int = 2400, seed: int = 11) -> pd.DataFrame:
    """text, path, is_secret of n findings made by rule: keys, tokens and passwords of known forms in code and prose, and
    what is often taken for them: check sums, ids, card numbers, stand-ins, names, dates and paths."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    of = lambda chars, k: "".join(chars[i] for i in rng.integers(len(chars), size=k))
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa, mixed = digits + "abcdef", low + up + digits
    syllables = "ta re ion est ing and le ou eau sch ver con mi za the or en que".split()
    prose = lambda: " ".join("".join(pick(syllables) for _ in range(int(rng.integers(1, 5)))) for _ in range(int(rng.integers(2, 8))))
    b64 = lambda k: base64.b64encode(rng.bytes(k)).decode()
    name = lambda k: pick("_-")[0].join(pick(NAMES) for _ in range(k))
    rows = []
    for i in range(n):
        real = i % 2 == 0
        if real:
            value = pick([lambda: of(hexa, int(rng.choice([32, 40, 40, 64]))), lambda: of(mixed, int(rng.integers(20, 44))), lambda: b64(int(rng.integers(15, 48))), lambda: "AKIA" + of(up + digits, 16), lambda: "ghp_" + of(mixed, 36), lambda: "sk_live_" + of(mixed, 24), lambda: "eyJ" + of(mixed + "_-", 60), lambda: of(mixed + "+/", int(rng.integers(16, 24))),
                lambda: of(low + up, int(rng.integers(20, 40))), lambda: ".".join("eyJ"[: 3 * (k < 2)] + of(mixed + "_-", int(rng.integers(18, 40))) for k in range(3))])()
            if rng.random() < 0.2:
                value = of(mixed + "!@#%&*?", int(rng.integers(8, 15)))
            head = pick(["token", "secret", "api_key", "password", "auth_token", "access_key", "client_secret", "private_key", "bearer", "credential"])
            path = pick(["config/app.yml", "src/main.py", ".env", "deploy/run.sh", "src4", "src11", ""])
        else:
            head, value = pick([
                lambda: (pick(["sha256", "sha1", "checksum", "digest", "commit", "revision", "etag"]), of(hexa, int(rng.choice([32, 40, 64])))),
                lambda: (pick(["id", "uuid", "guid", "request", "trace"]), "-".join(of(hexa, k) for k in (8, 4, 4, 4, 12))),
                lambda: (pick(["card", "phone", "order", "number", pick(syllables), "invoice", "paid with"]), of(digits, 16)),
                lambda: (pick(["token", "secret", "api_key", "password"]), pick(["your-", "example_", "dummy-", "test_", "placeholder-"]) + pick(["api-key", "token", "secret"]) + "-goes-here-" + of(digits, 2)),
                lambda: (pick(["token", "secret"]), "x" * int(rng.integers(12, 24)) + of(digits, 4)),
                lambda: (pick(["file", "see", "module", "import", pick(syllables)]), name(int(rng.integers(3, 5))) + of(digits, 2)),
                lambda: (pick(["module", "call", "class", pick(syllables)]), "".join(pick(NAMES).capitalize() for _ in range(int(rng.integers(3, 5))))),
                lambda: (pick(["token", "password", "key", "author", "auth", "passage"]), pick(["required", "optional", "changeme", "undefined", "see-above", "string", "env.SECRET", "${TOKEN}", "<password>", "********", "expired", pick(NAMES), pick(NAMES) + " " + pick(NAMES)])),
                lambda: (pick(["at", "on", "built"]), f"2024-0{rng.integers(1, 9)}-1{rng.integers(0, 9)}T1{rng.integers(0, 9)}-30-0{rng.integers(0, 9)}"),
                lambda: (pick(["open", "link", "path"]), "/" + "/".join(pick(NAMES) for _ in range(4)) + "/" + of(digits, 3)),
                lambda: (pick(["image", "data", "blob"]), b64(int(rng.integers(150, 400)))),
            ])()
            path = pick(["package.lock", "tests/test_app.py", "docs/guide.md", "src/main.py", "config/app.yml", "src4", "src11", ""])
        text = f"{prose()} {head}{pick([' = ', ': ', '=', *([' '] if len(value) > 15 else [])])}{(q := pick(['', chr(34), chr(39)]))}{value}{q} {prose()}"
        rows.append((text.upper() if rng.random() < 0.05 else text, path, int(real)))
    return pd.DataFrame(rows, columns=["text", "path", "is_secret"])


def _spans(w: Words) -> list[tuple[int, int, int]]:
    """Text, first and last byte (in the block) of the candidates of a block; none lies in another."""
    count = lambda m: np.concatenate([[0], np.cumsum(m)])
    data = w.buf.tobytes()
    digits, upper, lower = (count((w.buf >= a) & (w.buf <= b)) for a, b in ((48, 57), (65, 90), (97, 122)))
    inside = lambda c, skip=0: c[w.end] - c[np.minimum(w.start + skip, w.end)]
    odd = (inside(digits) > 0) | (inside(upper, 1) > 1) & (inside(lower) > 0)
    found = []
    for k in np.flatnonzero((w.end - w.start >= MIN_LENGTH) & odd):
        a, b = int(w.start[k]), int(w.end[k])
        a, b = a + len(data[a:b]) - len(data[a:b].lstrip(b".-=/")), a + len(data[a:b].rstrip(b".-"))
        if b - a >= MIN_LENGTH:
            found.append((int(w.doc[k]), a, b))
    for doc in range(len(w.n)):
        lo, hi = int(w.bounds[doc]), int(w.bounds[doc + 1])
        if hi > lo:
            for m in _ASSIGNED.finditer(data, lo, hi):
                a, b = m.span(m.lastindex)
                b -= len(data[a:b]) - len(data[a:b].rstrip(b".,;:)"))
                if b - a >= MIN_ASSIGNED:
                    found.append((doc, a, b))
    out: list[tuple[int, int, int]] = []
    for doc, a, b in sorted(set(found), key=lambda x: (x[1], -x[2])):
        if not out or b > out[-1][2]:
            if out and a < out[-1][2] and b - a > out[-1][2] - out[-1][1]:
                out.pop()
            if not out or a >= out[-1][2]:
                out.append((doc, a, b))
    return out


def scan_text(column: pa.Array) -> Iterator[tuple[int, int, str, str, str]]:
    """Number of the text, first code point, candidate, and its line before and after it, of every candidate."""
    for w in blocks(column, of=RUN):
        points = np.concatenate([[0], np.cumsum((w.buf & 0xC0) != 0x80)])
        text = lambda a, b: w.buf[a:b].tobytes().decode(errors="ignore")  # noqa: B023, E731
        for doc, a, b in _spans(w):
            begin, end = int(w.bounds[doc]), int(w.bounds[doc + 1])
            yield w.first + doc, int(points[a] - points[begin]), text(a, b), text(max(begin, a - REACH), a).rpartition("\n")[2], text(b, min(end, b + REACH)).partition("\n")[0]


def learn(spark: SparkSession, known: Knowledge, findings: pd.DataFrame, *, trees: int = 40, depth: int = 8, seed: int = 1) -> tuple[Knowledge, RandomForestClassificationModel]:
    """known, with the words around the findings, and the forest over FEATURES of labelled findings (text, path, is_secret;
    a bounded table), of which the longest candidate counts. A finding's own words are not counted for itself."""
    rows = []
    for text, path, verdict in findings[["text", "path", "is_secret"]].itertuples(index=False):
        found = max(scan_text(pa.array([text])), key=lambda x: len(x[2]), default=None)
        if found:
            rows.append((found[2:], path or "", int(verdict)))
    counts = {side: (Counter(), Counter()) for side in SIDES}
    for (_, before, after), path, verdict in rows:
        for side, words in neighbours(before, after, path).items():
            counts[side][1 - verdict].update(words)
    seen = {side: {w: (c1[w], c0[w]) for w in {*c1, *c0} if c1[w] + c0[w] >= LEAST_SEEN} for side, (c1, c0) in counts.items()}
    known = Knowledge(known.logs, known.words, seen, (sum(v for *_, v in rows), sum(1 - v for *_, v in rows)))
    table = spark.createDataFrame([(features(*found, path, known, verdict), float(verdict)) for found, path, verdict in rows], "x array<double>, label double")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=3, seed=seed)
    return known, forest.fit(table.select(array_to_vector("x").alias("features"), "label").coalesce(1))


def fit(docs: DataFrame, *, text_col: str = "text", findings: pd.DataFrame | None = None) -> tuple[Knowledge, RandomForestClassificationModel]:
    """Transitions and words of all documents, and what labelled findings (by default those of labelled_findings) add."""
    known = Knowledge(log_transitions(transition_counts(docs, text_col)), corpus_words(docs, text_col))
    return learn(docs.sparkSession, known, labelled_findings() if findings is None else findings)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", findings: pd.DataFrame | None = None, min_score: float = 0.5) -> DataFrame:
    """id_col, start (code points), length, preview, value_sha256, score, is_secret: every candidate with the forest's
    verdict; the candidate itself is not repeated.

    Null and empty texts have no candidates, a null path is empty. Each row, repeated or with a null id, is scanned by
    itself. Other columns are not read. Empty table: no rows. One pass counts transitions, one words, a third one scans.
    """
    known, model = fit(docs, text_col=text_col, findings=findings)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            paths = batch.column("path")
            found = [(row, at, len(x), x[:4], hashlib.sha256(x.encode()).hexdigest(), features(x, before, after, paths[row].as_py() or "", known)) for row, at, x, before, after in scan_text(batch.column("text"))]
            row, *rest = zip(*found, strict=True) if found else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row, pa.int64())), *(pa.array(x, k) for x, k in zip(rest, kinds, strict=True))], ["id", "start", "length", "preview", "value_sha256", "x"])

    path = F.col(path_col).cast("string") if path_col else F.lit("")
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("preview", T.StringType()), T.StructField("value_sha256", T.StringType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), path.alias("path")).mapInArrow(run, schema)
    scored = model.transform(rows.withColumn("features", array_to_vector("x"))).withColumn("score", vector_to_array("probability")[1])
    return scored.select(F.col("id").alias(id_col), "start", "length", "preview", "value_sha256", "score", (F.col("score") >= min_score).alias("is_secret"))
