"""The corpus pipeline: documents without toxic ones, recurring lines, near duplicates and benchmark leaks, packed into
sequences. Each stage is a function of (spark, docs, sf_dir) on all that the one before it kept; each but the last
returns the columns of documents. An empty table passes through every stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridextract.llm import decontaminate, line_templates, packing, simhash_anchor, toxicity_knn
from gridextract.llm.queries import TOKENIZER, table
from gridextract.llm.scratch import discard, settled


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is under 0.5."""
    index = toxicity_knn.fit_index(docs, table(spark, sf_dir, "labels"), label="toxic")
    return toxicity_knn.score(docs, index, drop_from=0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of templates that recur across five or more of them (the first keeps its own)."""
    out = line_templates.drop_recurring_lines(docs)
    return out.select(*(F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates: a Jaccard similarity of 0.8 or more of five-word
    shingles, computed for the documents that fingerprints bring together."""
    return simhash_anchor.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their token ids, as sequences of 1024 tokens or a power of two."""
    return packing.pack(docs, TOKENIZER, max_len=1024)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]

#: No SQL: the neighbours of a text, tilings and tokens are beyond it; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, settled(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir))
        if before is not documents:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
