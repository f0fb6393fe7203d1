"""The corpus pipeline: quality rules, near-duplicates, substring de-duplication, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the
columns of ``documents``. ``run`` writes each stage's result to the shared folder and reads it again, so a stage starts
from files that outlive executors."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranktide.llm import bpe, decontam, neardup, quality, substring
from ranktide.llm.common import materialise, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go (null and empty texts among them)."""
    judged = quality.judge(docs, keep=("text", "lang", "source", "n_chars"))
    return judged.where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document of the smallest id stays."""
    return neardup.representatives(docs).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that a document of smaller id has are cut; a text that loses none stays as it is. ``n_chars``
    is counted again. A document that loses all its words stays, with an empty text."""
    rows = docs.withColumn("original", F.col("text"))
    out = substring.remove_repeats(rows, keep=("original", "lang", "source", "n_chars"))
    cut = F.col("n_removed") > 0
    return out.select(
        "doc_id", F.when(cut, F.col("text")).otherwise(F.col("original")).alias("text"), "lang", "source",
        F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark").select("item_id", "text")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): the ids of each text, and proof that they decode to it."""
    return bpe.encode(docs, bpe.rank_file(public_tokenizers.path(TOKENIZER)), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("substring dedup", substring_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: sketches, Poisson processes and merges of ranks are not SQL; tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
