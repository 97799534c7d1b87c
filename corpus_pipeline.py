"""Training-corpus pipeline: language, repeated lines, near-duplicates, benchmark passages, packing.

Every stage takes the documents that the one before kept, as written to disk,
and returns documents again; the last returns the packing plan.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlytics.llm import decontamination, jaccard, language, line_dedup, packing
from orderlytics.llm.common import table, unwrapped
from orderlytics.session import cut_lineage

#: Near-duplicates: shingles of five words, similarity of 0.8 or more.
WORDS, SIMILAR = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain."""
    return unwrapped(language.identified(docs).where("NOT rejected"), docs.schema)


def line_level_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them hold; their length follows."""
    runs = line_dedup.LineRuns(spark)
    runs.add(docs)
    kept = line_dedup.without_known_lines(docs, runs)
    changed = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    return unwrapped(kept, docs.schema, **changed)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return jaccard.without_duplicates(docs, WORDS, SIMILAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    found = decontamination.searched(docs, table(spark, sf_dir, "benchmark"))
    return unwrapped(found.where("NOT contaminated"), docs.schema)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their ids, and their places in training sequences."""
    ranks, tokenizer = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("tiktoken", "json"))
    return packing.packed(docs, ranks, tokenizer, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_level_dedup),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminate),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained language models and tokens are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None
