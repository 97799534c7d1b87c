"""The text operators as named queries over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlytics.llm import (
    alignment,
    classifier,
    conversation_trie,
    decontamination,
    jaccard,
    language,
    licenses,
    line_dedup,
    packing,
    quality_rules,
    secrets,
    url_filter,
    warc,
)
from orderlytics.llm.common import ROW, batches, table
from orderlytics.session import scratch_path

RANKS, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"

ID = f"{ROW}.doc_id"

#: Batches in which the rows arrive at the blob ledger and at the line runs, whose first
#: four are merged before the fifth comes.
SCANS, LINE_BATCHES = 3, 5


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.BlobLedger(spark)
    for batch in batches(docs, "doc_id", SCANS):
        ledger.scan(batch)  # blobs of earlier batches are in the ledger
    counts = ["n_assign", "n_access", "n_hex"]
    return ledger.joined(docs, keep=["doc_id"]).select(ID, *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.withColumn("kept_sha256", F.sha2("kept_text", 256)).drop(ROW, "kept_text")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.packed(docs, public_tokenizers.path(RANKS), public_tokenizers.path(TOKENIZER))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    runs = line_dedup.LineRuns(spark)
    for batch in batches(docs, "doc_id", LINE_BATCHES):
        runs.add(batch)
    kept = line_dedup.without_known_lines(docs, runs)
    return kept.select(ID, "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = jaccard.joined(docs, size=3, similar=90)
    return found.select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_filter.judged(pages, rules)
    return judged.select(F.col(f"{ROW}.page_id").alias("page_id"), "host", "path", "rule", "verdict")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classifier.scored(docs, *classifier.train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(classifier.fold(f"{ROW}.doc_id") == 0, F.lit(False))
    return scored.select(ID, held_out.alias("held_out"), "score", "predicted")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.searched(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        ID,
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scanned(docs)
    return found.select(ID, "digest", "license", F.array_join("notices", ",").alias("notices"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = language.identified(docs)
    return judged.select(ID, "language", F.round("posterior", 6).alias("posterior"), "rejected")


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language ID over all pages, with the evidence that documents lack: markup, address and its host."""
    judged = language.pages_identified(table(spark, sf_dir, "pages"))
    return judged.select(f"{ROW}.page_id", "language", F.round("posterior", 6).alias("posterior"), "rejected")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.turns(table(spark, sf_dir, "conversations"))
    return conversation_trie.trie(*conversation_trie.spliced(turns, family=5, heads=9))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), f"{folder}/files")
    archive = warc.Archive.ingest(warc.records(spark, f"{folder}/files"), f"{folder}/archive")
    return warc.resolved(archive.restored()).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = alignment.aligned(docs, public_tokenizers.path(RANKS), public_tokenizers.path(PIECES))
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return found.select(F.col(f"{ROW}.doc_id").cast("bigint").alias("doc_id"), *numbers)


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_url_filter": op6_url_filter,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_license_scan": op9_license_scan,
    "op10_language_id": op10_language_id,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_warc": op12_warc,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
    "page_language": page_language,
}
