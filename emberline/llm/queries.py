"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, html_labelled, jaccard_join, lm_score, mpeg_audio, packing, prefix_trie, secret_scan, simhash_dedup, toxicity, url_filter, vector_codes, warc
from .common import read, sha256_hex, shared_dir


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = html_extract.train(html_labelled.labelled_pages(spark))
    return html_extract.main_text(read(spark, sf_dir, "pages"), model).select("page_id", "url", "text", "n_chars")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score(read(spark, sf_dir, "documents").select("doc_id", "text"), ~lm_score.held_out(F.col("doc_id")))
    return scored.select("doc_id", (~F.col("learns")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("hit_items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), sha256_hex(ids).alias("items_sha256"), "contaminated")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "toxic_spans")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans with one ledger: the second knows what the first has run, the base rules, and runs only what the method adds."""
    docs, ledger = read(spark, sf_dir, "documents").select("doc_id", "text"), f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    secret_scan.scan(docs, secret_scan.BASE, ledger)
    found = secret_scan.scan(docs, ledger=ledger)
    base = F.filter("findings", lambda s: s["ordinal"] < len(secret_scan.BASE))
    ordinals = F.transform("findings", lambda s: s["ordinal"])
    counts = {f"n_{r.kind}": (F.size(ordinals) - F.size(F.array_remove(ordinals, k))).cast("long") for k, r in enumerate(secret_scan.BASE)}
    return found.select("doc_id", *(v.alias(k) for k, v in counts.items()), sha256_hex(secret_scan.joined_spans(base)).alias("base_sha256"), secret_scan.joined_spans(F.col("findings")).alias("spans"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(read(spark, sf_dir, "pages"))).withColumnRenamed("key", "page_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.carry_texts(read(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf_dir, "embeddings"))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_lm_score": op2_lm_score,
    "op3_decontamination": op3_decontamination,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_url_filter": op5_url_filter,
    "op6_toxicity": op6_toxicity,
    "op7_secret_scan": op7_secret_scan,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_mpeg_audio": op10_mpeg_audio,
    "op11_vector_codes": op11_vector_codes,
    "op12_simhash_dedup": op12_simhash_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}
