"""The corpus pipeline: documents pass five stages, each written as Parquet and read again as the next one's input.

toxicity drops documents that the tagger rejects; near_duplicates keeps one of
each group; decontamination drops contaminated documents; secret_scan redacts
secrets; packing lays what is left into token sequences. The first four return
the columns of documents.

Defined cases: a null or empty text is not toxic, has no near duplicate and no
secret, is clean, and is packed as its end id; of rows that repeat a doc_id and its
text one stays, of a doc_id with several texts each that is kept; a null doc_id is
kept like any other; columns that bear the operators' names pass as they are; an
empty table, and one without labels or benchmark items, goes through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import decontaminate, jaccard_join, packing, secret_scan, toxicity
from emberline.llm.common import read, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs that the tagger, trained on the labelled ones among docs, does not reject."""
    return toxicity.reject(docs, read(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def without_contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_contamination),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: The trained tagger and the tokenizer can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
