"""Small helpers that the text operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of texts small: a task holds each batch several times, in the JVM and in Python. Only ever lowers the session's setting."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def written(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again.

    Unlike cache() the rows outlive executors, and unlike checkpoint() later
    reads can prune columns and know the size.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def aside(documents: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """documents with columns of these names (in any case) renamed out of an operator's way, and the columns that bring documents back."""
    taken, moved = {c.lower() for c in documents.columns}, {}
    for c in documents.columns:
        if c.lower() in names:
            new = c
            while new.lower() in taken or new.lower() in names:
                new += "_"
            taken.add(new.lower())
            moved[c] = new
    return documents.withColumnsRenamed(moved), [F.col(moved.get(c, c)).alias(c) for c in documents.columns]


def without(documents: DataFrame, *names: str) -> list[str]:
    """The columns of documents but those of these names, in any case."""
    return [c for c in documents.columns if c.lower() not in names]


#: Most rows of keys that checked() broadcasts, under 100 bytes each.
BROADCAST_ROWS = 1_000_000


def checked(keys: DataFrame, label: str) -> DataFrame:
    """keys, written; to be broadcast if they are few, else joined by a shuffle."""
    keys = written(keys, label)
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() does the same, and faster, where every character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)
