"""Vector code compression: product codes by weighted Lloyd over the distinct parts of all vectors.

Each component x becomes the integer floor(scale * x), and a vector is cut into equal
consecutive parts. At each part position equal parts are one row with a weight, so
copies cost nothing after the first count, and Lloyd's rounds run over the distinct
rows: a round assigns each to the nearest entry of its position's codebook (ties to
the lower index) and sums components by entry, inside tasks first. Only those sums
reach the driver: positions x entries x part length integers, whatever the table's
size. Codes and errors are then joined back to the vectors' parts; parts that very
many vectors share meet them by broadcast (see jaccard_join.lookup for the bound).

All arithmetic is on integers, so results are exact and depend on no order.

Defined cases: a row whose vector is null, or holds a null, NaN or infinite component,
is dropped; a component beyond +-2^27 after scaling (|x| > 32768 at 4096) counts as
that bound, so that squared distances fit 64 bits; the first vector (by vec_id, then
components) gives the table's length, and a vector of another length has null code and
errors of its own; where the parts don't divide the length, vectors are filled up with
zeros at the end; vectors of no components have code 00 at each part; repeated rows
are each returned; repeated vec_ids begin one codebook entry, by their smallest vector,
a null vec_id begins none (where no vec_id is known, there are no entries, and codes and
errors are null); with fewer ids than entries, the codebooks are shorter;
label_error sums what is known of the label (null where nothing is); an empty table
gives an empty result; columns other than vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked, written
from .jaccard_join import lookup

#: Largest scaled component: 2^28 squared, times 64 components, stays below 2^63.
LARGEST = 2**27
#: Distinct parts whose distances a task holds at once.
AT_ONCE = 20_000


@dataclass(frozen=True)
class Config:
    scale: int = 4096
    parts: int = 8
    entries: int = 16
    rounds: int = 6


def integers(embedding: Column, scale: int) -> Column:
    """Components as integers; null where the vector or a component is null or not finite."""
    x = embedding.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(finite, F.transform(x, lambda v: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.greatest(F.lit(-2.0 * LARGEST), F.least(F.lit(2.0 * LARGEST), v * scale))))).cast("int")))


def exploded(vectors: DataFrame, length: int, config: Config) -> DataFrame:
    """vectors (.., v) of this length with a row for each part: key (position and part)."""
    size = -(-length // config.parts)
    filled = F.concat("v", F.array_repeat(F.lit(0), config.parts * size - length))
    parts = F.transform(F.sequence(F.lit(0), F.lit(config.parts - 1)), lambda k: F.struct(k.alias("pos"), F.slice(filled, k * size + 1, size).alias("part")))
    return vectors.where(F.size("v") == length).withColumn("key", F.explode(parts)).drop("v")


def nearest(parts: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the lower of equals, and the squared distance, for each row of parts."""
    code, error = np.zeros(len(parts), dtype=np.int64), np.zeros(len(parts), dtype=np.int64)
    for at in range(0, len(parts), AT_ONCE):
        some = parts[at : at + AT_ONCE]
        distance = np.stack([((some - entry) ** 2).sum(axis=1) for entry in codebook], axis=1)
        code[at : at + AT_ONCE] = distance.argmin(axis=1)
        error[at : at + AT_ONCE] = distance.min(axis=1)
    return code, error


def _by_position(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of a batch (key, n): position, places in the batch, and the parts there as a matrix."""
    key = batch.column(0)
    pos, part = key.field("pos").to_numpy(), key.field("part")
    flat = part.flatten().to_numpy().astype(np.int64)
    flat = flat.reshape(len(pos), len(flat) // max(1, len(pos)))
    for p in np.unique(pos).tolist():
        at = np.flatnonzero(pos == p)
        yield p, at, flat[at]


def lloyd(distinct: DataFrame, codebooks: np.ndarray, rounds: int) -> np.ndarray:
    """codebooks (positions x entries x part length) after so many rounds over distinct (key, n)."""
    spark = distinct.sparkSession
    size = codebooks.shape[2]
    for _ in range(rounds if size else 0):
        sent = spark.sparkContext.broadcast(codebooks)  # of fixed size

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            books = sent.value
            total, count = np.zeros(books.shape, dtype=np.int64), np.zeros(books.shape[:2], dtype=np.int64)
            for batch in batches:
                n = batch.column(1).to_numpy()
                for p, at, parts in _by_position(batch):
                    code, _ = nearest(parts, books[p])
                    np.add.at(count[p], code, n[at])
                    np.add.at(total[p], code, parts * n[at, None])
            pos, entry = np.nonzero(count)
            rows = total[pos, entry]
            yield pa.RecordBatch.from_arrays([pa.array(pos.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[pos, entry]), *(pa.array(np.ascontiguousarray(rows[:, j])) for j in range(size))], names=["pos", "entry", "n", *(f"c{j}" for j in range(size))])

        schema = "pos int, entry int, n long, " + ", ".join(f"c{j} long" for j in range(size))
        found = distinct.mapInArrow(sums, schema).groupBy("pos", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"c{j}").alias(f"c{j}") for j in range(size)))
        codebooks = codebooks.copy()
        for r in found.collect():  # positions x entries rows at most
            codebooks[r["pos"], r["entry"]] = [r[f"c{j}"] // r["n"] for j in range(size)]
        sent.destroy()
    return codebooks


def coded(distinct: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """key, n, code, error of the distinct parts."""
    sent = distinct.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            for p, at, parts in _by_position(batch):
                code[at], error[at] = nearest(parts, sent.value[p])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code), pa.array(error)], names=["key", "n", "code", "error"])

    return distinct.mapInArrow(run, f"key {distinct.schema['key'].dataType.simpleString()}, n long, code long, error long")


def first_entries(vectors: DataFrame, config: Config) -> tuple[np.ndarray | None, int]:
    """The codebooks that the smallest vec_ids begin (None without any vector), and the vectors' length."""
    one = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").first()
    if one is None:
        return None, 0
    length = len(one["v"])
    of_length = vectors.where(F.size("v") == length).where("vec_id is not null")
    # the smallest ids first, so that a row an id is kept and no more
    ids = [r["vec_id"] for r in of_length.select("vec_id").distinct().orderBy("vec_id").limit(config.entries).collect()]
    rows = of_length.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect() if ids else []
    size = -(-length // config.parts)
    books = np.zeros((len(rows), config.parts * size), dtype=np.int64)
    for k, r in enumerate(rows):
        books[k, :length] = r["v"]
    return books.reshape(len(rows), config.parts, size).transpose(1, 0, 2), length


def codebooks_sha256(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(embeddings: DataFrame, config: Config = Config()) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error and codebooks_sha256 of every kept vector."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), integers(F.col("embedding"), config.scale).alias("v")).where("v is not null")
    # numbered once and written, so that a lost task finds the same numbers again
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    books, length = first_entries(rows, config)
    if books is None or not books.shape[1]:
        empty = np.zeros((config.parts, 0, 0), dtype=np.int64)
        return rows.select("vec_id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error"), F.lit(codebooks_sha256(empty)).alias("codebooks_sha256"))
    parts = exploded(rows.select("row", "v"), length, config)
    distinct = written(parts.groupBy("key").agg(F.count("*").alias("n")), "parts")
    books = lloyd(distinct, books, config.rounds)
    total = rows.count() * config.parts
    back = lookup(parts, written(coded(distinct, books), "codes"), "key", total)
    hexed = F.lpad(F.lower(F.hex("code")), 2, "0")
    whole = back.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key.pos", hexed.alias("h")))), lambda x: x["h"]), "").alias("code"), F.sum("error").alias("error"))
    out = written(rows.select("row", "vec_id", "label").join(whole, "row", "left").drop("row"), "coded")
    errors = checked(out.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "labels")
    out = out.join(errors, F.col("label").eqNullSafe(F.col("of_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
