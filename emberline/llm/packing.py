"""Sequence packing by shortest-pack-first over the length histogram.

Texts are tokenised in the tasks and cut into pieces of at most `capacity`
tokens. Only the histogram of piece lengths (at most `capacity` numbers) goes to
the driver, where lengths are placed longest first into the emptiest pack that
takes them, as counted patterns. Each split or new pack makes one pattern, so
there are at most 2 * capacity of them. Patterns come back to the pieces by
rank: the r-th piece of a length has a fixed place. Ranks are counted inside the
tokenising tasks and shifted by sums over tasks, so a length that a third of all
pieces share is never gathered.

Defined cases: a null or empty text is its end id alone; equal rows are packed
each; an empty table gives no pieces; a text of any length is cut, none dropped.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

CAPACITY = 2048
END_ID = 1
JSON, RANKS, SPECIAL = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "<|endoftext|>"
#: Text is tokenised so many rows at a time.
ROWS = 256
#: Characters of a run that only the tokenizer file takes.
LONG_RUN = 1000


def long_runs(text: str) -> bool:
    """Whether a text may have a run of LONG_RUN white-space characters, or has a word of as many."""
    if len(text) < LONG_RUN:
        return False
    words = text.split()
    sizes = list(map(len, words))
    return max(sizes, default=0) >= LONG_RUN or len(text) - sum(sizes) - len(words) >= LONG_RUN - 2


def encoder(vocabulary: Callable[[str], str] = public_tokenizers.path) -> Callable[[str], list[int]]:
    """Ids of a text without special tokens added, as the tokenizer file gives them.

    The rank file holds the same vocabulary and splits, and is four times as
    fast, but overflows its stack on long white space and is quadratic in long
    words. Texts with either, and those that spell a special token, go through the
    tokenizer file itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(vocabulary(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow: list[Tokenizer] = []

    def encode(text: str) -> list[int]:
        if SPECIAL not in text and not long_runs(text):
            return fast.encode_ordinary(text)
        if not slow:
            slow.append(Tokenizer.from_file(vocabulary(JSON)))
        return slow[0].encode(text, add_special_tokens=False).ids

    return encode


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of the packing patterns, for how often each length (1 to capacity) occurs."""
    spaces: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    widest: list[int] = []  # heap of -space; may hold spaces that are used up
    full: list[tuple[int, tuple[int, ...]]] = []

    def put(count: int, pattern: tuple[int, ...], space: int) -> None:
        if not space:
            full.append((count, pattern))
            return
        if space not in spaces:
            spaces[space] = []
            heapq.heappush(widest, -space)
        spaces[space].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left, made = histogram[length], []
        while left:
            while widest and not spaces.get(-widest[0]):
                spaces.pop(-heapq.heappop(widest), None)
            if not widest or -widest[0] < length:
                if made and max(s for _, _, s in made) >= length:  # what this length has filled may take it again
                    for x in made:
                        put(*x)
                    made = []
                    continue
                made.append((left, (length,), capacity - length))
                # packs opened now can take the same length again
                k = capacity // length
                if k > 1:
                    made.pop()
                    packs, rest = divmod(left, k)
                    made += [(packs, (length,) * k, capacity - length * k)] * (packs > 0) + [(1, (length,) * rest, capacity - length * rest)] * (rest > 0)
                left = 0
                break
            space = -widest[0]
            count, pattern = spaces[space].pop()
            take = min(count, left)
            if count > take:
                spaces[space].append((count - take, pattern))
            made.append((take, (*pattern, length), space - length))
            left -= take
        for x in made:
            put(*x)
    return full + [x for s in spaces.values() for x in s]


def pieces(documents: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, lane, rank (within lane and length), and ids with with_ids. Must be written before use: lane and rank are the task's own."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, lane long, rank long" + (", ids array<int>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lane = encoder(), TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, rows = batch.slice(at, ROWS), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                    for start in range(0, len(ids), capacity):
                        cut = ids[start : start + capacity]
                        n = len(cut)
                        row = (doc, start, n, zlib.crc32(cut.tobytes()), len(ids), lane, int(ranks[n]))
                        ranks[n] += 1
                        rows.append((*row, cut.astype(np.int32)) if with_ids else row)
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=False)], names=names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


PLACE = T.StructType([T.StructField(x, T.LongType(), False) for x in ("length", "rank_from", "rank_to", "first_sequence", "offset")])


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """PLACE rows: pieces of this length with rank from..to go to sequences from first_sequence on, at this offset."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            rank = used.get(length, 0)
            out.append((length, rank, rank + count, sequence, offset))
            used[length] = rank + count
            offset += length
        sequence += count
    return out


def pack(documents: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of every text with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids with with_ids)."""
    spark = documents.sparkSession
    p = written(pieces(documents, capacity, end_id, with_ids), "pieces")
    lanes = p.groupBy("length", "lane").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in lanes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    where = spark.createDataFrame(places(shortest_pack_first(histogram, capacity)), PLACE)
    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    shift = lanes.select("length", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = p.join(shift, ["length", "lane"]).withColumn("rank", F.col("rank") + F.col("shift")).drop("lane", "shift")
    w = F.broadcast(where.withColumnRenamed("length", "of_length"))
    placed = ranked.join(w, (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first_sequence") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset", *(["ids"] if with_ids else []))


def padding(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens, padded (padding up to capacity; a sequence whose length is a power of two needs none)."""
    s = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    even = F.col("used").bitwiseAND(F.col("used") - 1) == 0
    return s.agg(F.count("*").alias("sequences"), F.sum("used").alias("tokens"), F.sum(F.when(even, 0).otherwise(capacity - F.col("used"))).alias("padded"))
