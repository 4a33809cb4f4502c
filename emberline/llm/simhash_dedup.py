"""SimHash near-duplicates: fingerprints of word shingles, linked where few bits differ, and the groups that links make.

A shingle's hash is XXH64 (seed 42) of its words joined by spaces; a bit of a text's
fingerprint is set if it is set in more than half of its shingles' hashes, repeats
included. Texts of one fingerprint form a class, and only classes are joined.

Candidates. Two fingerprints that differ in at most two bits are cut into two halves
only, so one of the halves differs in one bit at most, where plain blocks would take
three, and wider, cuts. Either the upper halves differ in at most one bit: then they
share a variant of the upper half with that bit left out, one of 32. Or the lower
halves are equal: the lower half itself is the key, and 33 keys a class are enough.
Equal keys meet by an equality join, are sorted by key, and each pair is verified
against the whole fingerprints. A pair whose upper halves are equal would meet in all
32 variants; it counts in the first only.

Buckets of any size. Up to BUCKET classes of a key are held together in a task. A
larger bucket is not: its key is sent on, and its classes get keys with both bits
left out (one in each half, or two in the half that isn't the key). Such a key has at
most four fingerprints and they all link, so its smallest links with the others and
nothing is compared. So work is linear in a bucket's size, and no link is lost.

Defined cases: a null text and one without words have fingerprint zero, and link like
any other; a text of fewer words than a shingle is one shingle; repeated rows are each
returned; a null doc_id never becomes a component_id unless all ids of the component
are null; an empty table gives an empty result; columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, small_batches, written
from .jaccard_join import components, lookup

#: Most bits that linked fingerprints differ in. The halves and the variants below are made for two.
APART = 2
#: Classes of a key that are held against each other; larger buckets go by keys with two bits left out.
BUCKET = 500
#: Shingles whose bits are unpacked at once.
AT_ONCE = 50_000
HALF = 32


def fingerprint(text: str, words: int = 3) -> int:
    """The fingerprint of a text, 0 without words."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and the six ASCII spaces, only
    if not found:
        return 0
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(words, len(found))
    pairs = zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashed = xxhash.xxh64_intdigest
    hashes = np.fromiter((hashed(joined[a:b], 42) for a, b in pairs), dtype=">u8", count=len(found) - k + 1)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        total += np.unpackbits(hashes[at : at + AT_ONCE].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py() or "", words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    small_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _bit(k) -> F.Column:
    """A long with bit k of 64."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def variants(classes: DataFrame) -> DataFrame:
    """key, fp: the lower half (variant -1), and the upper half with each of its bits left out; the variant's number makes part of the key."""
    upper, lower = F.shiftrightunsigned("fp", HALF), F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1))
    keys = F.transform(F.sequence(F.lit(0), F.lit(HALF - 1)), lambda p: _bit(F.lit(HALF)) * (p + 1) + upper.bitwiseAND(F.bitwise_not(_bit(p))))
    return classes.select(F.explode(F.concat(F.array(lower), keys)).alias("key"), "fp")


def meet(batches: Iterator[pa.RecordBatch], bucket: int = BUCKET) -> Iterator[pa.RecordBatch]:
    """a, b of the linked pairs in buckets of up to `bucket`, and the key (hot) of each larger one. Rows (key, fp) come sorted by key, each once."""
    held_key, held = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def pairs(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.r_[head, len(key)])
        hot = key[head[size > bucket]]
        keep = np.repeat((size > 1) & (size <= bucket), size)
        key, fp = key[keep], fp[keep]
        at, a, b = np.arange(len(key)), [], []
        step = 1
        while len(at):
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
            variant = (key[at] >> HALF) - 1
            differ = fp[at] ^ fp[at + step]
            # equal upper halves count in variant 0 only, and in the lower half's bucket only what the variants don't find
            upper = (differ.view(np.uint64) >> np.uint64(HALF)).astype(np.int64)
            ones = np.bitwise_count(differ.view(np.uint64))
            here = np.where(variant < 0, np.bitwise_count(upper) == APART, (variant == 0) | (upper != 0))
            found = at[(ones <= APART) & here]
            a.append(fp[found])
            b.append(fp[found + step])
            step += 1
        a, b = (np.concatenate([*x, np.zeros(0, dtype=np.int64)]) for x in (a, b))
        nothing = pa.nulls(len(a), pa.int64())
        left = pa.nulls(len(hot), pa.int64())
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(a), left]), pa.concat_arrays([pa.array(b), left]), pa.concat_arrays([nothing, pa.array(hot)])], names=["a", "b", "hot"])

    for batch in batches:
        key, fp = np.r_[held_key, batch.column(0).to_numpy()], np.r_[held, batch.column(1).to_numpy()]
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
        if last:
            yield pairs(key[:last], fp[:last])
        held_key, held = key[last:], fp[last:]
        if len(held) > bucket + 1:  # hot in any case: no more of it need be held
            held_key, held = held_key[: bucket + 1], held[: bucket + 1]
    yield pairs(held_key, held)


def within_hot(keyed: DataFrame, hot: DataFrame) -> DataFrame:
    """a, b: links inside the hot buckets, whose keys are in hot (key). Each class gets keys with two bits left out; all classes of such a key link."""
    rows = keyed.join(checked(hot, "hot"), "key", "left_semi").withColumn("variant", F.shiftright("key", HALF) - 1)
    bits = lambda of: F.sequence(F.lit(of), F.lit(of + HALF - 1))
    two = lambda of: F.flatten(F.transform(bits(of), lambda p: F.transform(F.filter(bits(of), lambda q: q > p), lambda q: F.struct(p.alias("p"), q.alias("q")))))
    one_each = F.transform(bits(0), lambda q: F.struct((F.col("variant") + HALF).cast("int").alias("p"), q.alias("q")))
    out = F.when(F.col("variant") < 0, two(HALF)).when(F.col("variant") == 0, F.concat(one_each, two(0))).otherwise(one_each)
    left = rows.select("fp", F.explode(out).alias("x")).select("fp", "x.p", "x.q")
    masked = left.select("fp", "p", "q", F.col("fp").bitwiseAND(F.bitwise_not(_bit(F.col("p")).bitwiseOR(_bit(F.col("q"))))).alias("rest"))
    groups = masked.groupBy("rest", "p", "q").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)  # four at most
    return groups.select(F.explode("all").alias("a"), F.array_min("all").alias("b")).where("a <> b").distinct()


def links(classes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """a, b: links between the fingerprints (fp) of classes, as many as give the components of all that differ in APART bits or fewer."""
    keyed = variants(classes)
    met = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: meet(batches, bucket), "a long, b long, hot long")
    met = written(met, "met")
    found, hot = met.where("hot is null").select("a", "b"), met.where("hot is not null").select(F.col("hot").alias("key"))
    return found if hot.isEmpty() else written(found.unionAll(within_hot(keyed, hot)).distinct(), "links")


def near_duplicates(documents: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id that links reach) of every row."""
    rows = written(fingerprints(documents, words), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")), "classes")
    roots = written(components(links(classes)), "roots")
    named = classes.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    # a component of very many classes is one row of smallest; its classes bring n, the rows that a fingerprint has
    named = named.select("fp", "n", "root").join(checked(smallest, "smallest"), "root").select("fp", "n", "component_id")
    out = lookup(rows, written(named, "named"), "fp", rows.count())
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
