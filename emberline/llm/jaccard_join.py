"""N-gram Jaccard join by parity sketches, and the groups that its links make.

A text's set is its different word shingles, as 64-bit hashes. Texts of equal sets
form a class, and only classes are joined. Two classes link when their Jaccard
similarity is at least percent / 100.

Candidates. In a size band, linked sets differ in at most D tokens. Each token
flips one bit of a sketch, so the Hamming distance of two sketches is a lower
bound of the sets' symmetric difference. The sketch of a band has more than D
parts, and a token touches one part only: by the pigeonhole principle a linked pair
has equal parts, and equal parts meet as join keys. The key of a part is the XOR
of its tokens' 64-bit hashes, of which the sketch's bits are a digest. Empty parts
say nothing and are left out where enough others must agree; where a set has so
many that they might be needed, they are keys too. So no link is lost.

Verification without all pairs. In a bucket each class is held against the
smallest class only, first by sketches of 512 and 2048 bits, then exactly. Links give
components. Only where a bucket still holds several components are pairs across
them held together, the largest component's members never with each other. All
candidate pairs are then either verified or inside one component, so components
are exact, and a group of n near copies costs about n verifications, not n^2.

Buckets of what does not link. Texts that share a long template meet in the same
buckets without being linked. There are a fifth more parts than the pigeonholes need,
so a linked pair has not one but several equal keys, t at least, a number that a set
knows by itself. Each set therefore leaves out its t - 1 largest buckets (of those that
hold several components, all sets by the same order): of t shared keys one stays. This
empties nearly all buckets that a template of up to two fifths of the texts' shingles
makes; members of others are held against each other by their sketches.

Hot keys. A class that a large share of the pairs name, as the hub of a large group,
meets its data by broadcast: keys above max(500, 1 / 20,000 of the rows) are fewer
than 20,000. Whole sets are never broadcast: a hub's set is sent once for each
slice of so many members.

Sets are compared by 64-bit hashes: N classes are confused with a chance of about
N^2 / 2^65.

Defined cases: a null text, or one without words, has no shingles and is alone;
a text of fewer words than a shingle is one shingle; repeated rows are each
returned; a null doc_id never becomes a component_id unless all ids of the
component are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text_kernel as K
from .common import aside, checked, small_batches, written

U64 = np.uint64
SKETCH = 8  # longs: 512 bits
SKETCH_COLUMNS = tuple(f"s{i}" for i in range(SKETCH))
WIDE = 4 * SKETCH  # longs of the finer sketch, which folds into the other
#: Parts whose keys are odd; a pair that meets in several of them is put forward once.
EARLY = 6
#: Most keys that are hot, and rows that every key may have.
HOT, COLD_ROWS = 20_000, 500
#: Different classes a task remembers, so that copies send their keys once.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Config:
    words: int = 5
    percent: int = 80

    def most_apart(self, both: int) -> int:
        """The largest symmetric difference of a linked pair of sets with `both` tokens together."""
        return both * (100 - self.percent) // (100 + self.percent)


def bands(config: Config, longest: int) -> np.ndarray:
    """Lower ends of the size bands: a set links only into its own band and the next."""
    ends = [1]
    while ends[-1] <= longest:
        ends.append(ends[-1] * 100 // config.percent + 1)
    return np.array(ends, dtype=np.int64)


def parts(config: Config, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each band, as that of a pair's smaller set: most tokens apart, and number of sketch parts. A fifth more parts than the pigeonholes need make up for empty ones, and let a linked pair agree in several."""
    largest = ends[1:] - 1
    apart = np.array([config.most_apart(int(n + n * 100 // config.percent)) for n in largest], dtype=np.int64)
    return apart, np.ceil((apart + 1) * 1.2).astype(np.int64) + 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different shingle hashes of all rows, and where each row's begin (one entry more than rows)."""
    _, _, word, first = K.words(data, offsets)
    n = np.diff(first)
    factor = K.splitmix(np.arange(1, words + 1)) | U64(1)
    with np.errstate(over="ignore"):
        count = np.maximum(len(word) - words + 1, 0)
        total = np.zeros(count, dtype=U64)
        for k in range(words):
            total += K.splitmix(word[k : k + count] + factor[k])
        total = K.splitmix(total)
        sizes = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
        starts = np.r_[0, np.cumsum(sizes)]
        out = np.empty(starts[-1], dtype=U64)
        for row in range(len(n)):
            a, b = starts[row], starts[row + 1]
            if n[row] >= words:
                out[a:b] = total[first[row] : first[row] + b - a]
                out[a:b].sort()
            elif b > a:
                w = word[first[row] : first[row + 1]]
                out[a] = K.splitmix(K.splitmix(w + factor[: len(w)]).sum(dtype=U64) + U64(len(w)))
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = out[1:] != out[:-1]
    keep[starts[:-1][sizes > 0]] = True
    return out[keep], np.r_[0, np.cumsum(keep)][starts]


def _reduce(ufunc: np.ufunc, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """ufunc over each row's values; 0 for a row without any."""
    full = np.flatnonzero(np.diff(starts))
    out = np.zeros(len(starts) - 1, dtype=values.dtype)
    if len(full):
        out[full] = ufunc.reduceat(values, starts[:-1][full])
    return out


def class_ids(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's set."""
    with np.errstate(over="ignore"):
        mixed = K.splitmix(tokens ^ U64(0xA5A5A5A55A5A5A5A))
        return K.splitmix(_reduce(np.bitwise_xor, mixed, starts)) ^ K.splitmix(_reduce(np.add, mixed, starts) + np.diff(starts).astype(U64))


def sketches(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """rows x WIDE longs: each token flips one of the row's 2048 bits. XOR of the four quarters is the 512-bit sketch."""
    rows, bits = len(starts) - 1, WIDE * 64
    row = np.repeat(np.arange(rows), np.diff(starts))
    flips = np.bincount(row * bits + (tokens & U64(bits - 1)).astype(np.int64), minlength=rows * bits) & 1
    return np.packbits(flips.astype(np.uint8).reshape(rows, bits), axis=1).view(np.int64)


def spare_keys(tokens: np.ndarray, starts: np.ndarray, config: Config) -> np.ndarray:
    """rows x 2: in how many keys of an even and of an odd band, beside one, a linked row agrees at least."""
    n = np.diff(starts)
    if not len(tokens):
        return np.zeros((len(n), 2), dtype=np.int64)
    ends = bands(config, int(n.max()))
    apart, count = parts(config, ends)
    own = np.searchsorted(ends, n, side="right") - 1
    row = np.repeat(np.arange(len(n)), n)
    out, high = np.zeros((len(n), 2), dtype=np.int64), tokens >> U64(32)
    for band in (own, own - 1):
        fits = np.flatnonzero((n > 0) & (band >= 0))
        parts_of = np.where(band >= 0, count[np.maximum(band, 0)], 0)  # a row without shingles has no band
        with np.errstate(over="ignore"):
            part = (high * parts_of[row].astype(U64)) >> U64(32)  # as in part_keys
        filled = np.bincount(row, weights=np.r_[True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])], minlength=len(n)).astype(np.int64)
        out[fits, band[fits] & 1] = np.maximum(0, filled[fits] - apart[band[fits]] - 1)
    return out


def part_keys(tokens: np.ndarray, starts: np.ndarray, config: Config) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the sketch parts of all rows, in both bands where a row can link.

    Bit 0 of a key: an early part. Bit 1: whether the band is odd.
    """
    n = np.diff(starts)
    ends = bands(config, int(n.max()) if len(n) else 1)
    apart, count = parts(config, ends)
    own = np.searchsorted(ends, n, side="right") - 1
    token_row = np.repeat(np.arange(len(n)), n)
    rows, keys = [], []
    with np.errstate(over="ignore"):
        mixed = K.splitmix(tokens ^ U64(0x5BD1E9955BD1E995))
        for band in (own, own - 1):
            fits = (n > 0) & (band >= 0)
            fits[fits] &= apart[band[fits]] > 0  # equal sets are one class already
            inside = fits[token_row]
            if not inside.any():
                continue
            r, t, x = token_row[inside], tokens[inside], mixed[inside]
            m = count[band[r]].astype(U64)
            part = ((t >> U64(32)) * m >> U64(32)).astype(np.int64)  # grows with t, and t is sorted in its row
            head = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (part[1:] != part[:-1])])
            r, part, x = r[head], part[head], np.bitwise_xor.reduceat(x, head)
            filled = np.bincount(r, minlength=len(n))
            needed = apart[np.maximum(band, 0)] + 1
            for row in np.flatnonzero(fits & (filled < needed)):  # too many empty parts
                empty = np.setdiff1d(np.arange(count[band[row]]), part[r == row])
                r, part, x = np.r_[r, np.full(len(empty), row)], np.r_[part, empty], np.r_[x, np.zeros(len(empty), dtype=U64)]
            rows.append(r)
            key = K.splitmix(x ^ K.splitmix((band[r] << 32 | part).astype(U64)))
            keys.append(key & ~U64(3) | (band[r] & 1).astype(U64) << U64(1) | (part < EARLY).astype(U64))
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
    return np.concatenate(rows), np.concatenate(keys)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def members(documents: DataFrame, config: Config) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, cls (null without shingles), sketch, and how many keys it may leave out of even and of odd bands, of every row."""
    words, percent = config.words, config.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in K.slices(batch.column(1)):
                tokens, starts = shingle_sets(data, offsets, words)
                n, wide = np.diff(starts), sketches(tokens, starts)
                sketch = np.bitwise_xor.reduce(wide.reshape(-1, 4, SKETCH), axis=1)
                finer = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * WIDE), pa.array(wide.ravel()))
                cls = pa.array(class_ids(tokens, starts).view(np.int64), mask=n == 0)
                spare = spare_keys(tokens, starts, Config(words, percent))
                longs = [*(sketch[:, i] for i in range(SKETCH)), spare[:, 0], spare[:, 1]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), batch.column(2).slice(at, to - at), pa.array(n), cls, *(pa.array(np.ascontiguousarray(x)) for x in longs), finer], names=["doc_id", "th", "n_shingles", "cls", *SKETCH_COLUMNS, "even", "odd", "wide"])

    schema = "doc_id long, th long, n_shingles long, cls long, " + ", ".join(f"{s} long" for s in SKETCH_COLUMNS) + ", even long, odd long, wide array<long>"
    small_batches(documents.sparkSession)
    return with_hash(documents).mapInArrow(run, schema)


def with_hash(documents: DataFrame) -> DataFrame:
    """doc_id, text and th: together the name of a row, as ids can be null or repeated, and texts, too."""
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def buckets(documents: DataFrame, config: Config) -> DataFrame:
    """key, cls, hub: the classes that share a sketch part with a smaller class, the bucket's smallest being its hub."""
    words = config.words

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in K.slices(batch.column(0)):
                tokens, starts = shingle_sets(data, offsets, words)
                cls = class_ids(tokens, starts)
                new = np.zeros(len(cls), dtype=bool)
                for i, c in enumerate(cls.tolist()):
                    if c not in seen:
                        new[i] = True
                        if len(seen) < REMEMBERED:
                            seen.add(c)
                row, key = part_keys(tokens, starts, Config(words, percent))
                here = new[row]
                yield pa.RecordBatch.from_arrays([_long(key[here]), _long(cls[row[here]])], names=["key", "cls"])

    percent = config.percent

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key and cls: the first of a key is the hub, of which only two numbers are kept."""
        last_key, hub, last_cls = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first = np.r_[last_key is None or key[0] != last_key, key[1:] != key[:-1]]
            run = np.cumsum(first)
            hubs = np.r_[hub, cls[first]][run]
            fresh = np.r_[first[0] or cls[0] != last_cls, first[1:] | (cls[1:] != cls[:-1])]
            out = ~first & fresh
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(cls[out]), pa.array(hubs[out])], names=["key", "cls", "hub"])
            last_key, hub, last_cls = key[-1], hubs[-1], cls[-1]

    sent = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(keys, "key long, cls long")
    return sent.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(meet, "key long, cls long, hub long")


def _near(a: str, b: str, config: Config) -> Column:
    """Whether sizes and sketches of a and b (prefixes of columns) allow a link: a lower bound of the difference against its upper bound."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    distance = sum((F.bit_count(F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}"))) for s in SKETCH_COLUMNS), F.lit(0))
    return (100 * F.least(na, nb) >= config.percent * F.greatest(na, nb)) & (distance * (100 + config.percent) <= (na + nb) * (100 - config.percent))


def lookup(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with table (key; n: how many rows it has at most; ...), without n. Keys with many rows meet by broadcast; their rows are HOT times fewer than total, or COLD_ROWS times."""
    limit = max(COLD_ROWS, total // HOT)
    hot = F.broadcast(table.where(F.col("n") > limit))
    cold = table.where(F.col("n") <= limit)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key)).drop("n")


def counted(rows: DataFrame, key: str, classes: DataFrame) -> DataFrame:
    """classes (key; ...), written, with n: how many of rows have the key. Keys without any are left out."""
    return written(classes.join(checked(rows.groupBy(key).agg(F.count("*").alias("n")), "counts"), key), "counted")


def closer(pairs: DataFrame, classes: DataFrame, config: Config) -> DataFrame:
    """The pairs (a, b) that the finer sketches allow too. It spares most pairs just below the threshold the journey of their whole sets."""
    pairs = written(pairs, "pairs")
    both, total = pairs, pairs.count()
    for x in ("a", "b"):
        both = lookup(both, counted(pairs, x, classes.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}"))), x, total)
    distance = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return both.where(distance * (100 + config.percent) <= (F.col("na") + F.col("nb")) * (100 - config.percent)).select("a", "b")


def _named(classes: DataFrame, prefix: str) -> DataFrame:
    return classes.select(F.col("cls").alias(f"{prefix}cls"), F.col("n").alias(f"{prefix}n"), *(F.col(s).alias(f"{prefix}{s}") for s in SKETCH_COLUMNS))


def verified(pairs: DataFrame, documents: DataFrame, classes: DataFrame, config: Config) -> DataFrame:
    """The pairs (a, b) of classes that link, by their whole sets, which are made again from one text of each class.

    Each pair brings the set of a to where b's set is; b has a place for every COLD_ROWS pairs.
    """
    words, total = config.words, pairs.count()
    limit = max(COLD_ROWS, total // HOT)
    hot = F.broadcast(pairs.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > limit))
    place = F.when(F.col("n").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / limit)))
    placed = written(pairs.join(hot, "b", "left").select("a", "b", place.alias("place")), "placed")
    docs, chosen = classes.select("cls", F.col("row.doc_id").alias("doc"), F.col("row.th").alias("doc_th")), with_hash(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in K.slices(batch.column(3)):
                tokens, starts = shingle_sets(data, offsets, words)
                cols = [batch.column(k).slice(at, to - at) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*cols, _long(class_ids(tokens, starts)), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), _long(tokens))], names=["b", "place", "cls", "is", "tokens"])

    def sets(asked: DataFrame, label: str) -> DataFrame:
        """b, place, cls and tokens for asked (b, place, cls)."""
        asked = checked(asked.join(docs, "cls").select("b", "place", "cls", "doc", "doc_th"), label)
        made = chosen.join(asked, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("th") == F.col("doc_th"))).select("b", "place", "cls", "text")
        return made.mapInArrow(run, "b long, place long, cls long, is long, tokens array<long>").where(F.col("cls") == F.col("is")).drop("is")

    left = sets(placed.select("b", "place", F.col("a").alias("cls")), "asked").withColumnsRenamed({"cls": "a", "tokens": "ta"})
    right = sets(placed.select("b", "place", F.col("b").alias("cls")).distinct(), "asked").drop("cls").withColumnRenamed("tokens", "tb")
    common = F.size(F.array_intersect("ta", "tb")).cast("long")
    links = left.join(right, ["b", "place"]).where(100 * common >= config.percent * (F.size("ta") + F.size("tb") - common))
    return links.select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node that links reach), for the nodes of links (a, b). Large-star and small-star by turns until nothing changes."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m")), "least")
        large = lookup(both.where("v > u"), least, "u", 2 * edges.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "edges")
        least = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = lookup(large, least, "u", large.count())
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def across(met: DataFrame, roots: DataFrame, classes: DataFrame, tried: DataFrame, config: Config) -> DataFrame:
    """Pairs (a, b) in one bucket, of different components, that sketches allow and that have not been tried."""
    several = met.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")  # a bucket of two has been tried
    rows = met.join(several, "key", "left_semi")
    rows = rows.select("key", "cls").unionAll(rows.select("key", F.col("hub").alias("cls")).distinct())
    rows = rows.join(roots, rows["cls"] == roots["node"], "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))
    held = rows.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1").select("key", "top")
    rows = written(rows.join(held, "key"), "mixed")
    # a class leaves out its largest buckets, as far as a linked class agrees with it in others
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"))
    odd = F.col("key").bitwiseAND(F.lit(2)) != 0
    order = Window.partitionBy("cls", odd).orderBy(F.col("size").desc(), F.col("key"))
    rows = rows.join(sizes, "key").withColumn("rank", F.row_number().over(order)).join(classes.select("cls", "even", "odd"), "cls")
    rows = written(rows.where(F.col("rank") > F.when(odd, F.col("odd")).otherwise(F.col("even"))).select("key", "cls", "root", "top"), "mixed")
    early = rows.where("key % 2 <> 0").groupBy("cls").agg(F.collect_set("key").alias("early"))  # EARLY keys in each of two bands at most
    about = classes.join(early, "cls", "left").select("cls", "n", *SKETCH_COLUMNS, F.coalesce("early", F.array().cast("array<bigint>")).alias("early"))
    rows, columns = rows.join(about, "cls"), ("cls", "n", *SKETCH_COLUMNS, "early")
    left = rows.where("root <> top").select("key", F.col("root").alias("a_root"), *(F.col(c).alias(f"a_{c}") for c in columns))
    right = rows.select(F.col("key").alias("b_key"), F.col("root").alias("b_root"), "top", *(F.col(c).alias(f"b_{c}") for c in columns))
    # a pair that shares a smaller early key has been put forward there
    first = F.coalesce(F.array_min(F.array_intersect("a_early", "b_early")) >= F.col("key"), F.lit(True))
    meets = (F.col("key") == F.col("b_key")) & (F.col("a_root") != F.col("b_root")) & ((F.col("b_root") == F.col("top")) | (F.col("a_cls") < F.col("b_cls"))) & _near("a_", "b_", config) & first
    pairs = left.join(right, meets).select(F.greatest("a_cls", "b_cls").alias("a"), F.least("a_cls", "b_cls").alias("b")).distinct()
    return pairs.join(tried, ["a", "b"], "left_anti")


def near_duplicates(documents: DataFrame, config: Config = Config()) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row."""
    rows = written(members(documents, config), "members")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first_doc"), F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th")).alias("row"), F.first("n_shingles").alias("n"), *(F.first(s).alias(s) for s in (*SKETCH_COLUMNS, "even", "odd", "wide")))
    classes = written(classes, "classes")
    met = written(buckets(documents, config), "buckets")
    stars = written(met.select(F.col("cls").alias("a_cls"), F.col("hub").alias("b_cls")).distinct(), "stars")
    tried = lookup(stars.join(_named(classes, "a_"), "a_cls"), counted(stars, "b_cls", _named(classes, "b_")), "b_cls", stars.count()).where(_near("a_", "b_", config))
    tried = written(closer(tried.select(F.greatest("a_cls", "b_cls").alias("a"), F.least("a_cls", "b_cls").alias("b")).distinct(), classes, config), "stars")
    links = written(verified(tried, documents, classes, config), "links")
    roots = written(components(links), "roots")
    more = written(closer(across(met, roots, classes, tried, config), classes, config), "across")
    if not more.isEmpty():
        links = links.unionAll(verified(more, documents, classes, config))
        roots = written(components(links), "roots")
    named = classes.select("cls", "first_doc").join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls"))
    smallest = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = named.select("cls", "root").join(smallest, "root").select("cls", "component_id")
    out = rows.join(named, "cls", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(documents: DataFrame, config: Config = Config()) -> DataFrame:
    """documents without near duplicates: of each component the row with the smallest doc_id stays, and one row of those that repeat it."""
    found = near_duplicates(documents, config)
    stays = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))
    ids = written(found.groupBy("doc_id").agg(F.max(stays).alias("stays"), F.count("*").alias("n")), "ids")
    # those that go are the fewer, so texts need not travel while their ids can be broadcast
    gone = checked(ids.where("not stays").select(F.col("doc_id").alias("gone_id")), "gone")
    clear, back = aside(documents, ("gone_id", "repeated_id"))
    out = clear.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti")
    repeated = ids.where("stays and n > 1").select(F.col("doc_id").alias("repeated_id"))
    if repeated.isEmpty():
        return out.select(*back)
    same = F.col("doc_id").eqNullSafe(F.col("repeated_id"))
    single, several = out.join(repeated, same, "left_anti"), out.join(repeated, same, "left_semi")
    return single.unionByName(several.dropDuplicates(["doc_id", "text"])).select(*back)
