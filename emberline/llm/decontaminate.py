"""Benchmark decontamination by exact word windows.

Benchmark items become windows of `n` consecutive normalised words (a shorter
item is one window). Training texts are scanned against a broadcast
hash set of them, keyed by each window's rarest word (the one in the fewest
windows), so that a word which many windows share leads to few of them; a hash hit
counts only if the words of the whole window are equal.
Everything is DataFrame operations.

The broadcast side is the benchmark, whose windows are counted first: above
`broadcast_windows` the same join runs shuffled instead.

Defined cases: null or wordless texts have no words, no hits and are clean; null
or wordless items have no windows; items that share a window are all found;
repeated rows get equal results; an empty benchmark leaves every text clean;
other columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, aside, checked, written

WINDOW = 13
OWN = ("n_words", "n_hit", "hit_items", "hit_words", "contaminated", "th_", "hit_doc", "th")
#: Most benchmark windows that are broadcast: some 200 bytes each, so 200 MB.
BROADCAST_WINDOWS = 1_000_000
#: Most bytes of their words and of the ids of the items that hold them.
BROADCAST_BYTES = 256_000_000
#: After A-Z are lower-cased, the same words as [^\x00-\x2F\x3A-\x60\x7B-\x7F]+; Java matches this form six times as fast.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def windows(tokens: Column, length: int) -> Column:
    """Array of (pos from 1, w: array of words) of all windows of the length."""
    last = F.size(tokens) - (length - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.struct(i.alias("pos"), F.slice(tokens, i, length).alias("w"))))


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """len, w, items (the ids that hold the window), anchor (its rarest word, the longest of these) and at (where in w); one row for each different window."""
    b = benchmark.select("item_id", words(F.col("text")).alias("tokens")).where("size(tokens) > 0")
    long = b.where(F.size("tokens") >= n).select("item_id", F.explode(F.transform(windows(F.col("tokens"), n), lambda x: x["w"])).alias("w"))
    short = b.where(F.size("tokens") < n).select("item_id", F.col("tokens").alias("w"))
    out = long.unionAll(short).groupBy("w").agg(F.collect_set("item_id").alias("items"))
    out = written(out, "benchmark-grams")
    each = out.select("w", F.explode(F.array_distinct("w")).alias("word"))
    held = each.groupBy("word").agg(F.count("*").alias("held"))  # words of the benchmark: few rows, however many windows hold one
    rarest = F.min_by("word", F.struct("held", -F.length("word"), "word"))
    anchors = each.join(held, "word").groupBy("w").agg(rarest.alias("anchor"))
    return out.join(anchors, "w").select(F.size("w").alias("len"), "w", "items", "anchor").withColumn("at", F.array_position("w", F.col("anchor")).cast("int"))


def _scan_broadcast(d: DataFrame, grams: DataFrame) -> DataFrame:
    """Hits by the broadcast set, keyed by the windows' rarest words: such a word in a text names the windows that may lie around it, and the words there decide. A text's words are not copied for this: probe and comparison run inside one generated loop."""
    probe = d.select("doc_id", "th", "tokens", F.posexplode("tokens").alias("i", "word"))
    start = F.col("i") + 2 - F.col("at")
    there = F.slice(F.col("tokens"), F.greatest(start, F.lit(1)), F.col("len")) == F.col("w")
    keyed = F.broadcast(grams.withColumn("h", F.xxhash64("anchor")))
    return probe.join(keyed, (F.xxhash64("word") == F.col("h")) & (start >= 1) & there).select("doc_id", "th", F.size("tokens").alias("size"), start.alias("pos"), "len", "items")


def _scan_shuffled(d: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """The same hits for a set too large to broadcast: every window of every text meets the set by its hash, then by its words."""
    none = F.array().cast("array<struct<pos:int,w:array<string>>>")
    every = F.concat(*(F.coalesce(windows(F.col("tokens"), k), none) for k in lengths))
    scanned = d.select("doc_id", "th", F.size("tokens").alias("size"), F.explode(every).alias("x")).select("doc_id", "th", "size", "x.pos", F.col("x.w").alias("dw"))
    keyed = grams.withColumn("h", F.xxhash64("w"))
    return scanned.join(keyed, (F.xxhash64("dw") == F.col("h")) & (F.col("dw") == F.col("w"))).select("doc_id", "th", "size", "pos", "len", "items")


def hits(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, th (hash of the text), size (words), hit_words (array of word positions from 1), items (array); rows with hits only, one for each (doc_id, th)."""
    grams = written(benchmark_windows(benchmark, n), "benchmark-windows")
    held = F.aggregate("w", F.lit(0).cast("long"), lambda n, x: n + 24 + F.octet_length(x)) + 24 + F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + 16 + F.octet_length(x.cast("string")))
    found = grams.groupBy("len").agg(F.count("*").alias("n"), F.sum(held).alias("bytes")).collect()  # at most n rows
    sizes = {r["len"]: r["n"] for r in found}
    few = sum(sizes.values()) <= broadcast_windows and sum(r["bytes"] for r in found) <= BROADCAST_BYTES
    d = documents.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("tokens"))
    hit = _scan_broadcast(d, grams) if few else _scan_shuffled(d, grams, sorted(sizes))
    # sets, so that copies of a row that bears one id add nothing, however many they are
    hit = hit.select("doc_id", "th", "size", F.struct("pos", "len").alias("at"), "items")
    places = F.flatten(F.transform(F.collect_set("at"), lambda x: F.sequence(x["pos"], x["pos"] + x["len"] - 1)))
    return hit.groupBy("doc_id", "th").agg(F.max("size").alias("size"), F.array_sort(F.array_distinct(places)).alias("hit_words"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, least_share: int = 20, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """documents with n_words, n_hit (words inside any hit window), hit_items (array) and contaminated: n_hit > 0 and least_share * n_hit >= n_words."""
    kept = documents.select(*(c for c in documents.columns if c.lower() not in OWN))
    found = hits(documents, benchmark, n, broadcast_windows).select(F.col("doc_id").alias("hit_doc"), "th", "hit_words", F.col("items").alias("hit_items"))
    d = kept.withColumns({"th_": F.xxhash64("text"), "n_words": F.size(words(F.col("text"))).cast("long")})
    out = d.join(found, d["doc_id"].eqNullSafe(found["hit_doc"]) & (d["th_"] == found["th"]), "left")
    n_hit = F.coalesce(F.size("hit_words"), F.lit(0)).cast("long")
    items = F.coalesce("hit_items", F.array().cast(found.schema["hit_items"].dataType))
    return out.select(*kept.columns, "n_words", n_hit.alias("n_hit"), items.alias("hit_items"), F.coalesce("hit_words", F.array().cast("array<int>")).alias("hit_words"), ((n_hit > 0) & (least_share * n_hit >= F.col("n_words"))).alias("contaminated"))


def remove_documents(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, least_share: int = 20) -> DataFrame:
    """documents without the contaminated ones; all their columns as they were.

    Only the contaminated ones' keys are joined back, so texts need not travel while these are few.
    """
    clear, back = aside(documents, OWN)
    bad = hits(clear, benchmark, n).where(least_share * F.size("hit_words") >= F.col("size")).select(F.col("doc_id").alias("hit_doc"), "th")
    bad = checked(bad, "contaminated")
    return clear.join(bad, F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.xxhash64("text") == F.col("th")), "left_anti").select(*back)


def remove_spans(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """documents whose hit words are cut out: the text becomes its other normalised words, joined by spaces. Texts without hits stay as they are."""
    clear, back = aside(documents, OWN)
    c = contamination(clear, benchmark, n)
    tokens = words(F.col("text"))
    rest = F.array_join(F.filter(tokens, lambda w, i: ~F.array_contains("hit_words", i + 1)), " ")
    return c.withColumn("text", F.when(F.col("n_hit") > 0, rest).otherwise(F.col("text"))).select(*back)
