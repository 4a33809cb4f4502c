"""Operators 11 to 13 against brute force in plain Python, with odd tables."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import pytest
import xxhash

from emberline.llm import prefix_trie, queries, simhash_dedup, vector_codes
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"
FLOATS = "vec_id long, embedding array<float>, label int, code string, n int, error string"


# --- 11: vector codes


def brute_codes(rows, config=vector_codes.Config()):
    """(vec_id, label, code, error) of rows (vec_id, vector, label), and the codebooks' hash."""
    kept = [(i, [math.floor(config.scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][1]) // config.parts
    cut = lambda v: [tuple(v[k * size : (k + 1) * size]) for k in range(config.parts)]
    begin = sorted({i: v for i, v, _ in sorted((k for k in kept if k[0] is not None), key=lambda k: k[:2], reverse=True)}.items())[: config.entries]
    books = [[cut(v)[k] for _, v in begin] for k in range(config.parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(config.rounds):
        for k, book in enumerate(books):
            groups = collections.defaultdict(list)
            for _, v, _ in kept:
                groups[near(cut(v)[k], book)[1]].append(cut(v)[k])
            books[k] = [tuple(sum(p[j] for p in groups[e]) // len(groups[e]) for j in range(size)) if groups[e] else entry for e, entry in enumerate(book)]
    out = []
    for i, v, label in kept:
        found = [near(p, books[k]) for k, p in enumerate(cut(v))]
        out.append((i, label, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()


def checked_codes(df, rows):
    expected, digest = brute_codes(rows)
    by_label = collections.Counter()
    for _, label, _, error in expected:
        by_label[label] += error
    found = df.collect()
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in found), key=repr) == sorted(((i, c, e, by_label[label]) for i, label, c, e in expected), key=repr)
    assert {r["codebooks_sha256"] for r in found} == {digest}


def test_codes_by_brute_force(spark):
    draw = random.Random(1)
    single = lambda: [draw.choice([-0.5, 0.25, draw.randrange(-131072, 131072) / 65536]) for _ in range(16)]
    rows = [(i, single(), draw.choice([None, 0, 1])) for i in range(60)]
    rows += [(100 + i, rows[5][1], 3) for i in range(80)]  # a third of all rows are one vector
    rows += [(7, rows[7][1], 0), (7, single(), 1), (None, single(), None)]  # repeated and null ids
    rows += [(200, None, 1), (201, [float("nan")] + [0.0] * 15, 1), (202, [float("inf")] + [0.0] * 15, 1), (203, [None] + [0.0] * 15, 1)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], FLOATS).repartition(3)
    checked_codes(vector_codes.compress(df), rows)


def test_codes_of_few_and_odd_vectors(spark):
    table = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert vector_codes.compress(table([])).collect() == []
    assert vector_codes.compress(table([(1, None, 1)])).collect() == []
    one = vector_codes.compress(table([(1, [0.5] * 8, None)])).collect()
    assert [(r["code"], r["error"], r["label_error"]) for r in one] == [("00" * 8, 0, 0)]
    # another length has no code; ten components are filled up to sixteen; no components are equal parts
    mixed = {r["vec_id"]: r for r in vector_codes.compress(table([(1, [0.5] * 10, 1), (2, [0.5] * 9, 1), (3, [-1.0] * 10, 1)])).collect()}
    assert (mixed[1]["code"], mixed[2]["code"], mixed[2]["error"], mixed[2]["label_error"]) == ("00" * 8, None, None, 0)
    assert mixed[3]["code"] == "01" * 5 + "00" * 3 and mixed[3]["error"] == 0
    assert vector_codes.compress(table([(1, [], 1)])).first()["code"] == "00" * 8
    assert vector_codes.compress(table([(None, [0.5] * 8, 1)])).first()["code"] is None
    huge = vector_codes.compress(table([(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1)])).collect()
    assert {r["error"] for r in huge} == {0}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_codes_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    checked_codes(queries.op11_vector_codes(spark, SF), rows)


# --- 12: SimHash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """The smallest place that links reach, for each of fps."""
    least = list(range(len(fps)))

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            a, b = sorted((top(i), top(j)))
            least[b] = a
    return [top(i) for i in range(len(fps))]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_simhash_by_brute_force(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    fps = [brute_fingerprint(t) for _, t in docs]
    expected = {i: (f"{fps[k]:016x}", docs[root][0]) for k, ((i, _), root) in enumerate(zip(docs, brute_components(fps), strict=True))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op12_simhash_dedup(spark, SF).collect()} == expected
    assert len({c for _, c in expected.values()}) < len(docs)


def test_simhash_odd_rows(spark):
    assert simhash_dedup.fingerprint("One TWO") == brute_fingerprint("one two") != 0
    long = " ".join(f"w{i % 700}" for i in range(200_000))
    assert simhash_dedup.fingerprint(long) == brute_fingerprint(long)
    rows = [(5, None), (3, ""), (4, " \t"), (9, "a b"), (9, "a b"), (None, "a b"), (None, "x y z"), (8, long)]
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], "doc_id long, text string, Component_ID string, fp long, n int")
    found = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash_dedup.near_duplicates(df).collect()), key=repr)
    fp = lambda t: f"{brute_fingerprint(t):016x}"
    expected = [(5, "0" * 16, 3), (3, "0" * 16, 3), (4, "0" * 16, 3), (9, fp("a b"), 9), (9, fp("a b"), 9), (None, fp("a b"), 9), (None, fp("x y z"), None), (8, fp(long), 8)]
    assert found == sorted(expected, key=repr)
    assert simhash_dedup.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("bucket", [1, 4, 500])
def test_simhash_links_in_buckets_of_any_size(spark, bucket):
    """Clouds of fingerprints around few centres: the components are those of all pairs, whichever way a bucket goes."""
    draw = random.Random(bucket)
    fps = set()
    for _ in range(6):
        centre = draw.getrandbits(64)
        for _ in range(60):
            fp = centre
            for _ in range(draw.choice([0, 1, 2, 3, 4, 6])):
                fp ^= 1 << draw.choice([draw.randrange(64), draw.randrange(4), 33, 62])
            fps.add(fp)
    fps = sorted(fps)
    signed = {fp - (fp >> 63 << 64): k for k, fp in enumerate(fps)}
    classes = spark.createDataFrame([(x,) for x in signed], "fp long")
    least = list(range(len(fps)))
    for r in simhash_dedup.links(classes, bucket).collect():
        a, b = signed[r["a"]], signed[r["b"]]
        assert (fps[a] ^ fps[b]).bit_count() <= 2
        x, y = sorted((least[a], least[b]))
        least = [x if z == y else z for z in least]
    assert least == brute_components(fps)


# --- 13: prefix trie


def brute_trie(rows):
    """Rows of the trie by walking lists of turns; rows are (conv_id, turn, role, text)."""
    turns = collections.defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        turns[c].append((role or "", text or ""))
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        made = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
        for d in range(len(made) + 1):
            members[made[:d]].append(c)
        ends[made].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in members.items()), key=repr)


def trie_rows(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=repr)


TURNS = "conv_id long, turn long, role string, text string, depth string, node int"


def test_trie_by_brute_force(spark):
    draw = random.Random(3)
    rows = []
    for c in [*range(0, 60), 1000, 10**12]:
        for t in range(draw.choice([1, 2, 3, 5, 9, 12])):
            rows.append((c, t, draw.choice(["user", "assistant", None]), draw.choice(["yes", "no", "", None, "ä" * 3])))
    rows += [(70, t, "user", f"step {t}") for t in range(150)]  # a long path, cut into many slices
    rows += [(71, t, "user", f"step {t}") for t in range(120)] + [(74, 0, "user", "step 0")]
    rows += [(80, None, "user", "first"), (80, 3, "user", "later"), (None, 1, "user", "nobody's")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS).repartition(3)
    expected = brute_trie(rows)
    assert trie_rows(prefix_trie.trie(df, slice_rows=40)) == expected
    assert trie_rows(prefix_trie.trie(df)) == expected
    assert max(r[1] for r in expected) == 150


def test_trie_of_copies_and_of_nothing(spark):
    rows = [(c, t, "user", "same") for c in range(300) for t in range(3)] + [(7, 1, "user", "same")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)
    assert trie_rows(prefix_trie.trie(df, slice_rows=100)) == brute_trie(rows)
    assert prefix_trie.trie(df.limit(0)).collect() == []
    # one conversation whose base has no turns, and whose own are fewer than h: the root alone
    lone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(lone, 0, "user", "a")]
    assert trie_rows(prefix_trie.trie(spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS))) == brute_trie(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_trie_of_the_table(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert trie_rows(queries.op13_prefix_trie(spark, SF)) == brute_trie(rows)
