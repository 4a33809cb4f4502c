"""Conversation prefix trie: which conversations share their first turns, and what caching those would save.

Conversations are rebuilt first: conversation c takes the first h turns of
conversation c - c % family (all if it has fewer, none if there is no such
conversation), then its own turns after its first h; h is crc32 of c's decimal digits
modulo shared. A node is a different sequence of first d turns (role and text).

Digests. A turn's digest is made of its role, text and position. The digest of a
sequence is the XOR of its turns' digests, 128 bits, so prefixes are running XORs, and
these go along slices of the conversations' order: a conversation of any length is cut
into many tasks, and what lies before a slice is carried by a row a slice. Two lanes of
64 bits confuse N sequences with a chance of about N^2 / 2^129. Texts themselves are
hashed where they are read, and don't travel.

Rollup by pointer jumping. Each node has an edge to its parent's digest. In round k a
node's sums hold its descendants nearer than 2^k, and its pointer the ancestor 2^k above:
it adds its sums to that ancestor's, and takes the ancestor's pointer. So a path of
depth d takes about log2(d) rounds of joins instead of d. Sums toward a node are made
before the shuffle; a node that very many point to, as the root, meets them by
broadcast (see jaccard_join.lookup for the bound).

The hash of the ends of a node is one hash over a list of ids, which can't be put
together from parts: the ids come sorted, and stream through it without being held.

Defined cases: rows without conv_id belong to no conversation and are left out; turns
are in order of turn, null first, and equal turns in order of their digests; repeated
rows are turns like any other; a null role or text is empty; c % family has the sign of
c; an empty table has no conversation and no node, not even the root; columns other than
these four are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.ordered import SLICE_ROWS, carried, numbered, sliced, with_carried

from .common import written
from .jaccard_join import lookup


@dataclass(frozen=True)
class Config:
    family: int = 5
    shared: int = 9


def _lanes(digest: Column, first: str, second: str) -> tuple[Column, Column]:
    """A hex digest's first 128 bits as two longs."""
    return tuple(F.conv(F.substring(digest, at, 16), 16, -10).cast("long").alias(name) for at, name in ((1, first), (17, second)))


def turns(conversations: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """conv_id, at (place from 1), content (digest of role and text), bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.sha2(F.concat_ws("", F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), content.alias("content"), F.octet_length(text).cast("long").alias("bytes"))
    return numbered(rows, "conv_id", ("turn", "content"), slice_rows).select("conv_id", "at", "content", "bytes")


def rebuilt(found: DataFrame, config: Config = Config()) -> DataFrame:
    """conv_id, at, content, bytes of the rebuilt conversations; a conversation without turns is one row with place 0."""
    h = (F.crc32(F.col("conv_id").cast("string")) % config.shared).cast("long")
    convs = found.groupBy("conv_id").agg(F.max("at").alias("own")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % config.family})
    sizes = convs.select(F.col("conv_id").alias("base_id"), F.col("own").alias("base_turns"))
    # of a base at most family * 2 - 1 conversations are rebuilt, so no key is hot
    convs = convs.join(sizes, F.col("base") == F.col("base_id"), "left").withColumn("taken", F.least("h", F.coalesce("base_turns", F.lit(0)))).select("conv_id", "own", "h", "base", "taken")
    convs = written(convs, "convs")
    heads = found.where(F.col("at") < config.shared).withColumnRenamed("conv_id", "base")
    begun = convs.join(heads, "base").where(F.col("at") <= F.col("taken")).select("conv_id", "at", "content", "bytes")
    # the first turns and the rest: where a conversation is long, its turns stay many rows, and its one row of convs goes to them
    own = found.join(convs.select("conv_id", "h", "taken"), "conv_id").where(F.col("at") > F.col("h")).select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "content", "bytes")
    none = convs.where((F.col("taken") == 0) & (F.col("own") <= F.col("h"))).select("conv_id", F.lit(0).cast("long").alias("at"), F.lit(None).cast("string").alias("content"), F.lit(0).cast("long").alias("bytes"))
    return begun.unionAll(own).unionAll(none)


def prefixes(rows: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """conv_id, depth, node (digest of the first turns), parent (digest without the last), bytes, ends (whether it is the whole conversation) of every turn of rows, and of place 0 where there is none."""
    lanes = _lanes(F.sha2(F.concat_ws(":", F.col("at").cast("string"), "content"), 256), "x", "y")
    s = sliced(rows.select("conv_id", "at", "bytes", *lanes).withColumns({c: F.when(F.col("at") > 0, F.col(c)).otherwise(F.lit(0)) for c in ("x", "y")}), "conv_id", ("at",), slice_rows)
    before = carried(s, "conv_id", {"x0": F.bit_xor("x"), "y0": F.bit_xor("y")}, {"x0": F.bit_xor, "y0": F.bit_xor})
    after = carried(s, "conv_id", {"more": F.lit(1)}, {"more": F.max}, after=True)
    s = with_carried(with_carried(s, "conv_id", before), "conv_id", after)
    inside = Window.partitionBy("conv_id", "slice").orderBy("at")
    upto = {c: F.bit_xor(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)).bitwiseXOR(F.coalesce(f"{c}0", F.lit(0))) for c in ("x", "y")}
    s = s.withColumns({"px": upto["x"], "py": upto["y"], "ends": F.lead("at").over(inside).isNull() & F.col("more").isNull()})
    node, parent = F.struct(F.col("px").alias("x"), F.col("py").alias("y")), F.struct(F.col("px").bitwiseXOR(F.col("x")).alias("x"), F.col("py").bitwiseXOR(F.col("y")).alias("y"))
    return s.select("conv_id", F.col("at").alias("depth"), node.alias("node"), F.when(F.col("at") > 0, parent).alias("parent"), "bytes", "ends")


def ends_hashes(found: DataFrame) -> DataFrame:
    """node, ends_sha256 of the nodes where conversations end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple[tuple[int, int], str]] = []
            for x, y, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (x, y) != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = (x, y), hashlib.sha256(str(c).encode())
                else:
                    state.update(f",{c}".encode())
            yield out(done)
        if now is not None:
            yield out([(now, state.hexdigest())])

    def out(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n[0] for n, _ in done], pa.int64()), pa.array([n[1] for n, _ in done], pa.int64()), pa.array([h for _, h in done], pa.string())], names=["x", "y", "ends_sha256"])

    rows = found.where("ends").select("node.x", "node.y", "conv_id").repartition("x", "y").sortWithinPartitions("x", "y", "conv_id")
    return rows.mapInArrow(run, "x long, y long, ends_sha256 string").select(F.struct("x", "y").alias("node"), "ends_sha256")


def subtree_sums(values: DataFrame, edges: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """values (node, and a long for each name) summed over each node's subtree. edges (node, ptr): each node's parent, but for the root."""
    sums, jumps = written(values, "sums"), written(edges, "jumps")
    while not jumps.isEmpty():
        moved = jumps.join(sums, "node").groupBy("ptr").agg(*(F.sum(c).alias(f"{c}_up") for c in names), F.count("*").alias("n"))
        moved = written(moved, "moved")
        got = sums.join(moved.withColumnRenamed("ptr", "node").drop("n"), "node", "left")
        sums = written(got.select("node", *(F.col(c) + F.coalesce(f"{c}_up", F.lit(0)) for c in names)).toDF("node", *names), "sums")
        # a node beyond the root has no pointer, and what points there is done
        further = jumps.select(F.col("node").alias("ptr"), F.col("ptr").alias("next")).join(moved.select("ptr", "n"), "ptr")
        jumps = written(lookup(jumps, written(further, "further"), "ptr", jumps.count()).select("node", F.col("next").alias("ptr")), "jumps")
    return sums


def trie(conversations: DataFrame, config: Config = Config(), slice_rows: int = SLICE_ROWS) -> DataFrame:
    """A row a node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes of turns that members share, over the subtree), ends_sha256."""
    rows = written(rebuilt(written(turns(conversations, slice_rows), "turns"), config), "rebuilt")
    found = written(prefixes(rows, slice_rows), "prefixes")
    below = found.where("depth > 0").groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("bytes").alias("bytes"))
    root = found.agg(F.min("conv_id").alias("conv_id"), F.count_if(F.col("depth") <= 1).alias("n_convs")).where("conv_id is not null")
    origin = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    root = root.select(origin.alias("node"), F.lit(None).cast(found.schema["parent"].dataType).alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("bytes"))
    nodes = written(below.unionByName(root), "nodes")
    children = written(nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children")), "children")
    nodes = written(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    edges = nodes.where("parent is not null").select("node", F.col("parent").alias("ptr"))
    values = nodes.select("node", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    sums = subtree_sums(values, edges, ("n_leaves", "saved_tokens"))
    parents = nodes.where("n_children > 0").select(F.col("node").alias("ptr"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    parents = lookup(edges, written(parents, "parents"), "ptr", edges.count()).select("node", "parent_conv_id")
    out = nodes.join(sums, "node").join(parents, "node", "left").join(ends_hashes(found), "node", "left")
    ends = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256"))
