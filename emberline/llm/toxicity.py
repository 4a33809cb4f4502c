"""Toxic spans by a linear-chain conditional random field over words.

Learning needs document labels only. In the first pass, Spark counts in how many
toxic and clean training documents each word and word beginning occurs, which
gives its log-odds. Features pass a likelihood-ratio test that allows for the
number of features tested, and for copies. Words of toxic documents with a high
one become the labelled toxic tokens; every other token is labelled clean. A two-state chain is then fitted to these labels by gradient
ascent on the conditional likelihood. Its unary potential is a weighted sum of a
token's log-odds. Forward-backward marginals of all tokens make a document's
score (noisy-or, calibrated) and its offending character offsets.

Bounds: learning sees at most `fit_rows` documents of each class for counts and
`chain_rows` for the chain, which one task fits, chosen by a hash of doc_id. A broadcast feature
occurs in a share `support` of the toxic training documents at least, so there
are at most (mean features of a toxic document) / support of them, whatever the
size of the corpus. Scoring covers every row and whole texts.

Defined cases: null and empty texts have no tokens and score the chain's score
for no evidence; unlabelled rows and null labels teach nothing; a document with
several labels counts as toxic if one says so; without both classes every score
is 0; repeated rows score alike; other columns pass, but for clashing `score`,
`predicted` and `toxic_spans`, which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text_kernel as K
from .common import aside, small_batches, without, written

PREFIXES = (3, 4, 5, 6)
FEATURES = 1 + len(PREFIXES)
_MASK = K.U64(0xFFFF)


@dataclass(frozen=True)
class Config:
    fit_rows: int = 10_000
    chain_rows: int = 300
    support: float = 0.002  # least share of the toxic training documents, for a feature
    least: int = 4  # and least number of them
    mostly: float = 0.8  # least share of toxic documents among those that hold a feature
    surely: float = 0.9  # least share of toxic documents among those that hold a labelled toxic token
    chance: float = 0.1  # features expected to pass the test by chance
    span_at: float = 0.5  # marginal of a token inside a reported span
    steps: int = 60


@dataclass
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))  # sorted feature hashes
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    sure: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=bool))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))  # bias last
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: tuple[float, float] = (-1e3, 0.0)  # of the noisy-or's log-odds: intercept, slope
    bitmap: np.ndarray = field(default_factory=lambda: np.zeros(65536, dtype=bool))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the hashes that are features, and of those features. The bitmap spares most searches."""
        at = np.flatnonzero(self.bitmap[(hashes & _MASK).astype(np.int64)])
        if not len(self.keys) or not len(at):
            return at[:0], at[:0]
        to = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[to] == hashes[at]
        return at[same], to[same]


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    start, end, word, first = K.words(data, offsets, K.NOT_ALNUM)
    return start, end, [word, *K.prefix_hashes(data, start, end, PREFIXES)], first


def held_out(doc_id: Column) -> Column:
    """Rows that teach nothing: crc32(doc_id as text) mod 5 is 0. A null doc_id is one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def feature_counts(training: DataFrame) -> DataFrame:
    """feature, toxic, clean: in how many rows of training (text, toxic) it occurs; before: which of 64 hashes the words before it in toxic rows have, as bits. Summed within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.asarray(batch.column(1).to_pylist(), dtype=np.int64)
            for at, to, data, offsets in K.slices(batch.column(0)):
                _, _, hashes, first = _features(data, offsets)
                row = np.repeat(np.arange(to - at), np.diff(first))
                previous = np.r_[K.U64(0), hashes[0][:-1]][: len(hashes[0])]
                previous[first[:-1][np.diff(first) > 0]] = 0
                bit = K.U64(1) << (previous >> K.U64(58))
                row, bit = np.tile(row, FEATURES), np.tile(bit, FEATURES)
                every = np.concatenate(hashes)
                keep = every != 0
                every, row, bit = every[keep], row[keep], bit[keep]
                order = np.lexsort((row, every))
                every, row, bit = every[order], row[order], bit[order]
                new = np.ones(len(every), dtype=bool)
                new[1:] = (every[1:] != every[:-1]) | (row[1:] != row[:-1])
                every, label, bit = every[new], toxic[at:to][row[new]], bit[new]
                if not len(every):
                    continue
                head = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
                bad = np.add.reduceat(label, head)
                before = np.bitwise_or.reduceat(np.where(label == 1, bit, K.U64(0)), head)
                n = np.diff(np.r_[head, len(every)])
                yield pa.RecordBatch.from_arrays([pa.array(every[head].view(np.int64)), pa.array(bad), pa.array(n - bad), pa.array(before.view(np.int64))], names=["feature", "toxic", "clean", "before"])

    counts = training.select("text", "toxic").mapInArrow(run, "feature long, toxic long, clean long, before long")
    return counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_or("before").alias("before"))


# --- the chain

#: Tokens of a lane: longer rows are cut into several, so that steps don't grow with the longest text.
LANE = 1024


def _lanes(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes by falling length, and how many are longer than t, for each t."""
    order = np.argsort(-length, kind="stable")
    longest = int(length.max()) if len(length) else 0
    active = len(length) - np.searchsorted(np.sort(length), np.arange(longest), side="right")
    return order, active


def _forward(e: np.ndarray, begin: np.ndarray, length: np.ndarray, trans: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward messages of the tokens (P(toxic) given what came), and each lane's last one and log normaliser. before: P(toxic) of the token before each lane. All lanes advance together, one token a step."""
    order, active = _lanes(length)
    out, p, log_z, start = np.empty(len(e)), before[order], np.zeros(len(order)), begin[order]
    for t, k in enumerate(active):
        at, q = start[:k] + t, p[:k]
        x1, x0 = (1 - q) * trans[0, 1] + q * trans[1, 1], (1 - q) * trans[0, 0] + q * trans[1, 0]
        x1 = e[at] * x1
        z = x1 + x0
        p[:k] = x1 / z
        out[at] = p[:k]
        log_z[:k] += np.log(z)
    last, total = np.empty(len(order)), np.empty(len(order))
    last[order], total[order] = p, log_z
    return out, last, total


def _backward(e: np.ndarray, stop: np.ndarray, length: np.ndarray, trans: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Backward messages of the tokens, and each lane's first one (for the token before it) and log normaliser. behind: the message to each lane's last token."""
    order, active = _lanes(length)
    out, b, log_z, end = np.empty(len(e)), behind[order], np.zeros(len(order)), stop[order]
    for t, k in enumerate(active):
        at, q = end[:k] - 1 - t, b[:k].copy()
        out[at] = q
        x = e[at] * q
        b0, b1 = trans[0, 0] * (1 - q) + trans[0, 1] * x, trans[1, 0] * (1 - q) + trans[1, 1] * x
        b[:k] = b1 / (b0 + b1)
        log_z[:k] += np.log(b0 + b1)
    last, total = np.empty(len(order)), np.empty(len(order))
    last[order], total[order] = b, log_z
    return out, last, total


def _chained(turns: list[np.ndarray], start: float, pass0: tuple[np.ndarray, np.ndarray], pass1: tuple[np.ndarray, np.ndarray], lanes: int) -> np.ndarray:
    """What enters each lane, when turns lists the lanes of each cut row in the order they are passed. A lane is linear in what enters it, so its ends for 0 and for 1 tell all others."""
    enters = np.full(lanes, start)
    for own in turns:
        p = start
        for lane in own:
            enters[lane] = p
            most = max(pass0[1][lane], pass1[1][lane])
            a0, a1 = (1 - p) * np.exp(pass0[1][lane] - most), p * np.exp(pass1[1][lane] - most)
            p = (a0 * pass0[0][lane] + a1 * pass1[0][lane]) / (a0 + a1)
    return enters


def marginals(unary: np.ndarray, first: np.ndarray, transition: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(toxic) of each token; each row's log partition function; and the forward messages. A text begins after a clean token."""
    trans = np.exp(transition)
    e = np.exp(np.clip(unary, -30, 30))
    n = np.diff(first)
    pieces = np.maximum(1, -(-n // lane))
    row = np.repeat(np.arange(len(n)), pieces)
    head = np.r_[0, np.cumsum(pieces)]
    begin = first[:-1][row] + (np.arange(len(row)) - head[row]) * lane
    stop = np.minimum(begin + lane, first[1:][row])
    length = stop - begin
    cut = np.flatnonzero(pieces > 1)
    enters, leaves = np.zeros(len(row)), np.full(len(row), 0.5)
    if len(cut):
        many = np.flatnonzero(pieces[row] > 1)
        own = [np.arange(head[r], head[r + 1]) for r in cut]

        def ends(run, at, value):  # of the lanes of cut rows
            last, total = np.zeros(len(row)), np.zeros(len(row))
            _, last[many], total[many] = run(e, at[many], length[many], trans, np.full(len(many), value))
            return last, total

        enters = _chained(own, 0.0, ends(_forward, begin, 0.0), ends(_forward, begin, 1.0), len(row))
        leaves = _chained([x[::-1] for x in own], 0.5, ends(_backward, stop, 0.0), ends(_backward, stop, 1.0), len(row))
    forward, _, log_z = _forward(e, begin, length, trans, enters)
    backward, _, _ = _backward(e, stop, length, trans, leaves)
    both = forward * backward
    out = both / np.maximum(both + (1 - forward) * (1 - backward), 1e-300)
    return out, np.bincount(row, weights=log_z, minlength=len(n)), forward


def _unary(model: Model, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unary potentials of the tokens, their features (sparse rows: token, which, log-odds packed as a dense matrix of featured tokens), and whether they are sure."""
    n = len(hashes[0])
    dense, sure = np.zeros((n, FEATURES)), np.zeros(n, dtype=bool)
    for k, h in enumerate(hashes):
        at, to = model.find(h)
        dense[at, k] = model.odds[to]
        sure[at] |= model.sure[to]
    return dense @ model.weights[:-1] + model.weights[-1], dense, sure


def _fit_chain(model: Model, texts: list[tuple[str, int]], config: Config) -> None:
    """Weights and transitions by Adam on the conditional log-likelihood of the token labels, then the calibration."""
    array = pa.array([t for t, _ in texts], type=pa.string())
    dense, label, first = [], [], [np.zeros(1, dtype=np.int64)]
    at_row = 0
    for at, to, data, offsets in K.slices(array):
        _, _, hashes, f = _features(data, offsets)
        _, d, sure = _unary(model, hashes)
        toxic = np.repeat([y for _, y in texts[at:to]], np.diff(f)).astype(bool)
        dense.append(d)
        label.append(sure & toxic)
        first.append(f[1:] + at_row)
        at_row += len(d)
    x, y, first = np.concatenate(dense), np.concatenate(label).astype(float), np.concatenate(first)
    inner = np.ones(len(y), dtype=bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    here = np.flatnonzero(inner)
    theta = np.r_[np.full(FEATURES, 0.3), -4.0, 0.0, 0.0, 0.0]  # weights, bias, T01, T10, T11 (T00 is 0)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, config.steps + 1):
        trans = np.array([[0.0, theta[-3]], [theta[-2], theta[-1]]])
        p, _, forward = marginals(x @ theta[:FEATURES] + theta[FEATURES], first, trans)
        # pairwise marginals: P(y_t = b) known, split by where it comes from
        e = np.exp(trans)
        q = forward[here - 1]
        from1 = q[:, None] * e[1] / (q[:, None] * e[1] + (1 - q)[:, None] * e[0])
        e01, e10, e11 = (p[here] * (1 - from1[:, 1])).sum(), ((1 - p[here]) * from1[:, 0]).sum(), (p[here] * from1[:, 1]).sum()
        starts = np.setdiff1d(np.arange(len(y)), here)
        g = np.r_[x.T @ (y - p), (y - p).sum(), (y[here] * (1 - y[here - 1])).sum() + y[starts].sum() - e01 - p[starts].sum(), ((1 - y[here]) * y[here - 1]).sum() - e10, (y[here] * y[here - 1]).sum() - e11]
        g = g / max(1.0, y.sum()) - 0.001 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weights, model.transition = theta[: FEATURES + 1], np.array([[0.0, theta[-3]], [theta[-2], theta[-1]]])
    p, _, _ = marginals(x @ theta[:FEATURES] + theta[FEATURES], first, model.transition)
    z, target = _evidence(p, first), np.array([y for _, y in texts], dtype=float)
    model.calibration = _calibrated(z, target)


def _calibrated(z: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic fit of target on z: Newton steps, halved until the penalised likelihood rises."""

    def loss(at: np.ndarray) -> float:
        x = at[0] + at[1] * z
        return float((np.logaddexp(0, x) - target * x).sum() + 0.05 * at[0] ** 2 + 0.05 * (at[1] - 1) ** 2)

    at = np.array([0.0, 1.0])
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(at[0] + at[1] * z, -30, 30)))
        w = s * (1 - s)
        grad = np.array([(s - target).sum() + 0.1 * at[0], ((s - target) * z).sum() + 0.1 * (at[1] - 1)])
        step = np.linalg.solve(np.array([[w.sum() + 0.1, (w * z).sum()], [(w * z).sum(), (w * z * z).sum() + 0.1]]), grad)
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
    return float(at[0]), float(at[1])


def _evidence(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log-odds of the noisy-or of each row's marginals, within -12 and 12."""
    total = np.r_[0.0, np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))]
    none = total[first[1:]] - total[first[:-1]]  # log P(no token is toxic)
    return np.clip(np.log(np.maximum(-np.expm1(none), 1e-12)) - none, -12, 12)


def train(documents: DataFrame, labels: DataFrame, config: Config = Config()) -> Model:
    """Learn from rows of documents (doc_id, text) that have labels (doc_id, toxic) and aren't held out."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    classes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    model = Model()
    if not classes.get(0) or not classes.get(1):
        return model
    lot = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 30)) / (1 << 30)
    rate = F.when(F.col("toxic") == 1, config.fit_rows / classes[1]).otherwise(config.fit_rows / classes[0])
    sample = known.where(lot < rate)  # about fit_rows of a class at most
    drawn = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # an id counts once, by the text that is smallest by hash, however many rows bear it
    training = drawn.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic"))
    share = {c: min(n, config.fit_rows) for c, n in classes.items()}
    least = max(config.least, round(config.support * share[1]))
    odds = F.log((F.col("toxic") + 0.5) / (share[1] + 1)) - F.log((F.col("clean") + 0.5) / (share[0] + 1))
    counts = written(feature_counts(training), "features")
    # copies repeat a word with the word before it: of 64 hashes of the latter, how many are seen tells how many uses are independent
    seen = F.bit_count("before")
    used = F.when(seen < 64, F.least(F.col("toxic").cast("double"), -64 * F.log(1 - F.least(seen, F.lit(63)) / 64))).otherwise(F.col("toxic").cast("double"))
    counts = counts.select("feature", used.alias("toxic"), F.col("clean").cast("double").alias("clean"))
    rate = share[1] / (share[0] + share[1])
    part = lambda n, q: F.when(n > 0, n * F.log(n / (F.col("toxic") + F.col("clean")) / q)).otherwise(0.0)
    gain = part(F.col("toxic"), rate) + part(F.col("clean"), 1 - rate)  # log-likelihood ratio against the classes' mixture
    tested = math.log(max(1, counts.count()) / config.chance)
    bad, good = F.col("toxic") * (classes[1] / share[1]), F.col("clean") * (classes[0] / share[0])  # of all training documents
    rows = counts.where((F.col("toxic") >= least) & (odds > 1) & (gain >= tested)).select("feature", odds.alias("odds"), (bad / (bad + good)).alias("purity")).where(F.col("purity") >= config.mostly).orderBy("feature").collect()
    keys = np.array([r["feature"] for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    model.keys, model.odds = keys[order], np.clip(np.array([r["odds"] for r in rows]), 0, 10)[order]
    model.sure = np.array([r["purity"] >= config.surely for r in rows], dtype=bool)[order]
    model.bitmap[(model.keys & _MASK).astype(np.int64)] = True
    few = F.when(F.col("toxic") == 1, config.chain_rows / share[1]).otherwise(config.chain_rows / share[0])
    again = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(12)), F.lit(1 << 30)) / (1 << 30)
    if len(model.keys):
        # the chain's rows are few, so one task fits it
        rows = training.where(again < few).repartition(1).sortWithinPartitions("doc_id", "text").select("text", "toxic")
        found = rows.mapInArrow(_chain_fitter(model, config), "numbers array<double>").first()
        if found:
            *weights, t01, t10, t11, a, b = found["numbers"]
            model.weights, model.transition, model.calibration = np.array(weights), np.array([[0.0, t01], [t10, t11]]), (a, b)
    return model


def _chain_fitter(model: Model, config: Config) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [(t or "", y) for batch in batches for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        if {y for _, y in texts} == {0, 1}:
            _fit_chain(model, texts, config)
            numbers = [*model.weights.tolist(), float(model.transition[0, 1]), float(model.transition[1, 0]), float(model.transition[1, 1]), *model.calibration]
            yield pa.RecordBatch.from_arrays([pa.array([numbers], type=pa.list_(pa.float64()))], names=["numbers"])

    return run


ADDED = ("score", "predicted", "toxic_spans")


def tag(documents: DataFrame, model: Model, config: Config = Config()) -> DataFrame:
    """documents with score, predicted (score >= 0.5) and toxic_spans: characters from start to end whose tokens have marginals of span_at or more."""
    kept = documents.select(*without(documents, *ADDED))
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("toxic_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())])))])
    names, where, span_at = [*kept.columns, *ADDED], [c.lower() for c in kept.columns].index("text"), config.span_at
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            score, spans = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for at, to, data, offsets in K.slices(batch.column(where)):
                start, end, hashes, first = _features(data, offsets)
                unary, _, _ = _unary(model, hashes)
                p, _, _ = marginals(unary, first, model.transition)
                a, b = model.calibration
                score[at:to] = 1 / (1 + np.exp(-np.clip(a + b * _evidence(p, first), -30, 30)))
                if len(hit := np.flatnonzero(p >= span_at)):
                    chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                    row = np.searchsorted(first, hit, side="right") - 1
                    base = chars[offsets[row]]
                    for r, s, e, q in zip(row, chars[start[hit]] - base, chars[end[hit]] - base, p[hit], strict=True):
                        spans[at + r].append({"start": int(s), "end": int(e), "p": float(q)})
            arrays = [*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, type=span)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return kept.mapInArrow(run, schema)


def reject(documents: DataFrame, labels: DataFrame, config: Config = Config()) -> DataFrame:
    """documents without those predicted toxic; all their columns as they were."""
    clear, back = aside(documents, ADDED)
    return toxicity(clear, labels, config).where("predicted = 0").select(*back)


def toxicity(documents: DataFrame, labels: DataFrame, config: Config = Config()) -> DataFrame:
    """train(), then tag() every row."""
    return tag(documents, train(documents, labels, config), config)
