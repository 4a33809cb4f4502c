"""Main text of web pages by a tree-structured graphical model over the DOM.

Every DOM node is a binary variable: content or not. Its unary potential comes
from its own features (tag, class and id words, text length, link share,
punctuation, place); a parent-child potential couples it with its parent by the
pair of their tags' kinds. Sum-product messages go from the leaves to the root
and back, and give each node's exact content marginal. Text nodes whose marginal
reaches 0.5 are the main text.

Learning: feature and parent-child frequencies of labelled pages (html, text:
the true main text), counted by Spark in one aggregation. The model is as large
as its feature vocabulary, which hashing bounds at BUCKETS. Where no labelled
pages are given, the built-in ones of html_labelled serve.

Defined cases: null or empty html gives an empty text; unclosed, misnested and
truncated markup is repaired (an element that is never closed ends with its
parent); markup nested deeper than any limit is handled without recursion;
repeated rows give equal rows; other columns pass, `text` and `n_chars` are
replaced.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, without

#: Hash buckets of class and id words.
BUCKETS = 4096

# Fixed values of the HTML standard: elements without content, with raw text, and that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
P_CLOSERS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
KINDS = {
    **dict.fromkeys(("article", "main"), "main"), **dict.fromkeys(("nav", "menu"), "nav"), **dict.fromkeys(("header", "footer", "aside"), "edge"),
    **dict.fromkeys(("form", "input", "button", "select", "option", "label", "fieldset", "textarea"), "form"),
    **dict.fromkeys(("script", "style", "noscript", "template", "iframe", "svg", "object", "head", "title", "meta", "link", "xmp", "noembed", "noframes"), "code"),
    **dict.fromkeys(("p", "blockquote", "pre"), "para"), **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "head"), **dict.fromkeys(("ul", "ol", "li", "dl", "dt", "dd"), "list"),
    **dict.fromkeys(("table", "tr", "td", "th", "tbody", "thead"), "table"), **dict.fromkeys(("html", "body", "#root"), "root"), **dict.fromkeys(("div", "section"), "div"), "a": "link", "#text": "text",
}

_TOKEN = re.compile(r"<!--(?P<comment>.*?)(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Dom:
    """Nodes in page order; a parent comes before its children. Node 0 is the root."""

    tag: list[str] = field(default_factory=lambda: ["#root"])
    parent: list[int] = field(default_factory=lambda: [-1])
    names: list[str] = field(default_factory=lambda: [""])
    text: list[str] = field(default_factory=lambda: [""])

    def add(self, tag: str, parent: int, names: str = "", text: str = "") -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.names.append(names)
        self.text.append(text)
        return len(self.tag) - 1


#: Ancestors across which an implied end tag does not reach: of p, and of list items and table parts.
P_BARRIERS = frozenset(("button", "table", "td", "th"))
ITEM_BARRIERS = frozenset(("ul", "ol", "dl", "table", "select"))
ITEMS = frozenset(("li", "dt", "dd", "tr", "td", "th", "option"))


class _Stack:
    """Open nodes, and for each tag, and each kind of barrier, where on the stack it is open: closing costs as much as it closes."""

    def __init__(self) -> None:
        self.nodes, self.tags = [0], ["#root"]
        self.open: dict[str, list[int]] = {}

    @staticmethod
    def _lists(tag: str) -> list[str]:
        kinds = ((P_CLOSERS, "#block"), (P_BARRIERS, "#p"), (ITEM_BARRIERS, "#item"))
        return [tag, *(name for group, name in kinds if tag in group)]

    def push(self, node: int, tag: str) -> None:
        for name in self._lists(tag):
            self.open.setdefault(name, []).append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def close(self, tag: str, barrier: str | None = None) -> None:
        """Close the innermost open tag and what is open inside, unless a barrier is open inside it."""
        at, bars = self.open.get(tag), self.open.get(barrier)
        if not at or bars and bars[-1] > at[-1]:
            return
        first = at[-1]
        for closed in reversed(self.tags[first:]):
            for name in self._lists(closed):
                self.open[name].pop()
        del self.nodes[first:], self.tags[first:]


def parse(page: str) -> Dom:
    """A forgiving DOM; one pass, a stack, no recursion, time in proportion to the page."""
    dom, stack, at, n = Dom(), _Stack(), 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text and not text.isspace():
            dom.add("#text", stack.nodes[-1], text=text)
        elif text and len(stack.nodes) > 1:
            dom.add("#space", stack.nodes[-1], text=" ")
        if not m:
            break
        at = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["close"]:
            # an inline end tag does not reach across a block
            stack.close(tag, "#block" if tag in INLINE else None)
            continue
        if tag in P_CLOSERS and stack.open.get("p"):
            stack.close("p", "#p")
        elif tag in ITEMS:
            stack.close(tag, "#item")
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(m["attrs"])) if m["attrs"].strip() else ""
        node = dom.add(tag, stack.nodes[-1], names)
        if tag in VOID or m["attrs"].endswith("/") and tag not in INLINE and tag not in P_CLOSERS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            body = page[at : end.start() if end else n]
            if body.strip():
                dom.add("#text", node, text=body)
            at = end.end() if end else n
            continue
        stack.push(node, tag)
    return dom


def features(dom: Dom) -> list[list[str]]:
    """The features of each node, in buckets of a fixed vocabulary."""
    n = len(dom.tag)
    length, linked, marks = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if dom.tag[i] == "#text":
            length[i] = len(dom.text[i].strip())
            marks[i] = sum(map(dom.text[i].count, ".,;:!?"))
        if dom.tag[i] == "a":
            linked[i] = length[i]
        p = dom.parent[i]
        length[p] += length[i]
        linked[p] += linked[i]
        marks[p] += marks[i]
    out, total = [], max(1, length[0])
    for i in range(n):
        tag, size = dom.tag[i], length[i]
        if tag == "#space":
            out.append([])  # a blank leaf is neutral: its message is 0
            continue
        f = [f"tag={tag if tag in KINDS else 'other'}"]
        if dom.names[i]:
            f += {f"name={zlib.crc32(w.encode()) % BUCKETS}" for w in _WORD.findall(dom.names[i].lower())}
        if tag != "#text":
            f.append(f"links={min(4, 5 * linked[i] // max(1, size))}")
            f.append(f"share={min(4, 5 * size // total)}")
        else:
            f.append(f"size={min(6, int(math.log2(size + 1)))}")
            f.append(f"marks={min(3, 100 * marks[i] // max(1, size))}")
        out.append(f)
    return out


def _pair(dom: Dom, i: int) -> str:
    return KINDS.get(dom.tag[dom.parent[i]], "other") + ">" + KINDS.get(dom.tag[i], "other")


@dataclass
class Model:
    unary: dict[str, float]  # log-odds of content
    pair: dict[str, tuple[float, float, float, float]]  # P(child | parent) as logs: 00, 01, 10, 11 (parent, child)
    prior: float


def marginals(dom: Dom, model: Model) -> list[float]:
    """P(content) of every node: sum-product, leaves to root, then root to leaves. Exact on a tree."""
    n = len(dom.tag)
    default = model.pair["*"]
    table = [default] + [model.pair.get(_pair(dom, i), default) for i in range(1, n)]
    own = [sum(model.unary.get(f, 0.0) for f in fs) for fs in features(dom)]
    own[0] += model.prior
    belief = own[:]  # log-odds of node given its subtree; children's messages are added
    up = [0.0] * n
    for i in range(n - 1, 0, -1):
        t00, t01, t10, t11 = table[i]
        e = math.exp(max(-40.0, min(40.0, belief[i])))
        up[i] = math.log((t10 + t11 * e) / (t00 + t01 * e))
        belief[dom.parent[i]] += up[i]
    out = [0.0] * n
    full = belief[:]
    for i in range(n):
        if i:
            p = dom.parent[i]
            rest = math.exp(max(-40.0, min(40.0, full[p] - up[i])))
            t00, t01, t10, t11 = table[i]
            full[i] = belief[i] + math.log((t01 + t11 * rest) / (t00 + t10 * rest))
        out[i] = 1 / (1 + math.exp(-max(-40.0, min(40.0, full[i]))))
    return out


def blocks(dom: Dom, wanted: list[bool]) -> list[str]:
    """The wanted text nodes as blocks in page order: block elements separate, white space becomes one space, character references are decoded."""
    out, parts, block = [], [], None
    home = [0] * len(dom.tag)  # the block element that holds the node
    for i in range(1, len(dom.tag)):
        home[i] = home[dom.parent[i]] if dom.tag[i] in INLINE or dom.tag[i][0] == "#" else i
    for i in range(1, len(dom.tag)):
        if dom.tag[i][0] == "#":
            if home[i] != block:
                out.append("".join(parts))
                parts, block = [], home[i]
            if wanted[i] or dom.tag[i] == "#space":
                parts.append(entities.unescape(dom.text[i]))
        elif dom.tag[i] == "br":
            parts.append(" ")
        elif dom.tag[i] not in INLINE:
            out.append("".join(parts))
            parts, block = [], None
    out.append("".join(parts))
    return [x for x in (_SPACE.sub(" ", b).strip() for b in out) if x]


def extract(page: str | None, model: Model) -> str:
    if not page:
        return ""
    dom = parse(page)
    return "\n".join(blocks(dom, [p >= 0.5 for p in marginals(dom, model)]))


def label(dom: Dom, truth: str) -> list[bool]:
    """Content labels of a labelled page's nodes: text nodes in the true text are content, and so is an element most of whose text is."""
    lines = set(truth.split("\n"))
    joined = "\n" + truth + "\n"
    good, size = [0] * len(dom.tag), [0] * len(dom.tag)
    for i in range(len(dom.tag) - 1, 0, -1):
        if dom.tag[i] == "#text":
            text = _SPACE.sub(" ", entities.unescape(dom.text[i])).strip()
            size[i] = len(text)
            good[i] = size[i] if text and (text in lines or text in joined) else 0
        size[dom.parent[i]] += size[i]
        good[dom.parent[i]] += good[i]
    return [2 * g > s for g, s in zip(good, size, strict=True)]


def train(labelled: DataFrame, smooth: float = 0.5, temper: float = 0.3) -> Model:
    """Counts over labelled (html, text) pages become the potentials.

    temper: weight of the log-odds of shape features (lengths, shares, marks),
    which say much the same thing about a node, and about its children.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, str], list[int]] = {}
            for page, truth in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                dom = parse(page or "")
                y = label(dom, truth or "")
                for i, fs in enumerate(features(dom)):
                    if not fs:
                        continue
                    for f in fs:
                        counts.setdefault(("f", f), [0] * 4)[y[i]] += 1
                    counts.setdefault(("f", "*"), [0] * 4)[y[i]] += 1
                    if i:
                        for k in (_pair(dom, i), "*"):
                            counts.setdefault(("p", k), [0] * 4)[2 * y[dom.parent[i]] + y[i]] += 1
            rows = [(k, name, *c) for (k, name), c in counts.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(("kind", "name", "c0", "c1", "c2", "c3"), r, strict=True)) for r in rows])

    counted = labelled.select("html", "text").mapInArrow(run, "kind string, name string, c0 long, c1 long, c2 long, c3 long")
    rows = counted.groupBy("kind", "name").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(4))).collect()  # the bounded vocabulary
    unary, pair, total = {}, {}, (1, 1)
    for r in rows:
        if r["kind"] == "f" and r["name"] == "*":
            total = (r["c0"], r["c1"])
    for r in rows:
        c = [r[f"c{i}"] + smooth for i in range(4)]
        if r["kind"] == "p":
            pair[r["name"]] = (c[0] / (c[0] + c[1]), c[1] / (c[0] + c[1]), c[2] / (c[2] + c[3]), c[3] / (c[2] + c[3]))
        elif r["name"] != "*":
            odds = math.log(c[1] / (total[1] + 1)) - math.log(c[0] / (total[0] + 1))
            unary[r["name"]] = odds * (1 if r["name"].startswith(("tag=", "name=")) else temper)
    pair.setdefault("*", (0.9, 0.1, 0.1, 0.9))
    return Model(unary, pair, -math.log((total[0] + 1) / (total[1] + 1)))


def main_text(pages: DataFrame, model: Model, column: str = "html") -> DataFrame:
    """pages with text and n_chars (its code points)."""
    kept = pages.select(*without(pages, "text", "n_chars"))
    names, where = [*kept.columns, "text", "n_chars"], [c.lower() for c in kept.columns].index(column.lower())
    schema = T.StructType([*kept.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract(x, model) for x in part.column(where).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, type=pa.string()), pa.array(list(map(len, texts)), type=pa.int64())], names=names)

    return kept.mapInArrow(run, schema)
