"""WARC derivatives: response records become linked metadata and plain-text conversion records.

Records are rows: warc_type, record_id, refers_to, target_uri, date, headers
(map), block (binary), payload_digest, block_digest, content_length. derive()
adds to every response a `metadata` record (JSON: source headers, title, links)
and a `conversion` record (its text), both naming the response in
WARC-Refers-To. read_warc() reads files and to_members() makes the bytes of files,
gzip members included; each file is read whole by one task, so it may have 2 GB at
most (by convention WARC files have 1 GB). Field names are matched in any case; a
record whose length is no number is passed over.

Bodies are decoded by their headers: chunked, gzip and deflate, then the charset.

Defined cases: a null body is empty; bytes outside the charset are decoded with
replacement; a body in another coding, or not in the one it names, is taken as it
is; a null url gives an empty target; equal pages give equal digests,
and equal (key, url, body) equal record ids; an empty table gives no records.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

RECORD = "key long, warc_type string, record_id string, refers_to string, target_uri string, date string, headers map<string,string>, block binary, payload_digest string, block_digest string, content_length long"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
_HIDDEN = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)")
_BREAK = re.compile(r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|table|tr|section|article|header|footer|nav|aside|form|blockquote|pre|title|head|body|main|dl|dt|dd|figure|hr|br)\b[^<>]*>")
_TAG = re.compile(r"<[^<>]*>")
_START = re.compile(r"<!--(?:.*?-->|.*)|<([a-zA-Z][^\s/<>]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
#: Elements whose body is text, and where it ends.
_RAW = {x: re.compile(rf"(?i)</{x}(?=[\s/>])") for x in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
_META = re.compile(rb"(?i)<meta\b[^>]*?\bcharset\s*=\s*[\"']?\s*([a-z0-9_:.-]+)")
_CHARSET = re.compile(r"(?i)\bcharset\s*=\s*[\"']?\s*([a-z0-9_:.-]+)")
_LATIN = ("ascii", "iso8859-1")  # pages that say so are windows-1252, as browsers take it


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def plain_text(body: str) -> str:
    """The visible text: one line for each block, white space collapsed."""
    lines = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", body))).split("\n")
    return "\n".join(x for x in (" ".join(html.unescape(line).split()) for line in lines) if x)


def _http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers and body of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    status, *rest = head.decode("latin-1").split("\r\n")
    return status, {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in rest) if k.strip()}, body


def _dechunked(body: bytes) -> bytes:
    """The body without chunk sizes; as it is, where it begins with none."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0 and re.fullmatch(rb"[0-9a-fA-F]+", size := body[at:end].partition(b";")[0].strip()):
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out) if out else body


def _inflated(body: bytes, coding: str) -> bytes:
    """The body without gzip or deflate; as it is, where it is not so coded. What comes before damage is kept."""
    for bits in (31,) if coding == "gzip" else (15, -15):
        out, rest = [], body
        try:
            while rest:
                one = zlib.decompressobj(bits)
                out.append(one.decompress(rest))
                rest = one.unused_data if coding == "gzip" else b""
            return b"".join(out)
        except zlib.error:
            if out:
                return b"".join(out)
    return body


def decoded(headers: dict[str, str], body: bytes) -> str:
    """The text of a body: transfer and content encoding by the headers, then the charset of byte order mark, header or meta element, else UTF-8."""
    named = {k.lower(): v for k, v in headers.items()}
    if "chunked" in named.get("transfer-encoding", "").lower():
        body = _dechunked(body)
    for coding in reversed(named.get("content-encoding", "").lower().split(",")):
        coding = coding.strip().removeprefix("x-")
        if coding in ("gzip", "deflate"):
            body = _inflated(body, coding)
    said = _CHARSET.search(named.get("content-type", ""))
    meta = None if said else _META.search(body[:1024])
    charset = said[1] if said else meta[1].decode() if meta else "utf-8"
    for mark, of in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if body.startswith(mark):
            body, charset = body[len(mark) :], of
    try:
        name = codecs.lookup(charset).name
        if meta and name.startswith("utf-16"):
            name = "utf-8"  # the element was read byte by byte
        return body.decode("cp1252" if name in _LATIN else name, "replace")
    except (LookupError, UnicodeError):
        return body.decode("utf-8", "replace")


def links(page: str) -> list[dict[str, str]]:
    """Every href and src of the start tags, in page order. Comments and the bodies of raw-text elements hold no tags; an attribute's first value counts."""
    return scanned(page)[0]


def scanned(page: str) -> tuple[list[dict[str, str]], str]:
    """The links of a page, and its first title that is closed; one pass over the start tags."""
    out, title, at = [], None, 0
    while m := _START.search(page, at):
        at = m.end()
        if not m[1]:
            continue
        tag, seen = m[1].lower(), set()
        for name, *values in _ATTRIBUTE.findall(m[2]):
            name = name.lower()
            if name in ("href", "src") and name not in seen:
                out.append({"path": f"{tag}@{name}", "url": html.unescape("".join(values))})
            seen.add(name)
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            if tag == "title" and title is None and end:
                title = page[at + page[at : at + 1].count(">") : end.start()]
            at = end.start() if end else len(page)
    return out, " ".join(html.unescape(title or "").split())


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records (RECORD) of pages(page_id, url, html)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, url, page in frame.itertuples(index=False, name=None):
                body, url = (page or "").encode(), url or ""
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
                rid = record_id("response", str(key), url, hashlib.sha256(body).hexdigest())
                rows.append((key, "response", rid, None, url, date, {"Content-Type": "application/http; msgtype=response"}, block, digest(body), digest(block), len(block)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")]).astype({"key": "Int64"})

    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInPandas(run, RECORD)


def derive(records: DataFrame) -> DataFrame:
    """The records (RECORD) with two more for each response: metadata and conversion. One pass."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for frame in frames:
            yield frame
            rows = []
            for r in frame[frame["warc_type"] == "response"].itertuples(index=False):
                status, headers, body = _http(bytes(r.block or b""))
                text = decoded(headers, body)
                found, title = scanned(text)
                meta = json.dumps({"Response-Status": status, "Source-Headers": headers, "Title": title, "Links": found, "Payload-Digest": r.payload_digest}, ensure_ascii=False, sort_keys=True).encode()
                plain = plain_text(text).encode()
                for kind, mime, block in (("metadata", "application/json", meta), ("conversion", "text/plain", plain)):
                    rows.append((r.key, kind, record_id(kind, r.record_id), r.record_id, r.target_uri, r.date, {"Content-Type": mime, "WARC-Refers-To-Digest": r.payload_digest}, block, r.payload_digest if kind == "metadata" else digest(block), digest(block), len(block)))
            yield pd.DataFrame(rows, columns=names).astype({"key": "Int64"})

    small_batches(records.sparkSession, 250)  # a batch holds whole pages, and three records of each
    return records.select(*(x.split()[0] for x in RECORD.split(", "))).mapInPandas(run, RECORD)


def serialise(record: dict) -> bytes:
    """One WARC/1.0 record."""
    head = [("WARC-Type", record["warc_type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Date", record["date"]), ("WARC-Target-URI", record["target_uri"]), ("WARC-Refers-To", record["refers_to"]), ("WARC-Payload-Digest", record["payload_digest"]), ("WARC-Block-Digest", record["block_digest"])]
    head += sorted((record["headers"] or {}).items())
    block = bytes(record["block"] or b"")
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v)
    return f"WARC/1.0\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, plain or gzipped by record. The file is one task's; a damaged tail ends it."""
    if data[:2] == b"\x1f\x8b":
        stream = gzip.GzipFile(fileobj=io.BytesIO(data))
    else:
        stream = io.BytesIO(data)
    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            head: dict[str, str] = {}
            while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
                k, _, v = line.decode("utf-8", "replace").partition(":")
                head[k.strip()] = v.strip()
            spelt = {k.lower(): k for k in head}
            field = lambda name: head.pop(spelt[name], None) if name in spelt else None
            length = field("content-length") or "0"
            if not re.fullmatch("[0-9]{1,18}", length):
                continue  # the next line that begins a record is the next record
            size = int(length)
            block = stream.read(size)
            if len(block) < size:
                return
            named = {k: field(h) for k, h in (("warc_type", "warc-type"), ("record_id", "warc-record-id"), ("date", "warc-date"), ("target_uri", "warc-target-uri"), ("refers_to", "warc-refers-to"), ("payload_digest", "warc-payload-digest"), ("block_digest", "warc-block-digest"))}
            yield named | {"headers": head, "block": block, "content_length": size}
    except (EOFError, zlib.error, gzip.BadGzipFile):
        return


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows (RECORD, key null) of the WARC files under path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for frame in frames:
            for content in frame["content"]:
                part = []
                for r in parse_warc(bytes(content)):
                    part.append(tuple(({"key": None} | r)[n] for n in names))
                    if len(part) == 500:
                        yield pd.DataFrame(part, columns=names).astype({"key": "Int64"})
                        part = []
                if part:
                    yield pd.DataFrame(part, columns=names).astype({"key": "Int64"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, RECORD)


def to_members(records: DataFrame) -> DataFrame:
    """member (binary): each record as a gzip member; members of a file are simply concatenated."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"record_id": frame["record_id"], "member": [gzip.compress(serialise(r), 6, mtime=0) for r in frame.to_dict("records")]})

    return records.mapInPandas(run, "record_id string, member binary")
