"""MPEG audio columns: bytes of an MPEG audio stream in, exact durations and seek offsets out, and a lossless byte carrier.

parse() finds the first frame by resynchronising on chained headers (junk before it
is stepped over), follows the frames, resynchronises after damage, parses ID3v1,
ID3v2 (2.2 to 2.4) and APE tags wherever they stand, reads the Xing/Info and VBRI
tables and the encoder's delay and padding, checks the CRC-16 of protected frames
of all three layers, and returns exact sample counts (durations are summed by
sampling rate) with the byte offset of every frame.
carry() stores bytes as the ancillary data of silent Layer III frames; stored()
reads them back.

Defined cases: null, empty or frameless media give zero frames, zero duration,
no offsets; a truncated last frame is not counted; repeated rows give equal
rows; other columns pass through untouched.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, without

# Fixed values of ISO/IEC 11172-3 and 13818-3, in kbit/s by (version 1?, layer), and Hz by version.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    version: int  # the two header bits: 3 is MPEG-1, 2 is MPEG-2, 0 is MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    channels: int
    size: int
    samples: int
    side: int  # bytes of Layer III side information


@functools.lru_cache(maxsize=4096)
def header(head: bytes) -> Header | None:
    """The frame header in four bytes; None where they are none. Free-format frames have no size of their own and count as none."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3)
    rate_at, bits = head[2] >> 2 & 3, head[2] >> 4
    if version == 1 or layer == 4 or rate_at == 3 or bits in (0, 15) or head[3] & 3 == 2:
        return None
    kbps, rate = BITRATES[version == 3, layer][bits], RATES[version][rate_at]
    pad, mono = head[2] >> 1 & 1, head[3] >> 6 == 3
    if layer == 1:
        size, samples = (12 * kbps * 1000 // rate + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and version != 3 else 1152
        size = samples // 8 * kbps * 1000 // rate + pad
    side = 0 if layer != 3 else ((17 if mono else 32) if version == 3 else (9 if mono else 17))
    return Header(version, layer, not head[1] & 1, kbps, rate, 1 if mono else 2, size, samples, side)


def _crc_table() -> list[int]:
    out = []
    for x in range(256):
        c = x << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@functools.lru_cache(maxsize=65536)
def crc16(data: bytes, bits: int | None = None) -> int:
    """Over the first so many bits; None: all."""
    bits = 8 * len(data) if bits is None else bits
    c = 0xFFFF
    for x in data[: bits // 8]:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ x]
    for k in range(bits % 8):
        bit = data[bits // 8] >> 7 - k & 1
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15) ^ bit else 0)
    return c


def _layer2_widths(h: Header) -> list[int]:
    """Bits of the allocation field of each subband of a Layer II frame: fixed values of the standards' allocation tables."""
    if h.version != 3:
        return [4] * 4 + [3] * 7 + [2] * 19
    each = h.kbps // h.channels
    if each < 56:
        return [4] * 2 + [3] * (10 if h.rate == 32000 else 6)
    return [4] * 11 + [3] * 12 + [2] * (7 if each >= 96 and h.rate != 48000 else 4)


def protected_bits(frame: bytes, h: Header) -> int:
    """How many bits behind the checksum it covers: side information, or allocation and, in Layer II, the selection of scale factors."""
    if h.layer == 3:
        return 8 * h.side
    mode, extension = frame[3] >> 6, frame[3] >> 4 & 3
    widths = [4] * 32 if h.layer == 1 else _layer2_widths(h)
    bound = 0 if mode == 3 else min(len(widths), 4 * (extension + 1)) if mode == 1 else len(widths)
    fields = [(w, 2 if sb < bound else 1) for sb, w in enumerate(widths)]
    size = sum(w * n for w, n in fields)
    if h.layer == 1:
        return size
    body, at, chosen = int.from_bytes(frame[6:], "big"), 8 * (len(frame) - 6), 0
    for w, n in fields:
        for _ in range(n):
            at -= w
            if at >= 0 and body >> at & (1 << w) - 1:
                chosen += h.channels if n == 1 else 1
    return size + 2 * chosen


@dataclass
class Media:
    frames: int = 0
    samples: int = 0
    rate: int = 0
    channels: int = 0
    layer: int = 0
    crc_checked: int = 0
    crc_failed: int = 0
    junk_bytes: int = 0
    vbr: str | None = None
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    toc: list[int] = field(default_factory=list)
    delay: int = 0  # samples that the encoder has put before and behind the sound
    padding: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    by_rate: dict[int, int] = field(default_factory=dict)  # samples
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)


    @property
    def duration_us(self) -> int:
        return int(sum(Fraction(n * 1_000_000, rate) for rate, n in self.by_rate.items()))


def _text(body: bytes) -> str:
    return body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace")


def _id3v1(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Behind the 128-byte tag at `at`; fields that an earlier tag has stay."""
    for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93), ("TYER", 93, 97)):
        if value := data[at + a : at + b].split(b"\0")[0].decode("latin-1").strip():
            tags.setdefault(name, value)
    return at + 128


def _goes_on(data: bytes, at: int) -> bool:
    """Whether what follows a tag can: nothing, padding, a frame or another tag."""
    return at >= len(data) or data[at] == 0 or header(data[at : at + 4]) is not None or data[at : at + 3] in (b"TAG", b"ID3") or data[at : at + 8] == b"APETAGEX"


def _ape(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Behind the APE tag whose header or footer is at `at`; `at` itself where that can be none. A footer alone has its items before it, which have been passed as junk."""
    version, size, count, flags = (int.from_bytes(data[at + k : at + k + 4], "little") for k in (8, 12, 16, 20))
    is_header = flags >> 29 & 1
    if version not in (1000, 2000) or size < 32 or (at + 32 + size > len(data) or not _goes_on(data, at + 32 + size) if is_header else size > at + 32):
        return at
    p, end = (at + 32, min(len(data), at + 32 + size)) if is_header else (max(0, at + 32 - size), at)
    for _ in range(count):
        if p + 8 >= end:
            break
        n, kind = int.from_bytes(data[p : p + 4], "little"), int.from_bytes(data[p + 4 : p + 8], "little")
        stop = data.find(b"\0", p + 8, end)
        if stop < 0:
            break
        if not kind >> 1 & 3:  # text
            tags.setdefault(data[p + 8 : stop].decode("latin-1"), data[stop + 1 : min(end, stop + 1 + n)].decode("utf-8", "replace"))
        p = stop + 1 + n
    return max(at + 32, at + 32 + size) if is_header else at + 32


def _id3(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Behind the ID3v2 tag at `at`, whose text frames go to tags; `at` itself where there is none."""
    # versions and sizes of a tag have no byte FF, and sizes none above 7F; and a tag ends inside the data
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or data[at + 3] not in (2, 3, 4) or data[at + 4] == 0xFF or max(data[at + 6 : at + 10]) > 127:
        return at
    size = functools.reduce(lambda n, x: n << 7 | x & 127, data[at + 6 : at + 10], 0)
    end, p, major = at + 10 + size, at + 10, data[at + 3]
    behind = end + (10 if data[at + 5] & 0x10 else 0)
    if behind > len(data) or not _goes_on(data, behind):
        return at
    while major == 2 and p + 6 <= end and data[p : p + 3].isalnum():
        name, n = data[p : p + 3].decode("latin-1"), int.from_bytes(data[p + 3 : p + 6], "big")
        body = data[p + 6 : min(end, p + 6 + n)]
        if name[0] == "T" and body:
            tags[{"TT2": "TIT2", "TP1": "TPE1", "TAL": "TALB", "TYE": "TYER"}.get(name, name)] = _text(body).rstrip("\0")
        p += 6 + n
    while major >= 3 and p + 10 <= end and data[p : p + 4].isalnum():
        name, raw = data[p : p + 4].decode("latin-1"), data[p + 4 : p + 8]
        n = functools.reduce(lambda a, x: a << 7 | x & 127, raw, 0) if major == 4 else int.from_bytes(raw, "big")
        body = data[p + 10 : min(end, p + 10 + n)]
        if name[0] == "T" and body:
            text = _text(body)
            if name == "TXXX":
                name, _, text = text.partition("\0")
            tags[name] = text.rstrip("\0")
        p += 10 + n
    return behind


def _vbr(frame: bytes, h: Header, out: Media) -> bool:
    """Whether this is a table frame, whose fields then are in out."""
    at = 4 + 2 * h.protected + h.side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        out.vbr, flags, p = frame[at : at + 4].decode(), int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        if flags & 1:
            out.vbr_frames, p = int.from_bytes(frame[p : p + 4], "big"), p + 4
        if flags & 2:
            out.vbr_bytes, p = int.from_bytes(frame[p : p + 4], "big"), p + 4
        if flags & 4:
            out.toc, p = list(frame[p : p + 100]), p + 100
        p += 4 if flags & 8 else 0
        if frame[p : p + 4] in (b"LAME", b"Lavc", b"Lavf"):
            both = int.from_bytes(frame[p + 21 : p + 24], "big")
            out.delay, out.padding = both >> 12, both & 0xFFF
        return True
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        out.vbr, out.vbr_bytes, out.vbr_frames = "VBRI", *struct.unpack(">II", frame[46:54])
        count, scale, width = struct.unpack(">HHH", frame[54:60])
        out.toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(count)]
        return True
    return False


_PLACE = re.compile(rb"\xff|TAG|APETAGEX|ID3")


def parse(data: bytes | None) -> Media:
    """Follow the stream from end to end."""
    out = Media()
    data = data or b""
    at, n, synced = _id3(data, 0, out.tags), len(data), False
    while at + 4 <= n:
        h = header(data[at : at + 4])
        fits = h is not None and at + h.size <= n
        if fits and not synced:  # a lone header can be chance; the next one must chain, or the stream end
            after = at + h.size
            fits = after == n or header(data[after : after + 4]) is not None or data[after : after + 3] in (b"TAG", b"APE", b"ID3")
        if not fits:
            tagged = at
            if data[at : at + 3] == b"TAG" and n - at == 128:
                tagged = _id3v1(data, at, out.tags)
            elif data[at : at + 8] == b"APETAGEX" and n - at >= 32:
                tagged = _ape(data, at, out.tags)
            elif data[at : at + 3] == b"ID3":
                tagged = _id3(data, at, out.tags)
            if tagged > at:
                at, synced = tagged, False
                continue
            # the next place that can be a frame or a tag
            found = _PLACE.search(data, at + 1)
            nxt = found.start() if found else n
            out.junk_bytes += nxt - at
            at, synced = nxt, False
            continue
        frame = data[at : at + h.size]
        if h.protected:
            covered = protected_bits(frame, h)
            out.crc_checked += 1
            out.crc_failed += crc16(frame[2:4] + frame[6 : 6 + (covered + 7) // 8].ljust((covered + 7) // 8, b"\0"), 16 + covered) != int.from_bytes(frame[4:6], "big")
        if out.frames or out.vbr or not _vbr(frame, h, out):
            out.frames += 1
            out.samples += h.samples
            out.by_rate[h.rate] = out.by_rate.get(h.rate, 0) + h.samples
            out.rate, out.channels, out.layer = out.rate or h.rate, out.channels or h.channels, out.layer or h.layer
            out.offsets.append(at)
            out.sizes.append(h.size)
        at, synced = at + h.size, True
    return out


# --- the carrier: MPEG-1 Layer III, 44.1 kHz, mono, CRC on, silent; a frame's ancillary bytes are its unit.
_SIDE = 17
_LEAD = 4 + 2 + _SIDE
_HEADS = [bytes((0xFF, 0xFA, b << 4, 0xC0)) for b in range(1, 15)]
_ROOM = [header(h).size - _LEAD for h in _HEADS]


def _frame(which: int, body: bytes) -> bytes:
    head = _HEADS[which]
    return head + crc16(head[2:4] + bytes(_SIDE)).to_bytes(2, "big") + bytes(_SIDE) + body + bytes(_ROOM[which] - len(body))


def carry(payload: bytes) -> bytes:
    """The payload inside an MPEG audio stream: an ID3v2 tag with its length, a Xing table, then frames whose bit rate follows what is left."""
    frames, most = [], _ROOM[-1]
    for at in range(0, len(payload), most):
        part = payload[at : at + most]
        which = next(i for i, room in enumerate(_ROOM) if room >= len(part))
        frames.append(_frame(which, part))
    total, toc, sizes = sum(map(len, frames)), [], [0]
    for f in frames:
        sizes.append(sizes[-1] + len(f))
    table_size = _ROOM[3] + _LEAD
    for i in range(100):
        toc.append(min(255, (sizes[i * len(frames) // 100] + table_size) * 256 // max(1, total + table_size)))
    table = _frame(3, b"Xing" + struct.pack(">III", 7, len(frames), total + table_size) + bytes(toc))
    text = b"\x03payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    synchsafe = bytes(len(tag) >> s & 127 for s in (21, 14, 7, 0))
    return b"ID3\x03\0\0" + synchsafe + tag + table + b"".join(frames)


def stored(data: bytes, media: Media) -> bytes:
    """The payload of what carry() made, read back from the frames found by parse()."""
    body = b"".join(data[at + _LEAD : at + size] for at, size in zip(media.offsets, media.sizes, strict=True))
    size = int(media.tags.get("payload_bytes", len(body)))
    if size <= len(body):
        # every frame but the last is full, so the payload is the beginning of what the frames hold
        return body[:size]
    raise ValueError("the stream holds less than its payload")


def feature(m: Media) -> str:
    seek = zlib.crc32(b",".join(str(x).encode() for x in m.offsets))
    return f"layer={m.layer};rate={m.rate};channels={m.channels};frames={m.frames};samples={m.samples};duration_us={m.duration_us};vbr={m.vbr or '-'};crc={m.crc_checked - m.crc_failed}/{m.crc_checked};seek={seek:08x}"


PARSED = T.StructType([
    T.StructField("frames", T.LongType()), T.StructField("samples", T.LongType()), T.StructField("sample_rate", T.LongType()),
    T.StructField("duration_us", T.LongType()), T.StructField("vbr", T.StringType()), T.StructField("vbr_frames", T.LongType()),
    T.StructField("crc_checked", T.LongType()), T.StructField("crc_failed", T.LongType()), T.StructField("junk_bytes", T.LongType()),
    T.StructField("encoder_delay", T.LongType()), T.StructField("encoder_padding", T.LongType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())), T.StructField("seek_offsets", T.ArrayType(T.LongType())),
])


def describe(media: DataFrame, column: str = "media", to: str = "mpeg") -> DataFrame:
    """Add a struct column `to` (PARSED) with what the MPEG audio bytes in `column` hold."""

    kept = media.select(*without(media, to.lower()))
    where, names = [c.lower() for c in kept.columns].index(column.lower()), [*kept.columns, to]
    schema = T.StructType([*kept.schema.fields, T.StructField(to, PARSED)])
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 6 + [pa.map_(pa.string(), pa.string()), pa.list_(pa.int64())]
    small_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [parse(x) for x in part.column(where).to_pylist()]
                rows = [(m.frames, m.samples, m.rate, m.duration_us, m.vbr, m.vbr_frames, m.crc_checked, m.crc_failed, m.junk_bytes, m.delay, m.padding, list(m.tags.items()), m.offsets) for m in found]
                fields = [pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays(fields, names=PARSED.names)], names=names)

    return kept.mapInArrow(run, schema)


CARRIED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def carry_texts(documents: DataFrame, keep_media: bool = False) -> DataFrame:
    """Each whole text as MPEG audio: stored, read back, described.

    Columns CARRIED, and `media binary` with keep_media. A null text is an empty
    one, whose payload is 64 zero bytes. One output row for each input row; null
    and repeated doc_ids are kept.
    """
    schema = CARRIED + (", media binary" if keep_media else "")
    fields = [x.split()[0] for x in schema.split(", ")]
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = (text or "").encode()
                    payload = raw + bytes(-len(raw) % 64 if raw else 64)
                    media = carry(payload)
                    m = parse(media)
                    back = stored(media, m)
                    row = (doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(m))
                    rows.append(row + ((media,) if keep_media else ()))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=False)], names=fields)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
