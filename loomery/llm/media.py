"""MPEG audio as a media column: writing payloads into frames, and reading streams back whole.

`parse` resynchronises on frame headers, reads ID3v1, ID3v2 and APEv2 tags and Xing/Info and VBRI
tables, verifies the frames' CRC-16, and gives exact durations and the frames' byte offsets.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, ship

UNIT = 576  # payload bytes in a frame

_BITRATES = {  # (version 1 or not, layer): kbit/s by index
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
_RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
_NAMES = {3: "1", 2: "2", 0: "2.5"}


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    kbps: int
    rate: int
    channels: int
    mode: int
    extension: int
    length: int  # bytes of the frame
    samples: int  # for each channel
    side: int  # bytes of side information (layer III)


@lru_cache(1 << 14)
def header(word: int) -> Header | None:
    """The frame header in these 32 bits, or None. Free-format frames, whose length isn't stated, are no headers here."""
    version, layer = word >> 19 & 3, 4 - (word >> 17 & 3)
    bitrate, rate, mode = word >> 12 & 15, word >> 10 & 3, word >> 6 & 3
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or bitrate in (0, 15) or rate == 3 or word & 3 == 2:
        return None
    one = version == 3
    kbps, hz, pad = _BITRATES[one, layer][bitrate], _RATES[version][rate], word >> 9 & 1
    channels = 1 if mode == 3 else 2
    if layer == 1:
        length, samples = (12 * kbps * 1000 // hz + pad) * 4, 384
    else:
        samples = 1152 if layer == 2 or one else 576
        length = samples // 8 * kbps * 1000 // hz + pad
    side = 0 if layer < 3 else (17 if channels == 1 else 32) if one else (9 if channels == 1 else 17)
    return Header(_NAMES[version], layer, not word >> 16 & 1, kbps, hz, channels, mode, word >> 4 & 3, length, samples, side)


_CRC = []
for _i in range(256):
    _c = _i << 8
    for _ in range(8):
        _c = (_c << 1 ^ 0x8005 if _c & 0x8000 else _c << 1) & 0xFFFF
    _CRC.append(_c)


def crc16(data: bytes, bits: int | None = None) -> int:
    """CRC-16 with polynomial 8005 and start FFFF over the first bits."""
    crc, bits = 0xFFFF, len(data) * 8 if bits is None else bits
    for b in data[: bits // 8]:
        crc = (crc << 8 & 0xFFFF) ^ _CRC[crc >> 8 ^ b]
    for i in range(bits % 8):
        top = (crc >> 15) ^ (data[bits // 8] >> (7 - i) & 1)
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return crc


_crc_of = lru_cache(1 << 12)(crc16)


def _layer2_bands(h: Header) -> list[int]:
    """Bits of each subband's allocation field."""
    if h.version != "1":
        return [4] * 4 + [3] * 7 + [2] * 19
    each = h.kbps // h.channels
    if each <= 48 and each in (32, 48):
        return [4] * 2 + [3] * (10 if h.rate == 32000 else 6)
    if each <= 80 or h.rate == 48000:
        return [4] * 11 + [3] * 12 + [2] * 4
    return [4] * 11 + [3] * 12 + [2] * 7


def crc_holds(frame: bytes, h: Header) -> bool:
    """Whether the frame's checksum fits: over half the header and the side information or the allocation."""
    want, body = int.from_bytes(frame[4:6], "big"), frame[2:4] + frame[6:]
    if h.layer == 3:
        return _crc_of(body[: 2 + h.side]) == want
    bound = (h.extension + 1) * 4 if h.mode == 1 else 32
    if h.layer == 1:
        bits = 4 * sum(h.channels if sb < bound else 1 for sb in range(32))
        return crc16(body[: 2 + -(-bits // 8)], 16 + bits) == want
    bands = _layer2_bands(h)
    value, at, used = int.from_bytes(body[2:130], "big"), len(body[2:130]) * 8, 0
    for sb, n in enumerate(bands):
        for shared in range(h.channels if sb < bound else 1):
            at -= n
            if at < 0:
                return False
            if value >> at & (1 << n) - 1:
                used += 1 if sb < bound else h.channels
    bits = len(body[2:130]) * 8 - at + 2 * used
    return crc16(body[: 2 + -(-bits // 8)], 16 + bits) == want


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict[str, object] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)  # of audio frames
    lengths: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    crc_frames: int = 0
    crc_bad: int = 0
    skipped: int = 0  # bytes in no tag or frame

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers) - int(self.vbr.get("delay", 0)) - int(self.vbr.get("padding", 0))

    @property
    def rate(self) -> int:
        return self.headers[0].rate if self.headers else 0


def _text(kind: int, raw: bytes) -> str:
    return raw.decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(kind, "latin-1"), "replace").rstrip("\0")


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Read the tag at this offset; the offset behind it, or the same if there is none."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or any(b & 0x80 for b in data[at + 6 : at + 10]):
        return at
    major, flags = data[at + 3], data[at + 5]
    safe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    end = at + 10 + safe(data[at + 6 : at + 10])
    p, head = at + 10, 6 if major == 2 else 10
    if flags & 0x40 and major > 2 and len(data) >= p + 4:
        p += safe(data[p : p + 4]) if major == 4 else 4 + int.from_bytes(data[p : p + 4], "big")
    while p + head <= min(end, len(data)) and data[p]:
        name = data[p : p + head - (3 if major == 2 else 6)].decode("latin-1")
        size = int.from_bytes(data[p + 3 : p + 6], "big") if major == 2 else safe(data[p + 4 : p + 8]) if major == 4 else int.from_bytes(data[p + 4 : p + 8], "big")
        body = data[p + head : min(end, p + head + size)]
        if name[:1] == "T" and body:
            tags[name] = _text(body[0], body[1:])
        p += head + size
    return min(len(data), end + (10 if major == 4 and flags & 0x10 else 0))


def _vbr(frame: bytes, h: Header) -> dict[str, object]:
    """The Xing, Info or VBRI table in this frame, if it holds one."""
    p = 4 + 2 * h.protected + h.side
    if h.layer == 3 and frame[p : p + 4] not in (b"Xing", b"Info"):
        p = 4 + h.side  # most writers leave out the checksum here
    if h.layer == 3 and frame[p : p + 4] in (b"Xing", b"Info"):
        out: dict[str, object] = {"kind": frame[p : p + 4].decode()}
        flags = int.from_bytes(frame[p + 4 : p + 8], "big")
        p += 8
        for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                raw = frame[p : p + size]
                out[name] = raw if name == "toc" else int.from_bytes(raw, "big")
                p += size
        if frame[p : p + 4] in (b"LAME", b"Lavc", b"Lavf") and len(frame) >= p + 24:
            gap = int.from_bytes(frame[p + 21 : p + 24], "big")
            out |= {"delay": gap >> 12, "padding": gap & 0xFFF}
        return out
    p = 36
    if h.layer == 3 and frame[p : p + 4] == b"VBRI" and len(frame) >= p + 26:
        g = lambda a, n: int.from_bytes(frame[p + a : p + a + n], "big")
        n, scale, width = g(18, 2), g(20, 2), g(22, 2)
        return {"kind": "VBRI", "bytes": g(10, 4), "frames": g(14, 4), "delay": g(6, 2), "toc": [g(26 + i * width, width) * scale for i in range(n)]}
    return {}


def _frames(s: Stream, data: bytes, at: int, end: int) -> None:
    """Add the frames between these offsets to the stream."""
    synced, first = False, True
    word_at = lambda p: int.from_bytes(data[p : p + 4], "big") if p + 4 <= end else 0
    while at + 4 <= end:
        h = header(word_at(at))
        ok = h is not None and at + h.length <= end
        if ok and not synced:  # a lone header may be chance: the next one must follow
            nxt = at + h.length
            then = header(word_at(nxt))
            ok = nxt + 4 > end or (then is not None and (then.version, then.layer, then.rate) == (h.version, h.layer, h.rate))
        if not ok:
            p = data.find(b"\xff", at + 1, end)
            p = end if p < 0 else p
            s.skipped += p - at
            at, synced = p, False
            continue
        synced = True
        frame = data[at : at + h.length]
        if h.protected:
            s.crc_frames += 1
            s.crc_bad += not crc_holds(frame, h)
        table = _vbr(frame, h) if first else {}
        first = False
        if table:
            s.vbr = table
        else:
            s.offsets.append(at)
            s.lengths.append(h.length)
            s.headers.append(h)
        at += h.length
    s.skipped += max(0, end - at)


def _covered(data: bytes, at: int, end: int) -> bool:
    """Whether a frame runs from before the last 128 bytes to their end: then they are its payload, and no tag."""
    _frames(s := Stream(), data, at, end)
    return bool(s.offsets) and s.offsets[-1] < end - 128 and s.offsets[-1] + s.lengths[-1] == end


def parse(data: bytes | None) -> Stream:
    """Read a whole stream. Empty, cut or foreign bytes give a stream with fewer or no frames, and count as skipped."""
    s, data = Stream(), data or b""
    at, end = 0, len(data)
    while (nxt := _id3v2(data, at, s.tags)) > at:
        at = nxt
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG" and not _covered(data, at, end):
        end -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            s.tags.setdefault(name, data[end + a : end + b].rstrip(b"\0 ").decode("latin-1"))
    if end - at >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size = int.from_bytes(data[end - 20 : end - 16], "little")
        has_head = int.from_bytes(data[end - 12 : end - 8], "little") >> 31
        if 32 <= size <= end - at:
            s.tags.setdefault("ape_items", str(int.from_bytes(data[end - 16 : end - 12], "little")))
            end = max(at, end - size - 32 * has_head)
    _frames(s, data, at, end)
    return s


# MPEG-1 layer III, 44.1 kHz, one channel, 192 kbit/s, protected: 626 bytes, of which 603 may be ancillary.
_HEAD = bytes([0xFF, 0xFA, 0xB0, 0xC0])
_H = header(int.from_bytes(_HEAD, "big"))
_DATA = 4 + 2 + _H.side
_SIDE = bytes(_H.side)  # no scale factors, no coefficients: what follows is ancillary data, played as silence
_FRAME = np.frombuffer(_HEAD + crc16(_HEAD[2:] + _SIDE).to_bytes(2, "big") + _SIDE + bytes(_H.length - _DATA), np.uint8)


def payload_of(text: str | None) -> bytes:
    """UTF-8 of the text with bytes 255 up to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def write(payload: bytes) -> bytes:
    """A stream that holds the payload: ID3v2 tag, Info frame with seek table, one frame for each UNIT bytes."""
    n = len(payload) // UNIT
    frames = np.repeat(_FRAME[None], n, 0)
    frames[:, _DATA : _DATA + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    total = _H.length * (n + 1)
    toc = bytes(min(255, 256 * (_H.length * (1 + i * n // 100)) // total) for i in range(100))
    info = b"Info" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    lead = _FRAME[:_DATA].tobytes() + info + bytes(_H.length - _DATA - len(info))
    body = b"\x03payload\0" + str(len(payload)).encode()
    tag = b"TXXX" + bytes([0, 0, 0, len(body)]) + b"\0\0" + body
    return b"ID3\x04\0\0" + bytes([0, 0, 0, len(tag)]) + tag + lead + frames.tobytes()


def payload(data: bytes, s: Stream) -> bytes:
    """What write() stored, taken out of the stream's frames."""
    if not s.offsets:
        return b""
    if s.offsets[-1] - s.offsets[0] == (len(s.offsets) - 1) * _H.length:
        a = np.frombuffer(data, np.uint8, len(s.offsets) * _H.length, s.offsets[0]).reshape(-1, _H.length)
        return a[:, _DATA : _DATA + UNIT].tobytes()
    return b"".join(data[o + _DATA : o + _DATA + UNIT] for o in s.offsets)


def describe(s: Stream) -> str:
    h = s.headers[0] if s.headers else None
    seek = zlib.crc32(np.array(s.offsets, "<u8").tobytes())
    return (f"mpeg{h.version}-layer{h.layer}" if h else "none") + f";hz={s.rate};frames={len(s.offsets)};samples={s.samples};crc={s.crc_frames - s.crc_bad}/{s.crc_frames};vbr={s.vbr.get('kind', '-')}:{s.vbr.get('frames', 0)};tags={len(s.tags)};skipped={s.skipped};seek={seek:08x}"


def _to_media(text: pd.Series) -> pd.Series:
    return text.map(lambda t: write(payload_of(t)), na_action=None)


PROBE = ("version string, layer int, hz int, frames long, samples long, duration_s double, crc_frames long, crc_bad long, skipped long, tags map<string,string>, seek_offsets array<long>")


def _probe(media: pd.Series) -> pd.DataFrame:
    rows = []
    for data in media:
        s = parse(data)
        h = s.headers[0] if s.headers else None
        rows.append((h and h.version, h.layer if h else 0, s.rate, len(s.offsets), s.samples, s.samples / s.rate if s.rate else 0.0, s.crc_frames, s.crc_bad, s.skipped, s.tags, s.offsets))
    return pd.DataFrame(rows, columns=["version", "layer", "hz", "frames", "samples", "duration_s", "crc_frames", "crc_bad", "skipped", "tags", "seek_offsets"])


DIGEST = ("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _digest(media: pd.Series) -> pd.DataFrame:
    rows = []
    for data in media:
        s = parse(data)
        p = payload(data, s)
        rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(data), hashlib.sha256(data).hexdigest(), describe(s)))
    return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def to_media(text: str) -> Column:
    """A media column from texts."""
    return F.pandas_udf(_to_media, "binary")(text)


def probe(media: str) -> Column:
    """What parse() finds in each media value; null and empty media have no frames. samples / hz is the exact duration."""
    return F.pandas_udf(_probe, PROBE)(media)


def digest(media: str) -> Column:
    """Of stored media: the payload read back, as sizes and hashes, and the stream's features."""
    return F.pandas_udf(_digest, DIGEST)(media)


def stored(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column of each text. A null text counts as empty; ids may be null or repeat."""
    ship(spark)
    d = columns(docs, "doc_id", "text")
    return d.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), to_media("text").alias("media"))


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The digest of each row's stored media; one row for each input row, in one pass, without a shuffle."""
    return stored(spark, docs).withColumn("x", digest("media")).select("doc_id", "n_bytes", "x.*")
