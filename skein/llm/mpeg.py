"""MPEG audio as a media column: frames, tags, seek tables and checksums.

``encode`` stores bytes losslessly in MPEG-1 layer III frames, 576 to a frame, as ancillary data
of frames without audio bits; an ID3v2 tag gives the length, a Xing table the frames, the bytes
and 100 seek points. ``store`` writes the media column to the shared folder; ``features`` reads it
back. ``scan`` reads any stream of layer I, II or III frames, of constant or variable bitrate: it skips
tags, finds the first header that another frame follows, resynchronises after damage, reads the
Xing or VBRI table, checks each layer III frame's CRC-16 (those of other layers are counted as
unchecked) and gives exact durations, in samples, and the offset of every frame, by which
``seek`` finds the frame that plays a sample.

Defined cases: a null text is empty and is stored as one frame of bytes 255; null media is empty;
bytes without any frame give 0 frames, duration 0, no offsets and an n_bytes of the payload, as does
any stream without our length tag; very long texts are one stream, held by one task at a time; rows
that repeat, or share a doc_id or have none, give values of their own, equal for equal texts;
other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from skein.llm import ids
from skein.session import materialize

CHUNK = 576
PAD = b"\xff"
#: Fixed values of ISO 11172-3 and 13818-3: kbit/s by layer and index for MPEG-1, and for the lower
#: sampling rates; Hz by index.
RATES_1 = {
    1: (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    2: (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
}
RATES_2 = {
    1: (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    3: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = (44100, 48000, 32000)
MEDIA = f"{ids.SCHEMA}, media binary"
FEATURES = (
    f"{ids.SCHEMA}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, offsets array<long>"
)


@dataclass(frozen=True)
class Header:
    """A frame header; ``size`` is the whole frame's bytes."""

    version: int
    layer: int
    checked: bool
    hertz: int
    kbits: int
    padded: bool
    mono: bool

    @property
    def samples(self) -> int:
        if self.layer == 1:
            return 384
        return 1152 if self.version == 1 or self.layer == 2 else 576

    @property
    def size(self) -> int:
        if self.layer == 1:  # counted in slots of four bytes
            return (12 * self.kbits * 1000 // self.hertz + self.padded) * 4
        return self.samples // 8 * self.kbits * 1000 // self.hertz + self.padded

    @property
    def side(self) -> int:
        """Bytes of side information."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)

    @property
    def bits(self) -> bytes:
        rates = (RATES_1 if self.version == 1 else RATES_2)[self.layer]
        rate, hertz = rates.index(self.kbits), HERTZ.index(self.hertz * {1: 1, 2: 2, 25: 4}[self.version])
        second = 0xE0 | {1: 3, 2: 2, 25: 0}[self.version] << 3 | (4 - self.layer) << 1 | (not self.checked)
        return bytes([0xFF, second, rate << 4 | hertz << 2 | self.padded << 1, 0xC0 if self.mono else 0])


def header(data: bytes, at: int) -> Header | None:
    """The header at a place, or None; free and reserved formats are not read."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = {3: 1, 2: 2, 0: 25}.get(data[at + 1] >> 3 & 3), 4 - (data[at + 1] >> 1 & 3)
    rate, hertz = data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if not version or layer == 4 or rate in (0, 15) or hertz == 3:
        return None
    rates = (RATES_1 if version == 1 else RATES_2)[layer]
    each = HERTZ[hertz] // {1: 1, 2: 2, 25: 4}[version]
    return Header(version, layer, not data[at + 1] & 1, each, rates[rate], bool(data[at + 2] & 2), data[at + 3] >> 6 == 3)


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


OURS = Header(1, 3, True, 44100, 192, False, True)


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def encode(payload: bytes, n_bytes: int) -> bytes:
    """A stream of the payload, a positive multiple of 576 bytes."""
    side = bytes(OURS.side)
    head = OURS.bits + struct.pack(">H", crc16(OURS.bits[2:] + side)) + side
    fill = bytes(OURS.size - len(head) - CHUNK)
    chunks = [payload[k : k + CHUNK] for k in range(0, len(payload), CHUNK)]
    audio = b"".join([x for c in chunks for x in (head, c, fill)])
    total = (len(chunks) + 1) * OURS.size
    toc = bytes(min(255, 256 * (OURS.size * (1 + i * len(chunks) // 100)) // total) for i in range(100))
    xing = OURS.bits + head[4:6] + side + b"Xing" + struct.pack(">III", 7, len(chunks), total) + toc
    text = b"\x00length\x00" + str(n_bytes).encode()
    frame = b"TXXX" + _syncsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + _syncsafe(len(frame)) + frame + xing.ljust(OURS.size, b"\0") + audio


@dataclass
class Stream:
    """What a scan finds; ``offsets`` are the audio frames' places, ``starts`` their first samples."""

    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    samples: int = 0
    hertz: int = 0
    checked: int = 0
    bad: int = 0
    unchecked: int = 0
    skipped: int = 0
    rates: set[int] = field(default_factory=set)
    table: tuple[int, int, bytes] | None = None
    payload: bytes = b""

    @property
    def length(self) -> int:
        """The stored length of the payload, or all of it where no tag gives one."""
        name, _, value = self.tags.get("TXXX", "").partition("\0")
        return int(value) if name == "length" and value.isdecimal() else len(self.payload)


def _size(b: bytes) -> int:
    """A syncsafe integer."""
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3(data: bytes, found: Stream) -> int:
    """Reads an ID3v2.3 or 2.4 tag's text frames; where the tag ends."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    version, flags = data[3], data[5]
    end = min(len(data), 10 + _size(data[6:10]))
    body = data[10:end]
    if flags & 0x80 and version < 4:  # unsynchronised as a whole
        body = body.replace(b"\xff\x00", b"\xff")
    at = 0
    if flags & 0x40 and len(body) >= 4:  # an extended header, whose size counts itself in 2.4 only
        at = _size(body) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    while at + 10 <= len(body) and body[at : at + 4].strip(b"\0"):
        n = _size(body[at + 4 : at + 8]) if version == 4 else int.from_bytes(body[at + 4 : at + 8], "big")
        if body[at : at + 1] == b"T" and n:
            value = body[at + 10 : at + 10 + n]
            if version == 4 and body[at + 9] & 2:
                value = value.replace(b"\xff\x00", b"\xff")
            code = {1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin-1")
            found.tags[body[at : at + 4].decode("latin-1")] = value[1:].decode(code, "replace")
        at += 10 + n
    return end + (10 if version == 4 and flags & 0x10 else 0)


def _table(data: bytes, at: int, body: int) -> tuple[int, int, bytes] | None:
    """(frames, bytes, seek points) of a Xing, Info or VBRI frame."""
    number = lambda p, n=4: int.from_bytes(data[p : p + n], "big")
    if data[body : body + 4] in (b"Xing", b"Info"):
        flags, p = number(body + 4), body + 8
        frames = number(p) if flags & 1 else 0
        p += 4 * (flags & 1)
        total = number(p) if flags & 2 else 0
        p += 4 * (flags >> 1 & 1)
        return frames, total, data[p : p + 100] if flags & 4 else b""
    p = at + 36  # VBRI stands at a fixed place
    if data[p : p + 4] == b"VBRI":
        entries, each = number(p + 18, 2), number(p + 22, 2)
        return number(p + 14), number(p + 10), data[p + 26 : p + 26 + entries * each]
    return None


def scan(data: bytes) -> Stream:
    found = Stream()
    at = _id3(data, found)
    stop = len(data) - 128 if len(data) >= 128 and data[-128:-125] == b"TAG" else len(data)
    parts, seen, sums, synced, first = [], {}, {}, False, True
    while at + 4 <= stop:
        key = data[at : at + 4]
        if key not in seen:
            h = header(data, at)
            seen[key] = h and (h, h.size, h.side, h.samples)
        got = seen[key]
        follows = at + got[1] if got else 0
        if not got or follows > stop or (not synced and follows + 4 <= stop and header(data, follows) is None):
            nearest = data.find(b"\xff", at + 1, stop)
            nearest = stop if nearest < 0 else nearest
            found.skipped += nearest - at
            at, synced = nearest, False
            continue
        synced = True
        h, size, side, samples = got
        body = at + 4
        if h.checked:
            if h.layer == 3:
                covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + side]
                if covered not in sums:
                    sums[covered] = crc16(covered)
                found.checked += 1
                found.bad += sums[covered] != data[at + 4] << 8 | data[at + 5]
            else:
                found.unchecked += 1
            body += 2
        body += side
        table = _table(data, at, body) if first and h.layer == 3 else None
        if table:
            found.table = table
        else:
            found.offsets.append(at)
            found.starts.append(found.samples)
            found.samples += samples
            found.rates.add(h.kbits)
            found.hertz = found.hertz or h.hertz
            parts.append(data[body : min(body + CHUNK, at + size)])
        first = False
        at += size
    found.payload = b"".join(parts)
    return found


def seek(found: Stream, sample: int) -> int | None:
    """The place of the frame that plays a sample; None outside the stream."""
    if not 0 <= sample < found.samples:
        return None
    return found.offsets[bisect.bisect_right(found.starts, sample) - 1]


def feature(found: Stream) -> str:
    table = found.table or (0, 0, b"")
    rate = "none" if not found.rates else str(*found.rates) if len(found.rates) == 1 else "variable"
    exact = f"{found.samples}/{found.hertz or 1}"
    return f"frames={len(found.offsets)};duration={exact};kbits={rate};table={table[0]}:{table[1]}:{zlib.crc32(table[2])};checked={found.checked};bad={found.bad};skipped={found.skipped}"


def _stored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        raw = [(text or "").encode() for text in batch["text"]]
        media = [encode(r + PAD * (-len(r) % CHUNK if r else CHUNK), len(r)) for r in raw]
        yield batch[["missing", "id"]].assign(media=media)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in FEATURES.split(", ")]
    for batch in batches:
        rows = []
        for missing, doc_id, media in zip(*(batch[c].tolist() for c in ("missing", "id", "media")), strict=True):
            media = bytes(media or b"")
            found = scan(media)
            p = found.payload
            digests = (hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), hashlib.sha256(media).hexdigest())
            rows.append((missing, doc_id, found.length, len(p), *digests, feature(found), found.offsets))
        yield pd.DataFrame(rows, columns=names)


def store(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``media``: each text as a stream of frames, written to the shared folder."""
    made = docs.select(*ids.apart("doc_id"), "text").mapInPandas(_stored, MEDIA)
    return materialize(made.select(ids.together("doc_id"), "media"), "media", "zstd")


def features(media: DataFrame) -> DataFrame:
    """Digests, ``feature`` and ``offsets`` of stored streams, from their bytes alone."""
    made = media.select(*ids.apart("doc_id"), "media").mapInPandas(_read, FEATURES)
    return made.select(ids.together("doc_id"), *(c for c in made.columns if c not in ("missing", "id")))
