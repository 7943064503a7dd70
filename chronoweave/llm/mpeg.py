"""MPEG audio in media columns: frame headers resynchronised, tags and variable-bitrate tables parsed,
checksums verified, exact durations and frame offsets kept.

`store` writes a payload into a stream: an ID3v2 tag with its length and crc32, a frame with a Xing table, then
Layer III frames (MPEG-1, mono, checksummed) whose data hold the payload; the last frame takes the least
bitrate that fits, so the rate varies. `read` parses any stream: it finds the first header whose successor
is a header too, walks from frame to frame, and searches anew, counting skipped bytes, where one is missing.
A frame of free format (no bitrate in its header) ends where the next header of its stream stands. Xing, Info and
VBRI tables are read with their seek entries, which are held against the frames; what an encoder says it put
before and behind the sound is taken off the duration. ID3v2 tags may have an extended header, a footer and
unsynchronised bytes. An ID3v1 tag is one only where no frame holds its place: a payload may have its mark at 128
bytes before the end.

Defined results: null media has null columns; empty or foreign bytes have no frames, duration 0 and all
bytes skipped; equal bytes, repeated rows among them, have equal results; a very long payload is a long stream; an
empty table gives an empty one; other columns stay, but for one of the name of the result.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import without

# Fixed values of the format: kbit/s by version and layer, Hz by version, samples in a frame.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {0: (11025, 12000, 8000), 2: (22050, 24000, 16000), 3: (44100, 48000, 32000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}

SIDE_MONO = 17
RATE = 32000
#: Every how many frames a seek offset is listed in the feature string.
SEEK_EVERY = 32


@dataclass(frozen=True)
class Header:
    version: int  # 1 for MPEG-1, 2 for MPEG-2 and 2.5
    layer: int
    checked: bool
    bitrate: int
    rate: int
    size: int  # 0 for a frame of free format, before its end is found
    samples: int
    mono: bool

    @property
    def form(self) -> tuple:
        """What does not change within a stream."""
        return self.version, self.layer, self.rate, self.mono, not self.bitrate

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


@lru_cache(maxsize=4096)
def header(raw: bytes) -> Header | None:
    """The four header bytes, or None if they are none."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    kind, layer, rate_no, bit_no = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3), raw[2] >> 2 & 3, raw[2] >> 4
    if kind == 1 or layer == 4 or rate_no == 3 or bit_no == 15:
        return None
    version = 1 if kind == 3 else 2
    kbits, rate, pad = BITRATES[version, layer if version == 1 else min(layer, 2)][bit_no], RATES[kind][rate_no], raw[2] >> 1 & 1
    samples = SAMPLES[version, layer]
    size = 0 if not bit_no else (12000 * kbits // rate + pad) * 4 if layer == 1 else samples * 125 * kbits // rate + pad
    return Header(version, layer, not raw[1] & 1, kbits, rate, size, samples, raw[3] >> 6 == 3)


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ (0x8005 if c & 0x8000 else 0)) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@lru_cache(maxsize=65536)
def crc16(covered: bytes) -> int:
    c = 0xFFFF
    for b in covered:
        c = (c << 8 & 0xFF00) ^ _CRC[c >> 8 ^ b]
    return c


@dataclass
class Audio:
    """What a stream holds."""

    frames: list[tuple[int, Header]] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    table: str = ""
    table_frames: int = 0
    table_bytes: int = 0
    toc: list[int] = field(default_factory=list)  # where the table says that its points are, in bytes from `origin`
    origin: int = 0
    per_point: int = 0  # frames between two points; 0 for hundredths of all frames
    delay: int = 0
    padding: int = 0
    payload_crc: bool | None = None
    checked: int = 0
    checked_right: int = 0
    skipped: int = 0
    samples: int = 0
    rate: int = 0

    @property
    def sound(self) -> int:
        """Samples without what the encoder put before and behind."""
        return max(0, self.samples - self.delay - self.padding)

    @property
    def seek_error(self) -> int:
        """The greatest distance in bytes of a seek entry from the frame that it stands for."""
        if not self.toc or not self.frames:
            return 0
        n, last = len(self.toc), len(self.frames) - 1
        places = [self.frames[min(last, i * self.per_point if self.per_point else len(self.frames) * i // n)][0] - self.origin for i in range(n)]
        return max(abs(a - b) for a, b in zip(self.toc, places, strict=True))


def _syncsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """Bytes of the tag at the start, and its text frames."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0, {}
    version, flags = data[3], data[5]
    end = 10 + _syncsafe(data[6:10])
    after = min(len(data), end + 10 * (version == 4 and bool(flags & 0x10)))
    raw = data[10:end]
    if flags & 0x80 and version < 4:  # the whole tag; version 4 marks its frames
        raw = raw.replace(b"\xff\x00", b"\xff")
    number = _syncsafe if version == 4 else int.from_bytes
    at, tags = 0, {}
    if flags & 0x40 and len(raw) >= 4:
        at = _syncsafe(raw[:4]) if version == 4 else 4 + int.from_bytes(raw[:4])
    while at + 10 <= len(raw) and raw[at : at + 4].isalnum():
        size, marks = number(raw[at + 4 : at + 8]), raw[at + 9]
        body = raw[at + 10 : at + 10 + size]
        if version == 4 and marks & 0x01:
            body = body[4:]
        if version == 4 and marks & 0x02:
            body = body.replace(b"\xff\x00", b"\xff")
        if raw[at : at + 1] == b"T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
            name, _, value = text.partition("\0") if raw[at : at + 4] == b"TXXX" else (raw[at : at + 4].decode(), "", text)
            tags[name] = value.rstrip("\0")
        at += 10 + size
    return after, tags


def _table(data: bytes, at: int, h: Header, out: Audio) -> bool:
    """Reads a Xing, Info or VBRI table in a Layer III frame."""
    x = at + 4 + h.side
    if data[x : x + 4] in (b"Xing", b"Info"):
        flags, x, out.table, out.origin = int.from_bytes(data[x + 4 : x + 8]), x + 8, data[x : x + 4].decode(), at
        if flags & 1:
            out.table_frames, x = int.from_bytes(data[x : x + 4]), x + 4
        if flags & 2:
            out.table_bytes, x = int.from_bytes(data[x : x + 4]), x + 4
        if flags & 4:
            out.toc = [b * out.table_bytes // 256 for b in data[x : x + 100]]
            x += 100
        x += 4 * bool(flags & 8)
        if data[x : x + 4].isalnum() and x + 24 <= at + h.size:  # an encoder's name: 21 bytes on are its delay and padding
            out.delay, out.padding = data[x + 21] << 4 | data[x + 22] >> 4, (data[x + 22] & 15) << 8 | data[x + 23]
        return True
    x = at + 36
    if data[x : x + 4] == b"VBRI":
        out.table, out.table_bytes, out.table_frames = "VBRI", int.from_bytes(data[x + 10 : x + 14]), int.from_bytes(data[x + 14 : x + 18])
        entries, scale, width, out.per_point = (int.from_bytes(data[x + k : x + k + 2]) for k in (18, 20, 22, 24))
        steps = [scale * int.from_bytes(data[x + 26 + width * i : x + 26 + width * (i + 1)]) for i in range(entries)]
        out.origin, out.toc = at + h.size, [0, *itertools.accumulate(steps)][:entries]
        return True
    return False


def _free_end(data: bytes, at: int, h: Header, end: int) -> int:
    """Where a frame of free format ends: at the next header of its stream, or at the end."""
    found = data.find(b"\xff", at + 4, end)
    while found >= 0:
        ahead = header(data[found : found + 4])
        if ahead and ahead.form == h.form:
            return found
        found = data.find(b"\xff", found + 1, end)
    return end


def parse(data: bytes) -> Audio:
    out = Audio()
    at, out.tags = _id3v2(data)
    end = len(data)
    tag = end - 128 if end - at >= 128 and data[end - 128 : end - 125] == b"TAG" else end
    form = None  # what all headers of the stream being read agree in
    while at < end:
        if at == tag:
            out.tags.setdefault("TIT2", data[tag + 3 : tag + 33].split(b"\0")[0].decode("latin-1").strip())
            break
        h = header(data[at : at + 4])
        if h and not h.size:  # free format is believed only where its stream goes on
            stop = _free_end(data, at, h, tag if at < tag else end)
            h = replace(h, size=stop - at) if h.form == form or stop not in (tag, end) else None
        after = at + h.size if h else at
        ahead = header(data[after : after + 4]) if h else None
        follows = bool(h and ahead and ahead.form == h.form)
        # A frame may hold the tag's mark in its data: then it ends where the stream does or another follows.
        fits = after <= tag or at > tag or after == end or follows
        if h and after <= end and fits and (h.form == form or after in (tag, end) or follows):
            form = h.form
            if h.layer != 3 or out.frames or out.table or not _table(data, at, h, out):
                out.frames.append((at, h))
                out.samples += h.samples
                out.rate = out.rate or h.rate
                if h.checked and h.layer == 3:
                    out.checked += 1
                    out.checked_right += crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) == int.from_bytes(data[at + 4 : at + 6])
            at += h.size
            continue
        stop = tag if at < tag else end
        found = data.find(b"\xff", at + 1, stop)
        out.skipped += (found if found >= 0 else stop) - at
        at = found if found >= 0 else stop
    return out


def _head(bit_no: int, checked: bool) -> bytes:
    return bytes((0xFF, 0xFA | (not checked), bit_no << 4 | 2 << 2, 0xC0))


_SIZES = [0] + [header(_head(i, True)).size for i in range(1, 15)]
_ROOM = [s - 6 - SIDE_MONO for s in _SIZES]
_SIDE = bytes(SIDE_MONO)


def store(payload: bytes) -> bytes:
    """A stream that holds the payload."""
    full, rest = divmod(len(payload), _ROOM[14])
    kinds = [14] * full + ([next(i for i in range(1, 15) if _ROOM[i] >= rest)] if rest else [])
    frames, at = [], 0
    for k in kinds:
        head, part = _head(k, True), payload[at : at + _ROOM[k]]
        frames.append(head + crc16(head[2:] + _SIDE).to_bytes(2) + _SIDE + part + bytes(_ROOM[k] - len(part)))
        at += _ROOM[k]
    first_size = _SIZES[next(i for i in range(1, 15) if _SIZES[i] >= 21 + 116)]
    total = first_size + sum(map(len, frames))
    ends = first_size + np.cumsum([0] + [len(f) for f in frames])
    toc = bytes(min(255, int(256 * ends[len(frames) * i // 100] // total)) for i in range(100))
    table = _head(_SIZES.index(first_size), False) + _SIDE + b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    tag = b""
    for name, value in ((b"payload_bytes", len(payload)), (b"payload_crc32", zlib.crc32(payload))):
        text = b"\3" + name + b"\0" + str(value).encode()
        tag += b"TXXX" + bytes((0, 0, 0, len(text), 0, 0)) + text
    return b"ID3\4\0\0" + bytes((0, 0, len(tag) >> 7, len(tag) & 127)) + tag + table.ljust(first_size, b"\0") + b"".join(frames)


def payload_of(data: bytes, audio: Audio) -> bytes:
    """What `store` put in; for other streams the frames' data."""
    body = b"".join(data[at + (6 if h.checked else 4) + (h.side if h.layer == 3 else 0) : at + h.size] for at, h in audio.frames)
    length, crc = (audio.tags.get(k, "") for k in ("payload_bytes", "payload_crc32"))
    body = body[: int(length)] if length.isdigit() else body
    if crc.isdigit():
        audio.payload_crc = zlib.crc32(body) == int(crc)
    return body


def feature(a: Audio) -> str:
    rates = sorted({h.bitrate for _, h in a.frames})
    seek = [str(at) for at, _ in a.frames[::SEEK_EVERY]]
    first = a.frames[0][1] if a.frames else None
    parts = {
        "version": first.version if first else "", "layer": first.layer if first else "", "rate": a.rate, "frames": len(a.frames), "samples": a.samples,
        "kbits": "+".join(map(str, rates)), "table": f"{a.table}:{a.table_frames}:{a.table_bytes}", "crc": f"{a.checked_right}/{a.checked}", "payload_crc": "" if a.payload_crc is None else "right" if a.payload_crc else "wrong", "seek_error": a.seek_error, "skipped": a.skipped, "seek": "+".join(seek),
    }
    return ";".join(f"{k}={v}" for k, v in parts.items())


def _stored(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        out = [None if x is None else store(x.as_buffer().to_pybytes()) for x in (p if p.is_valid else None for p in batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["row", "media"])


def _read(batches: Iterator[pa.RecordBatch]):
    names = ["row", "media", "payload", "frames", "samples", "rate", "duration_s", "crc_right", "crc_all", "skipped", "offsets", "feature"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]
    for batch in batches:
        rows = []
        for m in batch.column(1):
            if not m.is_valid:
                rows.append((None,) * len(kinds))
                continue
            data = m.as_py()
            a = parse(data)
            rows.append((payload_of(data, a), len(a.frames), a.samples, a.rate, a.sound / a.rate if a.rate else 0.0, a.checked_right, a.checked, a.skipped, [at for at, _ in a.frames], feature(a)))
        columns = [pa.array([r[i] for r in rows], kinds[i]) for i in range(len(kinds))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)


def _packed(rows: DataFrame, col: str, kind: str, others: list[str]) -> DataFrame:
    """(row, value): the other columns as a struct of plain names, whatever theirs are."""
    plain = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    names = [f"c{rows.columns.index(c)}" for c in others]
    return plain.selectExpr(f"struct({', '.join(names) or '0 AS none'}) AS row", f"cast(c{rows.columns.index(col)} AS {kind}) AS value")


def store_column(rows: DataFrame, payload_col: str, out: str = "media") -> DataFrame:
    """rows with one more column, the stream that holds the payload column's bytes; a column of its name is replaced."""
    payload = rows.select(rows[f"`{payload_col}`"].alias("payload"), *[rows[f"`{c}`"] for c in rows.columns if c != out])
    others = payload.columns[1:]
    plain = payload.toDF("payload", *[f"c{i}" for i in range(len(others))])
    packed = _packed(plain, "payload", "binary", plain.columns[1:])
    got = packed.mapInArrow(_stored, f"row {packed.schema['row'].dataType.simpleString()}, media binary")
    return got.selectExpr(*[f"row.c{i + 1} AS `{c}`" for i, c in enumerate(others)], f"media AS `{out}`")


def read_column(rows: DataFrame, media_col: str = "media", out: str = "audio") -> DataFrame:
    """rows with one more column, a struct: payload, frames, samples, rate, duration_s, checksums, skipped, offsets, feature; a column of its name is replaced."""
    rows = without(rows, out)
    others = [c for c in rows.columns if c != media_col]
    packed = _packed(rows, media_col, "binary", others)
    kind = "payload binary, frames long, samples long, rate int, duration_s double, crc_right long, crc_all long, skipped long, offsets array<long>, feature string"
    got = packed.mapInArrow(_read, f"row {packed.schema['row'].dataType.simpleString()}, media binary, {kind}")
    picks = [f"row.c{rows.columns.index(c)} AS `{c}`" for c in others]
    return got.selectExpr(*picks, f"media AS `{media_col}`", f"struct({', '.join(x.split()[0] for x in kind.split(', '))}) AS `{out}`")
