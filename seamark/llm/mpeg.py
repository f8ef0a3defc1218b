"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, exact durations and seek offsets.

``parse`` walks the headers of a stream, resynchronises after damage, and reads ID3 tags and Xing tables. ``mux`` makes a
stream that carries bytes without loss: Layer III frames that decode as silence, with checksums, whose ancillary part
holds the payload, after an ID3v2 tag with its length and a Xing frame with the counts and the table of contents.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Fixed values of the format (ISO/IEC 11172-3, 13818-3): kbit/s by index, sampling rates by index.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1.0: (44100, 48000, 32000), 2.0: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
TAG_KEY = "PAYLOAD-BYTES"
RATE_INDEX, MONO = 2, 3  # what mux writes: MPEG-1 Layer III, 32 kHz, so that every frame length is exact
SIDE = 17
OUTPUT_BYTES = 16 << 20


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    length: int
    samples: int
    side: int

    @property
    def body(self) -> int:
        """Where the data after header, checksum and side information begins."""
        return 4 + 2 * self.protected + self.side


@lru_cache(maxsize=65536)
def header(raw: bytes) -> Header | None:
    """What four bytes say, or None if they are no frame header (free format is none)."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2.0, 3: 1.0}.get(raw[1] >> 3 & 3)
    layer, index, rate_index = 4 - (raw[1] >> 1 & 3), raw[2] >> 4, raw[2] >> 2 & 3
    if version is None or layer == 4 or index in (0, 15) or rate_index == 3 or raw[3] & 3 == 2:
        return None
    kbps, rate = BITRATES[(1 if version == 1 else 2), layer][index], RATES[version][rate_index]
    padding, mono = raw[2] >> 1 & 1, raw[3] >> 6 == 3
    samples = 384 if layer == 1 else 576 if layer == 3 and version > 1 else 1152
    length = (12000 * kbps // rate + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + padding
    side = 0 if layer < 3 else ((17 if mono else 32) if version == 1 else (9 if mono else 17))
    return Header(version, layer, not raw[1] & 1, kbps, rate, mono, length, samples, side)


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """The format's checksum: polynomial 0x8005, start 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    kbps: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    layer: int = 0
    version: float = 0.0
    skipped: int = 0         # bytes passed over to find a header again
    checked: int = 0
    bad_checksums: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict | None = None  # of a Xing or Info frame: frames, bytes, toc
    ancillary: list[bytes] = field(default_factory=list)

    @property
    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0

    def seek(self, seconds: float) -> int:
        """The offset of the frame that plays at this time."""
        per = self.samples / max(len(self.offsets), 1)
        return self.offsets[min(len(self.offsets) - 1, max(0, int(seconds * self.rate / per)))]


def _syncsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Read text frames of a tag at the start; returns its length, 0 without one."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    end, at = min(len(data), 10 + _syncsafe(data[6:10])), 10
    while at + 10 <= end and data[at:at + 4].isalnum():
        size = _syncsafe(data[at + 4:at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4:at + 8], "big")
        name, body = data[at:at + 4].decode("ascii"), data[at + 10:at + 10 + size]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\0")
            name, _, text = text.partition("\0") if name == "TXXX" else (name, "", text)
            tags[name] = text
        at += 10 + size
    return end


def _xing(frame: bytes, side: int) -> dict | None:
    at = 4 + side
    if frame[at:at + 4] not in (b"Xing", b"Info"):
        return None
    flags, at, out = int.from_bytes(frame[at + 4:at + 8], "big"), at + 8, {}
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit:
            out[name], at = int.from_bytes(frame[at:at + 4], "big"), at + 4
    if flags & 4:
        out["toc"] = list(frame[at:at + 100])
    return out


def parse(data: bytes) -> Stream:
    """Walk a stream. Damage is skipped up to the next header that another header, or the end, follows."""
    s = Stream()
    at = _id3v2(data, s.tags)
    end = len(data) - 128 if data[-128:-125] == b"TAG" and len(data) >= 128 else len(data)
    if end < len(data):
        for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
            s.tags.setdefault(name, data[end + a:end + b].decode("latin-1").rstrip("\0 "))
    sure = False
    while at + 4 <= end:
        h = header(data[at:at + 4])
        if h and at + h.length <= end and (sure or at + h.length == end or header(data[at + h.length:at + h.length + 4])):
            sure = True
        else:
            again = data.find(b"\xff", at + 1, end)
            s.skipped += (end if again < 0 else again) - at
            at, sure = (end if again < 0 else again), False
            continue
        if not s.offsets and s.vbr is None and h.layer == 3 and (table := _xing(data[at:at + h.length], h.side)) is not None:
            s.vbr = table
        else:
            s.offsets.append(at), s.lengths.append(h.length), s.kbps.append(h.kbps)
            s.samples, s.rate, s.layer, s.version = s.samples + h.samples, h.rate, h.layer, h.version
            if h.protected and h.layer == 3:
                s.checked += 1
                told = data[at + 4:at + 6]
                s.bad_checksums += told != crc16(data[at + 2:at + 4] + data[at + 6:at + 6 + h.side]).to_bytes(2, "big")
            s.ancillary.append(data[at + h.body:at + h.length])
        at += h.length
    s.skipped += max(0, end - at)
    return s


def _head(index: int, protected: bool) -> bytes:
    return bytes((0xFF, 0xFA | (not protected), index << 4 | RATE_INDEX << 2, MONO << 6))


@lru_cache(maxsize=16)
def _frame(index: int) -> tuple[bytes, int]:
    """Everything before the payload of a frame, and how many bytes of payload it takes."""
    head = _head(index, True)
    raw = head + crc16(head[2:] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE)
    return raw, header(head).length - len(raw)


def mux(payload: bytes) -> bytes:
    """A variable-bitrate stream that carries ``payload``; equal payloads give equal streams."""
    largest, room = _frame(14)
    frames = [largest + payload[at:at + room] for at in range(0, len(payload) - room + 1, room)]
    if rest := payload[len(frames) * room:]:
        start, fits = next(_frame(k) for k in range(1, 15) if _frame(k)[1] >= len(rest))
        frames.append(start + rest + bytes(fits - len(rest)))
    text = b"\3" + f"{TAG_KEY}\0{len(payload)}".encode()
    body = b"TXXX" + bytes(len(text) >> s & 127 for s in (21, 14, 7, 0)) + b"\0\0" + text
    tag = b"ID3\4\0\0" + bytes(len(body) >> s & 127 for s in (21, 14, 7, 0)) + body
    first = header(_head(1, False)).length
    total, ends, at = first + sum(map(len, frames)), [first], first
    for f in frames:
        at += len(f)
        ends.append(at)
    toc = bytes(min(255, ends[p * len(frames) // 100] * 256 // total) for p in range(100))
    info = _head(1, False) + bytes(SIDE) + b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    return tag + info + bytes(first - len(info)) + b"".join(frames)


def payload_of(stream: Stream) -> bytes:
    """The bytes that ``mux`` stored; raises if frames or checksums are damaged."""
    data, size = b"".join(stream.ancillary), int(stream.tags[TAG_KEY])
    if stream.skipped or stream.bad_checksums or len(stream.offsets) != stream.vbr["frames"] or len(data) < size:
        raise ValueError("the stream is damaged")
    return data[:size]


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def feature(s: Stream) -> str:
    """Layer, frames, exact duration, mean bitrate, checksums and a checksum of the seek offsets."""
    seek = zlib.crc32(b"".join(o.to_bytes(8, "little") for o in s.offsets))
    mean = round(sum(s.lengths) * 8 / s.seconds / 1000) if s.seconds else 0
    return (f"mpeg{s.version:g}-layer{s.layer} frames={len(s.offsets)} seconds={s.samples}/{s.rate} kbps={mean} "
            f"vbr={int(len(set(s.kbps)) > 1)} checked={s.checked} bad={s.bad_checksums} skipped={s.skipped} seek={seek:08x}")


def _sliced(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += size(row)
        if held > OUTPUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def encode_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as UTF-8, zero-padded to a positive multiple of 64, in a stream of its own.

    Null and empty texts are 64 zero bytes; repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def encode(batches):
        for batch in batches:
            yield from _sliced(((k, len(b or b""), mux(padded(b or b""))) for k, b in zip(*(c.to_pylist() for c in batch.columns))),
                               schema, lambda r: len(r[2]))

    return docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("binary")).mapInArrow(
        encode, "doc_id bigint, n_bytes bigint, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """``stored`` (doc_id, n_bytes, media) with what its bytes give: payload digests, exact duration and seek offsets."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
                        ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
                        ("duration_samples", pa.int64()), ("sample_rate", pa.int32()), ("frame_offsets", pa.list_(pa.int64()))])

    def look(key, n_bytes, media):
        s = parse(media)
        payload = payload_of(s)
        return (key, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media),
                hashlib.sha256(media).hexdigest(), feature(s), s.samples, s.rate, s.offsets)

    def read(batches):
        for batch in batches:
            yield from _sliced((look(*row) for row in zip(*(c.to_pylist() for c in batch.columns))), schema, lambda r: 8 * len(r[-1]) + 512)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(
        read, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
              "media_sha256 string, feature string, duration_samples bigint, sample_rate int, frame_offsets array<bigint>")
