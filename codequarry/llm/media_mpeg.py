"""MPEG audio columns: store bytes in Layer III frames, and inspect any MPEG audio.

``encode`` stores a text's UTF-8 bytes, padded with 255 to a positive multiple of
576, losslessly: one MPEG-2 Layer III frame of 576 samples carries 576 bytes as
8-bit units in its ancillary data (side information of zeros, so a player hears
silence), is protected by the format's CRC-16, and stands behind an ID3v2 tag
with the unpadded length and a Xing table of frame count, byte count and 100
seek points.

``inspect`` works on any MPEG-1/2/2.5 Layer I-III bytes.  It parses ID3v2.2 to
2.4 tags (unsynchronised ones too), an ID3v1 tag where the frames end, and Xing,
Info and VBRI tables with an encoder's delay and padding, finds frame headers
again after foreign bytes (a header counts only if another one, or the end,
stands where its length says), verifies the CRCs of all three layers, and gives
the exact duration (samples less delay and padding, and rate) and the byte offset
of every frame for seeking.

Defined results: null text is empty and becomes one frame of 255s; null or
foreign media have no frames and duration 0; repeated rows give equal values; an
empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import map_batches

UNIT = 576
_BITRATES = {
    ("1", 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    ("1", 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    ("1", 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    ("2", 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    ("2", 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    ("2", 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_VERSION = {3: "1", 2: "2", 0: "2.5"}

#: MPEG-2 Layer III, 144 kbit/s, 16 kHz, mono: frames of 648 bytes and 576 samples.
_PROTECTED, _PLAIN = bytes((0xFF, 0xF2, 0xD8, 0xC0)), bytes((0xFF, 0xF3, 0xD8, 0xC0))
_FRAME, _SIDE, _DATA = 648, 9, 4 + 2 + 9


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    bitrate: int
    rate: int
    mono: bool
    samples: int
    length: int
    bound: int  # subbands below it have a channel each

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mono else 32) if self.version == "1" else (9 if self.mono else 17)


@lru_cache(maxsize=4096)
def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None; free-format rates are not taken."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    rate_index, rates = four[2] >> 2 & 3, four[2] >> 4
    if version == 1 or layer == 4 or rate_index == 3 or rates in (0, 15) or four[3] & 3 == 2:
        return None
    bitrate, rate, padding = _BITRATES["1" if version == 3 else "2", layer][rates - 1] * 1000, _RATES[version][rate_index], four[2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    length = (12 * bitrate // rate + padding) * 4 if layer == 1 else samples // 8 * bitrate // rate + padding
    bound = 4 * (four[3] >> 4 & 3) + 4 if four[3] >> 6 == 1 else 32
    return Header(_VERSION[version], layer, not four[1] & 1, bitrate, rate, four[3] >> 6 == 3, samples, length, bound)


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
        table.append(value)
    return table


_TABLE = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    value = 0xFFFF
    for byte in data:
        value = (value << 8 & 0xFF00) ^ _TABLE[value >> 8 ^ byte]
    return value


def _crc_of_bits(data: bytes, bits: int) -> int:
    value = crc16(data[: bits // 8])
    for k in range(bits // 8 * 8, bits):
        bit = data[k // 8] >> (7 - k % 8) & 1
        value = (value << 1 ^ 0x8005 if (value >> 15) ^ bit else value << 1) & 0xFFFF
    return value


def _allocation(head: Header) -> list[int]:
    """Layer II: bits that each subband's allocation takes; fixed values of the standard's tables."""
    if head.version != "1":
        return [4] * 4 + [3] * 7 + [2] * 19
    each = head.bitrate // (1 if head.mono else 2) // 1000
    if each <= 48:
        return [4] * 2 + [3] * (10 if head.rate == 32000 else 6)
    return [4] * 11 + [3] * 12 + [2] * (4 if each <= 80 or head.rate == 48000 else 7)


def checksum_right(frame: bytes, head: Header) -> bool:
    """If a protected frame's CRC is that of its header and of what its layer protects."""
    body, channels = frame[6:], 1 if head.mono else 2
    if head.layer == 3:
        bits = 8 * head.side
    elif head.layer == 1:
        bits = 4 * (32 if head.mono else head.bound * 2 + 32 - head.bound)
    else:
        bits = chosen = 0
        for subband, width in enumerate(_allocation(head)):
            for _ in range(channels if subband < head.bound else 1):
                used = int.from_bytes(body[bits // 8 : bits // 8 + 2].ljust(2, b"\0"), "big") << bits % 8 & 0xFFFF
                # above the bound one allocation stands for both channels, and each has its selection
                chosen += (used >> (16 - width) > 0) * (1 if subband < head.bound else channels)
                bits += width
        bits += 2 * chosen
    return len(body) * 8 >= bits and _crc_of_bits(frame[2:4] + body, 16 + bits) == frame[4] << 8 | frame[5]


def _syncsafe(number: int) -> bytes:
    return bytes(number >> shift & 0x7F for shift in (21, 14, 7, 0))


def _id3(entries: dict[str, str]) -> bytes:
    body = b""
    for name, value in entries.items():
        content = b"\x03" + name.encode() + b"\x00" + value.encode()
        body += b"TXXX" + _syncsafe(len(content)) + b"\x00\x00" + content
    return b"ID3\x04\x00\x00" + _syncsafe(len(body)) + body


def encode_bytes(data: bytes) -> bytes:
    """``data`` as a playable MPEG audio stream that holds every byte."""
    payload = data + b"\xff" * (-len(data) % UNIT if data else UNIT)
    count = len(payload) // UNIT
    frames = np.zeros((count + 1, _FRAME), np.uint8)
    side = bytes(_SIDE)
    frames[1:, :_DATA] = np.frombuffer(_PROTECTED + crc16(_PROTECTED[2:] + side).to_bytes(2, "big") + side, np.uint8)
    frames[1:, _DATA : _DATA + UNIT] = np.frombuffer(payload, np.uint8).reshape(count, UNIT)
    size = frames.size
    points = bytes(min(255, _FRAME * (1 + k * count // 100) * 256 // size) for k in range(100))
    xing = _PLAIN + side + b"Xing" + struct.pack(">III", 7, count, size) + points
    frames[0, : len(xing)] = np.frombuffer(xing, np.uint8)
    return _id3({"n_bytes": str(len(data))}) + frames.tobytes()


@dataclass
class Inspection:
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, int] = field(default_factory=dict)
    seek_table: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    crc_good: int = 0
    crc_bad: int = 0
    skipped: int = 0
    resyncs: int = 0

    @property
    def duration_us(self) -> int:
        heard = max(0, self.samples - self.table.get("delay", 0) - self.table.get("padding", 0))
        return heard * 1_000_000 // self.rate if self.rate else 0


def _read_id3(data: bytes, tags: dict[str, str]) -> int:
    """Parse the ID3v2 tag at the start; its length, or 0."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    safe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    major, flags, size = data[3], data[5], safe(data[6:10])
    body, at = data[10 : 10 + size], 0
    if flags & 0x80:
        body = body.replace(b"\xff\x00", b"\xff")
    if flags & 0x40 and major > 2:
        at = safe(body[:4].ljust(4, b"\0")) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    # lengths of a name, of a size, and of all that stands before the content
    letters, width, start = (3, 3, 6) if major == 2 else (4, 4, 10)
    while at + start <= len(body) and body[at]:
        name, given = body[at : at + letters].decode("latin-1"), body[at + letters : at + letters + width]
        length = safe(given) if major == 4 else int.from_bytes(given, "big")
        content = body[at + start : at + start + length]
        if name.startswith("T") and content:
            kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(content[0], "latin-1")
            parts = content[1:].decode(kind, "replace").split("\x00")
            if name in ("TXXX", "TXX"):
                tags[f"TXXX:{parts[0]}"] = parts[1] if len(parts) > 1 else ""
            else:
                tags[name] = parts[0]
        at += start + length
    return min(len(data), 10 + size + (10 if flags & 0x10 else 0))


def _read_table(frame: bytes, head: Header, found: Inspection) -> bool:
    """Parse a Xing, Info or VBRI table; True if the frame holds one."""
    at = 4 + head.side
    if frame[at : at + 4] not in (b"Xing", b"Info"):
        at += 2 * head.protected
    if head.layer == 3 and frame[at : at + 4] in (b"Xing", b"Info") and at + 8 <= len(frame):
        flags, at = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                found.table[name], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        if flags & 4:
            found.seek_table, at = list(frame[at : at + 100]), at + 100
        if flags & 8:
            found.table["quality"], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        if len(frame) >= at + 24 and frame[at : at + 4].isalnum():  # an encoder's name; delay and padding have 12 bits each
            three = int.from_bytes(frame[at + 21 : at + 24], "big")
            found.table |= {"delay": three >> 12, "padding": three & 0xFFF}
        return True
    if head.layer == 3 and frame[36:40] == b"VBRI" and len(frame) >= 62:
        _, _, quality, size, frames, entries, scale, width, per = struct.unpack(">HHHIIHHHH", frame[40:62])
        found.table |= {"quality": quality, "bytes": size, "frames": frames, "frames_per_entry": per}
        cells = [frame[62 + k * width : 62 + (k + 1) * width] for k in range(entries)] if width else []
        found.seek_table = [int.from_bytes(c, "big") * scale for c in cells if len(c) == width]
        return True
    return False


def inspect_bytes(data: bytes | None) -> Inspection:
    found = Inspection()
    if not data:
        return found
    at, end = _read_id3(data, found.tags), len(data)
    # bytes that read TAG are a tag only where the frames before them end
    tail = end - 128 if data[-128:-125] == b"TAG" and end >= 128 else -1
    kind, first, synced = None, True, False
    while at + 4 <= end:
        head = header(data[at : at + 4])
        good = head is not None and at + head.length <= end and (kind is None or (head.version, head.layer, head.rate) == kind)
        if good and not synced:
            # after foreign bytes a header needs a second one, or the end, behind its frame
            after = at + head.length
            follow = header(data[after : after + 4])
            good = after in (end, tail) or follow is not None and (follow.version, follow.layer, follow.rate) == (head.version, head.layer, head.rate)
        if not good and at == tail:
            end = at
            for name, low, high in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
                found.tags.setdefault(f"v1:{name}", data[end + low : end + high].split(b"\x00")[0].decode("latin-1").strip())
            break
        if not good:
            found.resyncs += synced
            synced = False
            later = data.find(b"\xff", at + 1, end)
            later = end if later < 0 else later
            found.skipped += later - at
            at = later
            continue
        synced, kind = True, (head.version, head.layer, head.rate)
        if first and _read_table(data[at : at + head.length], head, found):
            first = False
            at += head.length
            continue
        first = False
        if head.protected:
            right = checksum_right(data[at : at + head.length], head)
            found.crc_good += right
            found.crc_bad += not right
        found.offsets.append(at)
        found.headers.append(head)
        found.samples += head.samples
        found.rate = head.rate
        at += head.length
    found.skipped += end - at
    return found


def payload_of(data: bytes, found: Inspection) -> bytes:
    """The padded bytes that ``encode_bytes`` stored."""
    return b"".join([data[at + _DATA : at + _DATA + UNIT] for at in found.offsets])


def encode(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, media: each text stored as MPEG audio."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                media = [encode_bytes(bytes(x.as_buffer() or b"") if x.is_valid else b"") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    chosen = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_batches(chosen, store, "doc_id long, media binary")


INSPECTED = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "samples long, sample_rate int, duration_us long, frame_offsets array<long>"
)


def inspect(media: DataFrame, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """Features, exact duration and frame offsets of stored media, with the bytes read back."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                rows = [_features(x.as_py()) for x in part.column(1)]
                columns = list(zip(*rows, strict=True)) or [()] * 11
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
                names = [f.split()[0] for f in INSPECTED.split(", ")]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    return map_batches(media.select(F.col(id_column).cast("long").alias("doc_id"), F.col(media_column).alias("media")), read, INSPECTED)


def _features(data: bytes | None) -> tuple:
    data = data or b""
    found = inspect_bytes(data)
    payload = payload_of(data, found)
    head = found.headers[0] if found.headers else None
    rates = sum(h.bitrate for h in found.headers) // max(1, len(found.headers))
    feature = ";".join(
        [
            f"mpeg{head.version}-layer{head.layer}" if head else "none", f"rate={found.rate}", f"channels={1 if head and head.mono else 2 if head else 0}",
            f"frames={len(found.offsets)}", f"samples={found.samples}", f"duration_us={found.duration_us}", f"bitrate={rates}",
            f"crc_good={found.crc_good}", f"crc_bad={found.crc_bad}", f"resyncs={found.resyncs}", f"skipped={found.skipped}",
            f"table_frames={found.table.get('frames', -1)}", f"table_bytes={found.table.get('bytes', -1)}", f"seek_points={len(found.seek_table)}", f"tags={len(found.tags)}",
        ]
    )
    size = found.tags.get("TXXX:n_bytes", "")
    return (
        int(size) if size.isdigit() else len(payload), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature,
        found.samples, found.rate, found.duration_us, found.offsets,
    )
