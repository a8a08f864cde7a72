"""Media columns: MPEG audio streams, written and parsed frame by frame.

The writer puts a payload into the ancillary data of silent MPEG-1 Layer III frames (mono, 32 kHz, CRC-protected)
after an ID3v2 tag and a frame with a variable-bitrate table. The parser reads any MPEG audio stream (versions 1, 2
and 2.5, Layers I to III, frames of a named bitrate): it reads ID3 tags (1, and 2.2 to 2.4 with extended headers,
footers and unsynchronisation), finds frame headers again after damage, checks each protected frame's CRC, reads Xing,
Info and VBRI tables with their seek entries, and keeps exact durations (samples over rate) and the byte offset of
every frame. A frame with a wrong CRC is no place to seek to; its samples count where the next frame follows it.

Defined results: null and empty texts are a payload of 64 zero bytes; equal texts give equal bytes; very long texts
give streams as long, held in memory one at a time; the columns of the input other than the two named are dropped, so
names cannot clash; an empty table gives an empty table. A stream without a frame parses to no frames and duration 0.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema

# Fixed values of the MPEG audio header: kbit/s by (version 1 or not, layer), Hz by version, samples of a frame.
KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}

SIDE, HEAD = 17, 4  # mono MPEG-1 Layer III


@lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
        out.append(crc)
    return out


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    table, crc = _crc_table(), 0xFFFF
    for byte in data:
        crc = (crc << 8 & 0xFF00) ^ table[crc >> 8 ^ byte]
    return crc


@dataclass(frozen=True)
class Header:
    first: bool
    layer: int
    protected: bool
    kbits: int
    hz: int
    mono: bool
    size: int
    samples: int
    bound: int = 32  # the subband from which on both channels of joint stereo share their allocation

    @property
    def side(self) -> int:
        """Bytes of side information in Layer III; 0 in the others."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.first else (9 if self.mono else 17)


@lru_cache(maxsize=256)
def allocation_bits(h: Header) -> tuple[int, ...]:
    """Layer II: bits of the allocation of each subband."""
    # fixed values: (subbands with so many bits, ...) of the standard's tables by rate and bits a channel
    if not h.first:
        runs = ((4, 4), (7, 3), (19, 2))
    else:
        each = h.kbits if h.mono else h.kbits // 2
        if each <= 48:
            runs = ((2, 4), (10, 3)) if h.hz == 32000 else ((2, 4), (6, 3))
        elif h.hz == 48000 or each <= 80:
            runs = ((11, 4), (12, 3), (4, 2))
        else:
            runs = ((11, 4), (12, 3), (7, 2))
    return tuple(bits for n, bits in runs for _ in range(n))


def covered_bits(body: bytes, h: Header) -> int:
    """Bits after the CRC that it covers: side information in Layer III, allocation in Layer I, allocation and scale selection in Layer II."""
    channels = 1 if h.mono else 2
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        return 4 * (32 if h.mono else 2 * h.bound + 32 - h.bound)
    widths = allocation_bits(h)
    bits = int.from_bytes(body[:32], "big")
    at, used = 0, 0
    for sub, width in enumerate(widths):
        own = channels if sub < h.bound else 1
        for _ in range(own):
            at += width
            if bits >> (256 - at) & ((1 << width) - 1):
                used += channels // own  # a shared allocation selects scales for both channels
    return at + 2 * used


def frame_crc(head: bytes, body: bytes, h: Header) -> int:
    """CRC of the header's last two bytes and of the bits that are covered after the CRC."""
    n = covered_bits(body, h)
    crc = crc16(head[2:4] + body[: n // 8])
    rest = body[n // 8] if n % 8 and n // 8 < len(body) else 0
    for i in range(n % 8):
        crc = (crc << 1 ^ (0x8005 if (crc >> 15 ^ rest >> (7 - i)) & 1 else 0)) & 0xFFFF
    return crc


@lru_cache(maxsize=4096)
def header(four: bytes) -> Header | None:
    """The header in four bytes; None unless it names a frame of known size."""
    word = int.from_bytes(four, "big")
    version, layer, kbits, hz = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    if len(four) < 4 or word >> 21 != 0x7FF or version == 1 or layer == 4 or kbits in (0, 15) or hz == 3:
        return None
    first = version == 3
    rate, hertz, pad = KBITS[first, layer][kbits], HZ[version][hz], word >> 9 & 1
    samples = SAMPLES[first, layer]
    size = (12 * rate * 1000 // hertz + pad) * 4 if layer == 1 else samples // 8 * rate * 1000 // hertz + pad
    bound = 4 * ((word >> 4 & 3) + 1) if word >> 6 & 3 == 1 else 32
    return Header(first, layer, not word >> 16 & 1, rate, hertz, word >> 6 & 3 == 3, size, samples, bound)


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    table: dict = field(default_factory=dict)
    offsets: array = field(default_factory=lambda: array("q"))
    sizes: array = field(default_factory=lambda: array("i"))
    samples: int = 0
    hz: int = 0
    resyncs: int = 0
    bad_crc: int = 0
    checked: int = 0
    vbr: bool = False

    @property
    def duration(self) -> Fraction:
        return Fraction(self.samples, self.hz) if self.hz else Fraction(0)


def _synchsafe(data: bytes) -> int:
    return data[0] << 21 | data[1] << 14 | data[2] << 7 | data[3]


def _to_synchsafe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


#: Names of version 2.2 by their later names.
SHORT_NAMES = {"TT2": "TIT2", "TP1": "TPE1", "TAL": "TALB", "TYE": "TYER", "TRK": "TRCK", "TCO": "TCON", "TXX": "TXXX"}


def _frame_body(body: bytes, major: int, flags: int) -> bytes | None:
    """A tag frame's content without what its flags add; None where it is encrypted or damaged."""
    if major < 4:
        packed, secret, grouped, length, split = flags & 0x80, flags & 0x40, flags & 0x20, flags & 0x80, 0
    else:
        packed, secret, grouped, length, split = flags & 0x08, flags & 0x04, flags & 0x40, flags & 0x01, flags & 0x02
    if secret:
        return None
    body = body[4 if length else 0 :] if major < 4 else body[bool(grouped) :]
    body = body[bool(grouped) :] if major < 4 else body[4 if length else 0 :]
    if split:
        body = body.replace(b"\xff\0", b"\xff")
    try:
        return zlib.decompress(body) if packed else body
    except zlib.error:
        return None


def _id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """Length of the tag at the start and its text frames."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, {}
    major, marks, size = data[3], data[5], _synchsafe(data[6:10])
    whole = 10 + size + (10 if major >= 4 and marks & 0x10 else 0)
    tag, at, tags = data[10 : 10 + size], 0, {}
    if marks & 0x80 and major < 4:
        tag = tag.replace(b"\xff\0", b"\xff")
    if marks & 0x40 and major >= 3 and len(tag) >= 4:
        at = _synchsafe(tag[:4]) if major >= 4 else 4 + int.from_bytes(tag[:4], "big")
    wide = 3 if major <= 2 else 4
    head = 6 if major <= 2 else 10
    while at + head <= len(tag) and tag[at]:
        raw = tag[at + wide : at + 2 * wide]
        n = _synchsafe(raw) if major >= 4 else int.from_bytes(raw, "big")
        name, body = tag[at : at + wide].decode("latin-1"), tag[at + head : at + head + n]
        if name[0] == "T" and (body := _frame_body(body, major, tag[at + 9] | (0x02 if major >= 4 and marks & 0x80 else 0)) if major >= 3 else body):
            name = SHORT_NAMES.get(name, name)
            codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8")
            text = body[1:].decode(codec, "replace").rstrip("\0")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            tags[key] = value
        at += head + n
    return whole, tags


def _id3v1(tag: bytes) -> dict[str, str]:
    """Fields of the 128 bytes at the end, by their names in later versions."""
    text = lambda a, b: tag[a:b].partition(b"\0")[0].decode("latin-1").rstrip()
    found = {"TIT2": text(3, 33), "TPE1": text(33, 63), "TALB": text(63, 93), "TYER": text(93, 97), "COMM": text(97, 127), "TCON": f"({tag[127]})" if tag[127] != 255 else ""}
    if not tag[125] and tag[126]:
        found["TRCK"] = str(tag[126])
    return {k: v for k, v in found.items() if v}


def _vbr_table(frame: bytes, h: Header) -> dict:
    for at in (HEAD + h.side, HEAD + 2 + h.side):
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags, p = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
            found: dict = {"kind": frame[at : at + 4].decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    found[name] = int.from_bytes(frame[p : p + 4], "big")
                    p += 4
            if flags & 4:
                found["toc"] = list(frame[p : p + 100])
                p += 100
            if flags & 8:
                found["quality"] = int.from_bytes(frame[p : p + 4], "big")
            return found
    if frame[36:40] == b"VBRI":
        number = lambda a, b: int.from_bytes(frame[a:b], "big")
        entries, scale, width = number(54, 56), number(56, 58), number(58, 60)
        steps = [number(62 + i * width, 62 + (i + 1) * width) * scale for i in range(entries) if 62 + (i + 1) * width <= len(frame)]
        return {"kind": "VBRI", "bytes": number(46, 50), "frames": number(50, 54), "frames_per_entry": number(60, 62), "toc": steps}
    return {}


def parse(data: bytes) -> Stream:
    out = Stream()
    at, out.tags = _id3v2(data)
    end = len(data)
    if end >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        out.tags = _id3v1(data[end:]) | out.tags
    first, rate, lost = True, None, False
    while at + HEAD <= end:
        h = header(data[at : at + HEAD])
        good = h is not None and at + h.size <= end and (not out.hz or h.hz == out.hz)
        if good and (lost or first):  # after damage a header counts only if another follows it, or the end does
            then = at + h.size
            good = then == end or header(data[then : then + HEAD]) is not None
        if not good:
            out.resyncs += not lost
            lost = True
            at = data.find(b"\xff", at + 1, end)
            if at < 0:
                break
            continue
        lost = False
        if h.protected:
            out.checked += 1
            if frame_crc(data[at : at + 4], data[at + 6 : at + h.size], h) != int.from_bytes(data[at + 4 : at + 6], "big"):
                out.bad_crc += 1
                then = at + h.size
                if not first and (then == end or header(data[then : then + HEAD]) is not None):
                    out.samples += h.samples
                    at = then
                else:
                    out.resyncs += 1
                    lost = True
                    at += 1
                continue
        if first:
            first, out.hz = False, h.hz
            out.table = _vbr_table(data[at : at + h.size], h)
            if out.table:
                at += h.size
                continue
        out.vbr |= rate is not None and rate != h.kbits
        rate = h.kbits
        out.offsets.append(at)
        out.sizes.append(h.size)
        out.samples += h.samples
        at += h.size
    return out


def _head(kbits_index: int, protected: bool) -> bytes:
    return bytes((0xFF, 0xFA | (not protected), kbits_index << 4 | 2 << 2, 0xC0))


@lru_cache(maxsize=64)
def _frame_start(kbits_index: int) -> tuple[bytes, int]:
    """Header, CRC and silent side information of a frame, and the bytes that it has room for."""
    head, side = _head(kbits_index, True), bytes(SIDE)
    start = head + struct.pack(">H", crc16(head[2:] + side)) + side
    return start, header(head).size - len(start)


def _text_tag(name: str, value: str) -> bytes:
    body = b"\x03" + name.encode() + b"\0" + value.encode()
    return b"TXXX" + _to_synchsafe(len(body)) + b"\0\0" + body


def write(payload: bytes) -> bytes:
    """A stream that holds the payload: frames of the highest rate, the last of the lowest rate with room enough."""
    tags = _text_tag("payload_bytes", str(len(payload))) + _text_tag("payload_crc32", f"{zlib.crc32(payload):08x}")
    tag = b"ID3\x04\x00\x00" + _to_synchsafe(len(tags)) + tags
    frames, sizes, at = [], [], 0
    start, room = _frame_start(14)
    while len(payload) - at > room:
        frames += (start, payload[at : at + room])
        sizes.append(len(start) + room)
        at += room
    rest = payload[at:]
    index = next(i for i in range(1, 15) if _frame_start(i)[1] >= len(rest))
    start, room = _frame_start(index)
    frames += (start, rest, bytes(room - len(rest)))
    sizes.append(len(start) + room)
    head = _head(1, False)
    total = sum(sizes) + header(head).size
    ends, so_far = [], header(head).size
    for s in sizes:
        ends.append(so_far)
        so_far += s
    toc = bytes(min(255, 256 * ends[i * len(ends) // 100] // total) for i in range(100))
    table = (head + bytes(SIDE) + b"Xing" + struct.pack(">III", 7, len(sizes), total) + toc).ljust(header(head).size, b"\0")
    return b"".join((tag, table, *frames))


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The payload that write() put into the frames; ValueError where it is not whole."""
    skip = HEAD + 2 + SIDE
    body = b"".join([data[o + skip : o + s] for o, s in zip(stream.offsets, stream.sizes)])[: int(stream.tags["payload_bytes"])]
    if len(body) != int(stream.tags["payload_bytes"]) or zlib.crc32(body) != int(stream.tags["payload_crc32"], 16):
        raise ValueError("the stream does not hold its payload whole")
    return body


def feature(s: Stream) -> str:
    seek = hashlib.sha256(s.offsets.tobytes()).hexdigest()[:16]
    d = s.duration
    return f"frames={len(s.offsets)};samples={s.samples};hz={s.hz};seconds={d.numerator}/{d.denominator};vbr={int(s.vbr)};crc_ok={s.checked - s.bad_crc};resyncs={s.resyncs};table={s.table.get('kind', '')}:{s.table.get('frames', 0)};seek={seek}"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Stores each text as a stream, reads the stream back and returns what it found; with_media adds the bytes and frame offsets."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary, offsets array<long>" * with_media
    fields = arrow_schema(schema)

    def one(raw: bytes) -> list:
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        media = write(payload)
        stream = parse(media)
        back = payload_of(media, stream)
        return [len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(stream), *([media, list(stream.offsets)] if with_media else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one((text.as_py() or "").encode()) for text in batch.column(1)]
            columns = [batch.column(0), *(pa.array(c) for c in zip(*rows))] if rows else [pa.array([], f.type) for f in fields]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, fields)], schema=fields)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
