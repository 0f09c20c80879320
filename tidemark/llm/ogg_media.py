"""Media columns in Ogg form: pages with checksums, packets from lacing values, logical streams, times from granule positions.

``mux`` stores a payload as 8-bit samples in two interleaved logical streams;
``demux`` reads any such bytes back: it looks for the capture pattern, checks
each page's CRC-32, joins segments into packets (a lacing value of 255 goes on),
keeps streams apart by serial number and takes times from granule positions.
A damaged page is skipped and counted, and reading goes on at the next pattern.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.common import map_texts, prepare

#: Bytes of a packet, samples a second, and packets that one page holds.
PACKET, RATE, PAGE_PACKETS = 4096, 8000, 12
CODEC = b"PCM8raw\0"
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """CRC-32 of polynomial 0x04c11db7, not reflected, from 0: zlib's CRC over bit-reversed bytes, reversed."""
    raw = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


def page(serial: int, seq: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIII", b"OggS", 0, flags, granule, serial, seq, 0)
    raw = head + bytes([len(lacing)]) + lacing + body
    return raw[:22] + struct.pack("<I", page_crc(raw)) + raw[26:]


def lace(packet: bytes) -> bytes:
    """Lacing values of a packet: 255s, then a smaller one that ends it."""
    return b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])


def stream_pages(serial: int, packets: list[bytes], samples: list[int]) -> list[bytes]:
    """Pages of one logical stream; at most 255 segments each, packets go on over pages."""
    lacing = b"".join(map(lace, packets))
    body = b"".join(packets)
    ends, total = [], 0  # granule position at each segment that ends a packet
    for p, n in zip(packets, samples, strict=True):
        total += n
        ends += [-1] * (len(p) // 255) + [total]
    out, at, seq, going, n = [], 0, 0, False, len(lacing)
    first = len(lace(packets[0]))  # the head packet has a page of its own
    place = 0
    while place < n:
        stop = first if not place else min(n, place + 255)
        part = lacing[place:stop]
        size = sum(part)
        done = [x for x in ends[place:stop] if x >= 0]
        flags = going | 2 * (not place) | 4 * (stop == n)
        out.append(page(serial, seq, flags, done[-1] if done else -1, part, body[at : at + size]))
        at, place, seq, going = at + size, stop, seq + 1, part[-1] == 255
    return out


def mux(payload: bytes) -> bytes:
    """Store a payload: even packets in stream 1, odd ones in stream 2, pages in turn."""
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    streams = []
    for serial in (1, 2):
        own = packets[serial - 1 :: 2]
        head = CODEC + struct.pack("<IIQ", RATE, serial, sum(map(len, own)))
        streams.append(stream_pages(serial, [head, *own], [0, *map(len, own)]))
    out = [streams[0][0], streams[1][0]]
    a, b = (s[1:] for s in streams)
    for i in range(max(len(a), len(b))):
        out += a[i : i + 1] + b[i : i + 1]
    return b"".join(out)


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # one a page that ends a packet
    part: bytes = b""
    seq: int = -1
    ended: bool = False
    broken: int = 0  # packets that lost a page


@dataclass
class Media:
    streams: dict[int, Stream]
    pages: int = 0
    damaged: int = 0


def demux(raw: bytes) -> Media:
    """Read Ogg bytes; whatever can be read is, and damage is counted."""
    media, at = Media({}), 0
    while (at := raw.find(b"OggS", at)) >= 0:
        if at + 27 > len(raw):
            media.damaged += 1
            break
        _, version, flags, granule, serial, seq, crc, n = struct.unpack_from("<4sBBqIIIB", raw, at)
        body = at + 27 + n
        lacing = raw[at + 27 : body]
        end = body + sum(lacing)
        whole = raw[at:end]
        if version or len(lacing) < n or end > len(raw) or page_crc(whole[:22] + b"\0\0\0\0" + whole[26:]) != crc:
            media.damaged += 1
            at += 4
            continue
        s = media.streams.setdefault(serial, Stream(serial))
        lost = seq != s.seq + 1 or bool(s.part) != bool(flags & 1)
        skip = bool(flags & 1) and lost  # the rest of a packet whose beginning is missing
        if lost and (s.part or skip):
            s.broken += 1
            s.part = b""
        place, size = body, 0
        for v in lacing:
            size += v
            if v < 255:
                if not skip:
                    s.packets.append(s.part + raw[place : place + size])
                s.part, skip, place, size = b"", False, place + size, 0
        if size and not skip:
            s.part += raw[place : place + size]
        if granule >= 0:
            s.granules.append(granule)
        s.seq, s.ended = seq, bool(flags & 4)
        media.pages += 1
        at = end
    return media


def read_payload(media: Media) -> bytes:
    """The payload that ``mux`` stored; refuses media with damage or missing streams."""
    if media.damaged or sorted(media.streams) != [1, 2]:
        raise ValueError("damaged or foreign media")
    first, second = (media.streams[k].packets[1:] for k in (1, 2))
    out: list[bytes] = [b""] * (len(first) + len(second))
    out[::2], out[1::2] = first, second
    return b"".join(out)


def times(stream: Stream) -> list[int]:
    """Microseconds at the end of each page that ends a packet, from granule positions."""
    rate = struct.unpack_from("<I", stream.packets[0], 8)[0]
    return [g * 1_000_000 // rate for g in stream.granules]


def feature(payload: bytes, media: Media) -> str:
    """Streams, packets, pages, time and level of read media, in one string."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    level = int((counts * np.arange(256)).sum()) * 1000 // len(x)
    length = max(times(s)[-1] for s in media.streams.values())
    packets = sum(len(s.packets) - 1 for s in media.streams.values())
    return f"streams={len(media.streams)};packets={packets};pages={media.pages};us={length};mean_milli={level};peak={int(x.max())};zeros={int(counts[0])}"


def store_as_ogg(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_media: bool = False) -> DataFrame:
    """Store each text as Ogg, read the bytes back, return figures of what was read.

    Texts are UTF-8 (null: empty), padded with zero bytes to a positive multiple
    of 64. Columns: key, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature; with ``keep_media`` also media. The
    stored form depends on the text alone, so equal texts give equal values; each
    row of repeated keys gets its own row.
    """
    prepare(docs.sparkSession)

    def make():
        def f(keys, texts):
            rows = []
            for k, t in zip(keys, texts, strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                stored = mux(raw + b"\0" * (-len(raw) % 64 if raw else 64))
                media = demux(stored)
                back = read_payload(media)
                rows.append((k, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(back, media), *([stored] if keep_media else [])))
            return [list(c) for c in zip(*rows, strict=True)]

        return f

    kind = docs.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_texts(docs, make, key, text, out + ", media binary" * keep_media)
