"""Ogg media columns: writing, verifying and demultiplexing Ogg files.

A file is a binary column. read_streams() parses one: each page's checksum is
verified, packets are put together from the lacing values (also across pages),
pages are sorted out by the serial number of their logical stream, and a packet's
time follows from granule positions.

encode_payload() stores bytes losslessly as 8-bit samples in two logical streams
(even and odd frames of FRAME samples), so that a file holds a real multiplex. A
stream starts with a header packet (b"CorviaPCM", version, frame size, rate,
number of the stream, number of streams), then has a packet a frame. A page's
granule position is the number of its stream's samples that are complete when the
page ends, as the format has it.

Defined results: a null text is empty; empty texts are one frame of padding. A
file with a wrong checksum, a missing page or a cut packet raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import F, T, map_batches, strings

FRAME, RATE, STREAMS = 576, 8000, 2
CONTINUED, FIRST, LAST = 1, 2, 4
HEADER = struct.Struct("<4sBBqIIIB")  # capture, version, flags, granule, serial, sequence, checksum, segments
STREAM_HEADER = struct.Struct("<9sBHIBB")
NAME = b"CorviaPCM"

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC (polynomial 04c11db7, most significant bit first, from 0), got
    from zlib's, which has the same polynomial bit-reversed."""
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


def page_bytes(segments: list[int], body: bytes, flags: int, granule: int, serial: int, sequence: int) -> bytes:
    def head(crc):
        return HEADER.pack(b"OggS", 0, flags, granule, serial, sequence, crc, len(segments)) + bytes(segments)

    return head(checksum(head(0) + body)) + body


def lacing(size: int) -> list[int]:
    return [255] * (size // 255) + [size % 255]


class StreamWriter:
    """Pages of one logical stream."""

    def __init__(self, serial: int):
        self.serial, self.sequence = serial, 0
        self.segments: list[int] = []
        self.body: list[bytes] = []
        self.granule, self.continued = -1, False
        self.pages: list[bytes] = []

    def flush(self, last: bool = False) -> None:
        if not self.segments and not last:
            return
        flags = CONTINUED * self.continued | FIRST * (self.sequence == 0) | LAST * last
        self.pages.append(page_bytes(self.segments, b"".join(self.body), flags, self.granule, self.serial, self.sequence))
        self.sequence += 1
        self.continued = bool(self.segments) and self.segments[-1] == 255
        self.segments, self.body, self.granule = [], [], -1

    def packet(self, data: bytes, granule: int) -> None:
        laces, at = lacing(len(data)), 0
        while laces:
            room = 255 - len(self.segments)
            if not room:
                self.flush()
                continue
            now, laces = laces[:room], laces[room:]
            n = sum(now)
            self.segments += now
            self.body.append(data[at : at + n])
            at += n
        self.granule = granule  # a packet ends on this page


def padded(text: bytes) -> bytes:
    size = max(1, -(-len(text) // FRAME)) * FRAME
    return text + b"\xff" * (size - len(text))


def encode_payload(payload: bytes) -> bytes:
    """An Ogg file; equal payloads give equal files."""
    if not payload or len(payload) % FRAME:
        raise ValueError("a payload is a positive multiple of the frame")
    serial = zlib.crc32(payload) & 0xFFFFFFFE
    writers = [StreamWriter(serial + k) for k in range(STREAMS)]
    for k, w in enumerate(writers):
        w.packet(STREAM_HEADER.pack(NAME, 1, FRAME, RATE, k, STREAMS), 0)
        w.flush()  # a stream's first page holds its header alone
    samples = [0] * STREAMS
    for n, at in enumerate(range(0, len(payload), FRAME)):
        k = n % STREAMS
        samples[k] += FRAME
        writers[k].packet(payload[at : at + FRAME], samples[k])
    for w in writers:
        w.flush(last=True)
    out = [w.pages[0] for w in writers]  # first pages precede all others
    for n in range(1, max(len(w.pages) for w in writers)):
        out += [w.pages[n] for w in writers if n < len(w.pages)]
    return b"".join(out)


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # of the page on which the packet ends, -1 if another ends after it there
    pages: int = 0
    ended: bool = False
    open: list[bytes] = field(default_factory=list)


def read_streams(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number, in order of their first page."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise ValueError("cut page")
        capture, version, flags, granule, serial, sequence, crc, n = HEADER.unpack_from(data, at)
        if capture != b"OggS" or version:
            raise ValueError("no page where one must begin")
        body = at + HEADER.size + n
        laces = data[at + HEADER.size : body]
        end = body + sum(laces)
        if len(laces) < n or end > len(data):
            raise ValueError("cut page")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"wrong checksum in page {sequence} of stream {serial}")
        if bool(flags & FIRST) != (serial not in streams):
            raise ValueError("first page flag")
        s = streams.setdefault(serial, Stream(serial))
        if sequence != s.pages or s.ended:
            raise ValueError("missing page")
        if bool(flags & CONTINUED) != bool(s.open):
            raise ValueError("continued packet without its begin, or the other way")
        s.pages += 1
        begin = pos = body
        last_done = -1
        for lace in laces:
            pos += lace
            if lace < 255:
                s.open.append(data[begin:pos])
                s.packets.append(s.open[0] if len(s.open) == 1 else b"".join(s.open))
                s.granules.append(-1)
                last_done = len(s.packets) - 1
                s.open, begin = [], pos
        if begin < pos:
            s.open.append(data[begin:pos])
        if last_done >= 0:
            s.granules[last_done] = granule
        s.ended = bool(flags & LAST)
        at = end
    for s in streams.values():
        if s.open or not s.ended:
            raise ValueError("stream without its end")
    return streams


def packet_times(stream: Stream, frame: int, rate: int) -> list[float]:
    """Begin of each data packet in seconds: a page tells the end of its last
    packet, those before it end a frame earlier each."""
    ends = [0] * len(stream.packets)
    known = None
    for k in range(len(stream.packets) - 1, 0, -1):
        known = stream.granules[k] if stream.granules[k] >= 0 else known - frame
        ends[k] = known
    return [(e - frame) / rate for e in ends[1:]]


def decode_payload(data: bytes) -> tuple[bytes, dict]:
    """(payload, facts of the container)."""
    streams = list(read_streams(data).values())
    parts: list[tuple[float, int, bytes]] = []
    duration = 0.0
    for s in streams:
        name, version, frame, rate, number, of = STREAM_HEADER.unpack(s.packets[0])
        if name != NAME or version != 1 or of != len(streams):
            raise ValueError("unknown stream header")
        times = packet_times(s, frame, rate)
        parts += [(t, number, p) for t, p in zip(times, s.packets[1:])]
        duration += (len(s.packets) - 1) * frame / rate
    parts.sort(key=lambda x: (x[0], x[1]))
    return b"".join(p for _, _, p in parts), {"streams": len(streams), "pages": sum(s.pages for s in streams), "packets": len(parts), "seconds": duration}


def features(payload: bytes, facts: dict) -> str:
    """A fixed text of the signal's statistics: mean, deviation, crossings of the
    mean, entropy of the sample values, and the container's counts."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    mean = float(x.mean())
    p = counts[counts > 0] / len(x)
    above = x >= mean
    return (
        f"mean={mean:.4f};dev={float(x.std()):.4f};crossings={int((above[1:] != above[:-1]).sum())};"
        f"entropy={float(-(p * np.log2(p)).sum()):.4f};seconds={facts['seconds']:.4f};"
        f"streams={facts['streams']};pages={facts['pages']};packets={facts['packets']}"
    )


def text_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text as an Ogg file."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batch):
        raw = [x.encode("utf-8") for x in strings(batch.column(1)).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([encode_payload(padded(x)) for x in raw], pa.binary())], names=schema.names)

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), schema, run)


DECODED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("seconds", T.DoubleType()),
    ]
)


def media_digests(media: DataFrame) -> DataFrame:
    """Read each file of text_media() back: digests, times and features."""

    def run(batch):
        rows = []
        for file in batch.column(2).to_pylist():
            payload, facts = decode_payload(file)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), features(payload, facts), facts["seconds"]))
        cols = list(zip(*rows))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], names=DECODED.names)

    return map_batches(media, DECODED, run)
