"""Ogg streams as a binary media column (operator 2).

A stream is a run of pages, each with a checksum, a lacing table that cuts its body into packets, a
granule position and the serial number of the logical stream that it belongs to.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from driftwood.llm.common import as_bytes, chunks, crc32_of, table

PAGE = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
NO_PACKET_ENDS = -1
#: The checksum has zlib's polynomial, bits in the other order, no inversions.
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))

SAMPLES, INDEX = 1, 2
SAMPLE_HEAD = struct.Struct("<8sIBBQ")
INDEX_HEAD = struct.Struct("<8sI")
RATE, BLOCK = 8000, 4096


class BadOgg(ValueError):
    """The bytes are not whole, well-formed Ogg pages."""


def checksum(page: bytes) -> int:
    value = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(value.to_bytes(4, "big").translate(REVERSED), "little")


@dataclass
class Packet:
    data: bytes
    granule: int  # of the last sample of the packet; derived


@dataclass
class Stream:
    packets: list[Packet] = field(default_factory=list)
    ended: bool = False


def page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def write_stream(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream; packets: (data, granule at its end). The first packet gets a page of its own."""
    pages: list[bytes] = []
    lacing, body, granule, flags = bytearray(), bytearray(), NO_PACKET_ENDS, FIRST

    def flush(then: int) -> None:
        nonlocal granule, flags
        pages.append(page(serial, len(pages), flags, granule, bytes(lacing), bytes(body)))
        lacing.clear(), body.clear()
        granule, flags = NO_PACKET_ENDS, then

    for k, (data, at) in enumerate(packets):
        for start in range(0, len(data) + 1, 255):
            if len(lacing) == 255:
                flush(CONTINUED if start else 0)
            part = data[start : start + 255]
            lacing.append(len(part))
            body += part
        granule = at
        if k == 0 and len(packets) > 1:
            flush(0)
    flags |= LAST
    flush(0)
    return pages


def mux(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """One physical stream: all first pages ahead, then the rest of each stream, taking turns."""
    lanes = [write_stream(serial, packets) for serial, packets in streams.items()]
    out = [lane[0] for lane in lanes]
    for k in range(1, max(map(len, lanes))):
        out += [lane[k] for lane in lanes if k < len(lane)]
    return b"".join(out)


def demux(media: bytes) -> dict[int, Stream]:
    """Logical streams by serial number; every page is checked, packets are put together from the lacing values.

    A page's granule position is that of the last packet that ends in it; packets that end earlier in the
    page get theirs by timed(). Raises BadOgg for a wrong checksum, a gap in page numbers, a page cut short, a
    packet that does not end or bytes between pages.
    """
    streams: dict[int, Stream] = {}
    open_: dict[int, tuple[int, bytearray]] = {}
    at = 0
    while at < len(media):
        if len(media) - at < PAGE.size:
            raise BadOgg("short page header")
        magic, version, flags, granule, serial, number, crc, n = PAGE.unpack_from(media, at)
        lacing = media[at + PAGE.size : at + PAGE.size + n]
        end = at + PAGE.size + n + sum(lacing)
        if magic != b"OggS" or version or len(lacing) < n or end > len(media):
            raise BadOgg("not a whole page")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise BadOgg("checksum")
        if bool(flags & FIRST) == (serial in streams):
            raise BadOgg("first page flag")
        stream = streams.setdefault(serial, Stream())
        expected, carried = open_.get(serial, (0, bytearray()))
        if number != expected or stream.ended or bool(flags & CONTINUED) != bool(carried):
            raise BadOgg("page order")
        body, ended = at + PAGE.size + n, []
        for size in lacing:
            carried += media[body : body + size]
            body += size
            if size < 255:
                ended.append(Packet(bytes(carried), NO_PACKET_ENDS))
                carried = bytearray()
        if ended:
            ended[-1].granule = granule
            stream.packets += ended
        open_[serial] = (number + 1, carried)
        stream.ended = bool(flags & LAST)
        at = end
    if any(carried for _, carried in open_.values()) or not all(s.ended for s in streams.values()):
        raise BadOgg("a stream does not end")
    return streams


def timed(packets: list[Packet], length) -> list[tuple[int, int]]:
    """(first, end) granule of each packet; length(packet) is its length in samples.

    A page's granule position is the end of the last packet that ends in it; those before it in the page are told backwards from there,
    so a stream may start anywhere and have gaps between pages. On the last page, a position below what its packets hold cuts their end off.
    """
    spans: list[tuple[int, int]] = []
    lengths: list[int] = []
    at = 0
    for k, p in enumerate(packets):
        lengths.append(length(p))
        if p.granule == NO_PACKET_ENDS:
            continue
        first = p.granule - sum(lengths)
        if first < at and (k + 1 < len(packets) or p.granule < at):
            raise BadOgg("granule position")
        end = max(first, at)
        for n in lengths:
            first, end = end, min(end + n, p.granule)
            spans.append((first, end))
        at, lengths = p.granule, []
    if lengths:
        raise BadOgg("no granule position")
    return spans


def to_media(payload: bytes, n_bytes: int, first: int = 0) -> bytes:
    """8-bit samples in one logical stream that starts at granule `first`, beside a second that says where each block of samples starts."""
    head = SAMPLE_HEAD.pack(b"SAMPLES8", RATE, 1, 8, n_bytes)
    blocks = [payload[k : k + BLOCK] for k in range(0, len(payload), BLOCK)]
    ends = [first + min(len(payload), k + BLOCK) for k in range(0, len(payload), BLOCK)]
    index = np.array([first, *ends[:-1]], "<u8").tobytes()
    return mux({SAMPLES: [(head, 0), *zip(blocks, ends, strict=True)], INDEX: [(INDEX_HEAD.pack(b"SEEKINDX", BLOCK), 0), (index, first + len(payload))]})


def from_media(media: bytes) -> dict:
    """The payload, the unpadded length and the timing that the stored bytes hold; spans: first and end granule of each packet of samples."""
    streams = demux(media)
    samples, index = streams[SAMPLES].packets, streams[INDEX].packets
    magic, rate, channels, bits, n_bytes = SAMPLE_HEAD.unpack(samples[0].data)
    if magic != b"SAMPLES8" or channels != 1 or bits != 8:
        raise BadOgg("sample format")
    spans = timed(samples[1:], lambda p: len(p.data))
    if np.frombuffer(index[1].data, "<u8").tolist() != [first for first, _ in spans]:
        raise BadOgg("index")
    return {"payload": b"".join(p.data for p in samples[1:]), "n_bytes": n_bytes, "rate": rate, "spans": spans, "packets": len(samples) - 1}


def features(stored: dict) -> str:
    """Duration by granule positions, packets, and of the samples: mean, RMS around 128, zero crossings and peak."""
    x = np.frombuffer(stored["payload"], np.uint8).astype(np.int16) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    power = int(np.dot(x.astype(np.float64), x))
    peak = int(max(x.max(), -x.min()))
    spans = stored["spans"]
    return f"ms={1000 * (spans[-1][1] - spans[0][0]) / stored['rate']:.3f};packets={stored['packets']};mean={x.mean(dtype=np.float64):.6f};rms={(power / len(x)) ** 0.5:.6f};zc={crossings};peak={peak}"


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each whole text as Ogg bytes; null text counts as empty, other columns are not read."""

    def run(batches):
        for batch in chunks(batches):
            media = []
            for text in as_bytes(batch.column(1)):
                pad = -len(text) % 64 if text else 64
                media.append(to_media(text + b"\0" * pad, len(text)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, media binary")


FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, packet_starts array<bigint>, packet_ends array<bigint>"


def decode(media: DataFrame) -> DataFrame:
    """Reads (doc_id, media) back: digests and features, from the stored bytes alone.

    packet_starts and packet_ends: the granules (samples at RATE a second) of each packet, told from the pages' granule positions.
    Null media and bytes that are not whole pages give a row of nulls but for doc_id, media_bytes and media_sha256.
    Repeated rows are kept; an empty table gives an empty result.
    """
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def row(doc_id, blob):
        if blob is None:
            return (doc_id, *[None] * 9)
        try:
            got = from_media(blob)
        except (BadOgg, KeyError, IndexError, struct.error):
            return (doc_id, None, None, None, None, len(blob), sha(blob), None, None, None)
        payload = got["payload"]
        return (doc_id, got["n_bytes"], len(payload), sha(payload), crc32_of(payload[-64:]), len(blob), sha(blob), features(got), *zip(*got["spans"], strict=True))

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [c.split()[0] for c in FEATURES.split(", ")]

    def run(batches):
        for batch in chunks(batches):
            rows = [row(i.as_py(), m.as_py()) for i, m in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return media.select("doc_id", "media").mapInArrow(run, FEATURES)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(encode(table(spark, sf_dir, "documents")))
