"""Media columns: payloads as Ogg containers (RFC 3533).

``encode_ogg`` multiplexes two logical streams into one container: 8-bit samples in packets of eight frames, which
cross page borders, and an index that has the CRC-32 of every sample packet. ``decode_ogg`` verifies page checksums,
demultiplexes by serial number, reassembles packets from lacing values and derives timestamps from granule positions.
Everything in a container depends on the payload alone, so equal texts have equal media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillspan.llm.common import table, widened, with_columns

FRAME = 576
PACKET = 8 * FRAME
RATE = 48_000
_HEAD = struct.Struct("<4sBBqIIIB")
_AUDIO, _INDEX = b"\x01QSpcm8\x00", b"\x01QSindex"
#: Every byte with its bits reversed.
_REV = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def ogg_crc(data: bytes) -> int:
    """CRC-32 as Ogg has it: polynomial 0x04C11DB7, not reflected, no initial or final XOR.

    It is the bit reversal of the reflected CRC of the bit-reversed bytes, which zlib computes.
    """
    reflected = zlib.crc32(data.translate(_REV), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "big").translate(_REV), "little")


def pad_payload(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and these filled up with 255 to a positive multiple of the frame."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw + b"\xff" * (-len(raw) % FRAME or (0 if raw else FRAME))


def _pages(serial: int, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """A logical stream's pages; the first packet has a page of its own. granules: position when each packet ends."""
    pages: list[bytes] = []

    def page(flags: int, granule: int, lacing: bytes, body: bytes) -> None:
        head = _HEAD.pack(b"OggS", 0, flags, granule, serial, len(pages), 0, len(lacing)) + lacing
        crc = ogg_crc(head + body)
        pages.append(b"".join((head[:22], struct.pack("<I", crc), head[26:], body)))

    first = packets[0]
    page(2 | (4 if len(packets) == 1 else 0), granules[0], b"\xff" * (len(first) // 255) + bytes([len(first) % 255]), first)
    lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets[1:])
    body = b"".join(packets[1:])
    at = packet = 0
    for k in range(0, len(lacing), 255):
        part = lacing[k : k + 255]
        ends = len(part) - part.count(255)
        packet += ends
        size = sum(part)
        page((1 if k and lacing[k - 1] == 255 else 0) | (4 if k + 255 >= len(lacing) else 0), granules[packet] if ends else -1, part, body[at : at + size])
        at += size
    return pages


def ogg_bytes(payload: bytes) -> bytes:
    """The payload as an Ogg container of two multiplexed logical streams."""
    serial = zlib.crc32(payload)
    chunks = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    ends = [min(i + PACKET, len(payload)) for i in range(0, len(payload), PACKET)]
    audio = _pages(serial, [_AUDIO + struct.pack("<IBBQ", RATE, 1, 8, len(payload)), *chunks], [0, *ends])
    index = _pages(serial ^ 1, [_INDEX + struct.pack("<I", len(chunks)), *(struct.pack("<I", zlib.crc32(c)) for c in chunks)], [0, *ends])
    out = [audio[0], index[0]]  # all first pages come before any other
    for i in range(1, max(len(audio), len(index))):
        out += audio[i : i + 1] + index[i : i + 1]
    return b"".join(out)


def read_ogg(media: bytes) -> dict[int, dict]:
    """Logical streams by serial number: packets, the granule and the time in ms at each page that ends a packet.

    Raises ValueError on a wrong checksum, a page missing from a sequence, a broken continuation or a truncated page.
    """
    streams: dict[int, dict] = {}
    at = 0
    while at < len(media):
        if at + 27 > len(media):
            raise ValueError("truncated page header")
        magic, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise ValueError("not a page")
        lacing = media[at + 27 : at + 27 + n]
        start, size = at + 27 + n, sum(lacing)
        if len(lacing) < n or start + size > len(media):
            raise ValueError("truncated page")
        if ogg_crc(b"".join((media[at : at + 22], b"\0\0\0\0", media[at + 26 : start + size]))) != crc:
            raise ValueError("wrong page checksum")
        s = streams.setdefault(serial, {"lacing": [], "body": [], "granules": [], "pages": 0, "closed": False, "open": False})
        if number != s["pages"] or s["closed"] or bool(flags & 2) != (number == 0):
            raise ValueError("page out of sequence")
        if bool(flags & 1) != s["open"]:
            raise ValueError("broken continuation")
        s["pages"] += 1
        s["closed"] = bool(flags & 4)
        s["open"] = n > 0 and lacing[-1] == 255 or (n == 0 and s["open"])
        s["lacing"].append(lacing)
        s["body"].append(media[start : start + size])
        if granule >= 0:
            s["granules"].append(granule)
        at = start + size
    for s in streams.values():
        if not s["closed"] or s["open"]:
            raise ValueError("stream not ended")
        lacing, body = np.frombuffer(b"".join(s.pop("lacing")), np.uint8), b"".join(s.pop("body"))
        ends = np.cumsum(lacing, dtype=np.int64)[lacing < 255].tolist()
        s["packets"] = [body[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return streams


def ogg_features(media: bytes) -> tuple[bytes, str]:
    """The sample stream's payload, and a digest of the container: streams, pages, packets, duration, level."""
    streams = read_ogg(media)
    audio = next(s for s in streams.values() if s["packets"][0].startswith(_AUDIO))
    index = next(s for s in streams.values() if s["packets"][0].startswith(_INDEX))
    rate, channels, bits, total = struct.unpack_from("<IBBQ", audio["packets"][0], 8)
    chunks = audio["packets"][1:]
    if [zlib.crc32(c) for c in chunks] != [struct.unpack("<I", p)[0] for p in index["packets"][1:]]:
        raise ValueError("index and samples differ")
    payload = b"".join(chunks)
    if len(payload) != total or audio["granules"][-1] != total:
        raise ValueError("wrong total")
    stamps = [g * 1_000_000 // rate for g in audio["granules"]]
    x = np.frombuffer(payload, np.uint8)
    mean, peak = int(x.sum(dtype=np.int64)) * 1000 // len(x), int(x.max())
    return payload, f"ogg streams={len(streams)} pages={sum(s['pages'] for s in streams.values())} packets={len(chunks)} rate={rate} channels={channels} bits={bits} end_us={stamps[-1]} mid_us={stamps[len(stamps) // 2]} mean_milli={mean} peak={peak}"


def encode_ogg(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_bytes (of the UTF-8 text) and media (binary). Null texts are empty; clashing columns are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [pad_payload(t) for t in b.column(text_col).to_pylist()]
            yield with_columns(b, {"n_bytes": pa.array([n for n, _ in got], pa.int64()), "media": pa.array([ogg_bytes(p) for _, p in got], pa.binary())})

    return df.mapInArrow(run, widened(df.schema, {"n_bytes": T.LongType(), "media": T.BinaryType()}))


def decode_ogg(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds payload, feature and media_error. A container that fails a check has null payload and feature and the
    reason in media_error; a null container is null throughout. Clashing columns are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for m in b.column(media_col).to_pylist():
                try:
                    got.append((*ogg_features(m), None) if m is not None else (None, None, None))
                except (ValueError, StopIteration, struct.error) as e:
                    got.append((None, None, str(e) or "stream missing"))
            cols = list(zip(*got, strict=True)) or [(), (), ()]
            yield with_columns(b, {"payload": pa.array(cols[0], pa.binary()), "feature": pa.array(cols[1], pa.string()), "media_error": pa.array(cols[2], pa.string())})

    return df.mapInArrow(run, widened(df.schema, {"payload": T.BinaryType(), "feature": T.StringType(), "media_error": T.StringType()}))


def op5_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text through an Ogg container and back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = decode_ogg(encode_ogg(docs).select("doc_id", "n_bytes", "media"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pay, med = b.column("payload").to_pylist(), b.column("media").to_pylist()
            if bad := [e for e in b.column("media_error").to_pylist() if e]:
                raise ValueError(bad[0])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), pa.array(map(len, pay), pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in pay]), pa.array([zlib.crc32(p[-32:]) for p in pay], pa.int64()), pa.array(map(len, med), pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in med]), b.column("feature")],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return back.mapInArrow(digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
