"""WARC 1.1 archives: writing with revisits and segmentation, reading with segment reassembly.

``write_archives`` makes a record of every page: an HTTP response in chunked transfer coding, split into a first segment
and continuation records if its block is longer than ``SEGMENT_BYTES``, or a revisit record that names an earlier equal
payload. ``read_archives`` parses archives, groups the segments of a record by the origin's id, orders them by number,
verifies that all are there and have the stated total length, and decodes the chunked framing.

Defined results: a null payload is empty. Of rows with equal payloads of at least ``MIN_REVISIT_BYTES`` those with the
smallest page_id are responses (repeated rows all are), the others revisit it; a null page_id ranks after all others
and is never referred to. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import stash, table

MIN_REVISIT_BYTES = 100
SEGMENT_BYTES, CHUNK_BYTES, ARCHIVE_BYTES = 16_384, 4_096, 4 << 20
_SPACE = uuid.UUID("5f4b1c1e-6d0a-4c43-9f0e-0d6a4f3f7a10")
_DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_LINE = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body. Raises ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            break
        out.append(body[at : at + n])
        if len(out[-1]) < n or body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("broken chunk")
        at += n + 2
    if not body.endswith(b"\r\n", at):
        raise ValueError("no end of the chunked body")
    return b"".join(out)


def _record(kind: str, record_id: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", _DATE), *fields, ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def _id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr((_SPACE.hex, *parts)).encode()).digest())}>"


def page_records(row: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, segment: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of a page. row: what tells it from every other row, also from equal ones."""
    digest = "sha256:" + hashlib.sha256(payload).hexdigest()
    rid = _id(row)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None
    own: list[tuple[str, object]] = [("WARC-Target-URI", target), ("X-Page-ID", page_id), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", refers_to), ("X-Payload-Length", len(payload))]
        return [_record("revisit", rid, own + more, b"HTTP/1.1 200 OK\r\n\r\n")]
    block = _HTTP + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        return [_record("response", rid, own, block)]
    out = [_record("response", rid, [*own, ("WARC-Segment-Number", 1)], parts[0])]
    for k, p in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
        out.append(_record("continuation", _id(row, k), [("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", k), *last], p))
    return out


def parse_records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and blocks. Raises ValueError at a broken record."""
    at = 0
    while at < len(archive):
        if not archive.startswith(b"WARC/", at) or (end := archive.find(b"\r\n\r\n", at)) < 0:
            raise ValueError(f"no record at byte {at}")
        head = {k.decode().lower(): v.decode() for k, v in _LINE.findall(archive, archive.index(b"\r\n", at) + 2, end + 2)}
        start, n = end + 4, int(head["content-length"])
        if archive[start + n : start + n + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} has another length")
        yield head, archive[start : start + n]
        at = start + n + 4


def revisit_targets(pages: DataFrame, id_col: str = "page_id", payload_col: str = "payload") -> DataFrame:
    """pages with payload_digest and refers_to (null for responses). Only repeated digests are joined back; a frequent
    digest is one row on that side, so its rows on the other may be split among tasks."""
    hashed = pages.withColumn("payload_digest", F.sha2(payload_col, 256)).withColumn("_big", F.octet_length(payload_col) >= MIN_REVISIT_BYTES)
    first = hashed.filter("_big").groupBy("payload_digest").agg(F.min(id_col).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").select("payload_digest", "_first")
    joined = hashed.join(first, "payload_digest", "left")
    revisit = F.col("_big") & F.col("_first").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("_first"))
    return joined.withColumn("refers_to", F.when(revisit, F.col("_first"))).drop("_big", "_first")


def write_archives(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (content: binary) of pages with page_id, url, payload and refers_to. Segments of a record may fall into
    different archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, size = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["content"])
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")]
            for page_id, url, payload, ref in zip(*cols, strict=True):
                n += 1
                for rec in page_records(f"{part}/{n}", page_id, url, payload or b"", ref, segment_bytes):
                    if held and size + len(rec) > archive_bytes:
                        yield pack()
                        held, size = [], 0
                    held.append(rec)
                    size += len(rec)
        if held:
            yield pack()

    return pages.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "content binary")


_PAGE = "page_id long, url string, record_type string, refers_to long, stated_bytes long, digest string, payload binary"


def _pages(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    cols = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.split()[0] for f in _PAGE.split(", ")])


def _payload(block: bytes, digest: str | None) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if digest and digest != "sha256:" + hashlib.sha256(payload).hexdigest():
        raise ValueError("payload digest differs")
    return payload


def _page(head: dict[str, str], block: bytes | None) -> tuple:
    num = lambda k: int(head[k]) if k in head else None
    digest = head.get("warc-payload-digest")
    return num("x-page-id"), head.get("warc-target-uri"), head["warc-type"], num("x-refers-to-page-id"), num("x-payload-length"), digest, _payload(block, digest) if block is not None else None


def read_archives(archives: DataFrame) -> DataFrame:
    """Pages: page_id, url, record_type, refers_to, stated_bytes and digest, and payload, null for revisits. Broken
    archives, missing segments and wrong lengths or digests raise ValueError."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows = []
                for head, block in parse_records(content.as_py()):
                    if head["warc-type"] == "revisit":
                        rows.append(_page(head, None))
                    elif head["warc-type"] == "response" and "warc-segment-number" not in head:
                        rows.append(_page(head, block))
                yield _pages(rows)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows = []
                for head, block in parse_records(content.as_py()):
                    if "warc-segment-number" in head:
                        kind = head["warc-type"]
                        rid = head["warc-segment-origin-id"] if kind == "continuation" else head["warc-record-id"]
                        num = lambda k, h=head: int(h[k]) if k in h else None
                        rows.append((rid, int(head["warc-segment-number"]), num("warc-segment-total-length"), num("x-page-id"), head.get("warc-target-uri"), head.get("warc-payload-digest"), block))
                types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                cols = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["origin", "number", "total", "page_id", "url", "digest", "block"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by origin and number; one record's segments are held at a time."""
        held: list[dict] = []
        done: list[tuple] = []

        def close() -> None:
            block = b"".join(x["block"] for x in held)
            if [x["number"] for x in held] != list(range(1, len(held) + 1)) or held[-1]["total"] != len(block):
                raise ValueError(f"segments of {held[0]['origin']} are missing or have another length")
            first = held[0]
            done.append((first["page_id"], first["url"], "response", None, None, first["digest"], _payload(block, first["digest"])))

        for b in batches:
            for x in b.to_pylist():
                if held and held[0]["origin"] != x["origin"]:
                    close()
                    held.clear()
                held.append(x)
            yield _pages(done)
            done.clear()
        if held:
            close()
            yield _pages(done)

    parts = archives.mapInArrow(segments, "origin string, number int, total long, page_id long, url string, digest string, block binary")
    by_origin = parts.repartition("origin").sortWithinPartitions("origin", "number")
    return archives.mapInArrow(whole, _PAGE).unionByName(by_origin.mapInArrow(joined, _PAGE))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through WARC archives in the shared folder and back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    back = read_archives(stash(write_archives(revisit_targets(pages)), "warc"))
    size = F.coalesce(F.octet_length("payload").cast("long"), F.col("stated_bytes"))
    return back.select("page_id", size.alias("payload_bytes"), F.substring("digest", 8, 64).alias("payload_digest"), "record_type", "refers_to")


ORACLE_SQL = {
    "op10_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
"""
}
