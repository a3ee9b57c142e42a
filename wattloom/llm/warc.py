"""WARC archives with an index that is written first and read first.

Every record is a gzip member of its own.  The index has offset, length, URL and digest of each record; a selection is read
from it, sorted by file and offset, and fetched in byte ranges that join neighbouring records.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from wattloom.llm.support import OneFile, cut, new_folder, open_store, prepare

#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 100
FILE_BYTES = 64 << 20
#: A range ends where the gap to the next record or the range itself would be larger.
GAP_BYTES = 64 << 10
RANGE_BYTES = 8 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAME = "urn:page:"
INDEX = "page_id long, file string, offset long, length long, url string, digest string"


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and refers_to of each page.

    Of equal payloads of at least ``REVISIT_BYTES`` the smallest page_id is the response; rows that share that id are all
    responses, rows with a larger or null id refer to it.  Null html is an empty payload.  Only ids and digests are joined by
    digest, where one payload may have most rows; the payloads are dealt by page_id.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256))
    narrow = base.filter(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", "digest")
    # written first: a join of two exchanges lets Spark split a digest that most rows share
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    firsts = cut(firsts, "warc-firsts")
    later = narrow.join(firsts, "digest").filter("page_id is null or page_id > refers_to").distinct()
    later = later.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to")
    return base.join(later, base["page_id"].eqNullSafe(later["_page"]) & (base["digest"] == later["_digest"]), "left").drop("_page", "_digest")


def _line(text: str) -> str:
    """A header value without line ends."""
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, which has the payload's length, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    own = f"{_NAME}{page_id}" if page_id is not None else f"{_NAME}none:{uuid.uuid4().hex}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{own}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{_NAME}{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record starts here")
    warc = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(warc["content-length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a WARC record does not end where its length says")
    http, _, payload = body.partition(b"\r\n\r\n")
    return warc, {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode("utf-8").split("\r\n")[1:])}, payload


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Write a record for each page into gzip files of about ``FILE_BYTES`` and return the written index.

    File names are new in each attempt of a task, so a repeated task can't change a file that the index names.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            rows = []
            for page, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out = OneFile(folder, name)
                press = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = press.compress(record(page, url, payload, digest, refers_to, date)) + press.flush()
                rows.append((page, name, out.write(data), len(data), url, digest))
                if out.size >= FILE_BYTES:
                    out.close()
                    out = None
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "file", "offset", "length", "url", "digest"])
        if out is not None:
            out.close()

    rows = with_revisits(pages).select("page_id", "url", "payload", "digest", "refers_to")
    return cut(rows.mapInArrow(run, INDEX), "warc-index")


def read_records(selected: DataFrame, folder: str) -> DataFrame:
    """Read the records of index rows: page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest.

    A revisit has a null payload; its bytes and digest are those of the full payload, from its headers.  A response whose
    payload does not have the digest of its header stops the read.
    """
    prepare(selected.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        store, base = open_store(folder)

        def fetch(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
            file, start = rows[0][0], rows[0][1]
            with store.open_input_file(f"{base}/{file}") as source:
                data = source.read_at(rows[-1][1] + rows[-1][2] - start, start)
            out = []
            for _, offset, length in rows:
                warc, http, payload = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                own = warc["warc-record-id"].strip("<>").removeprefix(_NAME)
                digest, kind = warc["warc-payload-digest"].removeprefix("sha256:"), warc["warc-type"]
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{file}: the record at {offset} is damaged")
                refers_to = int(warc["warc-refers-to"].strip("<>").removeprefix(_NAME)) if kind == "revisit" else None
                out.append((None if own.startswith("none:") else int(own), warc.get("warc-target-uri"), kind, refers_to, payload if kind == "response" else None, int(http["content-length"]), digest))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())
            names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        held: list[tuple[str, int, int]] = []
        for batch in batches:
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (file != held[0][0] or offset - held[-1][1] - held[-1][2] > GAP_BYTES or offset + length - held[0][1] > RANGE_BYTES):
                    yield fetch(held)
                    held = []
                held.append((file, offset, length))
        if held:
            yield fetch(held)

    ordered = selected.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages into a fresh folder of the shared one and read every record back."""
    folder = new_folder(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder), folder)
