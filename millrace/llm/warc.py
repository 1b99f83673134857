"""WARC archives: a Zstandard dictionary built from records leads each file, in a skippable frame; a frame a record."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_broadcast, written
from .frames import DICTIONARY, header, read_files, skippable, trained, write_frames

SAMPLE, DICTIONARY_BYTES = 500, 65536
#: High half of a record's UUID; the low half is the page_id.
_RECORDS = 0x6D696C6C72616365 << 64
_DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=_RECORDS | page_id & (2**64 - 1))}>"


def page_of(record: str) -> int:
    low = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int & (2**64 - 1)
    return low - 2**64 if low >= 2**63 else low


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of the record refers_to; a revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id) if page_id is not None else '<' + uuid.uuid5(uuid.NAMESPACE_URL, url or '').urn + '>'}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {record_id(refers_to)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and payload (None for a revisit).

    A response's length and digest are those of the payload that is read; headers that say otherwise are an error. A
    revisit has no payload, so they come from its headers.
    """
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = {"payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:")}
    if fields["WARC-Type"] == "response" and said != {"payload_bytes": len(payload), "payload_digest": digest(payload)}:
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    own = fields["WARC-Record-ID"].strip("<>").removeprefix("urn:uuid:")
    to = fields.get("WARC-Refers-To")
    return {
        "page_id": page_of(own) if uuid.UUID(own).int >> 64 == _RECORDS >> 64 else None,
        **said,
        "record_type": fields["WARC-Type"],
        "refers_to": page_of(to) if to else None,
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def _frames(dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        begun = False
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = [] if begun else [skippable(DICTIONARY, dictionary)]
                begun = True
                for page_id, url, html, to in zip(*[c.to_pylist() for c in batch.slice(at, 512).columns], strict=True):
                    out.append(packer.compress(build_record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), to)))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    return run


def records_of(content: bytes) -> Iterator[bytes]:
    """The records of one archive, one after the other."""
    data, at, unpacker = memoryview(content), 0, None
    while at < len(data):
        magic, size = header(data, at)
        if magic:
            if magic == DICTIONARY:
                raw = bytes(data[at + 8 : at + 8 + size])
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
            at += 8 + size
            continue
        one, parts = unpacker.decompressobj(), []
        while not one.eof:
            parts.append(one.decompress(data[at : at + 16_384]))
            at += min(16_384, len(data) - at)
        at -= len(one.unused_data)
        yield b"".join(parts)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for record in records_of(content.as_py()):
                row = parse_record(record)
                del row["payload"]
                rows.append(row)
                if len(rows) == 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def write_archives(pages: DataFrame, min_bytes: int = 0) -> str:
    """Writes a record for each row of pages (page_id, url, html) and returns the folder.

    Of equal payloads of at least min_bytes bytes, the one with the smallest page_id is a response and the others
    revisit it; a row with a null page_id is always a response. A null html is an empty payload. Rows that repeat a
    page_id with its payload: each is a response if that id is the smallest.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", "html", F.sha1(payload).alias("_sha"))
    groups = pages.where(F.octet_length(payload) >= min_bytes).groupBy("_sha").agg(F.count("*").alias("_n"), F.min("page_id").alias("_first"))
    groups = written(groups.where("_n > 1 and _first is not null").select("_sha", "_first"))
    marked = pages.join(maybe_broadcast(groups), "_sha", "left").select(
        "page_id", "url", "html", F.when(F.col("page_id") > F.col("_first"), F.col("_first")).alias("refers_to")
    )
    n = pages.count()
    share = max(1, int(2_000_000 * SAMPLE / max(n, 1)))
    chosen = pages.where(F.pmod(F.xxhash64("page_id", "_sha"), F.lit(1_000_000)) < share).where(F.length("html") < 20_000).limit(SAMPLE)
    sample = [build_record(r.page_id, r.url, (r.html or "").encode("utf-8", "surrogatepass"), None) for r in chosen.collect()]
    dictionary = trained(sample, DICTIONARY_BYTES) if sample else b""
    return write_frames(marked.mapInArrow(_frames(dictionary), "frame binary"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record in the archives.

    Lengths and digests are of the payloads as read, a revisit's of the response that it refers to. A damaged payload,
    or a revisit whose response is not there or has another digest, is an error.
    """
    rows = written(read_files(spark, path).mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"))
    plain, again = rows.where("record_type <> 'revisit'"), rows.where("record_type = 'revisit'")
    wanted = maybe_broadcast(written(again.select(F.col("refers_to").alias("page_id")).distinct()))
    firsts = plain.join(wanted, "page_id", "left_semi").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")).distinct()
    # ids may repeat with other payloads, so the digest is part of the key
    found = again.withColumnRenamed("payload_digest", "_digest").join(maybe_broadcast(written(firsts)), ["refers_to", "_digest"], "left")
    lost = F.raise_error(F.concat(F.lit("no such response: "), F.coalesce(F.col("refers_to").cast("string"), F.lit("null"))))
    size = F.when(F.col("_bytes") == F.col("payload_bytes"), F.col("_bytes")).otherwise(lost.cast("long"))
    return plain.unionByName(found.select("page_id", size.alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", "refers_to"))
