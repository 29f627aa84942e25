"""WARC archives with one Zstandard frame a record and the dictionary in a leading skippable frame."""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

#: Payloads below this size are always stored in full.
MIN_REVISIT_BYTES = 100
#: Size at which a task begins its next archive, and the bound of what a dictionary is trained on.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_ROWS, SAMPLE_BYTES = 8 << 20, 32 << 10, 256, 2 << 20


def payload(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def plan(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, refers_to of every page; refers_to is null for a response.

    Of equal payloads of at least ``MIN_REVISIT_BYTES``, the smallest page_id is the response. Rows that
    repeat that page_id are responses too; a null page_id comes last. A null html counts as empty; a very long payload
    is one row and stays whole; further columns are not read; an empty table gives an empty result.
    """
    rows = pages.select("page_id", "url", payload(F.col("html")).alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    long_enough = rows.where(F.octet_length("payload") >= MIN_REVISIT_BYTES)
    first = long_enough.groupBy(F.col("payload_digest").alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = first.where("n > 1 and first is not null").select("digest", "first")
    joined = rows.join(repeated, rows["payload_digest"] == repeated["digest"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "payload_digest", refers.alias("refers_to"))


def page_uri(page_id: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"none" if page_id is None else str(page_id).encode())


def page_of(uri: bytes) -> int | None:
    number = uri.removeprefix(b"<urn:page:").removesuffix(b">")
    return None if number == b"none" else int(number)


def header_value(text: str) -> bytes:
    """A URL as a header value: white space and control characters percent-encoded."""
    return b"".join(b"%%%02X" % c if c <= 32 or c == 127 else bytes([c]) for c in text.encode())


def record(page_id: int | None, url: str | None, body: bytes, digest: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http if refers_to is not None else http + body
    lines = [
        VERSION,
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: " + page_uri(page_id),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        *([b"WARC-Target-URI: " + header_value(url)] if url else []),
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
        *([b"WARC-Refers-To: " + page_uri(refers_to), b"WARC-Profile: " + REVISIT_PROFILE] if refers_to is not None else []),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    return b"\r\n".join(lines) + END + block + END


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on a bounded sample of records; empty where there is too little to learn from."""
    bounded, size = [], 0
    for s in samples[:SAMPLE_ROWS]:
        if size + len(s) > SAMPLE_BYTES:
            s = s[: max(0, SAMPLE_BYTES - size)]
        bounded.append(s)
        size += len(s)
    if len(bounded) < 16 or size < 8 * DICTIONARY_BYTES:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, bounded, k=1024, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def head(trained: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(19).compress(trained) if trained else b""
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def write(pages: DataFrame) -> DataFrame:
    """Archives of all pages: archive (name), n_records, content (the bytes of a .warc.zst file).

    An archive ends when it is long enough, so it holds at least one record, however long, whole. Further columns are not read;
    an empty table gives no archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, packer, name = bytearray(), 0, None, hashlib.sha256()

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"archive": f"{name.hexdigest()[:32]}.warc.zst", "n_records": n, "content": bytes(out)}], schema=arrow)

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "payload_digest", "refers_to")]
            for lo in range(0, batch.num_rows, SAMPLE_ROWS):
                records = [record(*row) for row in zip(*(c.slice(lo, SAMPLE_ROWS).to_pylist() for c in columns))]
                for raw in records:
                    if packer is None:
                        trained = dictionary(records)
                        packer = zstandard.ZstdCompressor(3, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None, write_checksum=True)
                        out += head(trained)
                    frame = packer.compress(raw)
                    name.update(frame[-4:])
                    out += frame
                    n += 1
                    if len(out) >= ARCHIVE_BYTES:
                        yield closed()
                        out, n, packer, name = bytearray(), 0, None, hashlib.sha256()
        if n:
            yield closed()

    arrow = pa.schema([("archive", pa.string()), ("n_records", pa.int64()), ("content", pa.binary())])
    return plan(pages).mapInArrow(run, "archive string, n_records long, content binary")


def frame_end(data: bytes, at: int) -> int:
    """End of the Zstandard frame that starts at ``at``, from its block headers."""
    has_checksum = zstandard.get_frame_parameters(data[at : at + 32]).has_checksum
    at += zstandard.frame_header_size(data[at : at + 32])
    while True:
        block = int.from_bytes(data[at : at + 3], "little")
        if at + 3 > len(data):
            raise ValueError("the archive ends within a frame")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return at + 4 * has_checksum


def records(content: bytes) -> Iterator[bytes]:
    """The records of one archive, frame by frame."""
    at, unpacker = 0, zstandard.ZstdDecompressor()
    if len(content) >= 8 and (found := struct.unpack_from("<II", content))[0] == DICTIONARY_MAGIC:
        at, held = 8 + found[1], content[8 : 8 + found[1]]
        if held.startswith(ZSTD_MAGIC):
            held = zstandard.ZstdDecompressor().decompress(held)
        if held:
            unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
    while at < len(content):
        end = frame_end(content, at)
        yield unpacker.decompress(content[at:end])
        at = end


def headers(lines: list[bytes]) -> dict[bytes, bytes]:
    found = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"not a header line: {line[:60]!r}")
        found[name.strip().lower()] = value.strip()
    return found


def parsed(raw: bytes) -> dict:
    """One record's fields, after its version, headers, lengths and digest have been validated."""
    top, found, rest = raw.partition(END)
    first, *lines = top.split(b"\r\n")
    if not found or first != VERSION:
        raise ValueError("no WARC header")
    warc = headers(lines)
    size = int(warc[b"content-length"])
    block, tail = rest[:size], rest[size:]
    if len(block) != size or tail != END:
        raise ValueError("the block is not as long as the header says")
    kind = warc[b"warc-type"].decode()
    http_top, _, body = block.partition(END)
    length = int(headers(http_top.split(b"\r\n")[1:])[b"content-length"])
    digest = warc[b"warc-payload-digest"].decode().removeprefix("sha256:")
    refers = page_of(warc[b"warc-refers-to"]) if kind == "revisit" else None
    if kind not in ("response", "revisit"):
        raise ValueError(f"unknown record type {kind}")
    if kind == "response" and (len(body) != length or hashlib.sha256(body).hexdigest() != digest):
        raise ValueError("the payload is not what the headers say")
    if kind == "revisit" and (body or refers is None):
        raise ValueError("a revisit needs a record to refer to and no payload")
    url = warc.get(b"warc-target-uri")
    return {"page_id": page_of(warc[b"warc-record-id"]), "url": url and url.decode(), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": refers, "payload": body if kind == "response" else None}


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of archives (column content): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    A record that fails validation fails the job, naming what is wrong. An empty table gives an empty result; further
    columns are not read; payloads are read whole, one record at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for raw in records(content.as_py()):
                    row = parsed(raw)
                    rows.append(row if with_payload else row | {"payload": None})
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return archives.select("content").mapInArrow(run, ddl)


def export(archives: DataFrame, folder: str) -> None:
    """Writes the archives as files of a folder that all executors share; a rerun task writes the same file."""

    def save(rows) -> None:
        for row in rows:
            path = os.path.join(folder, row.archive)
            with open(f"{path}.{os.getpid()}", "wb") as f:
                f.write(row.content)
            os.replace(f"{path}.{os.getpid()}", path)

    os.makedirs(folder, exist_ok=True)
    archives.foreachPartition(save)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The records of the .warc.zst files below a path that Spark can read."""
    return read(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path))
