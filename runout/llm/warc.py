"""WARC archives in Zstandard frames: a dictionary in the leading skippable frame, one frame per record.

Writing: equal payloads are grouped by SHA-1. Of a group whose payload has ``min_bytes`` or more, the page
with the largest id is a ``response`` with its payload; the others are ``revisit`` records that refer to
it. Only digests are shuffled, folded to one row per group first; the pages themselves stay where they
were read unless more than ``BROADCAST_ROWS`` groups have copies, and then move in a join that splits hot
payloads. Each task writes its own file under a new name, and the list of finished files is stored, so a
failed attempt leaves at most a file that nobody lists.

Reading: one task per listed file. Each frame is decoded on its own with the file's dictionary, and must
hold exactly one record: version line, mandatory headers, a block of the stated length, its digest, the
closing line breaks, and for responses a payload of the stated length and digest.

Defined results: a null payload is the empty one; a null url gives a record without target; control
characters in a url are percent-encoded; a null id is smaller than any other; repeated rows of the page
with the largest id are responses each; a group of null ids only has responses only; extra columns are
not read; an empty table gives no archive and no rows; a record of over ``RECORD_BYTES`` is an error, both
when it is written and when it is read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runout.llm.common import arrow_schema, lookup, file_folder, ship, stored

#: Fixed values of the formats: the dictionary frame, the end of a head, the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bounds: pages and characters of a page that the dictionary is trained on, and its bytes.
DICTIONARY_PAGES = 200
DICTIONARY_PAGE_CHARS = 20_000
DICTIONARY_BYTES = 64 * 1024
#: A task begins a new file beyond this size; a record may hold at most so many bytes.
FILE_BYTES = 256 * 1024 * 1024
RECORD_BYTES = 1 << 30

_CHUNK = 128 * 1024
_MANIFEST = "path string, records long, bytes long"
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(none|-?\d+)>", urn)
    if not m:
        raise ValueError(f"record id {urn!r}")
    return None if m[1] == "none" else int(m[1])


def record(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str
) -> bytes:
    """One WARC record; a revisit has the HTTP head of its page and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"header line {line!r}")
        out[name.lower()] = value.strip()
    return out


def _length(headers: dict[str, str]) -> int:
    text = headers.get("content-length", "")
    if not text.isdecimal():
        raise ValueError(f"content length {text!r}")
    return int(text)


def parse(data: bytes) -> dict:
    """Validate one decoded record and return its page, type, reference, url, payload, length and digest."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != b"WARC/1.1":
        raise ValueError(f"no WARC/1.1 head: {data[:40]!r}")
    headers = _headers(lines[1:])
    if missing := [h for h in _MANDATORY if h not in headers]:
        raise ValueError(f"headers missing: {missing}")
    n = _length(headers)
    block, end = rest[:n], rest[n:]
    if len(block) != n or end != b"\r\n\r\n":
        raise ValueError(f"block of {n} bytes stated, {len(rest)} bytes follow the head")
    if (stated := headers.get("warc-block-digest")) and stated != f"sha1:{base32_sha1(block)}":
        raise ValueError("block digest differs")
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        raise ValueError(f"record type {kind!r}")
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/1."):
        raise ValueError("no HTTP head")
    size = _length(_headers(http.split(b"\r\n")[1:]))
    algorithm, _, digest = headers.get("warc-payload-digest", "").partition(":")
    if algorithm != "sha1":
        raise ValueError("no SHA-1 payload digest")
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError("payload differs from its stated length or digest")
    if kind == "revisit" and (payload or headers.get("warc-profile") != REVISIT_PROFILE):
        raise ValueError("revisit with a payload or another profile")
    return {
        "page_id": _page_of(headers["warc-record-id"]),
        "record_type": kind,
        "refers_to": _page_of(headers.get("warc-refers-to", "")) if kind == "revisit" else None,
        "url": headers.get("warc-target-uri"),
        "payload": payload,
        "payload_bytes": size,
        "payload_digest": digest,
    }


def dictionary_frame(content: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content


def frames(stream: BinaryIO) -> Iterator[bytes]:
    """Decode an archive frame by frame. The dictionary is optional and may itself be compressed."""
    data = stream.read(8)
    dictionary = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", data[4:])[0]
        content = stream.read(size)
        if len(content) != size:
            raise ValueError("dictionary frame is cut off")
        if content[:4] == ZSTD_MAGIC:
            content = zstandard.ZstdDecompressor().decompress(content, max_output_size=RECORD_BYTES)
        dictionary, data = zstandard.ZstdCompressionDict(content), b""
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while data or (data := stream.read(_CHUNK)):
        frame, parts, size = decompressor.decompressobj(), [], 0
        while True:
            parts.append(frame.decompress(data))
            size += len(parts[-1])
            if size > RECORD_BYTES:
                raise ValueError(f"record of over {RECORD_BYTES} bytes")
            if frame.eof:
                break
            if not (data := stream.read(_CHUNK)):
                raise ValueError("last frame is cut off")
        data = frame.unused_data
        yield b"".join(parts)


def read_records(stream: BinaryIO, name: str) -> Iterator[dict]:
    for i, data in enumerate(frames(stream)):
        try:
            yield parse(data)
        except ValueError as e:
            raise ValueError(f"{name}, record {i}: {e}") from e


def train_dictionary(pages: DataFrame, html_col: str = "html") -> bytes:
    """A dictionary from a bounded sample; where that is too small, the fixed parts of a record."""
    payload = F.col(html_col).alias("html")
    sample = pages.select(payload).where(F.length("html").between(1, DICTIONARY_PAGE_CHARS))
    samples = [
        record(i, None, r.html.encode(), None, False, "") for i, r in enumerate(sample.limit(DICTIONARY_PAGES).collect())
    ]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return record(None, None, b"", None, True, "")


def _writer(folder: str, dictionary: bytes, date: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
        compressor = zstandard.ZstdCompressor(
            level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True
        )
        out, name, n, size = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": n, "bytes": size}], schema)

        for batch in batches:
            for page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_id, url, html, response, revisit = page
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = target.open_output_stream(f"{root}/{name}")
                    size += out.write(dictionary_frame(dictionary))
                data = record(page_id, url, html.encode(), response, revisit, date)
                if len(data) > RECORD_BYTES:
                    raise ValueError(f"page {page_id}: record of over {RECORD_BYTES} bytes")
                size += out.write(compressor.compress(data))
                n += 1
                if size > FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write_archives(
    pages: DataFrame, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 3
) -> DataFrame:
    """Write page_id, url and html of ``pages``; the stored list of archives (path, records, bytes)."""
    spark = pages.sparkSession
    ship(spark)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    large = rows.where(F.octet_length("html") >= min_bytes)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    copied = stored(groups.where("n > 1").select("digest", "response"))
    found = lookup(rows, copied, "digest", ["page_id"])
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    revisit = revisit & (F.octet_length("html") >= min_bytes)
    folder = file_folder(spark)
    target, root = fs.FileSystem.from_uri(folder)
    target.create_dir(root)
    written = found.select("page_id", "url", "html", "response", revisit.alias("revisit"))
    return stored(written.mapInArrow(_writer(folder, train_dictionary(pages), date, level), _MANIFEST))


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """Every record of the listed archives, validated; with its url and payload if asked for."""
    spark: SparkSession = archives.sparkSession
    ship(spark)
    ddl = _RECORD + (", url string, payload binary" if payload else "")
    schema = arrow_schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source, name = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with source.open_input_stream(name) as stream:
                    for r in read_records(stream, path):
                        rows.append({f: r[f] for f in schema.names})
                        size += 100 + (len(r["payload"]) if payload else 0)
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = max(1, archives.count())
    return archives.select("path").repartitionByRange(files, "path").mapInArrow(run, ddl)
