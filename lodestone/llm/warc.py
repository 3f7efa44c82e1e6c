"""Dictionary-compressed WARC archives.

Each archive begins with a skippable frame that holds a Zstandard dictionary, built from all records of that archive;
each record follows as a frame of its own, compressed with it. Archives are closed at ``ARCHIVE_BYTES`` of records, so a
task holds no more than that. Of pages with equal payloads of at least ``REVISIT_BYTES``, that with the smallest id is a
response record, the others are revisit records without payload, which refer to it; smaller payloads are all responses.

Archives are written through ``pyarrow.fs`` to the shared folder, under a name that no other attempt uses and renamed
when whole; the manifest, cut by checkpoint(), lists those of the attempts that succeeded, so lost executors or repeated
tasks leave at most files that no manifest names.

Null html: an empty payload. Null url: no target URI. Null ids: never the record that others refer to, unless they have
no other: then all are responses. Rows that repeat the smallest id are responses too. A long page closes its archive. No
pages: no archives, and an empty manifest. Only the three columns named are read, so other columns' names can't clash.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import shared

ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
REVISIT_BYTES = 100
LEVEL = 6
#: Archives that a task reads, about.
READ_AT_ONCE = 4
#: Magic number of the frame that holds the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def record(page: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A whole record; the HTTP header names the full payload's length in revisits too."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Built from all the records; where they are too few to train on, their own bytes serve."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, k=256, d=8, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    words = dictionary(records)
    body = words.as_bytes()
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=True)
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body + b"".join(compressor.compress(r) for r in records)


def read_archive(data: bytes):
    """(headers, block) of each record."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).stream_reader(io.BytesIO(data[8 + size :]), read_across_frames=True)
    plain, at = reader.readall(), 0
    while at < len(plain):
        stop = plain.index(b"\r\n\r\n", at)
        first, *lines = plain[at:stop].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"not a record: {first[:40]}")
        headers = dict(x.split(": ", 1) for x in lines)
        at = stop + 4 + int(headers["Content-Length"])
        yield headers, plain[stop + 4 : at]
        if plain[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end")
        at += 4


def place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _put(to: str, records: list[bytes]) -> tuple[str, int, int]:
    fs, base = place(to)
    name = f"{uuid.uuid4().hex}.warc.zst"
    data = archive(records)
    with fs.open_output_stream(f"{base}/.{name}.part") as out:
        out.write(data)
    fs.move(f"{base}/.{name}.part", f"{base}/{name}")
    return f"{to}/{name}", len(records), len(data)


def write_warc(pages: DataFrame, to: str, page_id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives below ``to`` and returns their manifest: path, records, bytes."""
    body = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{page_id}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest"))
    long = F.octet_length("body") >= REVISIT_BYTES
    first = rows.where(long).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    rows = rows.join(first, "digest", "left").select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "url", "body", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first").cast("string")).alias("refers_to"))
    fs, base = place(to)
    fs.create_dir(base)

    def run(batches):
        records, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                i, u, b, d, r = (batch.column(c)[k].as_py() for c in range(5))
                records.append(record(i, u, b.encode(), d, r))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield manifest(_put(to, records))
                    records, size = [], 0
        if records:
            yield manifest(_put(to, records))

    def manifest(row):
        return pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), row, strict=True))], schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return shared.cut(rows.mapInArrow(run, "path string, records long, bytes long"))


def read_warc(manifest: DataFrame, id_type: T.DataType | None = None) -> DataFrame:
    """A row a record: page_id, url, payload (null in revisits), payload_bytes, payload_digest, record_type, refers_to."""
    schema = T.StructType([T.StructField("page_id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.StringType())])
    types = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])

    def name(uri: str | None) -> str | None:
        return uri.removeprefix("<urn:page:").removesuffix(">") or None if uri else None

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = place(path)
                with fs.open_input_file(at) as f:
                    data = f.read()
                rows = []
                for h, block in read_archive(data):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    length = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
                    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                    whole = h["WARC-Type"] == "response"
                    if whole and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{path}: damaged payload of {h['WARC-Record-ID']}")
                    rows.append({"page_id": name(h["WARC-Record-ID"]), "url": h.get("WARC-Target-URI"), "payload": payload if whole else None, "payload_bytes": length, "payload_digest": digest, "record_type": h["WARC-Type"], "refers_to": name(h.get("WARC-Refers-To"))})
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, schema=types)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=types)

    # so many archives a task; a number that is asked for isn't coalesced
    out = manifest.select("path").repartition(max(1, -(-manifest.count() // READ_AT_ONCE))).mapInArrow(run, schema)
    kind = id_type or T.StringType()
    return out.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
