"""WARC archives compressed with an embedded Zstandard dictionary.

An archive (``.warc.zst``) is a leading skippable frame that holds the dictionary, then one Zstandard frame per
record, each compressed on its own with that dictionary, so any record can be read alone once the dictionary is.
The dictionary is trained from the first records that a task archives (those up to the one that reaches ``SAMPLE_BYTES``),
cut into samples of at most ``SEGMENT_BYTES``, so that a single long record is enough; where they give fewer than
``LEAST_SAMPLES`` samples, or zstd finds nothing to train on, the archive has no dictionary frame and plain record frames.

Records: the payload is the page's html in UTF-8. Of records with equal payloads of at least ``LEAST_SHARED`` bytes the one
with the largest page_id is a ``response``, the others are ``revisit`` records that refer to it and carry no
payload; smaller payloads are all ``response``.

Files are written by the tasks under names of their own attempt and reported in a manifest; only
files in the manifest of the finished job count, so a lost executor or a repeated attempt leaves orphans
at worst. Reading streams each archive record by record.

Defined cases: null html is an empty payload; a null url has no target header; line ends in a url are
percent-encoded; a null page_id reads back as null, never becomes the response of a group that has another id,
and is a response if it has none; rows repeated with the winning page_id are all responses; an empty table gives no
archives; other columns are ignored.

Scale: winners are found on narrow rows (digest, id) with map-side aggregation; groups of one are left out, and a hot
payload's rows meet their winner through :func:`common.attach`.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.common import attach, checkpointed, file_system, shared_folder, small_batches, write_once

# fixed values: the skippable frame's number, the least payload that revisits may share
DICT_FRAME = 0x184D2A5D
LEAST_SHARED = 1000

DICT_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
SEGMENT_BYTES = 16 << 10
LEAST_SAMPLES = 8
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
_ID = "urn:x-page:"


def classified(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, payload, digest (SHA-1), refers_to (null: response)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    # SHA-1 names the payload in the record; SHA-256 decides what is equal
    key = F.when(F.octet_length(payload) >= LEAST_SHARED, F.sha2(payload, 256))
    groups = (pages.select(key.alias("key"), "page_id").where("key IS NOT NULL").groupBy("key")
                   .agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"), key.alias("key"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("winner")), F.col("winner"))
    return attach(rows, checkpointed(groups), "key", "n").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20%]", lambda m: quote(m.group()), url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields, read back. The digest of a response is taken from its payload anew."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda f: int(s) if (s := fields[f][len(_ID) + 1:-1]) else None
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    url = unquote(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None
    return {"page_id": number("WARC-Record-ID"), "url": url, "payload": payload if kind == "response" else None, "payload_bytes": size,
            "payload_digest": digest, "record_type": kind, "refers_to": number("WARC-Refers-To") if "WARC-Refers-To" in fields else None}


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from archived records, or none where they are too few and short."""
    samples = [r[i:i + SEGMENT_BYTES] for r in records for i in range(0, len(r), SEGMENT_BYTES)]
    if len(samples) < LEAST_SAMPLES:
        return None
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, samples)) // 8)), samples)
    except zstandard.ZstdError:
        return None


def write_records(records: Iterator[bytes], folder: str) -> Iterator[tuple[str, int, int]]:
    """Write the records of one task as archives; yields (path, records, bytes) of each."""
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    if not held:
        return
    book = train(held)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=book) if book else zstandard.ZstdCompressor(level=LEVEL)

    def rest() -> Iterator[bytes]:
        yield from held
        held.clear()
        yield from records

    out, name, n, written = None, "", 0, 0
    try:
        for r in rest():
            if out is None:
                name, n, written = f"{folder}/{uuid.uuid4().hex}.warc.zst", 0, 0
                out = write_once(name)
                if book:
                    body = zstandard.ZstdCompressor(level=LEVEL).compress(book.as_bytes())
                    out.write(struct.pack("<II", DICT_FRAME, len(body)) + body)
            frame = packer.compress(r)
            out.write(frame)
            n, written = n + 1, written + len(frame)
            if written >= ARCHIVE_BYTES:
                out.close()
                out = None
                yield name, n, written
        if out is not None:
            out.close()
            out = None
            yield name, n, written
    finally:
        if out is not None:
            out.close()


def read_records(path: str) -> Iterator[bytes]:
    """The records of one archive, in order; a buffer at a time."""
    fs, at = file_system(path)
    with fs.open_input_stream(at, compression=None) as stream:
        data = stream.read(8)
        book = None
        if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICT_FRAME:
            book = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(stream.read(struct.unpack("<I", data[4:])[0])))
            data = b""
        reader = zstandard.ZstdDecompressor(dict_data=book) if book else zstandard.ZstdDecompressor()
        while True:
            frame, parts = reader.decompressobj(), []
            while not frame.eof:
                data = data or stream.read(1 << 20)
                if not data:
                    if parts:
                        raise ValueError(f"{path} ends inside a record")
                    return
                parts.append(frame.decompress(data))
                data = frame.unused_data if frame.eof else b""
            yield b"".join(parts)


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive pages(page_id, url, html); returns the manifest (path, records, bytes), stored beside the archives."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    files = f"{folder}/files"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = lambda x: None if pd.isna(x) else x
        whole = lambda x: None if x is None else int(x)
        # ids travel as text: pandas would turn nullable ones into floats
        rows = (record(whole(p), none(u), body, d, whole(r)) for b in batches for p, u, body, d, r in zip(b["page_id"], b["url"], b["payload"], b["digest"], b["refers_to"]))
        for done in write_records(rows, files):
            yield pd.DataFrame([done], columns=["path", "records", "bytes"])

    rows = classified(pages).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    small_batches(rows).mapInPandas(run, "path string, records long, bytes long").write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """manifest(path) -> a row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, and url and payload if asked for."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * payloads
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for paths in batches:
            for path in paths["path"]:
                held, size = [], 0
                for data in read_records(path):
                    held.append([parse(data)[c] for c in names])
                    size += len(data)
                    if size >= SAMPLE_BYTES:
                        yield _frame(held, names)
                        held, size = [], 0
                if held:
                    yield _frame(held, names)

    # one archive a task: archives are bounded in size, and their number grows with the input
    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInPandas(run, schema)


def _frame(rows: list[list], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.array([r[i] for r in rows], dtype="Int64") if n in ("page_id", "payload_bytes", "refers_to") else [r[i] for r in rows] for i, n in enumerate(names)})
