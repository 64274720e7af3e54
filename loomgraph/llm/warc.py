"""WARC archives of pages, compressed record by record with a Zstandard dictionary of their own.

An archive starts with a skippable frame that holds its dictionary, built from records that it archives; each record is
one frame after it.  A payload that is archived already becomes a revisit of that record.  Archives are rows of a table
in the cluster's shared storage, each the bytes of one ``.warc.zst`` file.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, prepared

#: Fixed values of the file format.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Raw bytes of an archive before the next one starts, of the sample for its dictionary, and of the dictionary.
ARCHIVE_BYTES = 8 << 20
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10

RECORD_COLUMNS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = "" if page_id is None else str(page_id)
    target = "".join((url or "").split()) or f"urn:page:{name}"
    headers = [("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http;msgtype=response")]
    if not revisit:
        return record("response", headers, http + payload)
    return record("revisit", [*headers, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")], http)


def archive(records: list[bytes]) -> bytes:
    """The bytes of one archive."""
    sample, size = [], 0
    for r in records:
        if size < SAMPLE_BYTES:
            sample.append(r)
            size += len(r)
    try:
        built = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 8)), sample)
    except zstandard.ZstdError:  # too few or too even records to learn from: the records' own bytes serve as one
        built = zstandard.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content = built.as_bytes()
    out = [struct.pack("<II", DICTIONARY_FRAME, len(content)), content]
    compress = zstandard.ZstdCompressor(level=3, dict_data=built, write_checksum=True).compress
    return b"".join([*out, *map(compress, records)])


def records_of(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive: headers (names in lower case) and block."""
    magic, size = struct.unpack_from("<II", content)
    if magic != DICTIONARY_FRAME:
        raise ValueError("an archive starts with its dictionary")
    stored = content[8 : 8 + size]
    trained = stored[:4] == struct.pack("<I", 0xEC30A437)
    known = zstandard.ZstdCompressionDict(stored, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=known).stream_reader(memoryview(content)[8 + size :], read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError("a record starts with its version")
        headers = {}
        while line := stream.readline().decode().rstrip("\r\n"):
            name, _, value = line.partition(":")
            headers[name.lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record ends with two empty lines")
        yield headers, block


def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, refers_to, revisit``: of equal payloads that are long enough, the largest ``page_id`` responds.

    Counts come from partial aggregates over digests and are written first, so the join back is one of two shuffles,
    which Spark splits where a digest is very common.  Repeated rows of the largest id all respond.  Null ids come
    before all others.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha2("payload", 256))
    shared = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(cut(shared), "sha", "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("original")).alias("refers_to"), revisit.alias("revisit"))


def archives(pages: DataFrame, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``name, n_records, content``: archives of all rows of ``pages`` (``page_id, url, html``; null html is empty)."""
    prepared(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, held, size, k = TaskContext.get().partitionId(), [], 0, 0

        def row() -> pa.RecordBatch:
            name = f"part-{task:06d}-{k:06d}.warc.zst"
            info = record("warcinfo", [("WARC-Record-ID", f"<urn:archive:{name}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([archive([info, *held])], pa.binary())], names=["name", "n_records", "content"])

        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(page_record(*values, date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield row()
                    held, size, k = [], 0, k + 1
        if held:
            yield row()

    return with_originals(pages, least_bytes).mapInArrow(write, "name string, n_records long, content binary")


def read(archive_rows: DataFrame, payloads: bool = False) -> DataFrame:
    """The page records of archives (column ``content``; ``binaryFile`` rows will do): RECORD_COLUMNS, and ``payload`` if asked.

    The digest of a response is computed anew from what is read and must be the one in its header.  A revisit's payload
    is null; its length and digest are those its headers state for the full payload.
    """
    prepared(archive_rows.sparkSession)
    columns = RECORD_COLUMNS + ", payload binary" * payloads

    def page(headers: dict[str, str], block: bytes) -> dict:
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = headers["warc-payload-digest"].removeprefix("sha1:")
        size = int(http.decode().lower().split("content-length:")[1].split("\r\n")[0])
        number = lambda name: int(x) if (x := headers.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
        revisit = headers["warc-type"] == "revisit"
        if not revisit and (len(payload) != size or digest(payload) != stated):
            raise ValueError(f"damaged payload in {headers['warc-record-id']}")
        return {"page_id": number("warc-record-id"), "payload_bytes": size, "payload_digest": stated, "record_type": headers["warc-type"], "refers_to": number("warc-refers-to"), "payload": None if revisit else payload}

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *[("payload", pa.binary())] * payloads])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = [page(*r) for r in records_of(content.as_py()) if r[0]["warc-type"] != "warcinfo"]
                yield pa.RecordBatch.from_pylist([{k: v for k, v in r.items() if k in schema.names} for r in found], schema=schema)

    return archive_rows.select("content").mapInArrow(run, columns)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives of all pages written as a table below the shared checkpoint folder (or at ``folder``), and read back.

    One row a row of ``pages``: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.  Null html is an
    empty payload, a null url a ``urn:``; repeated rows are archived each for itself; other columns are ignored; an
    empty table gives an empty result.
    """
    spark = prepared(pages.sparkSession)
    folder = folder or f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    archives(pages).write.parquet(folder)
    return read(spark.read.schema("name string, n_records long, content binary").parquet(folder))


def to_files(archive_rows: DataFrame, folder: str) -> DataFrame:
    """Each archive as a file in ``folder``, a path that all executors mount; returns ``name, bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open(f"{folder}/{name}.part", "wb") as file:
                    file.write(content)
                os.replace(f"{folder}/{name}.part", f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c.as_py()) for c in batch.column(1)], pa.int64())], names=["name", "bytes"])

    return archive_rows.select("name", "content").mapInArrow(run, "name string, bytes long")
