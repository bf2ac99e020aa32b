"""WARC archives as a chunked record table.

`write_archives` streams one record per page into gzip members of WARC/1.1 files in a shared folder; a payload that
occurs again is a revisit of the page with the least id. `read_chunks` streams archives back as rows of record and
chunk number, each with the digest of the payload up to its end, so that no record is ever held whole.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import lean, new_path, stash

CHUNK_BYTES = 64 << 10
LEVEL = 1
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "archive string, record_no long, record_id string, page_id long, record_type string, refers_to long, target_uri string, payload_digest string, payload_bytes long, chunk_no long, chunk_offset long, chunk_bytes long, data binary, digest_so_far string, last boolean"


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def base32(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, digest, first: the least page_id with an equal payload of at least min_bytes, else null."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html")).withColumn("digest", F.sha1("html"))
    large = rows.where(F.length("html") >= min_bytes)
    firsts = stash(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first"), "firsts")
    return rows.join(firsts, "digest", "left")


def _header(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def _write(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        # the name is new in every attempt; only files named by a finished task are ever read
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        records, out = 0, None
        for batch in batches:
            for page, url, html, first in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html"), batch.column("first").to_pylist(), strict=True):
                out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                payload = memoryview(html.as_buffer())
                sha1 = hashlib.sha1()
                for at in range(0, len(payload), CHUNK_BYTES):
                    sha1.update(payload[at : at + CHUNK_BYTES])
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                again = first is not None and first != page
                head = _header([
                    ("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", f"<urn:x-page:{'none' if page is None else page}>"), ("WARC-Date", DATE),
                    ("WARC-Target-URI", None if url is None else " ".join(url.split())), ("WARC-Payload-Digest", f"sha1:{base32(sha1)}"),
                    ("WARC-Profile", PROFILE if again else None), ("WARC-Refers-To", f"<urn:x-page:{first}>" if again else None),
                    ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(http) + (0 if again else len(payload))),
                ])
                zipped = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                out.write(zipped.compress(head + http))
                if not again:
                    for at in range(0, len(payload), CHUNK_BYTES):
                        out.write(zipped.compress(payload[at : at + CHUNK_BYTES]))
                out.write(zipped.compress(b"\r\n\r\n") + zipped.flush())
                records += 1
        if out:
            out.close()
            yield pa.record_batch({"archive": pa.array([f"{folder}/{name}"]), "records": pa.array([records], pa.int64())})

    return write


def write_archives(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes the archives; returns their manifest (archive, records), itself a written table.

    Null html is an empty payload; a null url leaves its header out; a null page_id is written as 'none' and is first
    of a payload only if all its pages are. Rows that repeat the least page_id of a payload are responses too. Other
    columns are dropped, whatever their names. Of an empty table there are no archives.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    return stash(roles(pages, min_bytes).select("page_id", "url", "html", "first").mapInArrow(_write(folder), "archive string, records long"), "manifest")


class _Members:
    """Bytes of a file of gzip members, read and unzipped in small pieces."""

    def __init__(self, stream):
        self.stream, self.zip, self.raw, self.held = stream, zlib.decompressobj(31), b"", bytearray()

    def more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.stream.read(CHUNK_BYTES)
                if not self.raw:
                    return False
            got = self.zip.decompress(self.raw, CHUNK_BYTES)
            self.raw = self.zip.unconsumed_tail
            if self.zip.eof:
                # at its end a member that once left a tail gives what follows both as tail and as unused data
                self.raw, self.zip = self.zip.unused_data, zlib.decompressobj(31)
            if got:
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.held.find(mark)) < 0:
            if not self.more():
                return None
        out = bytes(self.held[: at + len(mark)])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:] if line)}


def _page(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").rpartition(":")[2]
    return int(number) if number.lstrip("-").isdigit() else None


def _read(data: bool, batch_bytes: int = 8 << 20):
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in CHUNKS.split(", ")])

    def rows(archive: str) -> Iterator[tuple]:
        store, path = _filesystem(archive)
        with store.open_input_stream(path, compression=None) as stream:
            source, number = _Members(stream), 0
            while (head := source.until(b"\r\n\r\n")) is not None:
                meta = _fields(head)
                http = source.until(b"\r\n\r\n")
                left = int(meta["content-length"]) - len(http)
                whole = int(_fields(http).get("content-length", left))
                record = (archive, number, meta["warc-record-id"], _page(meta["warc-record-id"]), meta["warc-type"], _page(meta.get("warc-refers-to")), meta.get("warc-target-uri"))
                sha1, offset, chunk = hashlib.sha1(), 0, 0
                while True:
                    piece = source.take(min(left, CHUNK_BYTES))
                    if len(piece) < min(left, CHUNK_BYTES):
                        raise EOFError(f"{archive} ends within record {number}")
                    sha1.update(piece)
                    left -= len(piece)
                    said, now = meta["warc-payload-digest"].removeprefix("sha1:"), base32(sha1)
                    if not left and meta["warc-type"] == "response" and said != now:
                        raise ValueError(f"{archive}: payload digest of record {number} does not hold")
                    yield (*record, said, whole, chunk, offset, len(piece), piece if data else None, now, not left)
                    offset, chunk = offset + len(piece), chunk + 1
                    if not left:
                        break
                if source.take(4) != b"\r\n\r\n":
                    raise ValueError(f"{archive}: record {number} has no end mark")
                number += 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                held, size = [], 0
                for row in rows(archive):
                    held.append(row)
                    size += 400 + (row[11] if data else 0)
                    if size >= batch_bytes:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    return read


def read_chunks(manifest: DataFrame, data: bool = True) -> DataFrame:
    """Rows of CHUNKS, one per record and chunk, for every archive. Without data the chunks' bytes stay null. The
    digest_so_far of a record's last chunk is that of its payload. A revisit has one empty chunk, and the digest and
    length that its headers state. A truncated or altered archive raises. Of an empty manifest there are no rows."""
    spark = manifest.sparkSession
    files = manifest.select("archive").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return files.mapInArrow(lean(_read(data)), CHUNKS)


def archived_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes and reads back; per page: page_id, payload_bytes, payload_digest, record_type, refers_to, chunks.

    What is said of a record comes from the row of its last chunk. Nulls, repeats, ties and empty tables are as in
    write_archives; every row of pages comes back once.
    """
    ends = read_chunks(write_archives(pages, min_bytes), data=False).where("last")
    response = F.col("record_type") == "response"
    return ends.select(
        "page_id", F.when(response, F.col("chunk_offset") + F.col("chunk_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to", (F.col("chunk_no") + 1).alias("chunks"),
    )
