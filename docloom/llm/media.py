"""Media columns: ISO media containers (ISO/IEC 14496-12).

`to_media` stores each text as a lossless 8-bit grey video: frames of 16 x 12 samples, one per 192 bytes. `probe`
walks the nested boxes of stored files, decodes the sample tables, and gives codec, duration and the byte ranges of
key frames without decoding payloads; `payload` follows the same tables to the stored samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bounded, lean, stash

WIDTH, HEIGHT = 16, 12
FRAME = WIDTH * HEIGHT
TIMESCALE, SAMPLES_PER_CHUNK, KEY_EVERY = 24, 16, 8
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}
#: Bytes of media that a yielded batch aims at.
BATCH_BYTES = 16 << 20


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"qt  ")
_ENTRY = box(b"raw ", bytes(6), struct.pack(">HHH12xHHIIIH", 1, 0, 0, WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
_HDLR = full_box(b"hdlr", bytes(4), b"vide", bytes(12), b"text as samples\0")
_VMHD = full_box(b"vmhd", bytes(8), flags=1)
_DINF = box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1)))
_STSD = full_box(b"stsd", struct.pack(">I", 1), _ENTRY)


def padded(text: bytes) -> bytes:
    """The text, then bytes 32 up to a positive multiple of the frame size."""
    return text + b" " * (FRAME - len(text) if len(text) < FRAME else -len(text) % FRAME)


def encode(payload: bytes) -> bytes:
    """A file of ftyp, moov and mdat with the payload as frames; 64-bit boxes and offsets where sizes ask for them."""
    n = len(payload) // FRAME
    chunks = -(-n // SAMPLES_PER_CHUNK)
    last = n - (chunks - 1) * SAMPLES_PER_CHUNK
    runs = [(1, SAMPLES_PER_CHUNK, 1)] if last == SAMPLES_PER_CHUNK else [(1, last, 1)] if chunks == 1 else [(1, SAMPLES_PER_CHUNK, 1), (chunks, last, 1)]
    keys = range(1, n + 1, KEY_EVERY)
    wide = len(payload) >= 1 << 31
    stbl = [
        _STSD, full_box(b"stts", struct.pack(">III", 1, n, 1)), full_box(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
        full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)), full_box(b"stsz", struct.pack(">II", FRAME, n)),
    ]

    def moov(base: int) -> bytes:
        offsets = [base + k * SAMPLES_PER_CHUNK * FRAME for k in range(chunks)]
        table = full_box(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets))
        mdhd = full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0))
        mdia = box(b"mdia", mdhd, _HDLR, box(b"minf", _VMHD, _DINF, box(b"stbl", *stbl, table)))
        tkhd = full_box(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, n, 0, 0, 0, 0), _MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=7)
        mvhd = full_box(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, n, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = len(_FTYP) + len(moov(0)) + (16 if wide else 8)
    return b"".join((_FTYP, moov(head), box(b"mdat", payload)))


def walk(data, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, body end) of every box, outer boxes first; a box cut off by the end of the file ends the walk."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                return
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield (*path, kind), start + head, start + size
        if kind in CONTAINERS:
            yield from walk(data, start + head, start + size, (*path, kind))
        start += size


class SampleTable:
    """Codec, times and places of one track's samples, from its boxes alone."""

    def __init__(self, data):
        boxes = {p[-1]: (a, b) for p, a, b in walk(data)}
        missing = {b"mdhd", b"stsd", b"stts", b"stsc", b"stsz"} - boxes.keys()
        if missing or not boxes.keys() & {b"stco", b"co64"}:
            raise ValueError(f"no complete sample table: {sorted(missing)}")
        table = lambda kind, form, skip=8: [*struct.iter_unpack(form, data[boxes[kind][0] + skip : boxes[kind][1]])]
        at = boxes[b"mdhd"][0]
        long = data[at] == 1
        self.timescale, self.duration = struct.unpack_from(">IQ" if long else ">II", data, at + (20 if long else 12))
        self.codec = bytes(data[boxes[b"stsd"][0] + 12 : boxes[b"stsd"][0] + 16]).decode("latin-1")
        self.same, self.count = struct.unpack_from(">II", data, boxes[b"stsz"][0] + 4)
        self.sizes = None if self.same else [x[0] for x in table(b"stsz", ">I", 12)]
        self.times = table(b"stts", ">II")
        self.chunks = [x[0] for x in (table(b"co64", ">Q") if b"co64" in boxes else table(b"stco", ">I"))]
        self.runs = table(b"stsc", ">III")
        self.keys = [x[0] for x in table(b"stss", ">I")] if b"stss" in boxes else range(1, self.count + 1)

    def samples(self) -> Iterator[tuple[int, int]]:
        """(offset, size) of each sample, in order."""
        sample = 0
        for k, (first, per_chunk, _) in enumerate(self.runs):
            stop = self.runs[k + 1][0] if k + 1 < len(self.runs) else len(self.chunks) + 1
            for chunk in range(first, stop):
                at = self.chunks[chunk - 1]
                for _ in range(per_chunk):
                    size = self.same or self.sizes[sample]
                    yield at, size
                    at, sample = at + size, sample + 1

    def key_ranges(self) -> list[tuple[int, int]]:
        places = [*self.samples()]
        return [places[k - 1] for k in self.keys]


def payload(data, table: SampleTable) -> bytes:
    """The stored samples, one after the other; neighbouring ones are read in one piece."""
    parts, start, end = [], None, None
    for at, size in table.samples():
        if at != end:
            if start is not None:
                parts.append(data[start:end])
            start = at
        end = at + size
    return b"".join([*parts, data[start:end]]) if start is not None else b""


def _encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, size, at, made, n = batch.column("id"), 0, 0, [], []
        for k, text in enumerate(batch.column("text").cast("binary")):
            text = text.as_py() or b""
            made.append(encode(padded(text)))
            n.append(len(text))
            size += len(made[-1])
            if size >= BATCH_BYTES or k + 1 == batch.num_rows:
                yield pa.record_batch({"id": ids[at : k + 1], "n_bytes": pa.array(n, pa.int64()), "media": pa.array(made, pa.large_binary() if size >= 1 << 31 else pa.binary())})
                size, at, made, n = 0, k + 1, [], []


def _probe_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for media in batch.column("media"):
            data = memoryview(media.as_buffer())
            table = SampleTable(data)
            stored, keys = payload(data, table), table.key_ranges()
            rows.append((len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-16:]), len(data), hashlib.sha256(data).hexdigest(), table.codec, table.duration / table.timescale, table.count, [{"offset": a, "bytes": b} for a, b in keys]))
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "codec", "seconds", "samples", "keyframes")
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.struct([("offset", pa.int64()), ("bytes", pa.int64())])))
        columns = [*zip(*rows, strict=True)] or [()] * len(names)
        yield pa.record_batch({"id": batch.column("id"), "n_bytes": batch.column("n_bytes"), **{n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)}})


def to_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as a stored file, in a written table.

    A null or empty text is stored as one frame of spaces; a very long one takes as many frames as it needs, with
    64-bit offsets where 32 bits do not do. Every row, repeated or with a null id, comes back once; equal texts give
    equal files. Other columns are dropped, whatever their names. An empty table gives no rows.
    """
    bounded(docs.sparkSession)
    made = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(lean(_encode_rows), "id long, n_bytes long, media binary")
    return stash(made, "media")


def probe(media: DataFrame) -> DataFrame:
    """Container features of stored files, one row per row; a file without a complete sample table raises ValueError.

    An empty table gives no rows; repeated rows each come back.
    """
    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, seconds double, samples long, keyframes array<struct<offset:long,bytes:long>>"
    return media.mapInArrow(lean(_probe_rows), schema)
