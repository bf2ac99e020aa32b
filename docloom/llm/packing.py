"""Packing documents into fixed-length sequences along a Hilbert curve.

Every document's token vector is hashed and projected to a few dimensions; its Hilbert key orders it on the curve. The
documents are range-sorted by that key, and each range is packed in curve order by one task: documents follow each
other, and one is cut where a sequence is full. Cuts fall on multiples of GRAIN tokens, where the scan has
kept the document's running CRC, so token ids are never shuffled; at most GRAIN - 1 tokens of a sequence are padding,
beside the end of each range's last sequence.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import lean, stash
from .wordhash import slices, utf8

SEQUENCE, END_ID, GRAIN = 4096, 2, 16
DIMENSIONS, AXIS_BITS = 3, 10
#: Distinct words whose ids a worker keeps (about 250 MB), and the greatest length of one; longer words are encoded each
#: time.
CACHED_WORDS, CACHED_LENGTH = 1_000_000, 40
#: Tokens of a range of the curve, about, and the most ranges; with more tokens than that allows, ranges are longer.
RANGE_TOKENS, MOST_RANGES = 1 << 20, 20_000


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Words that need no Unicode normalisation, of characters whose lower case and class are beyond doubt.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_id = attrgetter("id")
_LAYOUT = [struct.Struct(f"<{n}I") for n in range(24)]
#: Marks that are a piece of their own after a word.
_STOPS = {b".", b",", b";", b":", b"!", b"?", b")"}
# The pieces that the vocabulary's pre-tokenizer splits words into.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, int]:
    """Byte-level letters: bytes that print stand for themselves, the others for code points from 256 on, in order."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return dict(zip([b for b in range(256) if b not in prints], range(256, 512), strict=False))


class WordIds:
    """Token ids of texts by words; the tokenizer's pieces never span ASCII white space, so each word is encoded once.

    Plain words are split into pieces here and only new pieces go to the tokenizer's model; all others, and words that
    hold the start of a special token, go through the whole tokenizer. Known words are kept in two generations: when
    the young one is full it becomes the old one, from which words in use are taken over again.
    """

    def __init__(self, path: str):
        self.tokenizer, self.known, self.old, self.pieces = _tokenizer(path), {}, {}, {}
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = [*map(_id, self.model.tokenize(letters))]
            got = _LAYOUT[len(ids)].pack(*ids) if len(ids) < len(_LAYOUT) else np.array(ids, "<u4").tobytes()
            if len(piece) <= CACHED_LENGTH:
                if len(self.pieces) >= CACHED_WORDS // 2:
                    self.pieces.clear()
                self.pieces[piece] = got
        return got

    def _encode(self, word: bytes) -> bytes:
        if word.isalpha():
            return self._piece(word.lower().decode())
        if word[:-1].isalpha() and word[-1:] in _STOPS:
            return self._piece(word[:-1].lower().decode()) + self._piece(word[-1:].decode())
        text = word.decode()
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self._piece, _PIECES.findall(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        got = self.known.get(word)
        if got is None:
            got = self.old.get(word)
            if got is None:
                got = self._encode(word)
            if len(word) <= CACHED_LENGTH:
                if len(self.known) >= CACHED_WORDS // 2:
                    self.known, self.old = {}, self.known
                self.known[word] = got
        return got

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for text in texts:
            words = text.split()
            got = [*map(self.known.get, words)]
            if None in got:
                for at, one in enumerate(got):
                    if one is None:
                        got[at] = self._word(words[at])
            out.append(b"".join(got))
        return out


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


@cache
def _directions() -> np.ndarray:
    """Per token id (hashed to 256 signed features) its projection."""
    rng = np.random.Generator(np.random.PCG64(5))
    features, ids = rng.standard_normal((256, DIMENSIONS)).astype(np.float32), np.arange(1 << 16, dtype=np.uint64)
    h = ids * np.uint64(0x9E3779B97F4A7C15)
    sign = np.where(h >> np.uint64(63), 1, -1).astype(np.float32)
    return features[(h >> np.uint64(40)).astype(np.int64) & 255] * sign[:, None]


def hilbert(axes: np.ndarray, bits: int = AXIS_BITS) -> np.ndarray:
    """Keys along the Hilbert curve of integer points (rows), by the transpose form of Skilling (2004)."""
    x = axes.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _curve_keys(ids: list[bytes]) -> np.ndarray:
    table, mean = _directions(), np.zeros((len(ids), DIMENSIONS))
    for k, doc in enumerate(ids):
        if doc:
            mean[k] = table[np.frombuffer(doc, "<u4") & 0xFFFF].mean(axis=0)
    return hilbert(np.minimum((np.tanh(mean * 2) + 1) / 2 * (1 << AXIS_BITS), (1 << AXIS_BITS) - 1))


def _scan(path: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_ids(path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, rows=256):
                ids = encode(utf8(part.column("text")))
                keys, crcs = _curve_keys(ids), []
                for doc in ids:
                    doc = memoryview(doc + end)
                    crc, row = 0, []
                    for k in range(0, len(doc), 4 * GRAIN):
                        crc = zlib.crc32(doc[k : k + 4 * GRAIN], crc)
                        row.append(crc)
                    crcs.append(np.array(row, "<u4").tobytes())
                yield pa.record_batch({"id": part.column("id"), "key": pa.array(keys), "tokens": pa.array([len(d) // 4 + 1 for d in ids], pa.int64()), "crcs": pa.array(crcs, pa.binary())})

    return scan


@cache
def _shift_tables() -> list[list[list[int]]]:
    """For 2**k zero bytes after a CRC: its new value, by each byte of it."""
    step = [[(zlib.crc32(b"\0", b << 8 * i) ^ zlib.crc32(b"\0")) for b in range(256)] for i in range(4)]
    out = [step]
    for _ in range(40):
        out.append([[_apply(step, step[i][b]) for b in range(256)] for i in range(4)])
        step = out[-1]
    return out


def _apply(step: list[list[int]], crc: int) -> int:
    return step[0][crc & 255] ^ step[1][crc >> 8 & 255] ^ step[2][crc >> 16 & 255] ^ step[3][crc >> 24]


def crc_between(first: int, both: int, n: int) -> int:
    """CRC of the last n bytes, from that of what stands before them and that of all."""
    k = 0
    while n:
        if n & 1:
            first = _apply(_shift_tables()[k], first)
        n, k = n >> 1, k + 1
    return first ^ both


def pack_group(rows: Iterator[tuple[object, int, bytes]]) -> Iterator[tuple]:
    """(id, tokens, crcs) in order -> (id, start, length, crc, tokens, sequence, offset)."""
    sequence = offset = 0
    for name, tokens, crcs in rows:
        kept, start = np.frombuffer(crcs, "<u4"), 0
        while start < tokens:
            room = SEQUENCE - offset
            take = tokens - start if tokens - start <= room else room // GRAIN * GRAIN
            if take:
                crc = int(kept[-(-(start + take) // GRAIN) - 1])
                if start:
                    crc = crc_between(int(kept[start // GRAIN - 1]), crc, 4 * take)
                yield name, start, take, crc, tokens, sequence, offset
                start, offset = start + take, offset + take
            if start < tokens or offset == SEQUENCE:
                sequence, offset = sequence + 1, 0


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), [pa.int64()] * 7
    held, place = [], TaskContext.get().partitionId()

    def rows():
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield from zip(*(part.column(c).to_pylist() for c in ("id", "tokens", "crcs")), strict=True)

    def batch():
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    for name, start, take, crc, tokens, sequence, offset in pack_group(rows()):
        held.append((name, start, take, crc, tokens, (place << 40) + sequence, offset))
        if len(held) >= 20_000:
            yield batch()
            held = []
    if held:
        yield batch()


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def pack(docs: DataFrame, tokenizer: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset), each token of each row in one of them.

    A null or empty text is the end id alone. Rows that repeat an id, or have none, are documents of their own. Ties on
    the curve go by id; equal rows in any order. Other columns are dropped, whatever their names. An empty table gives
    no pieces. A very long text is cut over as many sequences as it needs.
    """
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    scanned = stash(source.mapInArrow(lean(_scan(tokenizer or default_tokenizer())), "id long, key long, tokens long, crcs binary"), "tokens")
    total = scanned.agg(F.sum("tokens")).first()[0] or 0
    ranges = min(max(total // RANGE_TOKENS, 1), MOST_RANGES)
    # rows that share a key, of copies or of one id, are spread by the hash of what they hold
    order = ["key", "id", F.xxhash64("crcs")]
    ranged = scanned.repartitionByRange(int(ranges), *order).sortWithinPartitions(*order)
    out = ranged.select("id", "tokens", "crcs").mapInArrow(lean(_fold), "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_column)
