"""Vectorised 64-bit word hashes: words are runs of bytes other than 0x20 and 0x09-0x0D."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np

BLOCK = 1 << 20
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, dtype=np.uint64) | _U(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising bijection of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers.append(np.multiply.accumulate(row))
        _powers[:] = _powers[-2:]
    return _powers[0], _powers[1]


def _block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of one block."""
    buf = np.frombuffer(data, np.uint8)
    if not len(buf):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    gap = np.ones(len(buf) + 2, np.int8)
    gap[1:-1] = _SPACE[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power_tables(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), starts


def _pieces(text: bytes) -> Iterable[bytes]:
    """A long text in blocks that end at white space (or run on to it)."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def word_hashes(texts: Sequence[bytes]) -> list[np.ndarray]:
    """One array of word hashes per text; memory follows BLOCK and the longest text's word count."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            hashes, starts = _block(b" ".join(group))
            ends = np.cumsum([len(t) + 1 for t in group])
            out.extend(np.split(hashes, np.searchsorted(starts, ends[:-1])))
        group.clear()
        size = 0

    for text in texts:
        if len(text) > BLOCK:
            flush()
            out.append(np.concatenate([_block(p)[0] for p in _pieces(text)]))
            continue
        if size + len(text) > BLOCK:
            flush()
        group.append(text)
        size += len(text) + 1
    flush()
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, by start; empty when there are fewer."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total = total * _U(0xD6E8FEB86659FD93) + words[k : k + m]
    return mix(total)


def run_hash(words: np.ndarray) -> int:
    """Hash of one whole run of words."""
    return int(gram_hashes(words, len(words))[0]) if len(words) else 0


def utf8(column) -> list[bytes]:
    """An Arrow string column as bytes; nulls as empty."""
    return [t or b"" for t in column.cast("binary").to_pylist()]


def slices(batch, column: str = "text", rows: int = 512, size: int = 2 << 20) -> Iterator:
    """A batch in parts of at most so many rows and about so many bytes of a text column; one long text is a part alone."""
    import pyarrow.compute as pc

    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of one text's words."""
    parts, at = [], 0
    for piece in _pieces(text):
        hashes, starts = _block(piece)
        gap = np.ones(len(piece) + 1, bool)
        gap[:-1] = _SPACE[np.frombuffer(piece, np.uint8)]
        stops = np.flatnonzero(gap)
        parts.append((hashes, starts + at, stops[np.searchsorted(stops, starts)] + at))
        at += len(piece)
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))
