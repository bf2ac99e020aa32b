"""Substring dedup: repeated runs of words, found by matching against suffix automata of reference shards.

Every window of WINDOW words has an anchor, the first least hash of its GRAM-word runs; equal windows have equal
anchors, so only contexts (neighbouring windows of one anchor's place) whose anchor occurs again are looked at further.

1. A context that occurs again whole is repeated whole.
2. The distinct contexts of every other repeated anchor are reference texts. They are dealt by anchor to shards, each
   shard is built into one suffix automaton with occurrence counts, and its contexts are streamed through it: a span
   of WINDOW words or more whose state occurs at least twice is repeated.
3. Anchors with more than HOT distinct contexts (a very common passage in ever other surroundings) are counted exactly
   by window hash instead, so that no shard grows with a hot passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .scratch import forget, lean, stash
from .wordhash import _power_tables, gram_hashes, mix, slices, utf8, word_hashes

WINDOW, GRAM = 35, 6
HOT = 512
#: Words of reference text that one automaton holds, about.
SHARD_WORDS = 20_000
#: Columns of a document's key.
DOCUMENT = ("key", "more")
_U = np.uint64


def contexts(words: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(anchor, hash, start, windows) of a text's contexts."""
    n = len(words) - window + 1
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    gram = min(GRAM, window)
    value = gram_hashes(words, gram)
    place, width, span = np.arange(len(value)), 1, window - gram + 1

    def least(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(value[right] < value[left], right, left)

    while width * 2 <= span:
        place, width = least(place[:-width], place[width:]), width * 2
    if width < span:
        place = least(place[:n], place[span - width : span - width + n])
    cut = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    size = np.diff(np.append(cut, n))
    return value[place[cut]], run_hashes(words, cut, size + window - 1), cut, size


def run_hashes(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of runs of words, in constant time each."""
    up, down = _power_tables(len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[start + size] - total[start]) * down[start] + size.astype(np.uint64))


class SuffixAutomaton:
    """Generalised suffix automaton of integer sequences, with the number of occurrences of each state's strings."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, text: list[int], weight: int = 1) -> None:
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for c in text:
            p = last
            if c in nxt[p]:
                q = nxt[p][c]
                if length[q] != length[p] + 1:
                    q = self._clone(p, q, c)
                last = q
                count[last] += weight
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[p] + 1)
            link.append(0)
            count.append(weight)
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            last = cur

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length, count = self.next, self.link, self.length, self.count
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        count.append(0)
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def settle(self) -> None:
        """Sums the counts up the links; call it once, after the last text."""
        order = np.argsort(np.array(self.length), kind="stable")[::-1]
        for state in order.tolist():
            if self.link[state] > 0:
                self.count[self.link[state]] += self.count[state]

    def repeated(self, text: list[int], least: int) -> Iterator[int]:
        """Starts of the runs of `least` words of text that occur at least twice."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        state = matched = 0
        for k, c in enumerate(text):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state, matched = nxt[state][c], matched + 1
            else:
                matched = 0
            while length[link[state]] >= least if state else False:
                state = link[state]
                matched = length[state]
            if matched >= least and count[state] >= 2:
                yield k - least + 1


def _runs(starts: list[int]) -> Iterator[tuple[int, int]]:
    """(first, how many) of runs of consecutive numbers."""
    first = before = None
    for s in starts:
        if before is not None and s == before + 1:
            before = s
            continue
        if first is not None:
            yield first, before - first + 1
        first = before = s
    if first is not None:
        yield first, before - first + 1


def _anchor_rows(window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows=1024):
                found = [contexts(w, window) for w in word_hashes(utf8(part.column("text")))]
                anchor, ctx, start, size = (np.concatenate(c) for c in zip(*found, strict=True))
                key, more = (np.repeat(np.asarray(part.column(c)), [len(f[0]) for f in found]) for c in ("key", "more"))
                yield pa.record_batch({"anchor": anchor.view(np.int64), "ctx": ctx.view(np.int64), "key": key, "more": more, "start": start.astype(np.int32), "size": size.astype(np.int32)})

    return scan


def _context_words(window: int):
    """Rows (text, wanted contexts) -> each context's word hashes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows=256):
                out = []
                for key, more, words, rows in zip(part.column("key").to_pylist(), part.column("more").to_pylist(), word_hashes(utf8(part.column("text"))), part.column("wanted").to_pylist(), strict=True):
                    out += [(r["anchor"], key, more, r["start"], r["size"], r["copies"], r["hot"], words[r["start"] : r["start"] + r["size"] + window - 1].tobytes()) for r in rows]
                columns = [*zip(*out, strict=True)] or [()] * 8
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["anchor", *DOCUMENT, "start", "size", "copies", "hot", "words"])

    return cut


def _match(window: int):
    """Contexts in order of their anchors -> repeated ranges (key, more, start, size) of those that occur once."""

    def shard(held: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
        words = [np.frombuffer(h[4], np.uint64) for h in held]
        numbers = np.split(np.unique(np.concatenate(words), return_inverse=True)[1], np.cumsum([len(w) for w in words])[:-1])
        numbers = [n.tolist() for n in numbers]
        automaton = SuffixAutomaton()
        for text, h in zip(numbers, held, strict=True):
            automaton.add(text, h[3])
        automaton.settle()
        for text, h in zip(numbers, held, strict=True):
            if h[3] == 1:
                yield from ((*h[0], h[1] + first, size) for first, size in _runs([*automaton.repeated(text, window)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("anchor", *DOCUMENT, "start", "size", "copies", "words")), strict=True)

        def out(held):
            found = [*zip(*shard(held), strict=True)] or [()] * 4
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
            return pa.record_batch([pa.array(c, t) for c, t in zip(found, types, strict=True)], names=[*DOCUMENT, "start", "size"])

        held, size = [], 0
        for _, group in groupby(rows(), key=lambda r: r[0]):
            for _, key, more, start, n, copies, words in group:
                held.append(((key, more), start, n, copies, words))
                size += len(words) // 8
            if size >= SHARD_WORDS:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    return run


def _window_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, key, more, start, copies, words in zip(*(batch.column(c).to_pylist() for c in ("anchor", *DOCUMENT, "start", "copies", "words")), strict=True):
                words = np.frombuffer(words, np.uint64)
                n = len(words) - window + 1
                got = run_hashes(words, np.arange(n), np.full(n, window))
                yield pa.record_batch({"anchor": np.full(n, anchor), "run": got.view(np.int64), "key": np.full(n, key), "more": np.full(n, more, np.int32), "start": (start + np.arange(n)).astype(np.int32), "copies": np.full(n, copies)})

    return run


def repeated_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, more, ranges): of the text (key, more), windows start..start+size-1 that occur elsewhere; a written table.

    docs: (key, more, text). What is counted or joined is named by two hashes of 64 bits, or 96 bits of a document's
    key, so that no two of them meet by chance at any size of input.
    """
    place = [*DOCUMENT, "start", "size"]
    anchors = stash(docs.mapInArrow(lean(_anchor_rows(window)), "anchor long, ctx long, key long, more int, start int, size int"), "anchors")
    again = stash(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "repeated")
    found = stash(anchors.join(again, "anchor"), "contexts")
    forget(anchors, again)
    kinds = stash(found.groupBy("anchor", "ctx").agg(F.count("*").alias("copies"), F.min(F.struct(*place)).alias("rep")), "kinds")
    twice = kinds.where("copies > 1").select("anchor", "ctx", F.lit(True).alias("twice"))
    whole = found.join(twice, ["anchor", "ctx"], "left").select(*DOCUMENT, F.when(F.col("twice"), F.struct("start", "size")).alias("range"))
    mixed = stash(kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.count_if(F.col("copies") == 1).alias("single")).where("kinds > 1 and single > 0").select("anchor", (F.col("kinds") > HOT).alias("hot")), "mixed")
    wanted = kinds.join(mixed, "anchor").select("rep.key", "rep.more", F.struct("anchor", "rep.start", "rep.size", "copies", "hot").alias("w")).groupBy(*DOCUMENT).agg(F.collect_list("w").alias("wanted"))
    texts = docs.join(wanted, [*DOCUMENT])
    cut = stash(texts.select(*DOCUMENT, "text", "wanted").mapInArrow(lean(_context_words(window)), "anchor long, key long, more int, start int, size int, copies long, hot boolean, words binary"), "words")
    once = cut.dropDuplicates(["anchor", *DOCUMENT, "start"])
    part = stash(once.where("not hot").select("anchor", *place, "copies", "words").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lean(_match(window)), "key long, more int, start int, size int"), "part")
    runs = stash(once.where("hot").select("anchor", *DOCUMENT, "start", "copies", "words").mapInArrow(lean(_window_rows(window)), "anchor long, run long, key long, more int, start int, copies long"), "runs")
    forget(cut)
    common = runs.groupBy("anchor", "run").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor", "run")
    hot = runs.where("copies = 1").join(common, ["anchor", "run"]).select(*DOCUMENT, F.struct("start", F.lit(1).alias("size")).alias("range"))
    part_ranges = part.select(*DOCUMENT, F.struct("start", "size").alias("range"))
    # a context that is not repeated whole has a null range, which collect_set leaves out
    out = stash(whole.unionByName(part_ranges).unionByName(hot).groupBy(*DOCUMENT).agg(F.collect_set("range").alias("ranges")), "ranges")
    forget(found, kinds, mixed, part, runs)
    return out


def _removal(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch)):
            rows, ranges = [], part.column("ranges")
            for k, text in enumerate(utf8(part.column("text"))):
                words = text.split()
                kept, removed = words, 0
                if ranges[k].is_valid:
                    keep = np.ones(len(words), np.int8)
                    for r in ranges[k].as_py():
                        keep[r["start"] : r["start"] + r["size"] + window - 1] = 0
                    kept = [*compress(words, keep.tolist())]
                    removed = len(words) - len(kept)
                joined = b" ".join(kept)
                rows.append((len(words), removed, hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.record_batch([part.column("row"), *columns], names=["row", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, text_column: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """Each row as struct `row` (without its text), with n_words, n_removed, kept_sha256 and, if asked, kept_text.

    Windows are judged on the input. A null or empty text has no words. Rows that repeat another, id included, are
    texts of their own, so what they share is removed from both. A text of fewer words than a window keeps all. Columns
    of docs may have any names. An empty table gives no rows.
    """
    others = F.struct(*(F.col(c) for c in docs.columns if c != text_column)) if len(docs.columns) > 1 else F.struct(F.lit(0).alias("none"))
    source = docs.select(others.alias("row"), F.col(text_column).cast("string").alias("text"))
    source = source.withColumn("key", F.xxhash64("row", "text")).withColumn("more", F.hash("text", F.lit(7), "row"))
    ranges = repeated_ranges(source.select(*DOCUMENT, "text"), window)
    schema = StructType([source.schema["row"], *(StructField(n, t) for n, t in (("n_words", LongType()), ("n_removed", LongType()), ("kept_sha256", StringType()), ("kept_text", StringType())))])
    out = source.join(ranges, [*DOCUMENT], "left").select("row", "text", "ranges").mapInArrow(lean(_removal(window, with_text)), schema)
    return out if with_text else out.drop("kept_text")
