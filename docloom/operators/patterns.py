"""Many patterns in many texts at once: Aho-Corasick automata of shards of patterns, texts streamed through them.

Few patterns go to all tasks that read texts. More are dealt to shards of bounded size and every text meets every shard,
so that neither side has to fit into one task: a shard's rows come before its texts, and a task builds the automaton of
its shard and then reads text after text.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

try:
    import ahocorasick
except ImportError:  # the automaton below is used
    ahocorasick = None

SHARD, CHARS, BATCH = 100_000, 8 << 20, 4096


class Automaton:
    """All occurrences of a set of words in one pass; for where the native automaton is missing."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for number, word in enumerate(words):
            at = 0
            for c in word:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                at = self.next[at][c]
            self.ends[at].append(number)
        self.back = [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            at = queue.popleft()
            for c, to in self.next[at].items():
                queue.append(to)
                state = self.back[at]
                while state and c not in self.next[state]:
                    state = self.back[state]
                self.back[to] = self.next[state].get(c, 0) if self.next[state].get(c, 0) != to else 0
                self.ends[to] = self.ends[to] + self.ends[self.back[to]]

    def iter(self, text: str) -> Iterator[tuple[int, int]]:
        """(place of the last character, number of the word)."""
        at = 0
        for k, c in enumerate(text):
            while at and c not in self.next[at]:
                at = self.back[at]
            at = self.next[at].get(c, 0)
            for number in self.ends[at]:
                yield k, number


def automaton(words: list[str]):
    """Something whose iter(text) gives (place of the last character, number of the word)."""
    if ahocorasick is None or not words:
        return Automaton(words)
    made = ahocorasick.Automaton()
    for number, word in enumerate(words):
        made.add_word(word, number)
    made.make_automaton()
    return made


def whole(text: str, start: int, end: int) -> bool:
    """Does no word character touch text[start:end] from outside?"""
    return not (start and _word(text[start - 1])) and not (end < len(text) and _word(text[end]))


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def folded(text: str) -> str:
    """Lower case of the same length: a character whose lower case is several stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def searcher(held: list[tuple], whole_words: bool) -> Callable[[str], dict[int, list[int]]]:
    """held (name, pattern, exact) -> a function that gives the places of each pattern in a text, by its slot in held."""
    words = [sorted({p if e else folded(p) for _, p, e in held if e == exact}) for exact in (False, True)]
    slots: list[dict[str, list[int]]] = [{}, {}]
    for slot, (_, p, e) in enumerate(held):
        slots[e].setdefault(p if e else folded(p), []).append(slot)
    scans = [automaton(w) for w in words]

    def search(text: str) -> dict[int, list[int]]:
        places: dict[int, list[int]] = {}
        for exact in (0, 1):
            if words[exact]:
                for last, number in scans[exact].iter(text if exact else folded(text)):
                    word = words[exact][number]
                    start = last + 1 - len(word)
                    if not whole_words or whole(text, start, last + 1):
                        for slot in slots[exact][word]:
                            places.setdefault(slot, []).append(start)
        return places

    return search


def found_in(texts: DataFrame, patterns: DataFrame, whole_words: bool = True, shard: int = SHARD) -> DataFrame:
    """(text_id, pattern_id, places): where the patterns that occur in a text begin, in order.

    texts (text_id, text), patterns (pattern_id, pattern, exact): exact patterns mind their case. Empty and null patterns
    and texts have no places. whole_words: no letter, digit or underscore touches an occurrence. Patterns that are
    counted to be at most `shard`, and CHARS characters, go to the tasks that read the texts; more are dealt to shards.
    """
    kinds = [texts.schema["text_id"].dataType, patterns.schema["pattern_id"].dataType]
    types = [to_arrow_type(t) for t in kinds]
    known = patterns.where("pattern <> ''").select("pattern_id", "pattern", F.coalesce("exact", F.lit(False)).alias("exact"))
    read = texts.where("text <> ''").select("text_id", "text")

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [[r[k] for r in rows] for k in range(3)]
        rows.clear()
        return pa.record_batch([pa.array(columns[0], types[0]), pa.array(columns[1], types[1]), pa.array(columns[2], pa.list_(pa.int32()))], names=["text_id", "pattern_id", "places"])

    out = f"text_id {kinds[0].simpleString()}, pattern_id {kinds[1].simpleString()}, places array<int>"
    n, chars = known.agg(F.count("*"), F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()
    if n <= shard and chars <= CHARS:
        few = [tuple(r) for r in known.select(F.struct("pattern_id"), "pattern", "exact").collect()]  # within the bounds just counted
        few = [(name["pattern_id"], p, e) for name, p, e in few]

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search, rows = searcher(few, whole_words), []
            for batch in batches:
                for text_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    rows += [(text_id, few[slot][0], sorted(at)) for slot, at in search(text.as_py()).items()]
                    if len(rows) >= BATCH:
                        yield batch_of(rows)
            if rows:
                yield batch_of(rows)

        return read.mapInArrow(stream, out)
    shards = ceil(n / shard)
    copies = ceil(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) / shards)
    none = lambda c, of: F.lit(None).cast(of.schema[c].dataType).alias(c)
    dealt = known.select(F.pmod(F.xxhash64("pattern_id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "pattern_id", "pattern", "exact", none("text_id", read), none("text", read))
    asked = read.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("text_id"), F.lit(copies)).cast("int").alias("copy"), none("pattern_id", known), none("pattern", known), none("exact", known), "text_id", "text")
    both = dealt.unionByName(asked).repartition(shards * copies, "shard", "copy").sortWithinPartitions("shard", "copy", F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, search = None, [], None
        rows: list[tuple] = []
        for batch in batches:
            for at, copy, name, pattern, exact, text_id, text in zip(*(batch.column(c).to_pylist() for c in ("shard", "copy", "pattern_id", "pattern", "exact", "text_id", "text")), strict=True):
                if (at, copy) != key:
                    key, held, search = (at, copy), [], None
                if text is None:
                    held.append((name, pattern, exact))
                elif held:
                    search = search or searcher(held, whole_words)
                    rows += [(text_id, held[slot][0], sorted(places)) for slot, places in search(text).items()]
                    if len(rows) >= BATCH:
                        yield batch_of(rows)
        if rows:
            yield batch_of(rows)

    return both.mapInArrow(run, out)
