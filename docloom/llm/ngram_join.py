"""N-gram Jaccard self-join with signature trees.

Every text becomes its set of distinct word shingles; equal sets form one class, and only classes are compared. A
class is routed to BANDS trees by banded minima of its set (a pair at the similarity threshold shares no route with a
probability below 1e-12). In a route:

1. each class is tried against the route's least class, by exact set intersection; what links is one component;
2. routes that still hold several components build a signature tree: leaves are classes, inner nodes hold the OR of
   their token bitmaps and the range of their set sizes. A dual traversal drops node pairs whose maximum possible
   overlap is too small, and leaf pairs of one component; what is left is verified by exact intersection. A few rounds
   verify pairs that span a tree's components before the last one takes all that are still apart.

No pair list of a group of copies is ever formed: within a component nothing more is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .scratch import bounded, forget, lean, stash
from .wordhash import gram_hashes, mix, run_hash, slices, utf8, word_hashes

SHINGLE = 5
ROWS, BANDS = 3, 39
#: Bits of a class's token bitmap.
BITS = 2048
#: Rows of a route that one tree holds; larger routes are split into blocks, and every two blocks meet in one task.
BLOCK_ROWS = 1024
FANOUT = 8
#: Rounds in which a tree gives only pairs that span its components.
SPANNING_ROUNDS = 2
#: Node pairs that a traversal looks at together.
NODE_PAIRS = 8192
#: Bits of the filter of candidate documents, a bounded broadcast (2 MB).
FILTER_BITS = 1 << 24

_rng = np.random.Generator(np.random.PCG64(77))
_XOR = _rng.integers(0, 2**64, ROWS * BANDS, dtype=np.uint64)[:, None]
_MUL = (_rng.integers(0, 2**64, ROWS * BANDS, dtype=np.uint64) | np.uint64(1))[:, None]


def shingle_set(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, an empty one has none."""
    if 0 < len(words) < n:
        return np.array([run_hash(words) ^ len(words)], np.uint64)
    return np.unique(gram_hashes(words, n))


def _bands(members: np.ndarray) -> np.ndarray:
    least = np.full(ROWS * BANDS, ~np.uint64(0))
    for at in range(0, len(members), 4096):
        least = np.minimum(least, ((members[None, at : at + 4096] ^ _XOR) * _MUL).min(axis=1))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + part)
    return keys


def _bitmap(members: np.ndarray) -> bytes:
    bits = np.zeros(BITS, np.uint8)
    bits[(members >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _class_key(members: np.ndarray) -> bytes:
    n = np.uint64(len(members))
    return np.array([np.add.reduce(mix(members)) ^ n, np.bitwise_xor.reduce(mix(members * np.uint64(3) + n))], ">u8").tobytes()


def _profile(n: int, with_sets: bool, wanted: np.ndarray | None = None):
    """Rows of one scan: profiles of all texts, or the sets of the documents that pass the filter."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                hit = wanted[np.asarray(batch.column("slot")) >> 3] >> (np.asarray(batch.column("slot")) & 7) & 1
                batch = batch.filter(pa.array(hit.astype(bool)))
            for part in slices(batch):
                sets = [shingle_set(w, n) for w in word_hashes([t.lower() for t in utf8(part.column("text"))])]
                keys = pa.array([_class_key(s) if len(s) else None for s in sets], pa.binary())
                size = pa.array([len(s) for s in sets], pa.int64())
                if with_sets:
                    yield pa.record_batch({"cls": keys, "n": size, "members": pa.array([s.tobytes() for s in sets], pa.binary())})
                else:
                    bands = pa.array([_bands(s).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64()))
                    maps = pa.array([_bitmap(s) if len(s) else None for s in sets], pa.binary())
                    yield pa.record_batch({"id": part.column("id"), "n": size, "cls": keys, "bands": bands, "bitmap": maps})

    return scan


# Signature tree --------------------------------------------------------------------------------------------------

_POP = np.array([bin(i).count("1") for i in range(256)], np.int64)


def needed(a, b, num: int, den: int):
    """Least intersection of sets of sizes a and b for den * intersection >= num * union."""
    return -(-num * (a + b) // (num + den))


class SignatureTree:
    """Levels of nodes, leaves first. A node holds the least and greatest set size below it, the OR of the bitmaps, the
    greatest excess (members beyond a leaf's distinct bits), and the least and greatest component label."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, labels: np.ndarray):
        self.order = np.lexsort((labels, sizes))
        low = high = sizes[self.order]
        bits, one = maps[self.order], labels[self.order]
        excess, two = high - _POP[bits].sum(axis=1), one
        self.levels = [(low, high, bits, excess, one, two)]
        while len(low) > 1:
            cut = np.arange(0, len(low), FANOUT)
            low, high, bits = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.bitwise_or.reduceat(bits, cut, axis=0)
            excess, one, two = np.maximum.reduceat(excess, cut), np.minimum.reduceat(one, cut), np.maximum.reduceat(two, cut)
            self.levels.append((low, high, bits, excess, one, two))


def _may_link(x, y, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Node pairs that may hold a link: of different components, sizes within the ratio, overlap bound high enough.

    Members of an intersection take distinct bits that both maps have, but for at most the excess of either side.
    """
    ok = ~((x[4][i] == x[5][i]) & (y[4][j] == y[5][j]) & (x[4][i] == y[4][j]))
    ok &= (x[1][i] * den >= y[0][j] * num) & (y[1][j] * den >= x[0][i] * num)
    at = np.flatnonzero(ok)
    i, j = i[at], j[at]
    most = _POP[x[2][i] & y[2][j]].sum(axis=1) + np.minimum(x[3][i], y[3][j])
    ok[at] = np.minimum(most, np.minimum(x[1][i], y[1][j])) >= needed(x[0][i], y[0][j], num, den)
    return ok


def dual_traversal(x: SignatureTree, y: SignatureTree, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the leaf pairs that no node pair above them rules out."""
    same = x is y
    held = [(len(x.levels) - 1, len(y.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    while held:
        a, b, i, j = held.pop()
        if len(i) > NODE_PAIRS:
            held += [(a, b, i[NODE_PAIRS:], j[NODE_PAIRS:])]
            i, j = i[:NODE_PAIRS], j[:NODE_PAIRS]
        keep = _may_link(x.levels[a], y.levels[b], i, j, num, den)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if a == 0 and b == 0:
            found.append((i, j))
            continue
        if a >= b:
            a -= 1
            i, j = (i[:, None] * FANOUT + np.arange(FANOUT)).ravel(), np.repeat(j, FANOUT)
            ok = i < len(x.levels[a][0])
        else:
            b -= 1
            i, j = np.repeat(i, FANOUT), (j[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            ok = j < len(y.levels[b][0])
        if same and a == b:
            ok &= i <= j
        held.append((a, b, i[ok], j[ok]))
    i, j = (np.concatenate(c) for c in zip(*found, strict=True))
    i, j = x.order[i], y.order[j]
    return (i[i != j], j[i != j]) if same else (i, j)


def _spanning(i: np.ndarray, j: np.ndarray, labels: np.ndarray, seed: int) -> list[int]:
    """Of pairs in an order that the seed shuffles, those that join two components not joined before."""
    root = {int(x): int(x) for x in np.unique(np.concatenate((labels[i], labels[j])))}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out: list[int] = []
    for k in np.random.Generator(np.random.PCG64(seed)).permutation(len(i)).tolist():
        a, b = find(int(labels[i[k]])), find(int(labels[j[k]]))
        if a != b:
            root[a] = b
            out.append(k)
            if len(out) == len(root) - 1:
                break
    return out


def _tree_pairs(num: int, den: int, seed: int | None):
    """Sorted rows (route, one, two, block, cls, n, bitmap, label) -> candidate pairs of different components.

    With a seed a task gives only pairs that span its components, and says by `more` if it held any back.
    """

    def pairs(rows: dict) -> Iterator[tuple]:
        sides = {}
        for side in {*rows["block"]}:
            own = np.flatnonzero(rows["block"] == side)
            sides[side] = own, SignatureTree(rows["n"][own], rows["bitmap"][own], rows["label"][own])
        if len(sides) == 1 and rows["one"] != rows["two"]:
            return
        (a, x), (b, y) = sides[min(sides)], sides[max(sides)]
        i, j = dual_traversal(x, y, num, den)
        ids, labels = rows["cls"], rows["label"]
        i, j = a[i], b[j]
        ok = labels[i] != labels[j]
        i, j = i[ok], j[ok]
        some = range(len(i)) if seed is None or len(i) < 2 else _spanning(i, j, labels, seed)
        yield from ((min(ids[i[k]], ids[j[k]]), max(ids[i[k]], ids[j[k]]), len(some) < len(i)) for k in some)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def done() -> pa.RecordBatch:
            got = [*pairs({
                "one": key[1], "two": key[2], "block": np.array([r[0] for r in held]), "cls": [r[1] for r in held], "n": np.array([r[2] for r in held], np.int64),
                "bitmap": np.frombuffer(b"".join(r[3] for r in held), np.uint8).reshape(len(held), -1), "label": np.unique([r[4].hex() for r in held], return_inverse=True)[1],
            })] if len(held) > 1 else []
            columns = [*zip(*got, strict=True)] or [()] * 3
            task = [pa.array([k] * len(got), t) for k, t in zip(key, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
            return pa.record_batch([*task, *(pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.bool_()), strict=True))], names=["route", "one", "two", "u", "v", "more"])

        for batch in batches:
            for route, one, two, *row in zip(*(batch.column(c).to_pylist() for c in ("route", "one", "two", "block", "cls", "n", "bitmap", "label")), strict=True):
                if key != (route, one, two):
                    if held:
                        yield done()
                    held, key = [], (route, one, two)
                held.append(row)
        if held:
            yield done()

    return tasks


def _verify(num: int, den: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.concatenate((a, b))
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(den * same >= num * (len(both) - same))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return check


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) of classes whose sets link, by exact intersection."""
    a, b = (sets.select(F.col("cls").alias(k), F.col("members").alias(m)) for k, m in (("u", "a"), ("v", "b")))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(lean(_verify(num, den)), "u binary, v binary")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of documents without near-copies: of each component the row of least doc_id (then least text hash)."""
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("a"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("b"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"))
    found = ngram_components(rows.select("key", F.col("row.text").alias("text")), id_column="key")
    kept = found.where("key = component_id").select("key.a", "key.b").distinct()
    rows = rows.select("row", "key.a", "key.b").join(kept, ["a", "b"], "left_semi")
    first = F.row_number().over(Window.partitionBy("a", "b").orderBy("b"))
    return rows.withColumn("n", first).where("n = 1").select("row.*")


def ngram_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: tuple[int, int] = (80, 100), shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: the id column, n_shingles (set size) and component_id (least id reachable by links).

    Nulls: a null text, like one without words, is an empty set and linked with nothing: its component is its own id.
    A row with a null id takes part, but its id is no component's least unless all ids there are null. Rows that
    repeat an id each come back, with the result of their own text. Ties and equal texts: equal sets are one class.
    Other columns are dropped, whatever their names. An empty table gives no rows.
    """
    num, den = threshold
    bounded(docs.sparkSession)
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    profiles = stash(source.mapInArrow(lean(_profile(shingle, False)), f"id {kind}, n long, cls binary, bands array<long>, bitmap binary"), "profiles")
    classes = profiles.where("n > 0").groupBy("cls").agg(F.min("id").alias("least"), F.min("n").alias("n"), F.min("bands").alias("bands"), F.min("bitmap").alias("bitmap"))
    routes = classes.select("cls", "least", F.explode("bands").alias("route"))
    # routes with two classes or more, each class with the route's least one
    firsts = routes.groupBy("route").agg(F.min("cls").alias("first"), F.count("*").alias("size")).where("size > 1")
    shared = stash(routes.join(firsts, "route"), "routes")
    wanted = np.zeros(FILTER_BITS // 8, np.uint8)
    slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).cast("int")
    slots = shared.select(F.col("least").alias("id")).select(slot.alias("s")).groupBy(F.shiftright("s", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, s & 31))").alias("b")).toArrow()
    wanted.view("<u4")[np.asarray(slots.column("w"))] = np.asarray(slots.column("b")).astype("<u4")
    scan = _profile(shingle, True, wanted)
    found = source.withColumn("slot", slot).select("id", "text", "slot").mapInArrow(lean(scan), "cls binary, n long, members binary").where("n > 0")
    known = shared.select("cls").distinct()
    sets = stash(found.join(known, "cls", "left_semi").groupBy("cls").agg(F.min("n").alias("n"), F.min("members").alias("members")), "sets")

    stars = shared.where("cls <> first").select(F.col("first").alias("u"), F.col("cls").alias("v")).distinct()
    links = stash(_linked(stars, sets, num, den), "links")
    roots = components(links)

    def labels(table: DataFrame, roots: DataFrame) -> DataFrame:
        return table.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("label", F.coalesce("root", "cls")).drop("root")

    open_ = labels(shared, roots).groupBy("route").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count("*").alias("size")).where("l <> h").select("route", F.ceil(F.col("size") / BLOCK_ROWS).cast("int").alias("blocks"))
    held = shared.select("route", "cls").join(open_, "route").join(profiles.where("n > 0").groupBy("cls").agg(F.min("n").alias("n"), F.min("bitmap").alias("bitmap")), "cls")
    dealt = held.withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = ["route", "one", "two"]
    dealt = stash(dealt.select("route", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "cls", "n", "bitmap"), "dealt")
    # a few rounds of spanning pairs join the groups of copies; the last round looks at all pairs still held back
    for seed in [*range(SPANNING_ROUNDS), None]:
        rows = labels(dealt, roots).select(*task, "block", "cls", "n", "bitmap", "label").repartition(*task).sortWithinPartitions(*task)
        tries = stash(rows.mapInArrow(lean(_tree_pairs(num, den, seed)), "route long, one int, two int, u binary, v binary, more boolean"), "tries")
        if tries.isEmpty():
            forget(tries)
            break
        before, links = links, stash(links.unionByName(_linked(tries.select("u", "v").distinct(), sets, num, den)), "links")
        forget(before)
        roots = components(links)
        again = tries.where("more").select(*task).distinct()
        before, dealt = dealt, stash(dealt.join(again, task, "left_semi"), "dealt")
        forget(before, tries)
    forget(shared, sets, links, dealt)

    of_class = profiles.where("n > 0").groupBy("cls").agg(F.min("id").alias("least")).join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    least = of_class.groupBy("root").agg(F.min("least").alias("component"))
    of_class = of_class.join(least, "root").select("cls", "component")
    thin = profiles.select("id", "n", "cls")
    return thin.join(of_class, "cls", "left").select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
