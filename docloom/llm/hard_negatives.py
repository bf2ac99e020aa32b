"""Hard negatives by a pivot table.

With one entry more, sqrt(M^2 - |x|^2) for the greatest norm M, all rows have one length, and an anchor's inner product
with a row falls as their Euclidean distance grows: d^2 = |q|^2 + M^2 - 2 q.x. Every row is stored with its distances to
a few pivots. By the triangle inequality the pivots bracket the distance of an anchor and a row, and so their score.

Rows are dealt to tiles of bounded size, and every anchor meets every tile. A tile keeps its rows in runs of one label and
one nearest pivot, each with the least and greatest distance to every pivot. An anchor skips the runs whose bracket can
no longer enter its best rows; what survives is checked by exact inner products. A first pass finds positives, a second
the negatives within the windows that the positives' scores open. A task gives a few rows an anchor, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import bounded, lean, stash

SCALE = 256.0
ANCHOR_STEP, MISLABEL_STEP, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: Hundredths of a positive's score between which its negatives lie.
LOW, HIGH = 50, 95
PIVOTS, PIVOT_SAMPLE = 16, 4096
#: Rows of a tile (at most, on average), of a run, and anchors that are looked at together.
TILE_ROWS, RUN, TOGETHER = 1 << 17, 64, 512
#: Hits of a block of anchors that are held before they are thinned to its best.
HELD = 1 << 20


def choose_pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Rows far from each other, each the farthest from those chosen so far."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen = [int(np.argmax((sample**2).sum(axis=1)))]
    apart = np.full(len(sample), np.inf)
    while len(chosen) < most:
        apart = np.minimum(apart, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        if apart.max() <= 0:
            break
        chosen.append(int(np.argmax(apart)))
    return sample[chosen]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((vectors**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * vectors @ pivots.T, 0.0))


def matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with the entry that brings each to the square length most."""
    x = x.astype(float)
    return np.concatenate([x, np.sqrt(np.maximum(most - (x**2).sum(axis=1), 0.0))[:, None]], axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole rows: in doubles while no sum can reach 2^53, else in 64-bit integers."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Tile:
    """Rows of a tile in runs; brackets of scores by run."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, to_pivots: np.ndarray):
        nearest = to_pivots.argmin(axis=1)
        order = np.lexsort((ids, to_pivots.min(axis=1), nearest, labels))
        self.ids, self.x = ids[order], x[order]
        labels, nearest, far = labels[order], nearest[order], to_pivots[order]
        new = np.flatnonzero(np.append(True, (labels[1:] != labels[:-1]) | (nearest[1:] != nearest[:-1])))
        starts = np.concatenate([np.arange(a, b, RUN) for a, b in zip(new, np.append(new[1:], len(ids)), strict=True)])
        self.starts, self.ends, self.labels = starts, np.append(starts[1:], len(ids)), labels[starts]
        self.near, self.far = np.minimum.reduceat(far, starts), np.maximum.reduceat(far, starts)

    def bracket(self, norms: np.ndarray, to_pivots: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) score of every anchor (rows) with each run (columns), with room for rounding."""
        least, greatest = np.zeros((len(norms), len(self.starts))), np.full((len(norms), len(self.starts)), np.inf)
        for p in range(to_pivots.shape[1]):
            q = to_pivots[:, p : p + 1]
            np.maximum(least, np.maximum(q - self.far[:, p], self.near[:, p] - q), out=least)
            np.minimum(greatest, q + self.far[:, p], out=greatest)
        room = 1.0 + 1e-9 * most
        return (norms[:, None] + most - greatest**2) / 2 - room, (norms[:, None] + most - least**2) / 2 + room


class Best:
    """The best k rows of each query: higher scores first, then smaller ids; an id counts once."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score, self.id = np.full(queries, -(2**63), np.int64), np.full(queries, 2**63 - 1, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def offer(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        better = (score > self.score[query]) | (score == self.score[query]) & (ids < self.id[query])
        if better.any():
            self.held.append((query[better], score[better], ids[better]))
            self.size += int(better.sum())
            if self.size > self.k * len(self.score) * 4 + RUN * TOGETHER or self.size > HELD:
                self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return (np.empty(0, np.int64),) * 3
        query, score, ids = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        # an id that is there twice has its better score first
        _, first = np.unique(np.stack([query, ids], axis=1), axis=0, return_index=True)
        first.sort()
        query, score, ids = query[first], score[first], ids[first]
        start = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        place = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
        last = place == self.k - 1
        self.score[query[last]], self.id[query[last]] = score[last], ids[last]
        keep = place < self.k
        self.held = [(query[keep], score[keep], ids[keep])]
        self.size = int(keep.sum())
        return self.held[0]


def _positives(tile: Tile, labels, ids, x, norms, to_pivots, most: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, score, row id): the best k other rows of the anchor's label in the tile."""
    best = Best(len(ids), k)
    _, upper = tile.bracket(norms, to_pivots, most)
    upper[labels[:, None] != tile.labels] = -np.inf
    for run in np.argsort(-upper.max(axis=0), kind="stable"):
        who = np.flatnonzero(upper[:, run] >= best.score)
        who = who[np.isfinite(upper[who, run])]
        if len(who):
            a, b = tile.starts[run], tile.ends[run]
            score, rows = products(x[who], tile.x[a:b]), tile.ids[a:b]
            hit = (score >= best.score[who][:, None]) & (rows != ids[who][:, None])
            i, j = np.nonzero(hit)
            best.offer(who[i], score[i, j], rows[j])
    return best.rows()


def _negatives(tile: Tile, labels, low: np.ndarray, high: np.ndarray, x, norms, to_pivots, most: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor * windows + window, score, row id): the best k rows of other labels within each window of the anchor."""
    windows = low.shape[1]
    best = Best(low.size, k)
    lower, upper = tile.bracket(norms, to_pivots, most)
    upper[labels[:, None] == tile.labels] = -np.inf
    for run in np.argsort(-upper.max(axis=0), kind="stable"):
        need = np.maximum(low, best.score.reshape(low.shape))
        who = np.flatnonzero(((upper[:, run, None] >= need) & (lower[:, run, None] <= high)).any(axis=1))
        if len(who):
            a, b = tile.starts[run], tile.ends[run]
            score, rows = products(x[who], tile.x[a:b]), tile.ids[a:b]
            for w in range(windows):
                i, j = np.nonzero((score >= need[who, w][:, None]) & (score <= high[who, w][:, None]))
                if len(i):
                    best.offer(who[i] * windows + w, score[i, j], rows[j])
    return best.rows()


def _tiled(found, kinds: str, most: float):
    """Batches of one or more tiles, each with its rows before its anchors; found(tile, batch of anchors) gives columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, tile = None, [], None
        for batch in batches:
            numbers, anchor = batch.column("tile").to_numpy(), batch.column("anchor").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.append(True, (numbers[1:] != numbers[:-1]) | (anchor[1:] != anchor[:-1])))
            for a, b in zip(cuts, np.append(cuts[1:], batch.num_rows), strict=True):
                if numbers[a] != number:
                    number, held, tile = numbers[a], [], None
                if not anchor[a]:
                    part = batch.slice(a, b - a)
                    x = matrix(part.column("x"))
                    held.append((part.column("id").to_numpy(), part.column("label").to_numpy(), x.astype(np.float32) if np.abs(x).max() < 2**24 else x, matrix(part.column("to_pivots")).astype(np.float64)))
                    continue
                if tile is None and held:
                    tile, held = Tile(*(np.concatenate(c) for c in zip(*held, strict=True))), []
                for at in range(a, b, TOGETHER):
                    if tile is not None:
                        yield from found(tile, batch.slice(at, min(TOGETHER, b - at)), most)

    return lean(run)


def mine(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", anchor: Column | None = None, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows take part whose id, label and vector are not null and whose components are all finite; a component x counts as
    floor(SCALE * x). Of vectors of several lengths only those of the commonest take part (the longer of two as common).
    anchor and label are conditions over the given columns; without them, ids divisible by ANCHOR_STEP are anchors and
    labels are as they stand. Scores are integer inner products with the anchor. Positives are the first `positives` rows
    of the anchor's label with another id; negatives the first `negatives` rows of another label with LOW * positive <=
    100 * negative <= HIGH * positive. An id that repeats counts once for an anchor and label, with its best score; of
    anchors that repeat an id, the one with the least label and vector counts. Products beyond 64 bits are not foreseen.
    Other columns are dropped, whatever their names. An empty table, and an anchor without positives or without
    negatives in a window, give no rows.
    """
    spark = bounded(rows.sparkSession)
    c = F.transform(F.col(vector_column), lambda v: v.cast("double"))
    finite = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    is_anchor = F.col(id_column) % ANCHOR_STEP == 0 if anchor is None else anchor
    source = rows.select(F.col(id_column).cast("long").alias("id"), (F.col(label_column) if label is None else label).cast("long").alias("label"), is_anchor.alias("is_anchor"), c.alias("c"))
    source = source.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("c").isNotNull() & finite & (F.size("c") > 0))
    source = source.select("id", "label", "is_anchor", F.transform("c", lambda v: F.floor(v * SCALE)).alias("x"))
    norm = F.aggregate("x", F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double"))
    known = source.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"), F.max(norm).alias("most")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not known:
        return spark.createDataFrame([], result)
    size, n, most = known[0]
    source = source.where(F.size("x") == size)
    sample = source.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("x").toArrow()  # a bounded sample, to choose pivots only
    pivots = choose_pivots(augmented(matrix(sample.column("x").combine_chunks()), most))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"))
                yield pa.record_batch([*batch.columns, pa.array(list(distances(augmented(x, most), pivots)))], names=[*batch.schema.names, "to_pivots"])

    kept = "id long, label long, is_anchor boolean, x array<long>, to_pivots array<double>"
    table = stash(source.mapInArrow(lean(measure), kept), "pivots")
    tiles = max(ceil(n / tile_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = table.select(F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int").alias("tile"), F.lit(False).alias("anchor"), "id", "label", "x", "to_pivots", F.array().cast("array<long>").alias("scores"))
    one = table.where("is_anchor").groupBy("id").agg(F.min(F.struct("label", "x")).alias("least"))
    one = one.select("id", F.col("least.label").alias("label"), F.col("least.x").alias("x"))
    one = stash(one, "anchors")

    def at_pivots(x: np.ndarray) -> np.ndarray:
        q = np.concatenate([x.astype(float), np.zeros((len(x), 1))], axis=1)
        return distances(q, pivots)

    def meet(anchors: DataFrame, found, kinds: str) -> DataFrame:
        asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), F.lit(True).alias("anchor"), "id", "label", "x", F.array().cast("array<double>").alias("to_pivots"), "scores")
        both = dealt.unionByName(asked).repartitionByRange(tiles, "tile").sortWithinPartitions("tile", "anchor")
        return both.mapInArrow(_tiled(found, kinds, most), kinds)

    def positive(tile: Tile, batch: pa.RecordBatch, most: float) -> Iterator[pa.RecordBatch]:
        x, ids = matrix(batch.column("x")), batch.column("id").to_numpy()
        i, score, other = _positives(tile, batch.column("label").to_numpy(), ids, x, (x.astype(float) ** 2).sum(axis=1), at_pivots(x), most, positives)
        yield pa.record_batch({"id": pa.array(ids[i]), "positive_score": pa.array(score), "positive_id": pa.array(other)})

    def negative(tile: Tile, batch: pa.RecordBatch, most: float) -> Iterator[pa.RecordBatch]:
        x, ids = matrix(batch.column("x")), batch.column("id").to_numpy()
        low, high = np.full((len(ids), positives), 2**63 - 1, np.int64), np.full((len(ids), positives), -(2**63), np.int64)
        for k, scores in enumerate(batch.column("scores").to_pylist()):
            for w, s in enumerate(scores):
                low[k, w], high[k, w] = -((-LOW * s) // 100), (HIGH * s) // 100
        i, score, other = _negatives(tile, batch.column("label").to_numpy(), low, high, x, (x.astype(float) ** 2).sum(axis=1), at_pivots(x), most, negatives)
        yield pa.record_batch({"id": pa.array(ids[i // positives]), "window": pa.array((i % positives).astype(np.int32)), "negative_score": pa.array(score), "negative_id": pa.array(other)})

    by_anchor = Window.partitionBy("id").orderBy(F.desc("positive_score"), "positive_id")
    first = meet(one.withColumn("scores", F.array().cast("array<long>")), positive, "id long, positive_score long, positive_id long")
    first = first.withColumn("place", F.row_number().over(by_anchor)).where(F.col("place") <= positives)
    chosen = F.array_sort(F.collect_list(F.struct("place", "positive_score", "positive_id")))
    first = stash(first.groupBy("id").agg(chosen.alias("chosen")).join(one, "id"), "positives")
    by_window = Window.partitionBy("id", "window").orderBy(F.desc("negative_score"), "negative_id")
    second = meet(first.withColumn("scores", F.col("chosen.positive_score")), negative, "id long, window int, negative_score long, negative_id long")
    second = second.withColumn("rank", F.row_number().over(by_window)).where(F.col("rank") <= negatives)
    out = second.join(first.select("id", "chosen"), "id").withColumn("of", F.get("chosen", F.col("window")))
    return out.select(F.col("id").alias("anchor_id"), F.col("of.positive_id").alias("positive_id"), "rank", "negative_id", F.col("of.positive_score").alias("positive_score"), "negative_score")


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND (a.label <> b.label OR a.vec_id <> b.vec_id)),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p.b, p.score AS positive_score, s.b AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, b AS positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
