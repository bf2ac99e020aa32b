"""Dense top-k of a set of queries: vectors stream past the queries of a task, which keep their best as they go.

Vectors and queries are dealt to the lines and columns of a grid; a part of the grid is a task that holds its queries
and reads its vectors in blocks: all of them in an exact scan, or, with an inverted file, each by the queries that probe
its cell. Neither side passes through the driver or is broadcast, and a part gives k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.snapshots import Change, Snapshots
from .retrieval import BUCKETS, hash_embedding, rank

BLOCK, ASKED = 1024, 256
#: Bytes of the queries that a task holds, and products of entries that a part of the grid is made for.
HELD, PART = 32 << 20, 1 << 36
#: Scores are rounded to 5 places before they are ranked.
ROUNDING = 1e-5
#: Vectors of the sample that cells are fitted on, most cells, and rounds of the fit.
SAMPLE, MOST_CELLS, ROUNDS = 16384, 1024, 8
#: Share of the true neighbours within the sample that the cells probed by default have to hold, and how many sampled
#: queries and neighbours of each tell it.
RECALL, TRIED, NEIGHBOURS = 0.95, 256, 10


def matrix(values: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, as doubles."""
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


class _Held:
    """Queries of one task and the k best rows of each so far; of equal scores the smaller id is the better one."""

    def __init__(self, asked: pa.Table, k: int, same_ids: bool, id_type: pa.DataType):
        names, v = asked.column("query_id").combine_chunks(), matrix(asked.column("v").combine_chunks())
        whole = np.isfinite(v).all(axis=1)
        asked, self.v, self.k = asked.filter(pa.array(whole)), v[whole], k
        self.names = names.filter(pa.array(whole))
        self.scores = np.full((len(self.v), k), -np.inf)
        self.ids = np.zeros((len(self.v), k), np.int64 if pa.types.is_integer(id_type) else object)
        self.place = {q: n for n, q in enumerate(self.names.to_pylist())} if same_ids else {}
        self.docs = [(n, set(some)) for n, some in enumerate(asked.column("doc_ids").to_pylist()) if some]
        near = asked.column("near").combine_chunks()
        self.of_cell: dict[int, np.ndarray] | None = None
        if near.null_count < len(near):
            cells = near.flatten().to_numpy()
            order = np.argsort(cells, kind="stable")
            query = np.repeat(np.arange(len(near)), near.value_lengths().to_numpy())[order]
            found, first = np.unique(cells[order], return_index=True)
            self.of_cell = dict(zip(found.tolist(), np.split(query, first[1:]), strict=True))

    def meet(self, cell: int | None, rows: pa.RecordBatch) -> None:
        """Rows of one cell are met by the queries that probe it, by all where there are no cells."""
        asked = np.arange(len(self.v)) if self.of_cell is None else self.of_cell.get(cell, np.empty(0, int))
        v = matrix(rows.column("v"))
        whole = np.isfinite(v).all(axis=1)
        rows, v = rows.filter(pa.array(whole)), v[whole]
        if not len(asked) or not len(v):
            return
        ids = rows.column("id").to_numpy(zero_copy_only=False)
        own = np.array([(self.place[i], c) for c, i in enumerate(ids.tolist()) if i in self.place], int).reshape(-1, 2)
        hidden = []
        if self.docs:
            docs = rows.column("doc_id").to_pylist()
            hidden = [(n, np.array([d not in some for d in docs])) for n, some in self.docs]
        for at in range(0, len(asked), ASKED):
            some = asked[at : at + ASKED]
            scores = self.v[some] @ v.T
            slot = {n: j for j, n in enumerate(some.tolist())} if len(own) or hidden else {}
            for n, c in own.tolist():
                if n in slot:
                    scores[slot[n], c] = -np.inf
            for n, out in hidden:
                if n in slot:
                    scores[slot[n], out] = -np.inf
            self._keep(some, scores, ids)

    def _keep(self, some: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        least = self.scores[some, -1]
        if not np.isfinite(least).all() and scores.shape[1] > self.k:
            least = np.maximum(least, np.round(np.partition(scores, -self.k, axis=1)[:, -self.k], 5))
        # all that reach the k-th best score found, ties too
        q, c = np.nonzero((scores >= least[:, None] - ROUNDING) & (scores > -np.inf))
        if not len(q):
            return
        touched = np.unique(q)
        old_q, old_c = np.nonzero(self.scores[some[touched]] > -np.inf)
        held = some[touched[old_q]], old_c
        query, score, name = np.append(some[q], held[0]), np.append(np.round(scores[q, c], 5), self.scores[held]), np.append(ids[c], self.ids[held])
        order = np.lexsort((name if name.dtype != object else name.astype(str), -score, query))
        query, score, name = query[order], score[order], name[order]
        turn = np.arange(len(query)) - np.searchsorted(query, query)
        best = turn < self.k
        self.scores[query[best], turn[best]], self.ids[query[best], turn[best]] = score[best], name[best]

    def found(self, types: list[pa.DataType]) -> pa.RecordBatch:
        q, c = np.nonzero(self.scores > -np.inf)
        return pa.record_batch({"query_id": self.names.take(pa.array(q)).cast(types[0]), "id": pa.array(self.ids[q, c].tolist(), types[1]), "score": pa.array(self.scores[q, c])})


def _met_in_task(k: int, same_ids: bool, types: list[pa.DataType]):
    """Sorted by (part, kind, cell): the queries of a part and then its vectors -> (query_id, id, score), each query's k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("part", "kind", "cell")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, batch.num_rows).tolist(), strict=True):
                of, kind, cell = key[:, a].tolist()
                if of != part:
                    if held:
                        yield held.found(types)
                    part, waiting, held = of, [], None
                if kind == 0:
                    waiting.append(batch.slice(a, b - a))
                    continue
                if held is None and waiting:
                    held, waiting = _Held(pa.Table.from_batches(waiting), k, same_ids, types[1]), []
                if held:
                    for at in range(a, b, BLOCK):
                        held.meet(cell, batch.slice(at, min(BLOCK, b - at)))
        if held:
            yield held.found(types)

    return run


def _blocked(rows: DataFrame, columns: list[str], size: int, name: str) -> DataFrame:
    """Rows as (cell, name: array of up to about `size` structs), by salt within a cell that holds more."""
    counts = rows.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    salted = rows.join(counts, "cell").withColumn("salt", F.pmod(F.xxhash64(*columns[:1]), "blocks"))
    return salted.groupBy("cell", "salt").agg(F.collect_list(F.struct(*columns)).alias(name)).drop("salt")


class Cells:
    """An inverted file: vectors by the nearest of a few centroids, blocks of each cell written together.

    Centroids are fitted (k-means) on a bounded sample of vectors, every vector is indexed. How many cells a query probes
    by default is measured on the sample too. The folder is versioned; one object reads one version.
    """

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.snapshots = spark, Snapshots(spark, path)
        self.version = self.snapshots.latest() if version is None else version
        facts = self.snapshots.describe(self.version)["facts"]
        self.centroids, self.probes = np.array(facts["centroids"]), facts["probes"]

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None) -> Cells:
        """A new inverted file of vectors (id, v[, doc_id]) of unit length and one dimension."""
        base = Snapshots(vectors.sparkSession, path)
        with base.change() as change:
            change.state["tables"].pop("cells", None)
            change.facts.pop("centroids", None)
            cls.add_to(change, vectors, cells)
        return cls(base.spark, path, change.result)

    def add(self, vectors: DataFrame) -> Cells:
        """More vectors, dealt to the cells that there are."""
        with self.snapshots.change() as change:
            self.add_to(change, vectors)
        return Cells(self.spark, self.snapshots.root, change.result)

    @staticmethod
    def add_to(change: Change, vectors: DataFrame, cells: int | None = None) -> None:
        """Adds vectors to a change's inverted file, null ones apart; the first ones fit its cells."""
        vectors = vectors.where("v is not null")
        if "centroids" not in change.facts:
            sample = vectors.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()  # bounded
            sampled = matrix(sample.column("v").combine_chunks())
            centroids = fit_cells(sampled, cells or min(MOST_CELLS, max(1, int(sqrt(vectors.count())))))
            change.facts.update(centroids=centroids.tolist(), probes=probes_for(sampled, centroids))
        doc = "doc_id" if "doc_id" in vectors.columns else F.lit(None).cast("string").alias("doc_id")
        rows = nearest(vectors.select("id", doc, "v"), np.array(change.facts["centroids"]), 1).select(F.col("near")[0].alias("cell"), "id", "doc_id", "v")
        change.append("cells", _blocked(rows, ["id", "doc_id", "v"], BLOCK, "rows").repartitionByRange("cell").sortWithinPartitions("cell"))

    @property
    def blocks(self) -> DataFrame:
        return self.snapshots.read("cells", self.version)

    def topk(self, queries: DataFrame, k: int, probes: int | None = None, same_ids: bool = True) -> DataFrame:
        """(query_id, id, score, rank) of queries (query_id, v[, doc_ids]) among the vectors of their nearest cells.

        probes: cells of each query, those measured by default; as many as there are make the search exact.
        """
        probes = min(self.probes if probes is None else probes, len(self.centroids))
        asked = nearest(_asked(queries).where("v is not null"), self.centroids, probes)
        rows = self.blocks.select("cell", F.xxhash64(F.col("rows")[0]["id"]).alias("deal"), F.inline("rows"))
        return _met(rows, asked, k, same_ids, 8 * self.centroids.shape[1] + 16 * probes)


def fit_cells(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids of unit vectors; a centroid that loses all its vectors moves to the one that fits worst."""
    rng = np.random.default_rng(17)
    if not len(sample):
        return np.zeros((1, 1))
    centroids = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        scores = sample @ centroids.T
        cell, fit = scores.argmax(axis=1), scores.max(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, sample)
        empty = np.flatnonzero(np.bincount(cell, minlength=len(centroids)) == 0)
        sums[empty] = sample[np.argsort(fit, kind="stable")[: len(empty)]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids


def probes_for(sample: np.ndarray, centroids: np.ndarray) -> int:
    """Cells to probe so that RECALL of the nearest neighbours of sampled vectors, among the sample, are in them.

    Among all vectors neighbours are nearer than among the sample, so more of them are found than is asked for here.
    """
    if len(sample) < 2:
        return len(centroids)
    asked = sample[:TRIED]
    scores = asked @ sample.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    k = min(NEIGHBOURS, len(sample) - 1)
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    cell = (sample @ centroids.T).argmax(axis=1)
    turn = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)  # [query, cell]: when it is probed
    needed = np.sort(np.take_along_axis(turn, cell[best], axis=1).ravel())
    return int(needed[ceil(RECALL * len(needed)) - 1]) + 1


def nearest(rows: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """Rows (.., v) with `near`: the n cells whose centroid is nearest, the nearest first."""
    n = min(n, len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = matrix(batch.column("v")) @ centroids.T
                near = np.argsort(-scores, axis=1, kind="stable")[:, :n].astype(np.int32)
                yield pa.record_batch([*batch.columns, pa.array(list(near))], names=[*batch.schema.names, "near"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, near array<int>")


def _asked(queries: DataFrame) -> DataFrame:
    lists = "doc_ids" if "doc_ids" in queries.columns else F.lit(None).cast("array<string>").alias("doc_ids")
    return queries.select("query_id", "v", lists)


def _met(rows: DataFrame, asked: DataFrame, k: int, same_ids: bool, width: int | None = None) -> DataFrame:
    """rows (cell, deal, id, doc_id, v) and asked (query_id, v, doc_ids, near: cells, or null for all) -> the k best of each.

    A grid of parts: rows are dealt to its lines by `deal` and queries to its columns, so that every pair meets in one
    part. A column has no more queries than HELD bytes hold, at `width` each; more pairs make more parts, not longer ones.
    """
    spark = rows.sparkSession
    known, sought = rows.where("v is not null"), asked.where("v is not null")
    n = known.count()
    queries, dim = sought.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(n * queries * dim / PART))
    columns = max(1, ceil(queries * (width or 8 * dim) / HELD), min(parts, round(sqrt(parts * queries / max(n, 1)))))
    lines = ceil(parts / columns)
    place = lambda line, column: (line * columns + column).cast("int").alias("part")
    each = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    to = known.withColumn("line", F.pmod("deal", F.lit(lines))).withColumn("column", each(columns) if columns > 1 else F.lit(0))
    to = to.select(place(F.col("line"), F.col("column")), F.lit(1).alias("kind"), "cell", "id", "doc_id", "v")
    of = sought.withColumn("column", F.pmod(F.xxhash64("query_id"), F.lit(columns))).withColumn("line", each(lines))
    of = of.select(place(F.col("line"), F.col("column")), F.lit(0).alias("kind"), F.lit(-1).alias("cell"), "query_id", "v", "doc_ids", "near")
    both = of.unionByName(to, allowMissingColumns=True).repartitionById(lines * columns, F.col("part")).sortWithinPartitions("part", "kind", "cell")
    kinds = [asked.schema["query_id"].dataType, rows.schema["id"].dataType]
    found = both.mapInArrow(_met_in_task(k, same_ids, [to_arrow_type(t) for t in kinds]), f"query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, score double")
    return rank(found, k=k)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, same_ids: bool = True) -> DataFrame:
    """vectors (id, v), queries (query_id, v) of unit length -> (query_id, id, score, rank), by an exact scan.

    same_ids: queries are some of the vectors, and none is its own hit. With doc_id in vectors and doc_ids (array) in
    queries, a query with a list of documents sees only theirs, before the cut; a null or empty list is no filter.
    A vector that is null or holds null or non-finite entries is near to nothing.
    """
    doc = "doc_id" if "doc_id" in vectors.columns and "doc_ids" in queries.columns else F.lit(None).cast("string").alias("doc_id")
    rows = vectors.select(F.lit(0).alias("cell"), F.xxhash64("id").alias("deal"), "id", doc, "v")
    return _met(rows, _asked(queries).withColumn("near", F.lit(None).cast("array<int>")), k, same_ids)


def text_vectors(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, v): unit hash embeddings of 256 dimensions; texts without terms have none."""
    return dense_of(hash_embedding(rows, id_column, text_column))


def dense_of(counts: DataFrame) -> DataFrame:
    """(id, bucket, n) -> (id, v), of unit length; an entry is set once, not looked up for every bucket."""
    entries = counts.groupBy("id").agg(F.collect_list(F.struct("bucket", F.col("n").cast("double").alias("n"))).alias("e"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return entries.select("id", "e", "norm").mapInArrow(_spread, f"id {counts.schema['id'].dataType.simpleString()}, v array<double>")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, e: entries, norm) -> (id, v)."""
    for batch in batches:
        e, norm = batch.column("e"), batch.column("norm").to_numpy()
        v = np.zeros((len(norm), BUCKETS))
        v[np.repeat(np.arange(len(norm)), e.value_lengths().to_numpy()), e.flatten().field("bucket").to_numpy()] = e.flatten().field("n").to_numpy()
        unit = (v / norm[:, None]).ravel()
        yield pa.record_batch({"id": batch.column("id"), "v": pa.ListArray.from_arrays(pa.array(np.arange(len(norm) + 1, dtype=np.int32) * BUCKETS), pa.array(unit))})


