"""Embedding near-duplicates by collision counting over sorted one-dimensional projections.

Equal vectors of a label are one class. The classes of a label are dealt to buckets by routes: a route cuts a few
random projections into cells, and the numbers of routes and cuts follow from the label's size, so that a bucket stays
near BUCKET_ROWS rows and a pair at the threshold shares no bucket with a probability below MISS. A label of at most
BUCKET_ROWS classes is one bucket of one route.

In a bucket the vectors are sorted along projections. A query's window on the first one bounds the vectors it meets;
its windows on PROJECTIONS more are counted per pair, and the counts have to reach limits that a pair at the threshold
meets but for MISS. Pairs that do are verified by cosine in double precision. A pair that several routes bring together
belongs to the first of them. A task gives back each class's link count and local component, never a list of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import groupby
from math import ceil, comb, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import forget, lean, stash

PROJECTIONS, STEP = 32, 8
#: Half a window, in standard deviations of the projected difference of a pair at the threshold.
HALF_WINDOW = 4.0
#: The same for the sorted line that bounds a query's partners: a pair at the threshold falls outside once in 25 million.
REACH = 5.5
#: Most probability of losing a pair at the threshold, by the routes and by the counts.
MISS = 5e-7
BUCKET_ROWS = 8192
#: Width of a cell, where projections of unit vectors have a standard deviation of 1, and the share of them in one cell.
CELL, CELL_SHARE = 2.0, 0.45
MOST_CUTS = 40
#: Queries whose windows are looked at together, and window steps by which projections are rounded.
QUERIES, STEPS = 256, 16


def spread(threshold: float) -> float:
    """Standard deviation of the projected difference of two unit vectors at the threshold."""
    return sqrt(max(2 - 2 * threshold, 1e-12))


def limits() -> list[tuple[int, int]]:
    """(projections so far, least collisions): after each STEP, the highest count that loses few enough pairs."""
    p, out = erf(HALF_WINDOW / sqrt(2)), []
    for m in range(STEP, PROJECTIONS + 1, STEP):
        below, count = 0.0, 0
        while (more := below + comb(m, count) * p**count * (1 - p) ** (m - count)) <= MISS / (PROJECTIONS // STEP):
            below, count = more, count + 1
        out.append((m, count))
    return out


def routes_for(cuts: int, threshold: float) -> int:
    """Routes of so many cuts that a pair at the threshold needs, to share one but for MISS."""
    s, w = spread(threshold), CELL
    one = erf(w / s / sqrt(2)) - 2 * s / (sqrt(2 * pi) * w) * (1 - exp(-w * w / (2 * s * s)))
    return 1 if cuts == 0 else ceil(log(MISS) / log(1 - one**cuts))


@cache
def _directions(size: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(9)).standard_normal((size, PROJECTIONS + 1))


@cache
def _route(size: int, route: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64([11, size, route]))
    return rng.standard_normal((size, MOST_CUTS)), rng.random(MOST_CUTS), rng.integers(1, 2**63, MOST_CUTS) | 1


def route_keys(vectors: np.ndarray, routes: int, cuts: int) -> np.ndarray:
    """Bucket of every unit vector (rows) in every route (columns)."""
    out = np.zeros((len(vectors), routes), np.int64)
    for r in range(routes if cuts else 0):
        directions, offset, mark = _route(vectors.shape[1], r)
        cells = np.floor(vectors @ directions[:, :cuts] / CELL + offset[:cuts]).astype(np.int64)
        out[:, r] = (cells * mark[:cuts]).sum(axis=1)
    return out


def near_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of unit vectors of cosine >= threshold, among those whose window collisions reach the limits."""
    directions, s = _directions(a.shape[1]), spread(threshold)
    pa_, pb = a @ directions, b @ directions
    down, across = np.argsort(pa_[:, 0], kind="stable"), np.argsort(pb[:, 0], kind="stable")
    line = pb[across, 0]
    half = HALF_WINDOW * s + 1e-9
    # whole steps of a window, rounded down on both sides, are within STEPS + 1 of each other where values are within half
    qa, qb = (np.clip(np.floor(p[:, 1 : STEP + 1] * (STEPS / half)), -16000, 16000).astype(np.int16) for p in (pa_, pb))
    qb = np.ascontiguousarray(qb[across].T)
    (_, least), *rest = limits()
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for at in range(0, len(down), QUERIES):
        rows = down[at : at + QUERIES]
        left = np.searchsorted(line, pa_[rows[0], 0] - REACH * s - 1e-9, "left")
        right = np.searchsorted(line, pa_[rows[-1], 0] + REACH * s + 1e-9, "right")
        if left == right:
            continue
        count = np.zeros((len(rows), right - left), np.int8)
        for k in range(STEP):
            apart = qa[rows, k][:, None] - qb[k, left:right]
            np.abs(apart, out=apart)
            count += apart <= STEPS + 1
        i, j = np.nonzero(count >= least)
        i, j = rows[i], across[left:right][j]
        seen = (np.abs(pa_[i, 1 : STEP + 1] - pb[j, 1 : STEP + 1]) <= half).sum(axis=1)
        keep = seen >= least
        for m, enough in rest:
            i, j, seen = i[keep], j[keep], seen[keep]
            seen = seen + (np.abs(pa_[i, m - STEP + 1 : m + 1] - pb[j, m - STEP + 1 : m + 1]) <= half).sum(axis=1)
            keep = seen >= enough
        i, j = i[keep], j[keep]
        for k in range(0, len(i), 1 << 16):
            u, v = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            keep = np.einsum("ij,ij->i", a[u], b[v]) >= threshold
            found.append((u[keep], v[keep]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _unit(column) -> np.ndarray:
    vectors = np.stack([v.values.to_numpy(zero_copy_only=False) for v in column]).astype(np.float64)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes -> one row per class and route, with its bucket."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            sizes, cuts, routes = (np.asarray(part.column(c)) for c in ("size", "cuts", "routes"))
            for kind in np.unique(np.stack([sizes, cuts, routes], axis=1), axis=0).tolist():
                rows = np.flatnonzero((sizes == kind[0]) & (cuts == kind[1]) & (routes == kind[2]))
                some = part.take(pa.array(rows))
                keys = route_keys(_unit(some.column("vector")), kind[2], kind[1])
                for r in range(kind[2]):
                    yield pa.record_batch([*some.columns, pa.array(np.full(len(rows), r, np.int32)), pa.array(keys[:, r])], names=[*some.schema.names, "route", "bucket"])


TASK = ["label", "size", "route", "bucket", "one", "two"]


def _link(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in (*TASK, "cuts", "block", "cls", "copies")), batch.column("vector"), strict=True)

        for (_, _, route, _, one, two), group in groupby(rows(), key=lambda r: r[:6]):
            held = [*group]
            if len(held) < 2:
                continue
            block, names, copies = np.array([r[7] for r in held]), [r[8] for r in held], np.array([r[9] for r in held])
            vectors = _unit([r[10] for r in held])
            a, b = np.flatnonzero(block == one), np.flatnonzero(block == two)
            if not len(a) or not len(b):
                continue
            i, j = near_pairs(vectors[a], vectors[b], threshold)
            i, j = a[i], b[j]
            if one == two:
                i, j = i[i < j], j[i < j]
            if route and len(i):
                used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                earlier = route_keys(vectors[used], route, held[0][6])
                new = ~(earlier[at[: len(i)]] == earlier[at[len(i) :]]).any(axis=1)
                i, j = i[new], j[new]
            if not len(i):
                continue
            links = np.bincount(i, copies[j], len(held)) + np.bincount(j, copies[i], len(held))
            root, hit = _roots(len(held), i, j), np.flatnonzero(links)
            yield pa.record_batch({"cls": [names[k] for k in hit], "links": pa.array(links[hit].astype(np.int64)), "root": [names[root[k]] for k in hit]})

    return run


def near_duplicates(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", group_column: str = "label", threshold: float = 0.98) -> DataFrame:
    """Per row: id, n_links, component_id (least id reachable by links, itself included) and kept (id = component_id).

    Only rows of one label and one vector length are compared. Null labels and vectors, and vectors with a null or
    non-finite component or of norm 0, link with nothing. Equal vectors of a label link with each other. Rows that
    repeat an id are vectors of their own; a null id is no component's least unless it is the only one. Other columns
    are dropped, whatever their names. An empty table gives no rows.
    """
    v = F.col(vector_column)
    source = rows.select(F.col(id_column).cast("long").alias("id"), F.col(group_column).alias("label"), v.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    valid = F.coalesce(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite, F.lit(False))
    key = F.concat_ws("-", F.hex(F.xxhash64("label", "vector")), F.hex(F.xxhash64("vector", F.lit(1), "label")))
    source = source.withColumn("cls", F.when(valid, key))
    classes = source.where("cls is not null").groupBy("cls").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("id").alias("least"))
    classes = stash(classes.withColumn("size", F.size("vector")), "vectors")
    needs = F.array(*(F.lit(routes_for(c, threshold)) for c in range(MOST_CUTS + 1)))
    cuts = F.least(F.greatest(F.ceil(F.log(F.count("*") / BUCKET_ROWS) / -log(CELL_SHARE)), F.lit(0)), F.lit(MOST_CUTS)).cast("int")
    labels = classes.groupBy("label", "size").agg(cuts.alias("cuts")).withColumn("routes", F.get(needs, F.col("cuts")))
    kinds = "label {0}, size int, cls string, copies long, vector {1}, cuts int, routes int, route int, bucket long".format(*(classes.schema[c].dataType.simpleString() for c in ("label", "vector")))
    routed = classes.join(labels, ["label", "size"]).select("label", "size", "cls", "copies", "vector", "cuts", "routes")
    routed = stash(routed.mapInArrow(lean(_deal), kinds), "routed")
    bucket = TASK[:4]
    parts = routed.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BUCKET_ROWS).cast("int")).drop("n")
    dealt = routed.join(parts, bucket).withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    found = dealt.select(*TASK, "cuts", "block", "cls", "copies", "vector").repartition(*TASK).sortWithinPartitions(*TASK).mapInArrow(lean(_link(threshold)), "cls string, links long, root string")
    found = stash(found, "near")
    forget(routed)
    roots = components(found.select(F.col("cls").alias("u"), F.col("root").alias("v")))
    of_class = classes.select("cls", "least", "copies").join(found.groupBy("cls").agg(F.sum("links").alias("links")), "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    of_class = of_class.withColumn("root", F.coalesce("root", "cls"))
    least = of_class.groupBy("root").agg(F.min("least").alias("component"))
    of_class = stash(of_class.join(least, "root").select("cls", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component"), "classes")
    out = source.select("id", "cls").join(of_class, "cls", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept FROM embeddings e
LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = e.vec_id JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON c.a = e.vec_id
"""
