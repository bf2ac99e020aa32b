"""Whitening of embeddings by a covariance summed without loss.

A task cuts the centred vectors of a block into slices of so few bits that every product of two slices and every sum of
a block's products is a whole number of units below 2^53: the matrix product of slices is free of error. Products are
added to a double-double total by error-free additions, and the totals of tasks are merged, high and low parts, in two
steps by matrix row, so that neither the driver nor a task meets the totals of all tasks. The driver holds numbers of one
vector's length squared and solves for the eigenvectors (eigen.py).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .eigen import eigen
from .scratch import bounded, lean

COMPONENTS = 8
SCALE, OFFSET = 1024.0, 100000
#: Rows of a block, and bits of a slice: BLOCK * 2^(2 * BITS - 2) stays below 2^53. Three slices hold 66 bits.
BLOCK, BITS, SLICES = 1024, 22, 3
#: Groups in which the totals of one matrix row are merged first.
SPREAD = 32
#: Eigenvalues up to this share of the greatest, per dimension, are none.
RANK = 4 * np.finfo(float).eps

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b and its rounding error, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(total: Pair, more: Pair) -> Pair:
    """Double-double sum."""
    s, e = two_sum(total[0], more[0])
    t, f = two_sum(total[1], more[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def slices(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Columns of high + low as SLICES columns each, every slice a whole number below 2^(BITS - 1) times a power of 2."""
    most = np.abs(high).max(axis=0)
    unit = np.exp2(np.ceil(np.log2(np.where(most > 0, most, 1.0))) - BITS + 2)
    out, rest = [], high
    for k in range(SLICES):
        part = np.rint(rest / unit) * unit
        out.append(part)
        rest = rest - part
        if k == SLICES - 2:
            rest = rest + low
        unit = unit * 2.0**-BITS
    return np.concatenate(out, axis=1)


def gram(high: np.ndarray, low: np.ndarray) -> Pair:
    """Sum of outer products of the rows of high + low, in double-double."""
    size = high.shape[1]
    total: Pair = (np.zeros((size, size)), np.zeros((size, size)))
    for at in range(0, len(high), BLOCK):
        parts = slices(high[at : at + BLOCK], low[at : at + BLOCK])
        product = parts.T @ parts
        for i in range(SLICES):
            for j in range(SLICES):
                total = add(total, (product[i * size : (i + 1) * size, j * size : (j + 1) * size], np.zeros((size, size))))
    return total


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def centre(x: np.ndarray, mean: Pair) -> Pair:
    """x - mean for whole numbers x, as doubles and what they miss."""
    s, e = two_sum(x.astype(float), -mean[0])
    return two_sum(s, e - mean[1])


def _merged(table: pa.Table) -> pa.Table:
    order = np.argsort(table.column("task").to_numpy(), kind="stable")
    high, low = (matrix(table.column(c).combine_chunks())[order] for c in ("high", "low"))
    total: Pair = (high[0], low[0])
    for k in range(1, len(high)):
        total = add(total, (high[k], low[k]))
    return pa.table({"at": table.column("at")[:1], "task": table.column("task")[:1], "high": pa.array([total[0]]), "low": pa.array([total[1]])})


def co_moment(rows: DataFrame, centred: Callable[[np.ndarray], Pair], size: int) -> Pair:
    """Sum over all rows of the outer products of centred(x), of so many columns; rows have x, an array of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                more = gram(*centred(matrix(batch.column(0))))
                total = more if total is None else add(total, more)
        if total is not None:
            task = TaskContext.get().partitionId()
            yield pa.record_batch({"at": pa.array(np.arange(size, dtype=np.int32)), "task": pa.array(np.full(size, task)), "high": pa.array(list(total[0])), "low": pa.array(list(total[1]))})

    kinds = "at int, task long, high array<double>, low array<double>"
    sums = rows.select("x").mapInArrow(lean(run), kinds).withColumn("part", F.pmod("task", F.lit(SPREAD)))
    sums = sums.groupBy("at", "part").applyInArrow(lambda t: _merged(t), kinds).groupBy("at").applyInArrow(lambda t: _merged(t), kinds)
    high, low = np.zeros((size, size)), np.zeros((size, size))
    for r in sums.collect():  # one row for each dimension
        high[r["at"]], low[r["at"]] = r["high"], r["low"]
    return high, low


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            more = matrix(batch.column(0)).sum(axis=0)
            total = more if total is None else total + more
    if total is not None:
        yield pa.record_batch({"at": pa.array(np.arange(len(total), dtype=np.int32)), "total": pa.array(total)})


def whiten(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per remaining row and component: id, component, n, deviation (decimal), whitened, explained, identity_error.

    Rows whose vector is null or has a null or non-finite entry drop out, and so do empty vectors and those that have not
    the commonest length (the longer of two as common). An entry c counts as x = floor(SCALE * c) + OFFSET. Components
    are eigenvectors of the covariance of x over all remaining rows (divisor n, centred before multiplying), by falling
    eigenvalue. deviation is the exact sum of (n * x - S)^2 over dimensions, whitened is x - S / n on the component over
    the root of its eigenvalue. A component without variance (fewer distinct rows than dimensions) has whitened null and
    explained 0, and identity_error leaves it out; if nothing varies, explained and identity_error are null. Repeated
    rows, and ids, count as often as they occur and are given back as often; a null id stays null. Other columns are
    dropped, whatever their names. An empty table gives no rows.
    """
    spark = bounded(rows.sparkSession)
    c = F.transform(F.col(vector_column), lambda v: v.cast("double"))
    finite = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    source = rows.select(F.col(id_column).cast("long").alias("id"), c.alias("c")).where(F.col("c").isNotNull() & finite & (F.size("c") > 0))
    found = source.groupBy(F.size("c").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    size, n = found[0] if found else (1, 0)
    x = source.where(F.size("c") == size).select("id", F.transform("c", lambda v: F.floor(v * SCALE) + OFFSET).alias("x"))
    totals = [0] * size
    if n:
        for at, total in x.select("x").mapInArrow(lean(_sums), "at int, total long").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect():
            totals[at] = int(total)
    means = [Fraction(s, max(n, 1)) for s in totals]
    high = np.array([float(m) for m in means])
    mean: Pair = (high, np.array([float(m - Fraction(h)) for m, h in zip(means, high.tolist(), strict=True)]))
    covariance = sum(co_moment(x, lambda block: centre(block, mean), size)) / n if n else np.zeros((size, size))
    values, vectors = eigen((covariance + covariance.T) / 2)
    values, vectors = values[:components], vectors[:, :components]
    trace = float(np.trace(covariance))
    live = values > RANK * size * max(values[0], 0.0)
    values = np.where(live, values, 0.0)
    weights = vectors / np.sqrt(np.where(live, values, np.inf))

    def whitened(block: np.ndarray) -> Pair:
        high, low = centre(block, mean)
        out = high @ weights + low @ weights
        return out, np.zeros_like(out)

    error = None
    if live.any():
        square = sum(co_moment(x, whitened, len(values))) / n
        error = float(np.abs(square - np.eye(len(values)))[np.ix_(live, live)].max())
    sums = np.array([float(s) for s in totals])
    explained = [float(v) / trace if trace > 0 else None for v in values]

    def deviation(block: np.ndarray) -> pa.Array:
        if np.sqrt(size) * (np.abs(block).max() * float(n) + np.abs(sums).max()) < 2**31.4:
            return pa.array(((block * n - np.array(totals, np.int64)) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
        exact = block.astype(object) * n - np.array(totals, object)
        return pa.array([Decimal(v) for v in (exact * exact).sum(axis=1).tolist()], pa.decimal128(38, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                m, block = part.num_rows, matrix(part.column(1))
                of = np.repeat(np.arange(m), k)
                out = np.where(live, whitened(block)[0], 0.0)
                yield pa.record_batch({
                    "id": part.column(0).take(pa.array(of)), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), "n": pa.array(np.full(m * k, n, np.int64)),
                    "deviation": deviation(block).take(pa.array(of)), "whitened": pa.array(out.ravel(), mask=np.tile(~live, m)),
                    "explained": pa.array(explained * m, pa.float64()), "identity_error": pa.array([error] * (m * k), pa.float64()),
                })

    out = x.mapInArrow(lean(run), "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_column)
