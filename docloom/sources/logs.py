"""Logs, caches and job tables: append-only folders of JSON or Parquet, read back with their schema."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from . import files

log = logging.getLogger(__name__)


def append(rows: DataFrame, path: str, form: str = "json") -> None:
    """Adds rows to a log (answers, failures, reports); earlier files stay as they are."""
    rows.write.mode("append").format(form).save(path)


def read(spark: SparkSession, path: str, schema: StructType, form: str = "json") -> DataFrame:
    """A log's rows; none before its first append."""
    return spark.read.schema(schema).format(form).load(path) if files.exists(spark, path) else spark.createDataFrame([], schema)


def json_line(**fields: Column) -> Column:
    """One structured log line; null fields are left out."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))


def stamp(ts: Column) -> tuple[Column, Column]:
    """A time in UTC as ISO seconds and as a part of a file name."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX"), F.date_format(ts, "yyyyMMdd-HHmmss")


def save_trajectories(records: DataFrame, path: str) -> None:
    """Node records (with `ts`), by day."""
    records.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(path)


def load_trajectories(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, schemas.TRAJECTORY)


# Caches -----------------------------------------------------------------------------------------------------------


def cache_key(version: str, name: str, source: str, target: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{version}|{name}|{source}|{target}|"), text), 256)


class Cache:
    """Results by key in a folder: looked up by join, filled by append. Of a key that was written twice one row is read.

    What a damaged file held counts as never cached.
    """

    def __init__(self, spark: SparkSession, path: str, model: str = "", prompt_version: str = ""):
        self.spark, self.path, self.model, self.prompt_version = spark, path, model, prompt_version

    def rows(self) -> DataFrame:
        found = read(self.spark, self.path, schemas.CACHE).where(F.col("key").isNotNull() & F.col("value").isNotNull())
        own = found.where((F.col("model") == self.model) & (F.col("prompt_version") == self.prompt_version))
        return own.groupBy("key").agg(F.min("value").alias("value"))

    def split(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """asked (key, ...) -> those found, with `value`, and one row per key that is missing."""
        held = self.rows()
        return asked.join(held, "key"), asked.join(held, "key", "left_anti").dropDuplicates(["key"])

    def put(self, fresh: DataFrame) -> None:
        append(fresh.select("key", "value", F.lit(self.model).alias("model"), F.lit(self.prompt_version).alias("prompt_version")), self.path)

    def through(self, asked: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """asked with `value`; work turns the missing rows into (key, value), which are kept."""
        missing = self.split(asked)[1]
        self.put(work(missing))
        return asked.join(self.rows(), "key", "left")


# Jobs -------------------------------------------------------------------------------------------------------------


class Jobs:
    """Statuses of jobs, appended as they change; the newest row of a job is its state."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, rows: DataFrame) -> None:
        append(rows.select(*schemas.JOB.names), self.path)

    def all(self) -> DataFrame:
        return read(self.spark, self.path, schemas.JOB)

    def now(self) -> DataFrame:
        return latest(self.all())

    def recover(self) -> None:
        """After a restart: jobs that were queued or running have failed."""
        lost = recovered(self.now()).where("lost").drop("lost")
        self.put(lost.withColumn("seq", F.col("seq") + 1))


def latest(rows: DataFrame, key: str = "job_id") -> DataFrame:
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col("seq").desc()))
    return rows.withColumn("__n", last).where("__n = 1").drop("__n")


def recovered(jobs: DataFrame) -> DataFrame:
    """States with unfinished ones as failed, and `lost` for those."""
    lost = F.col("status").isin("queued", "running")
    return jobs.withColumn("lost", lost).withColumn("detail", F.when(lost, "interrupted by a restart").otherwise(F.col("detail"))).withColumn("status", F.when(lost, "failed").otherwise(F.col("status")))


def run_job(jobs: Jobs, job_id: str, work: Callable[[Callable[[int, int], None]], str]) -> str:
    """Runs work on the driver and records its statuses; work may report (done, total). A failure becomes a status."""
    spark, seq = jobs.spark, iter(range(1, 1 << 62))

    def note(status: str, detail: str = "", done: int = 0, total: int = 0) -> str:
        row = spark.createDataFrame([(job_id, status, detail, done, total, next(seq))], "job_id string, status string, detail string, done int, total int, seq long")
        jobs.put(row.withColumn("ts", F.current_timestamp()))
        return status

    def tell(done: int, total: int) -> None:
        note("running", "", done, total)

    note("running")
    try:
        return note("done", work(tell))
    except Exception as error:  # whatever happened is the job's result
        log.warning("job %s failed", job_id, exc_info=True)
        return note("failed", f"{type(error).__name__}: {error}"[:200])


# Traces -----------------------------------------------------------------------------------------------------------


class Trace:
    """Spans, model calls and scores of requests as rows; off without a path, and never a reason for a run to fail."""

    def __init__(self, spark: SparkSession, path: str | None):
        self.spark, self.path, self.held = spark, path, []

    @property
    def enabled(self) -> bool:
        return self.path is not None

    def note(self, thread: str, kind: str, name: str, **values) -> None:
        if self.enabled:
            self.held.append({"thread": thread, "kind": kind, "name": name, **values})

    def flush(self) -> None:
        held, self.held = self.held, []
        if not held:
            return
        try:
            rows = self.spark.createDataFrame([tuple(h.get(n) for n in schemas.TRACE.names) for h in held], schemas.TRACE)
            append(rows.withColumn("ts", F.coalesce("ts", F.current_timestamp())), self.path)
        except Exception:  # tracing must not stop what it traces
            log.warning("trace not written", exc_info=True)

    def rows(self) -> DataFrame:
        return read(self.spark, self.path, schemas.TRACE) if self.path else self.spark.createDataFrame([], schemas.TRACE)
