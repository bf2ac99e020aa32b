"""Written intermediate tables in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Rows of a partition.
ROWS = 1 << 18
#: Bytes of an Arrow batch between the JVM and a Python worker, for rows of long lists.
BATCH_BYTES = 8 << 20


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, on one machine, a folder that ends with the process."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not said:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="docloom-tables-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        said = f"file://{_own[0]}"
    return f"{said.rstrip('/')}/docloom"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def path_for(source: DataFrame, name: str) -> str:
    """A path below the shared folder that is the same as long as source reads the same files: what is made of them once
    is found there again."""
    spark, seen = source.sparkSession, hashlib.sha256()
    for file in sorted(source.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        seen.update(f"{file} {status.getLen()} {status.getModificationTime()}\n".encode())
    return f"{shared_root(spark)}/{name}-{seen.hexdigest()[:32]}"


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to as many partitions as keep each at about ROWS, so that a task's memory does not grow with them."""
    parts = ceil(rows.count() / ROWS)
    return rows.repartition(parts, *keys) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(*keys)


@contextlib.contextmanager
def slim(spark: SparkSession):
    """Arrow batches of BATCH_BYTES for the plans made and run within, where the session has Spark's default of 64 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    said = spark.conf.get(key, "67108864b")
    if said == "67108864b":
        spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        if said == "67108864b":
            spark.conf.unset(key)


def lean(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The same batch function; at its end the worker, which Spark keeps for later stages, gives free memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return run


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written and read again: computed once, and whole after a lost executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
