"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Bytes of an Arrow batch between the JVM and a Python worker, where the session has Spark's default of 64 MB.
BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with small Arrow batches unless it asks for a size of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") == "67108864b":
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def lean(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The same batch function; at its end the worker, which Spark keeps for later stages, gives free memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return run


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset (tests on one machine), a temporary folder of this process."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if said:
        return said.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="docloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/docloom/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str, thin: bool = False) -> DataFrame:
    """The rows of df, written and read again: cuts lineage and survives lost executors.

    thin: a table of a few numbers per row, which goes to an eighth of the files.
    """
    spark = bounded(df.sparkSession)
    path = new_path(spark, name)
    if thin:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._docloom_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(*stashed: DataFrame) -> None:
    """Deletes the files of stashes that no later plan reads."""
    for df in stashed:
        delete(df.sparkSession, df._docloom_path)
