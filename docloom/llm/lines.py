"""Lines that many documents share, dropped by levelled sorted runs of line hashes.

Documents come in batches. A batch's distinct line keys, each with its number of documents and its largest id, are a
table bucketed and sorted by hash. It is merge-anti-joined with every run so far: what is left are first sightings,
and they become a run of their own; the others are sightings again and go to a side table. Runs hold a key once among
them all. Once a level has FAN_OUT runs they are compacted into one run of the next level. In the end a key's number of
documents is that of its first sighting and of its repeats together.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import bounded, delete, lean, new_path, stash

LEAST_CHARS, LEAST_DOCS = 40, 5
BATCHES, FAN_OUT = 4, 2
#: What is stripped from both ends of a line before it is compared.
BLANKS = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
#: Rows of an output batch.
ROWS = 1 << 15


class LineRuns:
    """Levels of runs, each a table (h1, h2, docs, largest) bucketed and sorted by the 128-bit hash of a key."""

    def __init__(self, spark: SparkSession, fan_out: int = FAN_OUT):
        self.spark, self.fan_out = spark, fan_out
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.repeats: list[DataFrame] = []
        self._paths: dict[str, str] = {}

    def _save(self, rows: DataFrame, name: str) -> str:
        table = f"{name}_{uuid.uuid4().hex}"
        self._paths[table] = new_path(self.spark, name)
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", self._paths[table]).saveAsTable(table)
        return table

    def _remove(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete(self.spark, self._paths.pop(table))

    def _without(self, rows: DataFrame, tables: list[str]) -> DataFrame:
        for table in tables:
            rows = rows.join(self.spark.table(table).select(*KEY).hint("merge"), KEY, "left_anti")
        return rows

    @property
    def runs(self) -> list[str]:
        return [table for level in self.levels for table in level]

    def add(self, keys: DataFrame) -> None:
        """Takes a batch of (h1, h2, docs, largest) with each key once."""
        batch = self._save(keys.select(*KEY, "docs", "largest"), "batch")
        rows = self.spark.table(batch)
        if not self.runs:
            self.levels = [[batch]]
            return
        run = self._save(self._without(rows, self.runs), "run")
        self.repeats.append(stash(self._without(rows, [run]), "repeats"))
        self._remove(batch)
        self.levels[0].append(run)
        self._compact()

    def _compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) >= self.fan_out:
                rows = self.spark.table(level[0])
                for table in level[1:]:
                    rows = rows.unionByName(self.spark.table(table))
                merged = self._save(rows.repartition(self.buckets, *KEY), "run")
                for table in level:
                    self._remove(table)
                self.levels[k] = []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(merged)

    def totals(self, least_docs: int) -> DataFrame:
        """(h1, h2, keeper) of the keys of at least so many documents; keeper is the largest id that holds the key."""
        out = None
        again = self.repeats[0] if self.repeats else None
        for more in self.repeats[1:]:
            again = again.unionByName(more)
        if again is not None:
            again = again.groupBy(*KEY).agg(F.sum("docs").alias("more"), F.max("largest").alias("later"))
        for table in self.runs:
            rows = self.spark.table(table)
            if again is None:
                rows = rows.withColumns({"more": F.lit(0).cast("long"), "later": F.lit(None).cast("long")})
            else:
                rows = rows.join(again.hint("merge"), KEY, "left")
            rows = rows.where(F.col("docs") + F.coalesce("more", F.lit(0)) >= least_docs).select(*KEY, F.greatest("largest", "later").alias("keeper"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def close(self) -> None:
        for table in list(self._paths):
            self._remove(table)
        for table in self.repeats:
            delete(self.spark, table._docloom_path)


def _keys(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks, hashes, places = [], [], [], []

        def out() -> pa.RecordBatch:
            pair = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            columns = [pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(places, pa.list_(pa.int32()))]
            for some in (ids, marks, hashes, places):
                some.clear()
            return pa.record_batch(columns, names=["doc_id", "mark", *KEY, "at"])

        for batch in batches:
            for doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found: dict[bytes, list[int]] = {}
                for k, line in enumerate(text.as_py().split("\n")):
                    line = line.strip(BLANKS)
                    if len(line) >= least_chars:
                        found.setdefault(xxhash.xxh3_128_digest(line.encode().lower()), []).append(k)
                ids += [doc] * len(found)
                marks += [mark] * len(found)
                hashes += found.keys()
                places += found.values()
                if len(ids) >= ROWS:
                    yield out()
        if ids:
            yield out()

    return run


def drop_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fan_out: int = FAN_OUT) -> DataFrame:
    """Per row: id, n_lines (before dropping), n_dropped and kept_text.

    A key is a line with blanks stripped at both ends and A-Z lower-cased. Keys of at least least_chars code points
    that at least least_docs documents hold lose all their lines, but for those in the largest id that holds the key.
    Shorter lines stay. Rows of one id are one document when documents are counted; each row is split by itself and
    given back. A null id is one document, less than all others: it keeps a line only where every holder's id is null.
    Null and empty texts are one empty line. Other columns are dropped, whatever their names. An empty table gives no
    rows. Keys are told apart by 128 bits of hash.
    """
    spark = bounded(docs.sparkSession)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    path = new_path(spark, "lines")
    keys = source.select("doc_id", "mark", "text").mapInArrow(lean(_keys(least_chars)), "doc_id long, mark long, h1 long, h2 long, at array<int>")
    keys.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(path)
    keys = spark.read.schema("doc_id long, mark long, h1 long, h2 long, at array<int>, batch int").parquet(path)
    runs = LineRuns(spark, fan_out)
    try:
        for k in range(batches):
            holders = keys.where(F.col("batch") == k).select(*KEY, "doc_id").distinct()
            runs.add(holders.groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("doc_id").alias("largest")))
        shared = stash(runs.totals(least_docs), "shared")
    finally:
        runs.close()
    gone = keys.join(shared, KEY).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    gone = gone.groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("at")).alias("at")).withColumnsRenamed({"doc_id": "__id", "mark": "__mark"})
    rows = source.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")), "left")
    rows = rows.select("doc_id", F.split("text", "\n", -1).alias("lines"), F.coalesce("at", F.array().cast("array<int>")).alias("at"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "at")
    rows = rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"), "lines", kept.alias("kept"))
    text = F.array_join(F.transform("kept", lambda k: F.get("lines", k)), "\n")
    return rows.select(F.col("doc_id").alias(id_column), "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), text.alias("kept_text"))


ORACLE = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
