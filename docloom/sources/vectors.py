"""Vectors of passages as a table per model, appended to and read by key, in versions of a folder."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .snapshots import Change, Snapshots


def point_id(model: str, embed_text: Column) -> Column:
    """Key of a vector: it changes with the model and with what is embedded, and with nothing else."""
    return F.sha2(F.concat(F.lit(f"{model}\n"), embed_text), 256)


class VectorTable:
    """Vectors of one model and dimension in a versioned folder, which may hold other tables too.

    Reads the latest version, or the one it is given. A key is stored once: two changes at a time are refused.
    """

    def __init__(self, spark: SparkSession, root: str, model: str, dim: int, version: int | None = None):
        self.spark, self.model, self.dim, self.version = spark, model, dim, version
        self.snapshots = Snapshots(spark, root)
        self.name = f"vectors-{re.sub('[^A-Za-z0-9_.-]+', '-', model)}-{dim}"

    def rows(self) -> DataFrame:
        version = self.snapshots.latest() if self.version is None else self.version
        if self.name not in self.snapshots.describe(version)["tables"]:
            return self.spark.createDataFrame([], schemas.VECTOR)
        return self.snapshots.read(self.name, version)

    def count(self) -> int:
        return self.rows().count()

    def _stored(self, change: Change | None) -> DataFrame:
        if change is None:
            return self.rows()
        return change.read(self.name) if change.has(self.name) else self.spark.createDataFrame([], schemas.VECTOR)

    def missing(self, passages: DataFrame, change: Change | None = None) -> DataFrame:
        """Passages (point_id, ...) whose vector is not stored."""
        return passages.join(self._stored(change).select("point_id"), "point_id", "left_anti")

    def upsert(self, vectors: DataFrame, change: Change | None = None) -> None:
        """Adds (point_id, passage_id, doc_id, page, v) of keys that are not stored; a vector of another length raises.

        change: a change of the same folder that this belongs to; without one it is a change of its own.
        """
        if change is None:
            with self.snapshots.change() as own:
                return self.upsert(vectors, own)
        right = F.when(F.size("v") == self.dim, F.col("v").cast("array<double>")).otherwise(F.raise_error(F.lit(f"a vector of {self.model} has not {self.dim} dimensions")))
        rows = vectors.select("point_id", "passage_id", "doc_id", "page", right.alias("v"), F.lit(self.model).alias("model"))
        change.append(self.name, self.missing(rows.dropDuplicates(["point_id"]), change))

    def index(self, passages: DataFrame, embed: Callable[[DataFrame], DataFrame], change: Change | None = None) -> None:
        """Embeds and stores what is missing. passages (passage_id, doc_id, page, embed_text); embed adds `v`."""
        keyed = passages.withColumn("point_id", point_id(self.model, F.col("embed_text")))
        self.upsert(embed(self.missing(keyed, change).dropDuplicates(["point_id"])), change)

    def copy_to(self, root: str) -> VectorTable:
        """The same vectors below another root; running it again adds only what is new."""
        other = VectorTable(self.spark, root, self.model, self.dim)
        other.upsert(self.rows())
        return other
