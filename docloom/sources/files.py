"""Files behind Hadoop's file systems, whatever their store: listing, copying with a marker, safe names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Written last into a copied folder; a folder without it is incomplete.
DONE = "_COPIED"


def path_of(spark: SparkSession, uri: str):
    """(file system, path) of a URI in the JVM."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, uri: str) -> bool:
    store, path = path_of(spark, uri)
    return store.exists(path)


def bucket_and_prefix(url: Column) -> Column:
    """gs://bucket/a/b as struct(bucket, prefix "a/b/"); null for other URLs and without a bucket."""
    bucket = F.regexp_extract(url, "^gs://([^/]+)", 1)
    prefix = F.trim(F.regexp_extract(url, "^gs://[^/]+/(.*)$", 1), F.lit("/"))
    return F.when(bucket != "", F.struct(bucket.alias("bucket"), F.when(prefix != "", F.concat(prefix, F.lit("/"))).otherwise("").alias("prefix")))


def relative(name: Column, prefix: Column) -> Column:
    """An object's path below its folder as struct(path, safe): path is null for a placeholder of a folder; a path that
    would leave the folder is not safe."""
    rest = F.substring(name, F.length(prefix) + 1, F.length(name))
    placeholder = (F.replace(F.replace(rest, F.lit("/"), F.lit("")), F.lit("."), F.lit("")) == "") & ~F.contains(rest, F.lit("..")) | F.endswith(name, F.lit("/"))
    safe = ~F.startswith(rest, F.lit("/")) & ~F.array_contains(F.split(rest, "/"), F.lit(".."))
    return F.struct(F.when(~placeholder, rest).alias("path"), safe.alias("safe"))


def list_objects(spark: SparkSession, folder: str) -> DataFrame:
    """(uri, path, bytes) of all files below a folder; the store's own client pages through long listings.

    A name that leads out of the folder raises.
    """
    store, root = path_of(spark, folder)
    base = store.makeQualified(root).toString().rstrip("/") + "/"
    found, walk = [], store.listFiles(root, True)
    while walk.hasNext():
        status = walk.next()
        found.append((status.getPath().toString(), status.getLen()))
    rows = spark.createDataFrame(found, "uri string, bytes long").select("uri", "bytes", relative(F.col("uri"), F.lit(base)).alias("r"))
    unsafe = F.when(~F.col("r.safe"), F.raise_error(F.concat(F.lit("unsafe object name: "), "uri"))).otherwise(F.col("r.path"))
    return rows.select("uri", unsafe.alias("path"), "bytes").where("path is not null")


def copy_folder(spark: SparkSession, source: str, target: str) -> bool:
    """Copies a folder's files, then writes the marker; False if a complete copy is there already."""
    store, root = path_of(spark, target)
    if exists(spark, f"{target}/{DONE}"):
        return False
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for row in list_objects(spark, source).toLocalIterator():
        origin, at = path_of(spark, row["uri"])
        jvm.org.apache.hadoop.fs.FileUtil.copy(origin, at, store, jvm.org.apache.hadoop.fs.Path(f"{target}/{row['path']}"), False, True, conf)
    store.create(jvm.org.apache.hadoop.fs.Path(root, DONE), True).close()
    return True


def sign_in(spark: SparkSession, scheme: str, **settings: str) -> None:
    """Sets a store's credentials (as fs.gs.auth.type); its connector then refreshes tokens itself."""
    for name, value in settings.items():
        spark._jsc.hadoopConfiguration().set(f"fs.{scheme}.{name.replace('_', '.')}", value)
