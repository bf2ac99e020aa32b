"""The page source and the log sink: ranges, pushed bounds, damaged files, whole or no appends."""

import pytest
from pyspark.sql import functions as F

from docloom.sources import pages


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    (root / "sub").mkdir()
    (root / "a.txt").write_text("\f".join(f"a{k}" for k in range(40)))
    (root / "sub" / "b.txt").write_text("")
    (root / "c.txt").write_bytes(b"\0\1")
    (root / "d.txt").write_bytes(b"d0\fd1\f\xff\fd3")
    (root / "_hidden.txt").write_text("no")
    (root / "e.pdf").write_text("no")
    return f"file://{root}"


def rows(df):
    return sorted((r["path"].rsplit("/", 1)[1], r["page"], r["text"], r["error"]) for r in df.collect() if r["error"] is None)


def test_pages(spark, folder):
    df = pages.read_pages(spark, folder, pattern="*.txt")
    got = rows(df)
    assert got == sorted([("a.txt", k, f"a{k}", None) for k in range(40)] + [("b.txt", 0, "", None)] + [("d.txt", k, f"d{k}", None) for k in (0, 1, 3)])
    damaged = df.where("error is not null").orderBy("path").collect()
    assert [(r["path"].rsplit("/", 1)[1], r["page"], r["text"], r["error"].split(":")[0]) for r in damaged] == [("c.txt", None, None, "ValueError"), ("d.txt", 2, None, "UnicodeDecodeError")]
    assert pages.read_pages(spark, folder, pattern="nothing*").count() == 0 and pages.read_pages(spark, f"{folder}/none").count() == 0


def test_bounds_reach_the_reader(spark, folder):
    ranges = lambda **options: [(p.first, p.end) for p in pages.PageReader({"path": folder, "pattern": "a.txt", "pagesPerTask": "8"} | options).partitions()]
    assert ranges() == [(k, k + 8) for k in range(0, 40, 8)] and ranges(first="4", end="20") == [(4, 12), (12, 20)] and ranges(first="50") == [(0, 0)]
    df = pages.read_pages(spark, folder, pattern="a.txt")
    assert rows(df.where("page < 3")) == [("a.txt", k, f"a{k}", None) for k in range(3)] and df.count() == 40 and df.rdd.getNumPartitions() == 3
    some = pages.read_pages(spark, folder, pattern="a.txt", first=17, end=19)
    assert rows(some) == [("a.txt", 17, "a17", None), ("a.txt", 18, "a18", None)] and some.rdd.getNumPartitions() == 1


def test_log_is_whole(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    pages.append_log(spark.range(7).select("id", F.lit(None).cast("string").alias("none"), F.current_timestamp().alias("ts")), path)
    bad = spark.range(0, 40, 1, 4).select(F.when(F.col("id") == 39, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        pages.append_log(bad, path)
    read = lambda: spark.read.schema("id long").json(path)
    assert sorted(r["id"] for r in read().collect()) == list(range(7)) and list((tmp_path / "log" / "_staged").iterdir()) == []
    pages.append_log(spark.range(2), path)
    assert read().count() == 9
