"""Versioned tables, the segmented lexical index and the inverted file of cells, against plain versions."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom import schemas, storage
from docloom.operators import dense, lexical
from docloom.operators.dense import Cells, dense_topk, fit_cells
from docloom.operators.lexical import Index
from docloom.operators.retrieval import hash_embedding
from docloom.sources import corpus
from docloom.sources.snapshots import Conflict, Snapshots
from docloom.sources.vectors import VectorTable

SF = "/root/testdata/sf0.001"


def failing(rows):
    """The same rows; the task that meets the last of them fails."""
    return rows.withColumn("text", F.when(F.col("text") == "bad", F.raise_error(F.lit("broken"))).otherwise(F.col("text")))


def passages(spark, texts):
    return spark.createDataFrame([(f"d:p1:{n}", "d", "T", 1, None, t, None, "en") for n, t in enumerate(texts)], schemas.PASSAGE)


def test_failed_write_keeps_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "p")
    corpus.save_passages(passages(spark, ["one", "two"]), path)
    held = corpus.load_passages(spark, path)
    with pytest.raises(Exception, match="broken"):
        corpus.save_passages(failing(passages(spark, ["new"] * 50 + ["bad"])), path)
    assert sorted(r["text"] for r in corpus.load_passages(spark, path).collect()) == ["one", "two"]
    assert corpus.save_passages(corpus.load_passages(spark, path).limit(1).withColumn("text", F.lit("three")), path) == 2
    assert [r["text"] for r in corpus.load_passages(spark, path).collect()] == ["three"] and held.count() == 2  # its version is still there
    corpus.save_passages(passages(spark, ["four"]), path)
    assert Snapshots(spark, path).versions() == [2, 3] and len(list((tmp_path / "p" / "data").iterdir())) == 2


def test_two_changes_at_once(spark, tmp_path):
    base = Snapshots(spark, str(tmp_path / "t"))
    with base.change() as change:
        change.replace("a", spark.range(3))
    with pytest.raises(Conflict), base.change() as late:
        with base.change() as first:
            first.append("a", spark.range(2))
        late.append("a", spark.range(9))
    assert base.read("a").count() == 5 and base.read("a", 1).count() == 3 and base.latest() == 2
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2  # the refused change has left nothing
    with pytest.raises(KeyError):
        base.read("b")
    empty = Snapshots(spark, str(tmp_path / "none"))
    assert empty.latest() is None and empty.versions() == [] and empty.describe()["tables"] == {}


def test_failed_upsert_adds_nothing(spark, tmp_path):
    table = VectorTable(spark, str(tmp_path / "v"), "m", 2)
    rows = lambda a, b, size=2: spark.range(a, b).select(F.col("id").cast("string").alias("point_id"), F.lit("p").alias("passage_id"), F.lit("d").alias("doc_id"), F.lit(1).alias("page"), F.array(*[F.lit(1.0)] * size).alias("v"))
    table.upsert(rows(0, 5))
    with pytest.raises(Exception, match="2 dimensions"):
        table.upsert(rows(5, 30).unionByName(rows(30, 31, 3)))
    assert table.count() == 5
    table.upsert(rows(3, 9))
    assert table.count() == 9 and VectorTable(spark, str(tmp_path / "v"), "m", 2, version=1).count() == 5


def brute_bm25(docs, queries, terms_of, k):
    bags = {i: Counter(terms_of[t]) for i, t in docs}
    lengths = {i: sum(b.values()) for i, b in bags.items()}
    n, mean = len(bags), sum(lengths.values()) / len(bags)
    df = Counter(t for b in bags.values() for t in b)
    out = set()
    for q, text in queries:
        scores = Counter()
        for t in set(terms_of[text]):
            idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
            for i, b in bags.items():
                if t in b:
                    scores[i] += idf * b[t] * 2.5 / (b[t] + 1.5 * (0.25 + 0.75 * lengths[i] / mean))
        best = sorted(((-round(s, 5), i) for i, s in scores.items()))[:k]
        out |= {(q, i, rank, round(-s, 4)) for rank, (s, i) in enumerate(best, 1)}
    return out


def found(df):
    return {(r["query_id"], r["id"], r["rank"], round(r["score"], 4)) for r in df.collect()}


def test_segments(spark, tmp_path, monkeypatch):
    from docloom.functions.text import tokens

    monkeypatch.setattr(lexical, "SHARD", 512)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9003, "of the")], "doc_id long, text string"))
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text").unionByName(spark.createDataFrame([(-1, ""), (-2, "nowhere-to-be-found")], "query_id long, text string"))
    texts = docs.select("text").unionByName(asked.select("text")).distinct().select("text", tokens(F.col("text")).alias("t")).collect()
    want = brute_bm25([tuple(r) for r in docs.collect()], [tuple(r) for r in asked.collect()], {r["text"]: r["t"] for r in texts}, 10)
    whole = Index.build(docs, str(tmp_path / "whole"), "doc_id")
    assert found(whole.lexical(asked, 10)) == want and whole.ids.count() == docs.count()
    parts = Index.build(docs.where("doc_id % 8 = 0"), str(tmp_path / "parts"), "doc_id")
    first = parts.version
    for k in range(1, 8):
        before = set(parts.segments)
        parts = parts.add(docs.where(f"doc_id % 8 <= {k}"), "doc_id")  # what is indexed already is left out
        assert len(set(parts.segments) - before) == 1
    assert len(parts.segments) < 8 and sum(s["passages"] for s in parts.segments.values()) == docs.count()
    assert found(parts.lexical(asked, 10)) == want
    assert sorted(map(tuple, parts.postings.collect())) == sorted(map(tuple, whole.postings.collect()))
    old = Index(spark, str(tmp_path / "parts"), first)
    assert old.ids.count() == docs.where("doc_id % 8 = 0").count() and found(old.lexical(asked, 10)) == found(Index.build(docs.where("doc_id % 8 = 0"), str(tmp_path / "old"), "doc_id").lexical(asked, 10))
    with pytest.raises(Exception, match="broken"):
        parts.add(failing(spark.createDataFrame([(9100, "fine words"), (9101, "bad")], "doc_id long, text string")), "doc_id")
    assert Index(spark, parts.path).version == parts.version
    among = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"))
    every = brute_bm25([tuple(r) for r in docs.collect()], [tuple(r) for r in asked.collect()], {r["text"]: r["t"] for r in texts}, 10**6)
    held = sorted((q, -s, i) for q, i, _, s in every if i % 3 == 0)
    per = Counter(q for q, *_ in held)
    got = found(parts.lexical(asked, 10, among))
    assert Counter(q for q, *_ in got) == {q: min(n, 10) for q, n in per.items()} and {(q, i) for q, i, *_ in got} <= {(q, i) for q, _, i in held}


def test_blocks_are_left_out():
    """A shard of many passages: the kernel's best are those of the whole sum, whatever the order of scores."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    n, words = 3000, [f"w{k}" for k in range(12)]
    lengths = rng.integers(5, 80, n)
    lengths[17] = 3
    rows = {w: np.flatnonzero(rng.random(n) < p) for w, p in zip(words, np.linspace(0.9, 0.002, 12), strict=True)}
    counts = {w: rng.integers(1, 9, len(at)) for w, at in rows.items()}
    idf = {w: float(np.log(1 + (n - len(at) + 0.5) / (len(at) + 0.5))) for w, at in rows.items()}
    norm = 1.5 * (0.25 + 0.75 * lengths / 40.0)
    total = np.zeros(n)
    for w, at in rows.items():
        total[at] += idf[w] * counts[w] * 2.5 / (counts[w] + norm[at])
    schema = pa.schema([("segment", pa.string()), ("shard", pa.int64()), ("kind", pa.int32()), ("term", pa.string()), ("places", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("docs", pa.list_(pa.string())), ("query_id", pa.int64()), ("terms", pa.list_(pa.string())), ("idf", pa.list_(pa.float64())), ("doc_ids", pa.list_(pa.string()))])
    base = {name: None for name in schema.names} | {"segment": "s", "shard": 0}
    held = [base | {"kind": 0, "ids": list(range(n)), "lengths": lengths.tolist()}] + [base | {"kind": 1, "term": w, "places": at.tolist(), "counts": counts[w].tolist()} for w, at in rows.items()] + [base | {"kind": 2, "query_id": 5, "terms": words, "idf": [idf[w] for w in words]}]
    out = pa.Table.from_batches(lexical._scored(20, 40.0, [pa.int64(), pa.int64()])(iter([pa.RecordBatch.from_pylist(held, schema)])))
    want = np.argsort(-total, kind="stable")[:20]
    got = dict(zip(out.column("id").to_pylist(), out.column("score").to_pylist(), strict=True))
    assert set(want.tolist()) <= set(got) and all(abs(total[i] - s) < 1e-9 for i, s in got.items()) and len(got) < 60


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16))
    v = centres[rng.integers(0, 12, 1500)] + 0.5 * rng.standard_normal((1500, 16))
    v[:700] = v[0] + 0.01 * rng.standard_normal((700, 16))  # nearly half of all in one cell
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, spark.createDataFrame([(k, [float(c) for c in x], f"d{k % 5}") for k, x in enumerate(v)], "id long, v array<double>, doc_id string")


def test_cells(spark, vectors, tmp_path):
    v, rows = vectors
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "v")
    scores = np.round(v[::20] @ v.T, 5)
    scores[np.arange(75), np.arange(0, 1500, 20)] = -9
    want = {(q * 20, int(i), r) for q in range(75) for r, i in enumerate(np.lexsort((np.arange(1500), -scores[q]))[:10], 1)}
    exact = {(r["query_id"], r["id"], r["rank"]) for r in dense_topk(rows, asked, 10).collect()}
    assert exact == want
    cells = Cells.build(rows, str(tmp_path / "cells"))
    assert cells.blocks.select(F.sum(F.size("rows"))).first()[0] == 1500 and cells.blocks.agg(F.max(F.size("rows"))).first()[0] <= 2048
    all_ = cells.topk(asked, 10, probes=len(cells.centroids))
    assert {(r["query_id"], r["id"], r["rank"]) for r in all_.collect()} == want
    near = {(r["query_id"], r["id"]) for r in cells.topk(asked, 10).collect()}
    assert len(near & {w[:2] for w in want}) >= 0.9 * len(want)
    limited = asked.withColumn("doc_ids", F.when(F.col("query_id") % 40 == 0, F.array(F.lit("d1"))).otherwise(F.array().cast("array<string>")))
    for hits in (dense_topk(rows, limited, 10), Cells(spark, str(tmp_path / "cells")).topk(limited, 10, probes=99)):
        got = hits.join(rows.select("id", "doc_id"), "id").collect()
        assert {r["doc_id"] for r in got if r["query_id"] % 40 == 0} == {"d1"} and len({r["doc_id"] for r in got if r["query_id"] % 40}) == 5
    assert dense_topk(rows, asked.limit(0), 3).collect() == [] and dense_topk(rows.limit(0), asked, 3).collect() == []
    assert fit_cells(np.zeros((0, 3)), 4).shape == (1, 1) and len(fit_cells(np.ones((3, 2)), 5)) == 3


def test_recall_on_embeddings(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = rows.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    want = {(r["query_id"], r["id"]) for r in dense_topk(rows, asked, 10).collect()}
    cells = Cells.build(rows, str(tmp_path / "cells"))
    recall = lambda probes: len(want & {(r["query_id"], r["id"]) for r in cells.topk(asked, 10, probes).collect()}) / len(want)
    assert cells.probes < len(cells.centroids) and recall(None) >= 0.9 and recall(len(cells.centroids)) == 1.0


def test_dense_without_broadcast(spark):
    """Pairs meet in parts of a grid: no side is broadcast, a part gives k rows a query, copies and null vectors included."""
    rows = spark.range(3000).select("id", F.when(F.col("id") != 7, F.when(F.col("id") < 2900, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.6), F.lit(0.8)))).alias("v"))
    asked = rows.where("id % 20 = 0 or id = 7").withColumnRenamed("id", "query_id")
    found = dense_topk(rows, asked, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    near, far = [i for i in range(2900) if i != 7], list(range(2900, 3000))
    assert got == {q: [(i, 1.0) for i in (near if q < 2900 else far) if i != q][:3] for q in range(0, 3000, 20)}
    names = rows.select(F.format_string("n%04d", "id").alias("id"), "v")
    few = dense_topk(names, asked.where("query_id in (0, 2900)"), 3, same_ids=False).orderBy("query_id", "rank").collect()
    assert [r["id"] for r in few] == ["n0000", "n0001", "n0002", "n2900", "n2901", "n2902"]
    held, dense.HELD = dense.HELD, 400
    try:  # many columns of queries
        assert sorted(map(tuple, dense_topk(rows, asked, 3).collect())) == sorted(map(tuple, found.collect()))
    finally:
        dense.HELD = held


def plain_vector(text):
    counts = Counter(int(hashlib.md5(w.encode()).hexdigest()[:2], 16) for w in text.split())
    norm = math.sqrt(sum(n * n for n in counts.values()))
    return [counts[b] / norm for b in range(256)]


def test_vectors_of_shards(spark, tmp_path, monkeypatch):
    """Vectors come from each shard's postings in one shuffle, over segments and merged tiers; no terms, no vector."""
    monkeypatch.setattr(lexical, "SHARD", 300)
    texts = {n: " ".join(f"w{(n * k) % 97}q" for k in range(1 + n % 40)) for n in range(900)} | {900: "", 901: None}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    index = Index.build(rows.where("doc_id < 500"), str(tmp_path / "v"), "doc_id").add(rows.where("doc_id >= 500"), "doc_id")
    want = {n: plain_vector(t) for n, t in texts.items() if t}
    assert {r["id"]: r["v"] for r in index.vectors().collect()} == want
    plan = index.vectors()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert {r["id"]: r["v"] for r in dense.text_vectors(rows, "doc_id", "text").collect()} == want


def test_hash_embedding_counts_once(spark):
    """Terms are counted by bucket at once: one shuffle, also for an id that comes twice."""
    rows = spark.createDataFrame([(1, "alpha beta alpha"), (1, "beta gamma"), (2, None)], "doc_id long, text string")
    found = hash_embedding(rows, "doc_id", "text")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    counts = Counter(int(hashlib.md5(w.encode()).hexdigest()[:2], 16) for w in "alpha beta alpha beta gamma".split())
    assert sorted(map(tuple, found.collect())) == sorted((1, b, n) for b, n in counts.items())


def test_build_in_small_batches(spark, tmp_path, monkeypatch):
    """Shards are inverted from batches of bounded bytes, however many passages a task reads; the session stays as it was."""
    monkeypatch.setattr(storage, "BATCH_BYTES", 1 << 12)
    made, said = lexical._invert, spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")

    def watched(segment):
        def run(batches):
            def each():
                for batch in batches:
                    if batch.num_rows > 200:
                        raise ValueError("a large batch")
                    yield batch

            yield from made(segment)(each())

        return run

    monkeypatch.setattr(lexical, "_invert", watched)
    rows = spark.range(8000).select(F.col("id").alias("doc_id"), F.format_string("w%dq w%dq w%dq alpha beta", F.col("id") % 13, F.col("id") % 7, F.col("id") % 13).alias("text"))
    index = Index.build(rows, str(tmp_path / "small"), "doc_id")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == said
    got = {(r["term"], r["id"]): r["tf"] for r in index.postings.where("id < 200").collect()}
    want = {(t, n): c for n in range(200) for t, c in Counter(f"w{n % 13}q w{n % 7}q w{n % 13}q alpha beta".split()).items()}
    assert got == want
