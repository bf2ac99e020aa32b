"""The index, three modes, filters, stale vectors, excerpts, and passages from blocks."""

import pytest
from pyspark.sql import functions as F

from docloom import schemas
from docloom.operators import chunk, search
from docloom.providers import HashEmbedder, embed
from docloom.sources import html
from docloom.sources.vectors import VectorTable, point_id


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    texts = [("a", 1, "glacier water rises quickly"), ("a", 2, "dams hold the water of rivers"), ("b", 1, "forest fires burn hills"), ("b", 9, "water for forest fires"), ("c", 1, "")]
    rows = [(f"{d}:p{p}:{n}", d, f"Report {d}", p, None, t, None, "en") for n, (d, p, t) in enumerate(texts)]
    passages = spark.createDataFrame(rows, schemas.PASSAGE).withColumn("embed_text", chunk.embed_text(F.lit(""), F.lit(None).cast("string"), F.col("text")))
    root = str(tmp_path_factory.mktemp("index"))
    index = search.Index.build(passages, f"{root}/lex")
    table = VectorTable(spark, f"{root}/vec", "hash", 256)
    table.index(passages, lambda df: embed(df, HashEmbedder, "embed_text"))
    return passages, index, table, root


def hits(df):
    return [(r["query_id"], r["passage_id"], r["dense_rank"], r["bm25_rank"]) for r in df.orderBy("query_id", "rank").collect()]


def test_modes(spark, corpus):
    passages, index, table, _ = corpus
    asked = spark.createDataFrame([(1, "water dams"), (2, "fires")], "query_id long, text string")
    own = lambda df: embed(df, HashEmbedder, "text", queries=True)
    lex = search.search(passages, asked, index, mode="bm25")
    assert hits(lex)[0] == (1, "a:p2:1", None, 1)
    assert {h[1] for h in hits(lex) if h[0] == 2} == {"b:p1:2", "b:p9:3"} and lex.first()["title"].startswith("Report")
    den = search.search(passages, asked, vectors=table.rows(), embed=own, mode="dense")
    assert hits(den)[0] == (1, "a:p2:1", 1, None)
    both = search.search(passages, asked, index, table.rows(), own, top_k=2)
    assert hits(both)[0] == (1, "a:p2:1", 1, 1) and both.count() == 4
    limited = spark.createDataFrame([(1, "water dams", ["b"]), (2, "water", None), (3, "water", [])], "query_id long, text string, doc_ids array<string>")
    found = search.search(passages, limited, index, table.rows(), own, top_k=9)
    assert {r["doc_id"] for r in found.where("query_id = 1").collect()} == {"b"} and found.where("query_id = 3").count() == found.where("query_id = 2").count() >= 3
    # filters leave the score as it is over the whole corpus
    whole = {r["passage_id"]: r["score"] for r in search.search(passages, limited.drop("doc_ids"), index, mode="bm25", top_k=9).where("query_id = 1").collect()}
    part = {r["passage_id"]: r["score"] for r in search.search(passages, limited, index, mode="bm25", top_k=9).where("query_id = 1").collect()}
    assert part and part == {k: v for k, v in whole.items() if k.startswith("b")}
    # a vector whose passage is gone takes its place among the candidates, then drops out
    fewer = passages.where("passage_id <> 'a:p2:1'")
    cut = search.search(fewer, asked.where("query_id = 1"), vectors=table.rows(), embed=own, mode="dense", candidates=1)
    assert cut.count() == 0
    assert {r["query_id"]: r["unknown"] for r in search.known_documents(spark.createDataFrame([(1, ["a", "x"]), (2, [])], "query_id long, doc_ids array<string>"), passages).collect()} == {1: ["x"], 2: []}
    with pytest.raises(ValueError, match="mode"):
        search.search(passages, asked, index, mode="other")
    with pytest.raises(ValueError, match="embedder"):
        search.search(passages, asked, index)


def test_vectors(spark, corpus):
    passages, _, table, root = corpus
    n = table.count()
    assert n == passages.count()
    table.index(passages, lambda df: embed(df, HashEmbedder, "embed_text"))
    assert table.count() == n and table.copy_to(f"{root}/copy").count() == n
    changed = passages.withColumn("embed_text", F.concat("embed_text", F.lit("!"))).limit(1)
    assert table.missing(changed.withColumn("point_id", point_id("hash", F.col("embed_text")))).count() == 1
    bad = changed.select(F.lit("k").alias("point_id"), "passage_id", "doc_id", "page", F.array(F.lit(1.0)).alias("v"))
    with pytest.raises(Exception, match="256 dimensions"):
        table.upsert(bad)
    assert VectorTable(spark, f"{root}/none", "m/x y", 3).count() == 0


def test_comparison_excerpts(spark, corpus):
    passages = corpus[0]
    found = passages.withColumn("request_id", F.lit(1)).withColumn("rank", F.col("page")).where("doc_id in ('a', 'b')")
    documents = spark.createDataFrame([(1, 0, "b"), (1, 1, "a")], "request_id int, place int, doc_id string")
    excerpts, reports = search.report_ranges(found, documents)
    assert [(r["n"], r["passage_id"]) for r in excerpts.orderBy("n").collect()] == [(1, "b:p1:2"), (2, "b:p9:3"), (3, "a:p1:0"), (4, "a:p2:1")]
    assert [(r["label"], r["doc_id"], r["first"], r["last"]) for r in reports.orderBy("label").collect()] == [("A", "b", 1, 2), ("B", "a", 3, 4)]
    pages = search.summary_passages(passages, spark.createDataFrame([("b", [1, 3]), ("a", None)], "doc_id string, summary_pages array<int>"))
    assert [r["passage_id"] for r in pages.collect()] == ["b:p1:2"]
    many = spark.createDataFrame([("d", k, "x" * 10) for k in range(17)], "doc_id string, n int, text string")
    for most in (200, 100, 45, 3):
        keep = max(1, int(17 * most / 170))
        want = [*range(17)] if most >= 170 else [int(i * (17 / keep)) for i in range(keep)]
        assert sorted(r["n"] for r in search.spread(many, "doc_id", ["n"], most).collect()) == want


def test_passages(spark):
    word = "sediment "
    rows = []
    for page in range(4):
        rows += [("d", page, 0, "Annual survey", 7.0, False), ("d", page, 1, f"Chapter {page} of sands" if page % 2 == 0 else word * 3, 14.0 if page % 2 == 0 else 10.0, False), ("d", page, 2, word * 30, 10.0, False), ("d", page, 3, "page note with words " * 6, 6.0, False)]
    rows += [("d", 4, 0, "tiny", 10.0, False), ("d", 4, 1, "Contents ........ 12", 10.0, False), ("d", 4, 2, "1 234,5 %", 10.0, False)]
    blocks = spark.createDataFrame(rows, "doc_id string, page int, pos int, text string, size double, bold boolean").withColumn("horizontal", F.lit(True)).withColumn("numeric", F.col("text") == "1 234,5 %")
    blocks = blocks.withColumn("box", F.struct(F.lit(0.0).alias("x0"), F.col("pos").cast("double").alias("y0"), F.lit(1.0).alias("x1"), F.lit(2.0).alias("y1")))
    got = chunk.passages(blocks, most=200, overlap=20).orderBy(F.split_part("passage_id", F.lit(":"), F.lit(3)).cast("int")).collect()
    assert [r["passage_id"].split(":")[2] for r in got] == [str(k) for k in range(len(got))] and {r["page"] for r in got} == {1, 2, 3, 4}
    assert not any("Annual survey" in r["text"] or "Contents" in r["text"] for r in got) and all(80 <= len(r["text"]) <= 221 for r in got)  # a full piece may follow what is carried over
    assert [r["section"] for r in got if r["page"] == 2] == ["Chapter 0 of sands"] * sum(r["page"] == 2 for r in got) and all(len(r["boxes"]) >= 1 for r in got)
    assert got[0]["text"].startswith("Chapter 0 of sands sediment") and [r for r in got if r["page"] == 1][-1]["text"].startswith("page note")
    with pytest.raises(ValueError):
        chunk.passages(blocks, most=10, overlap=10)
    stats = {r["doc_id"]: r["passages"] for r in chunk.corpus_stats(chunk.passages(blocks), spark.createDataFrame([("d",), ("e",)], "doc_id string")).collect()}
    assert stats["d"] > 0 and stats["e"] == 0
    page = '<html lang="en-GB"><nav>Menu</nav><h1>Title &amp; more</h1><p>Some <b>words</b>\nhere</p><p><b>Bold line</b></p><li>12 %</li></html>'
    found = html.blocks(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).collect()
    assert [(r["text"], r["size"], r["bold"], r["numeric"]) for r in found] == [("Menu", 8.0, False, False), ("Title & more", 20.0, True, False), ("Some words here", 10.0, False, False), ("Bold line", 10.0, True, False), ("12 %", 10.0, False, True)]
