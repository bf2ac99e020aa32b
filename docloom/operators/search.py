"""Search over passages in three modes, hits joined to their passages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import shared_path
from . import dense
from .lexical import Index
from .retrieval import fuse, rank

MODES = ("hybrid", "dense", "bm25")


def bm25(passages: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "doc_id", text_column: str = "text", query_column: str = "item_id", query_text: str = "text", among: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank) over passages without an index of their own: one is written for this call."""
    index = Index.build(passages, shared_path(passages.sparkSession, "index"), id_column, F.col(text_column))
    return index.lexical(queries.select(F.col(query_column).alias("query_id"), F.col(query_text).alias("text")), k, among)


def search(
    passages: DataFrame, queries: DataFrame, index: Index | None = None, vectors: DataFrame | None = None, embed: Callable[[DataFrame], DataFrame] | None = None,
    mode: str = "hybrid", top_k: int = 5, candidates: int = 20, cells: dense.Cells | None = None,
) -> DataFrame:
    """Hits of all queries: query_id, rank, score, dense_rank, bm25_rank and the passage's columns.

    queries: (query_id, text) and, if wanted, doc_ids: a list of documents that a query is limited to. vectors:
    (passage_id, doc_id, v); embed gives queries their `v`. Vectors of passages that are no more are dropped after the
    cut to the candidates; passages are joined to the hits that are left. cells: the inverted file of the vectors, of
    which a query reads its nearest cells instead of all vectors.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if mode != "bm25" and (vectors is None or embed is None):
        raise ValueError("dense search needs vectors and an embedder")
    if mode != "dense" and index is None:
        raise ValueError("lexical search needs an index")
    filtered = "doc_ids" in queries.columns
    asked = queries.select("query_id", "text", *(["doc_ids"] if filtered else []))
    den = lex = None
    if mode != "bm25":
        # a query that is asked more than once is embedded once
        own = embed(asked.select("text").distinct())
        points, probed = vectors.select(F.col("passage_id").alias("id"), "doc_id", "v"), asked.join(own, "text").drop("text")
        den = dense.dense_topk(points, probed, candidates, same_ids=False) if cells is None else cells.topk(probed, candidates, same_ids=False)
        den = den.join(passages.select(F.col("passage_id").alias("id")), "id", "left_semi")
        den = rank(den.drop("rank"))
    if mode != "dense":
        doc_of = passages.select(F.col("passage_id").alias("id"), "doc_id") if filtered else None
        lex = index.lexical(asked, candidates, doc_of=doc_of)
    if mode == "hybrid":
        hits = fuse([den, lex], top_k).withColumnsRenamed({"rank_0": "dense_rank", "rank_1": "bm25_rank"})
    else:
        one = den if mode == "dense" else lex
        hits = one.where(F.col("rank") <= top_k).withColumn("dense_rank", F.col("rank") if mode == "dense" else F.lit(None).cast("int")).withColumn("bm25_rank", F.col("rank") if mode == "bm25" else F.lit(None).cast("int"))
    found = passages.withColumnRenamed("passage_id", "id")
    return hits.withColumn("score", F.round("score", 5)).join(found, "id").withColumnRenamed("id", "passage_id")


def known_documents(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, unknown): the documents of doc_ids that no passage has, in order; empty where all are known."""
    asked = queries.select("query_id", F.posexplode_outer("doc_ids").alias("pos", "doc_id"))
    known = passages.select("doc_id", F.lit(True).alias("known")).distinct()
    rows = asked.join(known, "doc_id", "left").withColumn("bad", F.when(F.col("doc_id").isNotNull() & F.col("known").isNull(), F.struct("pos", "doc_id")))
    return rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list("bad")), lambda b: b["doc_id"]).alias("unknown"))


def excerpts(hits: DataFrame) -> DataFrame:
    """Hits as the numbered excerpts that replies cite (operators.grounding)."""
    return hits.select(F.col("query_id").alias("request_id"), F.col("rank").cast("int").alias("n"), "passage_id", "doc_id", "title", "page", "section", "text")


def report_ranges(hits: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits of searches limited to one document each -> (excerpts, reports) of comparisons.

    hits: request_id, doc_id, rank and passage columns; documents: (request_id, place, doc_id), in the order asked for.
    Excerpts are numbered document after document, reports are labelled A, B, C.
    """
    from pyspark.sql import Window

    rows = hits.join(documents, ["request_id", "doc_id"])
    n = F.row_number().over(Window.partitionBy("request_id").orderBy("place", "rank"))
    numbered = rows.withColumn("n", n)
    reports = numbered.groupBy("request_id", "place", "doc_id").agg(F.min_by("title", "rank").alias("title"), F.min("n").alias("first"), F.max("n").alias("last"))
    label = F.chr(F.lit(ord("A")) + F.row_number().over(Window.partitionBy("request_id").orderBy("place")) - 1)
    return numbered.select("request_id", "n", "passage_id", "doc_id", "title", "page", "section", "text"), reports.withColumn("label", label).select("request_id", "label", "doc_id", "title", "first", "last")


def spread(passages: DataFrame, by: str, order: list[str], most_chars: int) -> DataFrame:
    """Passages of each group spaced evenly over it, within about most_chars; all of them where they fit.

    keep = max(1, chars * n / total) passages stay, those at the places int(i * n / keep).
    """
    from pyspark.sql import Window

    whole = Window.partitionBy(by)
    rows = passages.withColumn("__i", F.row_number().over(whole.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(whole)).withColumn("__total", F.sum(F.length("text")).over(whole))
    keep = F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(float(most_chars)) / F.col("__total")))
    # place i is taken if some j has int(j * n / keep) = i: the least j with j * n / keep >= i tells
    step = F.col("__n") / keep
    j = F.ceil(F.col("__i") / step - 1e-9)
    taken = (F.floor(j * step + 1e-9) == F.col("__i")) & (j < keep)
    return rows.where((F.col("__total") <= most_chars) | taken).drop("__i", "__n", "__total")


def summary_passages(passages: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Passages on the pages of their report's own summary. catalogue: (doc_id, summary_pages)."""
    ranges = catalogue.where("summary_pages is not null").select("doc_id", F.get("summary_pages", F.lit(0)).alias("first"), F.get("summary_pages", F.lit(1)).alias("last"))
    return passages.join(ranges, "doc_id").where(F.col("page").between(F.col("first"), F.col("last"))).drop("first", "last")


def fused_pages(rankings: list[DataFrame], passages: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, page): any number of rankings fused, mapped to pages, the first k."""
    hits = fuse(rankings, k).select("query_id", "id", "rank")
    return hits.join(passages.select(F.col("passage_id").alias("id"), "doc_id", "page"), "id").select("query_id", "rank", "doc_id", "page")
