"""Command line: python -m docloom.cli COMMAND. Tables are Parquet, an index is a folder."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .engine import Engine
from .operators import chunk
from .session import prepare
from .sources import corpus, html


def _show(rows: DataFrame, form: str) -> None:
    for line in (rows.select(F.to_json(F.struct(*rows.columns)).alias("j")) if form == "json" else rows.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in rows.columns)).alias("j"))).toLocalIterator():
        print(line["j"])


def _asked(spark: SparkSession, texts: list[str], name: str, key: str) -> DataFrame:
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], f"{key} long, {name} string")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="docloom", description=__doc__)
    top.add_argument("--index", default="index", help="folder of the index")
    top.add_argument("--form", choices=("json", "tab"), default="json")
    sub = top.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build", help="index documents (doc_id, text) or web pages (page_id, url, html)")
    build.add_argument("table")
    build.add_argument("--catalogue", help="JSON array of documents with id and title")
    find = sub.add_parser("search", help="passages for texts")
    find.add_argument("texts", nargs="+")
    find.add_argument("--mode", choices=("hybrid", "dense", "bm25"), default="hybrid")
    find.add_argument("--top", type=int)
    find.add_argument("--doc", action="append", help="only from this document; may be given again")
    ask = sub.add_parser("ask", help="answers whose quotes and figures are checked")
    ask.add_argument("texts", nargs="+")
    run = sub.add_parser("run", help="plan and run requests")
    run.add_argument("texts", nargs="+")
    dump = sub.add_parser("extract", help="counts of the blocks of web pages")
    dump.add_argument("table")
    dump.add_argument("--pages", type=int, help="only so many pages of each document")
    copy = sub.add_parser("copy", help="add an index's vectors to another root")
    copy.add_argument("target")
    score = sub.add_parser("evaluate", help="hit rates of a question set in JSON lines")
    score.add_argument("questions")
    return top


def main(arguments: list[str] | None = None, engine: Engine | None = None) -> int:
    given = parser().parse_args(arguments)
    spark = engine.spark if engine else prepare(SparkSession.builder.getOrCreate())
    engine = engine or Engine(spark, given.index, Settings.from_env())
    if given.command == "build":
        rows = spark.read.parquet(given.table)
        if "html" in rows.columns:
            engine.build_pages(rows)
        else:
            if given.catalogue:
                listed = corpus.load_catalogue(spark, given.catalogue).withColumnRenamed("id", "doc_id")
            else:
                listed = rows.select("doc_id", F.col("doc_id").cast("string").alias("title")).distinct()
            engine.build(chunk.lines(rows), listed)
        _show(chunk.corpus_stats(engine.passages, engine.catalogue).agg(F.count("*").alias("documents"), F.sum("passages").alias("passages")), given.form)
    elif given.command == "search":
        asked = _asked(spark, given.texts, "text", "query_id")
        kind = engine.passages.schema["doc_id"].dataType
        if given.doc:
            asked = asked.withColumn("doc_ids", F.array(*(F.lit(d).cast(kind) for d in given.doc)))
        _show(engine.search(asked, given.top, given.mode).orderBy("query_id", "rank").select("query_id", "rank", "score", "passage_id", "title", "page", "text"), given.form)
    elif given.command == "ask":
        _show(engine.ask(_asked(spark, given.texts, "question", "request_id")).orderBy("request_id").select("request_id", "answerable", "answer", "refusal"), given.form)
    elif given.command == "run":
        _show(engine.run(_asked(spark, given.texts, "request", "request_id")).orderBy("request_id"), given.form)
    elif given.command == "copy":
        print(engine.vectors.copy_to(given.target).count())
    elif given.command == "extract":
        found = html.blocks(spark.read.parquet(given.table)).withColumn("font", F.lit(""))
        found = corpus.keep_pages(found, given.pages) if given.pages is not None else found
        _show(corpus.extraction_summary(found).orderBy("doc_id"), given.form)
    else:
        questions = corpus.load_questions(spark, given.questions).select(F.col("id").alias("query_id"), F.col("question").alias("text"), "type", "expected")
        for rows in engine.evaluate(questions):
            _show(rows, given.form)
    return 0


if __name__ == "__main__":
    sys.exit(main())
