"""Blocks of pages as citable passages.

Blocks (doc_id, page, pos, text, size, bold, horizontal, numeric, and any further columns such as box): what a parser
found on a page, in reading order. `lines` makes blocks of plain texts, `sources.html` of web pages.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.kernels import pack_ranges, split_long
from ..functions.text import dot_leader, has_words, is_numeric, normalise

PAGE_LINES = 40


def lines(docs: DataFrame) -> DataFrame:
    """Blocks of plain texts: a page is PAGE_LINES lines; short capitalised lines are set larger."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    short = F.length("text") < 40
    size = F.when(short, 12.0).when(F.length("text") % 7 == 0, 7.0).otherwise(10.0)
    rows = rows.select("doc_id", F.floor(F.col("pos") / PAGE_LINES).cast("int").alias("page"), "pos", "text", size.alias("size"), (short & (F.col("pos") % 5 == 0)).alias("bold"))
    return rows.withColumn("horizontal", F.lit(True)).withColumn("numeric", is_numeric(F.col("text")))


def body_size(rows: DataFrame) -> DataFrame:
    """(doc_id, body): median size weighted by characters, 10 without any."""
    return rows.groupBy("doc_id").agg(F.coalesce(F.expr("percentile(size, 0.5, length(text))"), F.lit(10.0)).alias("body"))


def heading(body: Column) -> Column:
    text = F.trim("text")
    return F.length(text).between(3, 120) & ~text.rlike("[.,;:]$") & (F.col("bold") | (F.col("size") >= 1.15 * body))


def boilerplate(rows: DataFrame, share: float = 0.2) -> DataFrame:
    """(doc_id, line): short texts on at least max(3, share of the pages) pages of a document."""
    pages = rows.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    seen = rows.where(F.length("text") < 80).groupBy("doc_id", F.lower(normalise(F.col("text"))).alias("line")).agg(F.countDistinct("page").alias("on"))
    return seen.join(pages, "doc_id").where(F.col("on") >= F.greatest(F.lit(3), share * F.col("pages"))).select("doc_id", "line")


def units(rows: DataFrame) -> DataFrame:
    """Blocks that can be cited, with heading and note marks: upright, with words, no running header or table of contents."""
    sized = rows.join(body_size(rows), "doc_id").withColumn("clean", normalise(F.col("text")))
    kept = sized.where(F.col("horizontal") & ~F.col("numeric") & has_words(F.col("clean")) & ~dot_leader(F.col("clean")))
    skip = boilerplate(rows).withColumnRenamed("line", "key")
    kept = kept.withColumn("key", F.lower("clean")).join(skip, ["doc_id", "key"], "left_anti")
    note = F.col("size") < 0.85 * F.col("body")
    box = [F.col("box")] if "box" in rows.columns else []
    return kept.select("doc_id", "page", "pos", F.col("clean").alias("text"), (heading(F.col("body")) & ~note).alias("heading"), note.alias("note"), *box)


def _fold(most: int, overlap: int, least: int, names: list[str], schema: pa.Schema):
    """Units in order of document, page, notes last -> passages. A page is held at a time."""

    def page_passages(page: list[dict]) -> Iterator[tuple[str, str | None, list]]:
        pieces = [(piece, u["heading"] and len(u["text"]) <= most, u["note"], u.get("box")) for u in page for piece in split_long(u["text"], most)]
        for first, end, title in pack_ranges([p[:3] for p in pieces], most, overlap):
            yield " ".join(p[0] for p in pieces[first:end]), title, [p[3] for p in pieces[first:end]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (dict(zip(names, r, strict=True)) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = ["passage_id", "doc_id", "page", "section", "text", *(["boxes"] if "box" in names else [])]
            return pa.RecordBatch.from_pylist([dict(zip(columns, h, strict=False)) for h in held], schema=schema)

        for doc, of_doc in groupby(rows, key=lambda r: r["doc_id"]):
            section, number = None, 0
            for page, of_page in groupby(of_doc, key=lambda r: r["page"]):
                for text, title, boxes in page_passages([*of_page]):
                    section = title or section
                    if len(text) < least:
                        continue
                    held.append((f"{doc}:p{page + 1}:{number}", doc, page + 1, section, text, boxes))
                    number += 1
            if len(held) >= 2000:
                yield out()
                held.clear()
        if held:
            yield out()

    return run


def passages(blocks: DataFrame, most: int = 1000, overlap: int = 150, least: int = 80) -> DataFrame:
    """(passage_id, doc_id, page, section, text, and boxes if blocks have a box).

    Blocks are packed page by page, in one pass over each document's units: sections carry over pages, numbers count
    the passages kept. Pages count from 0 in blocks and from 1 in passages.
    """
    if overlap >= most:
        raise ValueError("overlap must be smaller than most")
    rows = units(blocks)
    names = ["doc_id", "page", "heading", "note", "text", *(["box"] if "box" in rows.columns else [])]
    fields = [StructField("passage_id", StringType()), rows.schema["doc_id"], StructField("page", IntegerType()), StructField("section", StringType()), StructField("text", StringType())]
    if "box" in names:
        fields.append(StructField("boxes", ArrayType(rows.schema["box"].dataType)))
    ordered = rows.repartition("doc_id").sortWithinPartitions("doc_id", "page", "note", "pos")
    return ordered.select(*names).mapInArrow(_fold(most, overlap, least, names, to_arrow_schema(StructType(fields))), StructType(fields))


def embed_text(title: Column, section: Column, text: Column) -> Column:
    """What is indexed of a passage: its title, a dash and its section if it has one, a new line, its text."""
    part = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(" — "), section)).otherwise("")
    return F.concat(F.coalesce(title, F.lit("")), part, F.lit("\n"), text)


def corpus_stats(found: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(doc_id, passages, pages): every document of the catalogue, also one without passages."""
    counts = found.groupBy("doc_id").agg(F.count("*").alias("passages"), F.countDistinct("page").alias("pages"))
    return catalogue.select("doc_id").join(counts, "doc_id", "left").fillna(0, ["passages", "pages"])
