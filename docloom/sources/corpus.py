"""Catalogue, passages, questions, glossaries and uploads: what a corpus is made of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import replies as R
from .snapshots import Snapshots, versioned

#: First bytes of a PDF, and those that mark its encryption dictionary.
PDF_MAGIC, PDF_ENCRYPT = b"%PDF", "/Encrypt"


def _checked(rows: DataFrame, good: Column, what: str) -> DataFrame:
    """The same rows; reading one that is not good raises."""
    return rows.where(F.when(good, True).otherwise(F.raise_error(F.lit(what))))


def load_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of documents; an entry without id, file, title or org, or with half a page range, raises."""
    rows = spark.read.schema(schemas.CATALOGUE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    named = F.concat("id", "file", "title", "org").isNotNull()
    return _checked(rows, named & (F.col("summary_pages").isNull() | (F.size("summary_pages") == 2)), f"{path}: an entry of the catalogue is not complete")


def load_passages(spark: SparkSession, path: str) -> DataFrame:
    """Passages from lines of JSON; blank lines are skipped. Of a folder that save_passages wrote, those of the last version."""
    if versioned(spark, path):
        return Snapshots(spark, path).read("passages")
    return spark.read.schema(schemas.PASSAGE).option("mode", "FAILFAST").json(path)


def save_passages(passages: DataFrame, path: str, form: str = "json") -> int:
    """Replaces the passages of a versioned folder. Until all is written readers see the old ones, and keep them if
    anything fails; those that read the version before go on. Returns the new version."""
    saved = Snapshots(passages.sparkSession, path)
    with saved.change() as change:
        change.replace("passages", passages, form)
    saved.vacuum()
    return change.result


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    return _checked(spark.read.schema(schemas.QUESTION).option("mode", "FAILFAST").json(path), F.concat("id", "question").isNotNull(), f"{path}: a question has no id or text")


def load_glossary(spark: SparkSession, path: str) -> DataFrame:
    """(source, target) of a JSON object of strings; anything else raises."""
    value = R.parsed(F.col("value"))
    entries = F.from_json("value", "map<string,variant>")
    rows = spark.read.option("wholetext", True).text(path).select(value.alias("v"), entries.alias("e"))
    whole = _checked(rows, F.coalesce(R.is_object(F.col("v")) & F.forall(F.map_values("e"), lambda x: R.kind(x) == "STRING"), F.lit(False)), f"{path}: a glossary is a JSON object of strings")
    return whole.select(F.explode("e").alias("source", "v")).select("source", R.string(F.col("v")).alias("target"))


def glossary_for(glossaries: DataFrame, explicit: DataFrame | None, source: str, target: str, default: DataFrame | None = None) -> DataFrame:
    """The glossary of a translation: an explicit one, else the configured one, else that of the language pair.

    glossaries: (source_lang, target_lang, source, target).
    """
    pair = glossaries.where((F.col("source_lang") == source) & (F.col("target_lang") == target)).select("source", "target")
    return explicit if explicit is not None else default if default is not None else pair


def files_of(spark: SparkSession, catalogue: DataFrame, folder: str, pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """(id, file, content, ...) of the catalogue's documents, and the documents whose file is missing, to be reported."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    named = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content", "length")
    return catalogue.join(named, "file"), catalogue.join(named.select("file"), "file", "left_anti")


def build_passages(catalogue: DataFrame, files: DataFrame, parse: Callable[[DataFrame], DataFrame], chunk: Callable[[DataFrame], DataFrame], on_doc: Callable[[str, int], None] | None = None) -> DataFrame:
    """Passages of all documents with their title and language. parse makes blocks of files, chunk passages of blocks.

    on_doc is told how many passages each document has, once they are counted.
    """
    found = chunk(parse(files)).join(catalogue.select(F.col("id").alias("doc_id"), "title", "lang"), "doc_id", "left")
    if on_doc:
        for row in found.groupBy("doc_id").count().toLocalIterator():
            on_doc(row["doc_id"], row["count"])
    return found


def check_uploads(files: DataFrame, most_bytes: int = 20 << 20, most_pages: int = 30, confirm_pages: int = 10) -> DataFrame:
    """files (file, content, length, pages or null) with `refused`, null for those that can be used, and needs_confirmation.

    pages comes from a parser; null says that it could not open the file.
    """
    text = F.decode("content", "ISO-8859-1")
    refused = (
        F.when(~F.lower("file").endswith(".pdf"), "only PDF files are accepted").when(F.col("length") > most_bytes, "the file is too large").when(F.substring("content", 1, 4) != F.lit(PDF_MAGIC), "the file is not a PDF")
        .when(F.contains(text, F.lit(PDF_ENCRYPT)), "password-protected PDFs are not supported").when(F.col("pages").isNull(), "the PDF could not be opened").when(F.col("pages") == 0, "the PDF has no pages")
        .when(F.col("pages") > most_pages, F.format_string("the PDF has more than %d pages", F.lit(most_pages)))
    )
    return files.withColumn("refused", refused).withColumn("needs_confirmation", F.col("refused").isNull() & (F.col("pages") > confirm_pages))


def keep_pages(blocks: DataFrame, pages: int) -> DataFrame:
    """Blocks of the first pages only."""
    return blocks.where(F.col("page") < pages)


def block_kind(blocks: DataFrame) -> DataFrame:
    """Blocks with `kind`: rotated, numeric, translatable or other, as drawings of a page colour them."""
    from ..functions.blocks import translatable

    return blocks.withColumn("kind", F.when(~F.col("horizontal"), "rotated").when(F.col("numeric"), "numeric").when(translatable(), "translatable").otherwise("other"))


def extraction_summary(blocks: DataFrame) -> DataFrame:
    """(doc_id, blocks, translatable, numeric, rotated, characters to translate) per document."""
    kinds = block_kind(blocks)
    is_ = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return kinds.groupBy("doc_id").agg(F.count("*").alias("blocks"), is_("translatable"), is_("numeric"), is_("rotated"), F.sum(F.when(F.col("kind") == "translatable", F.length("text")).otherwise(0)).alias("characters"))


def page_summary(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, blocks, lines, sizes, fonts) per page: what a dump of a page begins with."""
    return blocks.groupBy("doc_id", "page").agg(F.count("*").alias("blocks"), F.sum(F.size("lines")).alias("lines"), F.array_sort(F.collect_set(F.round("size", 1))).alias("sizes"), F.array_sort(F.collect_set("font")).alias("fonts"))
