"""Translation of blocks as table work: glossary terms, what needs no model, batches, missing answers, broken tags."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import markup as M
from ..functions import text as X
from ..storage import written
from . import messages as Msg
from . import patterns
from . import replies as R

MISSING_ROUNDS = 3
#: Kept with cached translations: another prompt makes others.
PROMPT_VERSION = "t1"


def relevant_terms(texts: DataFrame, glossary: DataFrame) -> DataFrame:
    """(id, source, target): the terms that occur as whole words in a text; capitals only terms mind their case.

    texts: (id, text). All terms are looked for in one pass over each text (operators.patterns), however many words they
    have. Terms that differ from another only in what they render are found each for itself.
    """
    terms = glossary.select(F.struct("source", "target").alias("pattern_id"), F.col("source").alias("pattern"), (F.col("source") == F.upper("source")).alias("exact")).distinct()
    met = patterns.found_in(texts.select(F.col("id").alias("text_id"), "text"), terms)
    return met.select(F.col("text_id").alias("id"), "pattern_id.source", "pattern_id.target").distinct()


def kept_locally(blocks: DataFrame, glossary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(done, todo) of blocks (id, text, ...): codes and exact glossary entries have their `translation` at once."""
    entries = glossary.select(F.col("source").alias("__text"), F.col("target").alias("__target"))
    rows = blocks.withColumn("__text", F.trim("text")).join(entries, "__text", "left")
    own = F.coalesce("__target", F.when(X.is_code(F.col("__text")), F.col("__text")))
    rows = rows.withColumn("translation", own).drop("__text", "__target")
    return rows.where("translation is not null"), rows.where("translation is null").drop("translation")


def batches(blocks: DataFrame, by: str, order: str, most_chars: int = 6000, most_items: int = 40) -> DataFrame:
    """blocks (by, order, text, ...) with `batch`: consecutive blocks of a group in batches of so many items and characters.

    A block that is larger alone is a batch of its own. Rows keep all their columns; blocks of a null group are one group.
    """
    kind = StructType([*blocks.schema.fields, StructField("batch", IntegerType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, number, items, chars = None, 0, 0, 0
        fresh = True
        for part in parts:
            numbers = []
            for name, size in zip(part.column(by).to_pylist(), pc.utf8_length(part.column("text")).to_pylist(), strict=True):
                size = size or 0
                if fresh or name != group:
                    group, number, items, chars, fresh = name, 0, 0, 0, False
                elif items >= most_items or chars + size > most_chars:
                    number, items, chars = number + 1, 0, 0
                items, chars = items + 1, chars + size
                numbers.append(number)
            yield pa.record_batch([*part.columns, pa.array(numbers, pa.int32())], names=[*part.schema.names, "batch"])

    return blocks.repartition(by).sortWithinPartitions(by, order).mapInArrow(run, kind)


def missing_items(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks (batch_id, pos, ...) of which no answer (batch_id, pos) came."""
    return asked.join(answers.select("batch_id", "pos"), ["batch_id", "pos"], "left_anti")


def translate_all(blocks: DataFrame, ask: Callable[[DataFrame], DataFrame], terms: DataFrame, source: str, target: str, rounds: int = MISSING_ROUNDS) -> DataFrame:
    """(batch_id, pos, text, translation) of every block. ask: (batch_id, messages) -> (batch_id, reply).

    Blocks that a reply skips are asked for again, in a few rounds; what is still missing then raises. terms: (batch_id,
    source, target), those relevant for each batch.
    """
    known = terms.groupBy("batch_id").agg(F.map_from_entries(F.collect_set(F.struct("source", "target"))).alias("terms"))
    todo, done = written(blocks.select("batch_id", "pos", "text"), "asked"), None
    for _ in range(rounds):
        listed = todo.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("items"))
        prompts = listed.join(known, "batch_id", "left").withColumn("texts", F.transform("items", lambda i: i["text"])).withColumn("terms", F.coalesce("terms", F.create_map().cast("map<string,string>")))
        replied = ask(Msg.translation_messages(prompts, F.lit(source), F.lit(target)))
        read = listed.join(replied, "batch_id").select("batch_id", "items", R.translations(F.col("reply"), F.size("items")).alias("r"))
        got = read.select("batch_id", "items", F.explode("r.items").alias("t")).select("batch_id", F.get("items", F.col("t.id"))["pos"].alias("pos"), F.col("t.text").alias("translation"))
        got = written(got.dropDuplicates(["batch_id", "pos"]).join(todo, ["batch_id", "pos"]), "translated")
        done = got if done is None else done.unionByName(got)
        todo = written(missing_items(todo, got), "asked")
        if todo.isEmpty():
            return done.select("batch_id", "pos", "text", "translation")
    raise RuntimeError(f"blocks are still untranslated after {rounds} requests: {[tuple(r) for r in todo.select('batch_id', 'pos').limit(5).collect()]}")


def repair(translated: DataFrame, terms: DataFrame, again: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Translations (id, text, translation) with whole style tags, and `repair`: none, restored, asked or dropped.

    Broken tags are first mended from the text; what cannot be is asked for once more (again: (id, text) -> (id, retry));
    what is still broken loses its tags, for the text matters more. terms: (id, source, target).
    """
    known = terms.groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("source", "target"))).alias("terms"))
    rows = translated.join(known, "id", "left").withColumn("terms", F.coalesce("terms", F.create_map().cast("map<string,string>")))
    same = M.tag_multiset(F.col("text")) == M.tag_multiset(F.col("translation"))
    rows = rows.withColumn("whole", same).withColumn("mended", F.when(same, F.col("translation")).otherwise(M.repair_tags(F.col("text"), F.col("translation"), F.col("terms"))))
    if again is not None:
        rows = written(rows, "mended")
        rows = rows.join(again(rows.where("mended is null").select("id", "text")), "id", "left")
    else:
        rows = rows.withColumn("retry", F.lit(None).cast("string"))
    rows = rows.withColumn("retried", F.when(F.col("mended").isNull() & F.col("retry").isNotNull(), M.repair_tags(F.col("text"), F.col("retry"), F.col("terms"))))
    how = F.when(F.col("whole"), "none").when(F.col("mended").isNotNull(), "restored").when(F.col("retried").isNotNull(), "asked").otherwise("dropped")
    return rows.select("id", "text", F.coalesce("mended", "retried", F.regexp_replace("translation", X.TAG, "")).alias("translation"), how.alias("repair"), F.when(how == "dropped", F.col("retry")).alias("failed_retry"))


def usage(repaired: DataFrame, local: DataFrame) -> DataFrame:
    """One row: blocks kept locally, tags restored, asked for again, and dropped."""
    of = lambda how: F.count_if(F.col("repair") == how)
    counts = repaired.agg(of("restored").alias("tags_restored"), of("asked").alias("tag_repairs"), of("dropped").alias("tag_fallbacks"))
    return counts.crossJoin(local.agg(F.count("*").alias("kept_locally")))  # one row each


def translate_blocks(blocks: DataFrame, glossary: DataFrame, ask: Callable[[DataFrame], DataFrame], source: str, target: str, by: str = "page", order: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(translations, usage) of blocks (by, order, text): what needs no model at once, the rest in batches of a group,
    skipped blocks asked for again, broken style tags mended."""
    key = F.struct(by, order)
    done, todo = kept_locally(blocks.select(by, order, "text"), glossary)
    cut = written(batches(todo, by, order).withColumn("batch_id", F.concat_ws("/", F.col(by).cast("string"), "batch")).withColumnRenamed(order, "pos"), "batches")
    terms = written(relevant_terms(cut.select(F.struct("batch_id", "pos").alias("id"), "text"), glossary).select("id.batch_id", "id.pos", "source", "target"), "terms")
    got = written(translate_all(cut, ask, terms.select("batch_id", "source", "target").distinct(), source, target), "translations")

    def again(broken: DataFrame) -> DataFrame:
        rows = broken.select(F.col("id.batch_id").alias("batch_id"), "id.pos", "text").groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("items"))
        prompts = rows.withColumn("texts", F.transform("items", lambda i: i["text"])).withColumn("terms", F.create_map().cast("map<string,string>"))
        said = Msg.translation_messages(prompts, F.lit(source), F.lit(target)).join(prompts.select("batch_id", "texts"), "batch_id")
        last = F.element_at("messages", -1)
        noted = F.concat(F.slice("messages", 1, F.size("messages") - 1), F.array(F.struct(last["role"].alias("role"), F.concat(last["content"], Msg.repair_note(F.col("texts"))).alias("content"))))
        read = rows.join(ask(said.select("batch_id", noted.alias("messages"))), "batch_id").select("batch_id", "items", F.explode(R.translations(F.col("reply"), F.size("items"))["items"]).alias("t"))
        return read.select(F.struct("batch_id", F.get("items", F.col("t.id"))["pos"].alias("pos")).alias("id"), F.col("t.text").alias("retry")).dropDuplicates(["id"])

    fixed = written(repair(got.select(F.struct("batch_id", "pos").alias("id"), "text", "translation"), terms.select(F.struct("batch_id", "pos").alias("id"), "source", "target"), again), "repaired")
    back = cut.select(F.struct("batch_id", "pos").alias("id"), by, F.col("pos").alias(order)).join(fixed, "id")
    columns = [by, order, "text", "translation"]
    return done.select(columns).unionByName(back.select(columns)), usage(fixed, done.withColumn("key", key))
