"""Language of texts and documents, in column expressions.

A naive Bayes model over function words and letters of six languages: each is a small list, so a text's score for a
language is its number of words from that list, and letters that only some languages have count as words do. The share
of the best language among all (a soft maximum) is the confidence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = {
    "en": "the of and to in is that for it with as was on are be this have from or an by not which but",
    "fr": "le la les des et en du que une dans est pour qui sur au avec par ne pas sont aux ce cette plus",
    "de": "der die das und ist nicht mit von ein den auf eine im dem des zu als auch sich wird bei nach aus wie",
    "es": "el los las que por con una del se para es lo como más su al pero sus este entre cuando muy sin sobre",
    "it": "il di che e la per un una sono con non della del si da nel come più anche gli le ha alla dei",
    "pt": "o os as que do da em um uma para com não se por mais dos das como na no ao ele foi são",
}
LETTERS = {"en": "", "fr": "èêçœëï", "de": "äßü", "es": "ñ¿¡", "it": "ìò", "pt": "ãõ"}
SUPPORTED = tuple(sorted(WORDS))
#: Natural logarithm of how much likelier a listed word is in its language than elsewhere.
LOG_RATIO = 1.0
LEAST_LETTERS, OVERRIDE, METADATA_ONLY = 20, 0.95, 0.9
SAMPLE_PAGES, SAMPLE_CHARS = 3, 5000


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once per row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hits(text: Column) -> Column:
    """Words and letters of each language in a text, as a struct with a field per language."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def counts(x: Column) -> Column:
        words = lambda c: F.size(F.filter(x["words"], lambda w: w.isin(*WORDS[c].split())))
        letters = lambda c: F.regexp_count(x["low"], F.lit(f"[{LETTERS[c]}]")) if LETTERS[c] else F.lit(0)
        return F.struct(*((words(c) + letters(c)).alias(c) for c in SUPPORTED))

    return once(F.struct(low.alias("low"), F.regexp_extract_all(low, F.lit(r"\p{L}+"), F.lit(0)).alias("words")), counts)


def classify(text: Column) -> Column:
    """struct(language, confidence); null and 0 for a text of too few letters. Ties go by the language's code."""
    enough = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]", "")) >= LEAST_LETTERS

    def read(x: Column) -> Column:
        found = {c: x["hits"][c] for c in SUPPORTED}
        best = F.greatest(*found.values())
        language = F.coalesce(*(F.when(found[c] == best, c) for c in SUPPORTED))
        share = 1 / sum((F.exp(LOG_RATIO * (found[c] - best)) for c in SUPPORTED), F.lit(0.0))
        return F.struct(F.when(x["enough"], language).alias("language"), F.when(x["enough"], F.round(share, 3)).otherwise(0.0).alias("confidence"))

    return once(F.struct(hits(text).alias("hits"), enough.alias("enough")), read)


def french_or_english(text: Column, default: str) -> Column:
    """The likelier of the two, however short the text; the default where they tie."""
    return once(hits(text), lambda h: F.when(h["fr"] > h["en"], "fr").when(h["en"] > h["fr"], "en").otherwise(default))


def request_language(text: Column) -> Column:
    return french_or_english(text, "fr")


def question_language(text: Column) -> Column:
    return french_or_english(text, "en")


def query_language(text: Column) -> Column:
    return F.when(classify(text)["language"] == "fr", "fr").otherwise("en")


def other_language(language: Column) -> Column:
    return F.when(language == "fr", "en").otherwise("fr")


def metadata_language(value: Column) -> Column:
    """A stated language as its code ("en-GB" is en); null if it is not supported."""
    code = F.split_part(F.replace(F.lower(F.trim(value)), F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1))
    return F.when(code.isin(*SUPPORTED), code)


def detect(stated: Column, sample: Column, read: Column | None = None) -> Column:
    """struct(language, confidence, method, metadata) from what a document states and a sample of its text.

    The statement holds unless the text is sure of another language: 1 where both agree, less where the text says
    nothing or leans elsewhere. read: a struct(language, confidence) of the sample, by the word lists if not given.
    """

    def decide(x: Column) -> Column:
        meta, text, sure = x["meta"], x["read"]["language"], x["read"]["confidence"]
        trust = meta.isNotNull() & (text.isNull() | (text == meta) | (sure < OVERRIDE))
        score = F.when(text == meta, 1.0).when(text.isNull(), METADATA_ONLY).otherwise(F.round(1 - sure, 3))
        return F.struct(
            F.when(trust, meta).otherwise(text).alias("language"), F.when(trust, score).otherwise(F.coalesce(sure, F.lit(0.0))).alias("confidence"),
            F.when(trust, "metadata").when(text.isNotNull(), "text").otherwise("none").alias("method"), x["stated"].alias("metadata"),
        )

    return once(F.struct(metadata_language(stated).alias("meta"), (classify(sample) if read is None else read).alias("read"), stated.alias("stated")), decide)


def text_sample(pages: DataFrame) -> DataFrame:
    """(doc_id, sample): the first pages' text in single spaces, up to a number of pages and of characters.

    pages: (doc_id, page, text). A page is read if those before it are not long enough.
    """
    plain = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    rows = pages.withColumn("plain", plain).withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")))
    ahead = F.coalesce(F.sum(F.length("plain")).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    read = rows.withColumn("ahead", ahead).where((F.col("i") <= SAMPLE_PAGES) & (F.col("ahead") < SAMPLE_CHARS))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "plain"))), lambda p: p["plain"]), " ")
    return read.groupBy("doc_id").agg(F.substring(joined, 1, SAMPLE_CHARS).alias("sample"))


def document_languages(pages: DataFrame, stated: DataFrame, classifier: Callable[[Column], Column] = classify) -> DataFrame:
    """(doc_id, language, confidence, method, metadata) of documents: pages (doc_id, page, text), stated (doc_id, stated).

    classifier: how a sample is read, by the word lists or by a trained model (operators.langid).
    """
    rows = stated.join(text_sample(pages), "doc_id", "left").withColumn("read", classifier(F.col("sample")))
    return rows.select("doc_id", detect(F.col("stated"), F.col("sample"), F.col("read")).alias("d")).select("doc_id", "d.*")
