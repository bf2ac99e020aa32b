"""Language identification by a trained model of byte n-grams.

The model is learnt from a table of texts with their language: the counts of byte n-grams (1 to 4 bytes of the letters, in
lower case, words parted by single spaces) are summed by Spark, the commonest of each language are kept, and each has the
logarithm of its probability in every language. A text is scanned once by an automaton of all n-grams.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.language import LEAST_LETTERS
from ..sources.snapshots import Snapshots

try:
    import ahocorasick
except ImportError:  # texts are then cut into all their n-grams
    ahocorasick = None

LONGEST = 4
#: Texts of each language that a model is fitted on, and n-grams kept of each language.
PER_LANGUAGE, GRAMS = 500, 2500
#: A language's share that every n-gram has, seen or not.
SMOOTHING = 0.5
_OTHER = re.compile(r"[\W\d_]+")


def words(text: str) -> str:
    return _OTHER.sub(" ", text).strip().lower()


def scanned(plain: str) -> str:
    """Words between single spaces, their bytes as the characters 0 to 255."""
    return f" {plain} ".encode().decode("latin-1")


def grams(text: str) -> Iterator[str]:
    for n in range(1, LONGEST + 1):
        yield from (text[k : k + n] for k in range(len(text) - n + 1))


class LanguageModel:
    """Languages, n-grams, and a row of log probabilities for each n-gram."""

    def __init__(self, languages: list[str], known: list[str], weights: np.ndarray):
        self.languages, self.known, self.weights = languages, known, weights

    @classmethod
    def fit(cls, rows: DataFrame, per_language: int = PER_LANGUAGE, most_grams: int = GRAMS) -> LanguageModel:
        """rows (text, lang). Of each language so many texts count, by hash order: a bounded sample."""
        own = rows.where("text is not null and lang is not null").select("lang", F.xxhash64("text").alias("h"), "text")
        turn = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
        # hashes are ranked without texts; of equal texts one comes
        first = own.select("lang", "h").distinct().withColumn("turn", turn).where(F.col("turn") <= per_language)
        some = own.join(F.broadcast(first), ["lang", "h"]).groupBy("lang", "h", "turn").agg(F.min("text").alias("text"))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, Counter] = {}
            for batch in batches:
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    held.setdefault(lang, Counter()).update(grams(scanned(words(text))))
            for lang, counts in held.items():
                yield pa.record_batch({"lang": pa.array([lang] * len(counts)), "gram": pa.array(list(counts)), "n": pa.array(list(counts.values()), pa.int64())})

        counts = some.select("lang", "text").repartition("turn").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
        best = counts.withColumn("place", place).where(F.col("place") <= most_grams).select("gram").distinct()
        kept = counts.join(best, "gram").collect()  # most_grams for each language at most
        languages, known = sorted({r["lang"] for r in kept}), sorted({r["gram"] for r in kept})
        at, of = {g: k for k, g in enumerate(known)}, {lang: k for k, lang in enumerate(languages)}
        table = np.full((len(known), len(languages)), SMOOTHING)
        for r in kept:
            table[at[r["gram"]], of[r["lang"]]] += r["n"]
        return cls(languages, known, np.log(table / table.sum(axis=0)) if known else table)

    def save(self, snapshots: Snapshots) -> None:
        rows = [(g, [float(w) for w in ws]) for g, ws in zip(self.known, self.weights, strict=True)]
        with snapshots.change() as change:
            change.replace("grams", snapshots.spark.createDataFrame(rows, "gram string, weights array<double>"))
            change.facts["languages"] = self.languages

    @classmethod
    def load(cls, snapshots: Snapshots, version: int | None = None) -> LanguageModel:
        rows = sorted(tuple(r) for r in snapshots.read("grams", version).collect())  # of the size that fit keeps
        return cls(snapshots.describe(version)["facts"]["languages"], [g for g, _ in rows], np.array([w for _, w in rows]))

    def scores(self, plain: str) -> np.ndarray:
        """A log probability of words for each language."""
        found = _scan(self, scanned(plain))
        return self.weights[found].sum(axis=0) if len(found) else np.zeros(len(self.languages))

    def classify(self, text: Column) -> Column:
        """struct(language, confidence), as functions.language.classify: null and 0 for texts of too few letters."""
        model = json.dumps([self.languages, self.known, self.weights.round(5).tolist()])

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            own = _opened(model)
            for texts in batches:
                out = []
                for text in texts:
                    plain = words(text or "")
                    if len(plain.replace(" ", "")) < LEAST_LETTERS or not own.known:
                        out.append((None, 0.0))
                        continue
                    s = own.scores(plain)
                    out.append((own.languages[int(s.argmax())], round(float(1 / np.exp(s - s.max()).sum()), 3)))
                yield pd.DataFrame(out, columns=["language", "confidence"])

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
        return F.pandas_udf(run, "language string, confidence double")(text)


@lru_cache(maxsize=2)
def _opened(model: str) -> LanguageModel:
    languages, known, weights = json.loads(model)
    return LanguageModel(languages, known, np.array(weights).reshape(len(known), len(languages)))


def _scan(model: LanguageModel, text: str) -> np.ndarray:
    """Numbers of all n-grams of the text that the model knows, repeats included."""
    if not hasattr(model, "index"):
        model.index = {g: k for k, g in enumerate(model.known)}
        model.automaton = None
        if ahocorasick is not None and model.known:
            model.automaton = ahocorasick.Automaton()
            for g, k in model.index.items():
                model.automaton.add_word(g, k)
            model.automaton.make_automaton()
    if model.automaton is not None:
        return np.fromiter((k for _, k in model.automaton.iter(text)), np.int64)
    return np.fromiter((model.index[g] for g in grams(text) if g in model.index), np.int64)
