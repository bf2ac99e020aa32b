"""The automaton of many patterns and the language model, against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.operators import langid, patterns
from docloom.operators.translate import relevant_terms
from docloom.sources.snapshots import Snapshots

SF = "/root/testdata/sf0.01"


def brute(texts, wanted, whole_words):
    out = {}
    for t, text in texts:
        for n, p, exact in wanted:
            if not p or not text:
                continue
            body = re.escape(p)
            at = [m.start() for m in re.finditer(f"(?={body})", text, 0 if exact else re.I)]
            if whole_words:
                at = [k for k in at if not (k and re.match(r"\w", text[k - 1])) and not (k + len(p) < len(text) and re.match(r"\w", text[k + len(p)]))]
            if at:
                out[t, n] = at
    return out


@pytest.mark.parametrize("native", [True, False])
def test_found_in(spark, native, monkeypatch):
    if not native:
        monkeypatch.setattr(patterns, "ahocorasick", None)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abAB1 _-é") for _ in range(rng.randrange(1, 4)))
    wanted = [(k, word(), rng.random() < 0.3) for k in range(60)] + [(60, "ab", False), (61, "AB", False), (62, "AB", True), (63, "", False), (64, None, False), (65, "a b a", None), (66, "12,5 %", True)]
    texts = [(k, "".join(rng.choice("abAB1 _-é,.") for _ in range(rng.randrange(80)))) for k in range(60)] + [(60, None), (61, ""), (62, "a b a b a"), (63, "about 12,5 % of 112,5 %"), (64, "x" * 50_000 + " ab ")]
    a = spark.createDataFrame(texts, "text_id long, text string")
    b = spark.createDataFrame(wanted, "pattern_id long, pattern string, exact boolean")
    for whole_words, shard in ((True, 100), (False, 7)):
        got = {(r["text_id"], r["pattern_id"]): r["places"] for r in patterns.found_in(a, b, whole_words, shard).collect()}
        assert got == brute(texts, wanted, whole_words)
    assert patterns.found_in(a, b.limit(0)).collect() == [] and patterns.found_in(a.limit(0), b).collect() == []


def test_terms_of_several_words(spark):
    texts = spark.createDataFrame([(1, "The water table sank; NATO said so."), (2, "a watertable and nato, very likely"), (3, "Likely.")], "id long, text string")
    glossary = spark.createDataFrame([("water table", "nappe"), ("likely", "probable"), ("very likely", "très probable"), ("NATO", "OTAN")], "source string, target string")
    got = sorted((r["id"], r["source"]) for r in relevant_terms(texts, glossary).collect())
    assert got == [(1, "NATO"), (1, "water table"), (2, "likely"), (2, "very likely"), (3, "likely")]


def test_language_model(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").where("lang is not null")
    model = langid.LanguageModel.fit(docs.where("doc_id % 5 <> 0"))
    read = docs.where("doc_id % 5 = 0").withColumn("read", model.classify(F.col("text"))).collect()
    right = sum(r["read"]["language"] == r["lang"] for r in read) / len(read)
    print("held-out accuracy", right)
    assert right >= 0.95 and all(0 <= r["read"]["confidence"] <= 1 for r in read)
    store = Snapshots(spark, str(tmp_path / "m"))
    model.save(store)
    again = langid.LanguageModel.load(store)
    text = read[0]["text"]
    assert again.languages == model.languages and again.scores(langid.words(text)) == pytest.approx(model.scores(langid.words(text)))
    plain = langid.LanguageModel(again.languages, again.known, again.weights)
    monkeypatch.setattr(langid, "ahocorasick", None)
    assert plain.scores(langid.words(text)) == pytest.approx(model.scores(langid.words(text)))
    short = spark.createDataFrame([(None,), ("",), ("12 34 !",), ("too short",)], "t string").select(model.classify(F.col("t")).alias("r")).collect()
    assert all(tuple(r["r"]) == (None, 0.0) for r in short)
    empty = langid.LanguageModel.fit(docs.limit(0))
    assert empty.languages == [] and docs.limit(2).select(empty.classify(F.col("text"))["language"].alias("l")).collect()[0]["l"] is None
