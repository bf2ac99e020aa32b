from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions.kernels import Passage, alike, batch_ranges, loose_figures, pack_ranges, plain_numbers, quote_holds, quote_in_passage, split_long, unsupported_numbers
from docloom.functions.markup import markup_html
from docloom.operators.evaluate import binomial_p
from docloom.operators.search import bm25

PASSAGE = "Global emissions reached 59 GtCO2 in 2019, about 12% higher than in 2010 and 54% higher than in 1990."


def test_quotes():
    assert quote_holds("emissions reached 59 GtCO2 in 2019", PASSAGE)
    assert quote_holds("Global emissions reached ... higher than in 1990 emissions", PASSAGE) is False
    assert quote_holds("emisions reached 59 GtCO2 in 2019, about higher", PASSAGE)
    assert not quote_holds("emissions reached 95 GtCO2 in 2019", PASSAGE)
    assert not quote_holds("59", PASSAGE)
    assert not quote_holds(None, PASSAGE)


def test_figures():
    assert loose_figures("It was 12% [1] and 13,5 in 2020", PASSAGE) == ["13.5", "2020"]
    assert plain_numbers("1 234 567,5") == plain_numbers("1\u00a0234\u202f567,5") == "1234567.5"
    assert loose_figures("2\u00a0390", "2390") == loose_figures("2390", "about 2\u202f390 tonnes") == []
    assert loose_figures("1.2 and 3", "1.20 and 3.") == ["1.2"]
    assert loose_figures("20", "2018") == ["20"]


def slow_in_order(quote, words, most):
    """The least number of words left out, by looking at every pair of places."""
    best = {k: 0 for k, w in enumerate(words) if alike(quote[0], w)}
    for word in quote[1:]:
        best = {k: c for k, w in enumerate(words) if alike(word, w) and (c := min((b + k - at - 1 for at, b in best.items() if at < k), default=99)) < 99}
    return bool(best) and min(best.values()) <= most


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=7), max_size=25), st.lists(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=6), st.integers(0, 6))
def test_in_order(words, quote, most):
    passage = Passage("")
    passage.bits = {}
    for k, w in enumerate(words):
        passage.bits[w] = passage.bits.get(w, 0) | 1 << k
    passage.sorted = sorted(passage.bits)
    for q in quote:
        assert passage.places(q) == sum(1 << k for k, w in enumerate(words) if alike(q, w))
    assert passage.in_order(quote, most) == slow_in_order(quote, words, most)


def test_quotes_of_a_batch(spark):
    """Rows in any order, nulls on both sides, the same passage in many rows."""
    rows = [(k, q, p) for k, (q, p) in enumerate([("emissions reached 59 GtCO2 in 2019", PASSAGE), (None, PASSAGE), ("emissions reached", None), ("other words here then", "Other words stand here then."), ("higher than in 1990", PASSAGE), ("Global emissions reached 58", PASSAGE)] * 7)]
    df = spark.createDataFrame(rows, "k int, q string, p string").repartition(3)
    got = {r["k"]: (r["h"], r["n"]) for r in df.select("k", quote_in_passage(F.col("q"), F.col("p")).alias("h"), unsupported_numbers(F.col("q"), F.col("p")).alias("n")).collect()}
    assert got == {k: (quote_holds(q, p), loose_figures(q, p)) for k, q, p in rows} and sum(h for h, _ in got.values()) == 14


def test_markup():
    style = {"s1": {"color": 255, "bold": True, "italic": False, "position": None, "font": "F"}}
    assert markup_html("a<s1>b & c</s1></s2>d<br/><sup>e", style) == 'a<span style="color: #0000ff; font-weight: bold; font-style: normal">b &amp; c</span>d <span style="vertical-align: super; font-size: 70%">e</span>'


def test_packing_units():
    units = [("Head", True, False), ("x" * 60, False, False), ("y" * 60, False, False), ("Next", True, False), ("z", False, False), ("note", False, True)]
    assert pack_ranges(units, 100, 30) == [(0, 2, "Head"), (2, 3, "Head"), (3, 5, "Next"), (5, 6, "Next")]
    assert pack_ranges([("a" * 50, False, False), ("b" * 20, False, False), ("c" * 60, False, False)], 100, 30) == [(0, 2, None), (1, 3, None)]
    assert pack_ranges([], 10, 1) == [] and batch_ranges([4, 4, 9, 1, 1, 1], 8, 2) == [(0, 2), (2, 3), (3, 5), (5, 6)] and batch_ranges([], 1, 1) == []


@settings(max_examples=50, deadline=None)
@given(st.text("ab. ", max_size=200), st.integers(5, 40))
def test_split_long_keeps_words(text, most):
    pieces = split_long(text, most)
    assert "".join("".join(pieces).split()) == "".join(text.split())


def test_text_functions(spark):
    row = spark.createDataFrame([("Les émissions ssp1-2.6 du CO2, 1,5", ["para-", "sols", "1850-", "1900", "Nord-", "Sud"])], "t string, l array<string>")
    got = row.select(X.tokens(F.col("t")).alias("a"), X.join_lines(F.col("l")).alias("b"), X.numbers(F.lit("CO2 12 emissions23 4,5")).alias("c"), X.pseudo_translate(F.lit("Les ponts du nord")).alias("d")).first()
    assert got["a"] == ["emission", "ssp1-2.6", "co2", "1,5"]
    assert got["b"] == "parasols 1850-1900 Nord-Sud"
    assert got["c"] == ["12", "4,5"]
    assert got["d"] == "LES PONTS DU NORD les"


def test_sign_test(spark):
    rows = spark.createDataFrame([(8, 1), (0, 0), (60, 40)], "w int, l int")
    got = [r[0] for r in rows.select(F.round(binomial_p(F.col("w"), F.col("l")), 7)).collect()]
    assert got[:2] == [round(20 / 512, 7), 1.0] and abs(got[2] - 0.0568879) < 1e-6


def test_idf_counts_every_document(spark):
    docs = spark.createDataFrame([(0, "aa bb"), (1, "aa cc"), (2, "dd"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "aa")], "item_id long, text string")
    got = bm25(docs, asked).collect()
    assert [r["id"] for r in got] == [0, 1] and got[0]["score"] == got[1]["score"]
    kept = bm25(docs, asked, among=docs.where("doc_id = 1").select(F.col("doc_id").alias("id"))).collect()
    assert [(r["id"], r["rank"], r["score"]) for r in kept] == [(1, 1, got[1]["score"])]
