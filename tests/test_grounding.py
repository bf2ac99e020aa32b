"""Checks of replies on small tables of excerpts."""

import pytest
from pyspark.sql import functions as F

from docloom.functions.kernels import quote_holds
from docloom.operators import grounding as G
from docloom.operators import replies as R

POINTS = "request_id long, point_no int, text string, evidence array<struct<n:int,quote:string>>, request string"
EXCERPTS = "request_id long, n int, passage_id string, doc_id string, title string, page int, section string, text string"


@pytest.fixture(scope="module")
def excerpts(spark):
    rows = [
        (1, 1, "a:p1:0", "a", "Water report", 1, None, "River levels fell by 12,5 % between 1999 and 2004 in the northern basin."),
        (1, 2, "a:p2:1", "a", "Water report", 2, "Dams", "Eleven dams were closed for repairs, at a cost of 2 390 thousand crowns."),
        (1, 3, "b:p7:0", "b", "Forest report", 7, None, "Planted forests now cover 41 percent of the southern hills."),
    ]
    return spark.createDataFrame(rows, EXCERPTS)


def test_points(spark, excerpts):
    rows = [
        (1, 0, "Levels fell by 12.5 % [1] **there** [3] .", [(1, "River levels fell by 12.5 % between 1999 and 2004")], "levels"),
        (1, 1, "It cost 2390 thousand.", [(2, "at a cost of 2390 thousand crowns"), (9, "x")], ""),
        (1, 2, "Hills: 41.", [(1, "planted forests now cover hills")], ""),
        (1, 3, "Levels fell in 2004, hills 41 and 7.", [(1, "levels fell between 1999 and 2004")], "the 7 hills"),
        (1, 4, "Nothing cited.", [], ""),
    ]
    got = {r["point_no"]: r for r in G.check_points(spark.createDataFrame(rows, POINTS), excerpts).collect()}
    assert [got[k]["kept"] for k in range(5)] == [True, True, False, False, False]
    assert got[0]["text"] == "Levels fell by 12.5 % [1] there." and [s["n"] for s in got[0]["sources"]] == [1]
    assert got[1]["bad_quotes"] == ["[9] x"] and got[1]["sources"][0]["quotes"] == ["at a cost of 2390 thousand crowns"]
    assert got[2]["reason"] == G.NO_QUOTE and got[2]["quotes"] == ["[1] planted forests now cover hills"]
    assert got[3]["reason"] == "figures not in the cited excerpts: 41" and got[3]["found_elsewhere"] == {"41": [3]}
    assert got[4]["reason"] == G.NO_QUOTE and got[4]["quotes"] == []


def test_answers(spark, excerpts):
    rows = [
        (1, "q", '{"answerable": true, "answer": "It fell [1].", "evidence": [{"n": 1, "quote": "River levels fell between 1999 and 2004"}]}'),
        (2, "q", '{"answerable": true, "answer": "Yes", "evidence": []}'),
    ]
    read = spark.createDataFrame(rows, "request_id long, question string, reply string").select("request_id", "question", R.answer(F.col("reply")).alias("r")).select("request_id", "question", "r.*")
    got = {r["request_id"]: r for r in G.answers(read, excerpts).collect()}
    assert got[1]["answerable"] and got[1]["answer"] == "It fell [1]." and got[1]["retrieved"] == ["a:p1:0", "a:p2:1", "b:p7:0"] and got[1]["refusal"] is None
    assert not got[2]["answerable"] and got[2]["answer"] is None and got[2]["refusal"] == "no passage found"
    why = spark.createDataFrame(
        [(False, ["p"], False, [], []), (False, ["p"], True, ["[1] " + "y" * 90], ["3", "4"]), (False, ["p"], True, ["[1] " + "y" * 90], []), (False, ["p"], True, [], [])],
        "answerable boolean, retrieved array<string>, model_answerable boolean, rejected_quotes array<string>, unsupported_numbers array<string>",
    )
    assert [r[0] for r in why.select(G.refusal_reason()).collect()] == ["the model said the passages do not answer", "figures not in the quotes: 3, 4", "quotes not found in their passage: [1] " + "y" * 76, "no verified quote"]


def test_comparison(spark, excerpts):
    reports = spark.createDataFrame([(1, "A", "a", "Water report", 1, 2), (1, "B", "b", "Forest report", 3, 3)], "request_id long, label string, doc_id string, title string, first int, last int")
    a, b = ("a ", "River levels fell [1].", [(1, "River levels fell between 1999 and 2004")]), ("B", "Forests cover 41 percent.", [(3, "Planted forests now cover 41 percent")])
    sides = [
        ("difference", [a, b]), ("only_in", [b]), ("agreement", [a]), ("only_in", [a, b]), ("agreement", [a, ("A", "x", [])]), ("agreement", [a, ("C", "x", [])]),
        ("agreement", [a, ("B", "It does not mention rivers.", [])]), ("agreement", [("A", "Levels.", [(3, "Planted forests now cover")]), b]), ("agreement", [a, ("B", "Cover is 55 percent.", [(3, "Planted forests now cover 41 percent")])]),
    ]
    rows = [(1, k, kind, " Land ", s, "land", "en") for k, (kind, s) in enumerate(sides)]
    points = spark.createDataFrame(rows, f"request_id long, point_no int, kind string, aspect string, sides {R.SIDES}, request string, lang string")
    got = {r["point_no"]: r for r in G.check_comparison(points, reports, excerpts).collect()}
    assert [got[k]["kept"] for k in range(9)] == [True, True] + [False] * 7
    assert [s["title"] for s in got[0]["sides"]] == ["Water report", "Forest report"] and got[0]["aspect"] == "Land" and got[0]["note"] is None
    assert got[1]["note"] == "Nothing on this in the 2 passages of Water report that were read."
    assert [got[k]["reason"] for k in range(2, 9)] == [
        "agreement: needs one side per report (has 1)", "only_in: one side only (several reports: agreement or difference?)", "two sides for the same report", "unknown report label in ['A', 'C']",
        'side B: absence claim ("does not mention")', "side A (Water report) quotes excerpts [3] of another report: wrong attribution", "figures not in the cited excerpts: 55",
    ]
    assert got[8]["rejected_text"].endswith("(side B)") and got[2]["rejected_text"] == "[agreement]  Land  — a : River levels fell [1]."


def test_absence(spark):
    texts = {
        "The study doesn't really discuss costs": "doesn't really discuss", "Le texte ne donne aucune date": "ne donne aucune", "Il n’est pas précisé": "n’est pas précisé", "costs were not quantified": "were not quantified",
        "without giving a date": "without giving", "no explicit figures": "no explicit figures", "Le plan reste muet": "reste muet", "sans les chiffrer": "sans les chiffrer", "The ban is not compatible with growth": None, "Rien ne change": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["c"] for r in df.select("t", G.absence_claim(F.col("t")).alias("c")).collect()} == texts


def test_judge(spark):
    items = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "request_id long, n int")
    verdicts = spark.createDataFrame([(1, 1, True, "", 0), (1, 1, False, "wrong year", 1), (1, 7, False, "p", 2), (2, 1, False, "p", 0)], "request_id long, n int, faithful boolean, problem string, pos int")
    judged = spark.createDataFrame([(1, True), (2, False)], "request_id long, judged boolean")
    got = {(r["request_id"], r["n"]): (r["judged"], r["faithful"], r["problem"]) for r in G.judge_join(items, verdicts, judged).collect()}
    assert got == {(1, 1): (True, False, "wrong year"), (1, 2): (True, True, None), (2, 1): (False, True, None)}


def test_parsers(spark):
    replies = {
        "points": '[{"text": "p", "evidence": [{"n": "1", "quote": "q"}]}, {"text": " "}, {"text": "k", "evidence": null}, {"text": "m"}]',
        "comparison": '{"points": [{"kind": "agreement", "sides": [{"report": "A", "says": "s"}]}, {"kind": "other", "sides": [{"report": "A", "says": "s"}]}, {"kind": "only_in", "sides": [{"report": "A"}]}]}',
        "steps": '{"route": "compare", "doc_ids": "d1", "topic": null}', "verdicts": '{"items": [{"n": 1, "faithful": false, "problem": "p"}, {"n": "2", "faithful": "yes"}, {"n": null}, 4]}',
        "answer": '{"answerable": true, "answer": null, "evidence": [{"n": 1, "quote": "a b"}, {"n": "2", "quote": "x"}, {"n": 3, "quote": " "}, 5]}',
    }
    df = spark.createDataFrame([(1,)], "x int")
    got = df.select(*(getattr(R, k)(F.lit(v)).alias(k) for k, v in replies.items()), R.error_reason(F.lit('[{"error": {"message": " full "}}]')).alias("e"), R.answer(F.lit("{x")).alias("bad"), R.translations(F.lit('{"translations": [{"id": 5, "text": "a"}]}'), F.lit(2)).alias("t"), R.translated_query(F.lit('{"translation": " "}')).alias("q")).first().asDict(True)
    assert got["points"] == {"valid": True, "points": [{"text": "p", "evidence": [{"n": 1, "quote": "q"}]}, {"text": "m", "evidence": []}]}
    assert [p["kind"] for p in got["comparison"]["points"]] == ["agreement"] and got["steps"]["steps"][0]["doc_ids"] == ["d1"] and got["steps"]["steps"][0]["topic"] == ""
    assert got["verdicts"]["verdicts"] == [{"n": 1, "faithful": False, "problem": "p"}, {"n": 2, "faithful": True, "problem": ""}]
    assert got["answer"] == {"valid": True, "answerable": True, "answer": "", "evidence": [{"n": 1, "quote": "a b"}]}
    assert got["e"] == "full" and not got["bad"]["valid"] and not got["t"]["valid"] and got["q"] is None


def test_quotes_with_skips():
    passage = "One two three words stand here while seven other words part them from the closing remark."
    assert quote_holds("three words stand here ... closing remark them other", passage) is False
    assert quote_holds("words stand here seven other words", passage)
    assert not quote_holds("three closing remark stand", passage)
    assert not quote_holds("word " * 61, "word " * 80)
