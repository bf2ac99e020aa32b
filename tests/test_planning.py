"""Plans, scores and runs on small tables."""

import datetime as dt

from docloom.operators import planning as P
from docloom.operators import replies as R
from pyspark.sql import functions as F


def test_plans(spark):
    catalogue = spark.createDataFrame([("w", "Water", "w.pdf"), ("f", "Forest", None)], "doc_id string, title string, file string")
    replies = [
        (1, "[]"), (2, '{"steps": [{"route": "summarize", "doc_ids": [" w ", "w"]}, {"route": "compare", "doc_ids": ["w", "x", "f"]}, {"route": "compare", "doc_ids": ["w"]}, {"route": "dance"}, {"route": "translate", "doc_ids": "w", "target_lang": "en"}, {"route": "question"}]}'),
        (3, '{"route": "translate", "doc_ids": ["f"]}'), (4, '{"route": "translate", "path": "\\"a/b.pdf\\"", "target_lang": "xx"}'), (5, '{"route": "question", "question": " why? "}'), (6, '{"route": "summarize", "reply": "Which?"}'),
    ]
    df = spark.createDataFrame(replies, "request_id long, reply string").select("request_id", F.lit("asked").alias("request"), F.lit("en").alias("lang"), R.steps(F.col("reply"))["steps"].alias("steps"))
    plans = P.check_plans(P.step_cap(df), catalogue).cache()
    got = {(r["request_id"], r["step_no"]): r for r in plans.collect()}
    assert sorted(k for k in got if k[0] == 2) == [(2, k) for k in range(5)] and got[2, 0]["dropped"] == 1
    assert [got[2, k]["route"] for k in range(5)] == ["summarize", "clarify", "clarify", "clarify", "translate"]
    assert got[2, 0]["doc_ids"] == ["w"] and got[2, 1]["reply"] == "No such report: x." and got[2, 4]["path"] == "w.pdf" and got[2, 4]["target_lang"] == "en"
    assert got[1, 0]["route"] == "clarify" and got[3, 0]["reply"] == "No such report: f." and got[4, 0]["path"] == "a/b.pdf" and got[4, 0]["target_lang"] == "fr"
    assert got[5, 0]["question"] == "why?" and got[6, 0]["reply"] == "Which?"
    signed = {r["request_id"]: r["signature"] for r in P.signatures(plans).collect()}
    assert signed[2] == "summarize(w) > clarify() > clarify() > clarify() > translate(w)" and signed[4] == "translate(b.pdf)"
    accepted = spark.createDataFrame(
        [(4, 0, 0, ["translate"], None, None, "B.PDF", None), (5, 0, 0, ["clarify"], None, None, None, None), (5, 1, 0, ["question", "clarify"], [], None, None, "fr"), (2, 0, 0, ["summarize"], [["w", "z"]], None, None, None)],
        "request_id long, option int, step_no int, routes array<string>, reports array<array<string>>, topic_any array<string>, path_contains string, target_lang string",
    )
    ok = {r["request_id"]: r["ok"] for r in P.plan_matches(plans, accepted).collect()}
    assert ok[4] and ok[5] and not ok[2] and not ok[1]


def test_scores(spark):
    rows = [("a", "x", 1, True, "s", False), ("a", "x", 2, True, "t", True), ("b", "y", 1, False, "s", None), ("b", "y", 2, True, "s", None)]
    got = P.routing_summary(spark.createDataFrame(rows, "id string, category string, run int, ok boolean, signature string, fixed_by_code boolean")).first()
    assert (got["right"], got["total"], got["stable"], got["cases"], got["unstable"], got["wrong"], got["fixed_by_code"]) == (3, 4, 1, 2, ["a"], ["b"], ["a"])
    assert {k: tuple(v) for k, v in got["by_category"].items()} == {"x": (2, 2), "y": (1, 2)}
    rows = [("i", "trap", True, True), ("i", "trap", True, False), ("j", "true", True, False), ("k", "trap", False, False)]
    got = P.judge_summary(spark.createDataFrame(rows, "item string, kind string, judged boolean, removed boolean")).first()
    assert (tuple(got["traps_caught"]), tuple(got["true_removed"]), got["constant"], got["items"], got["changing"], got["not_judged"]) == ((1, 2), (0, 1), 1, 2, ["i"], 1)


def test_judge_items(spark):
    passages = spark.createDataFrame([("w:p2:10", "w", "Water", 2, "Late text about dams. Rain fell.3 Dams held 1.5 m more. End"), ("w:p2:9", "w", "Water", 2, "Dams only.")], "passage_id string, doc_id string, title string, page int, text string")
    cases = spark.createDataFrame(
        [("c1", "w", 2, [["Dams", "1.5"], ["Rain"]], "ok", "bad", None), ("c2", "w", None, [["Rain", "Dams"]], "ok", None, None), ("c3", "w", 3, [["Rain"]], "ok", None, None)],
        "id string, doc_id string, page int, quotes array<array<string>>, true string, trap string, borderline string",
    )
    got = {(r["id"], r["kind"]): r for r in P.judge_items(cases, passages).collect()}
    assert got["c1", "true"]["quotes"] == ["Water, p. 2: Dams held 1.5 m more.", "Water, p. 2: Rain fell."] and got["c1", "trap"]["statement"] == "bad"
    assert got["c2", None]["error"].startswith("no sentence") and got["c3", None]["error"].startswith("no passage") and len(got) == 4


def test_runs(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    updates = spark.createDataFrame([("a", 0, 0, t(2), "plan"), ("a", 0, 1, t(5), P.PAUSE), ("a", 1, 2, t(101), "judge")], "thread string, run_no int, seq int, ts timestamp, node string")
    starts = spark.createDataFrame([("a", 0, t(0)), ("a", 1, t(100))], "thread string, run_no int, ts timestamp")
    got = P.node_durations(updates, starts)
    assert {r["node"]: r["seconds"] for r in got.collect()} == {"plan": 2.0, "judge": 1.0}
    records = got.withColumn("kept", F.lit(3)).withColumn("removed", F.lit(1))
    calls = spark.createDataFrame([("a", 1000, 10), ("a", 500, 5)], "thread string, tokens_in long, tokens_out long")
    total = P.run_totals(records, calls, 2.0, 10.0).first()
    assert (total["duration_s"], total["calls"], total["kept_ratio"], total["cost_usd"]) == (3.0, 2, 0.75, 0.00315)
    assert P.run_totals(records, calls, 2.0).first()["cost_usd"] is None
    plans = spark.createDataFrame([(r, k, "question") for r in (1, 2, 3) for k in range(3)], "request_id int, step_no int, route string")
    results = spark.createDataFrame([(1, 1, True, 1), (2, 0, False, 4)], "request_id int, step_no int, failed boolean, calls int")
    done = {(r["request_id"], r["step_no"]): r["why"] for r in P.chain(plans, results, limit=4).collect()}
    assert [done[1, k] for k in range(3)] == [None, None, "a step failed"] and [done[2, k] for k in range(3)] == [None, "budget", "budget"] and not any(done[3, k] for k in range(3))
    words = spark.createDataFrame([(" Oui ",), ("no",), (None,), ("1",)], "w string")
    assert [r[0] for r in words.select(P.is_yes(F.col("w"))).collect()] == [True, False, False, True]
