"""The engine end to end on four small pages, with scripted models."""

import json

import pytest
from pyspark.sql import functions as F

from docloom import cli
from docloom.engine import Engine

PAGES = [
    ("w", "Water report", "River levels in the northern basin fell by 12 percent between 1999 and 2004. The cause was a long drought in the hills. Eleven dams were closed for repairs in that time, at a cost of 2390 thousand crowns."),
    ("f", "Forest report", "Planted forests now cover 41 percent of the southern hills. Fires burnt 300 hectares of old forest in the last year. Seedlings from the nursery replaced most of the burnt trees within two years."),
]


def scripted(spark, answers):
    """A model that answers by what a prompt holds."""

    def model(prompts):
        rows = [(r["request_id"], next((a for key, a in answers if key in r["messages"][0]["content"] + r["messages"][1]["content"]), "nonsense")) for r in prompts.collect()]
        kind = prompts.schema["request_id"].dataType.simpleString()
        return spark.createDataFrame(rows, f"request_id {kind}, reply string")

    return model


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    levels = {"n": 1, "quote": "River levels in the northern basin fell by 12 percent between 1999 and 2004"}
    compare = {"points": [{"kind": "difference", "aspect": "Change", "sides": [{"report": "A", "says": "Levels fell by 12 percent.", "evidence": [levels]}, {"report": "B", "says": "Forests cover 41 percent.", "evidence": [{"n": 2, "quote": "Planted forests now cover 41 percent of the southern hills"}]}]}, {"kind": "agreement", "aspect": "", "sides": []}]}
    model = scripted(spark, [
        ("Request: sum", json.dumps({"steps": [{"route": "summarize", "doc_ids": ["w"]}, {"route": "question", "question": "river levels"}]})), ("Request: compare", json.dumps({"route": "compare", "doc_ids": ["w", "f"], "topic": "hills"})), ("Request: hello", '{"route": "out_of_scope"}'),
        ("Report: Water report", json.dumps({"points": [{"text": "Levels fell by 12 percent [1].", "evidence": [levels]}, {"text": "Levels fell by 99 percent.", "evidence": [levels]}]})),
        ("Topic: hills", json.dumps(compare)), ("Question: river levels", json.dumps({"answerable": True, "answer": "They fell by 12 percent [1].", "evidence": [levels]})), ("Question: ", '{"answerable": false}'), ("Query: ", '{"translation": " niveau des rivières "}'),
    ])
    judge = scripted(spark, [("Change", '{"items": [{"n": 1, "faithful": false, "problem": "mixed up"}]}'), ("Statement", '{"items": []}')])
    made = Engine(spark, str(tmp_path_factory.mktemp("engine")), model=model, judge=judge)
    blocks = spark.createDataFrame([(d, 0, 0, text, 10.0, False, True, False) for d, _, text in PAGES], "doc_id string, page int, pos int, text string, size double, bold boolean, horizontal boolean, numeric boolean")
    made.build(blocks, spark.createDataFrame([(d, t, "O", 2020, "en", None, None) for d, t, _ in PAGES], "doc_id string, title string, org string, year int, lang string, file string, summary_pages array<int>"))
    return made


def test_answers(spark, engine):
    asked = spark.createDataFrame([(1, "river levels"), (2, "moon")], "request_id long, question string")
    got = {r["request_id"]: r for r in engine.ask(asked).collect()}
    assert got[1]["answer"] == "They fell by 12 percent [1]." and got[1]["sources"][0]["title"] == "Water report" and got[2]["refusal"] == "the model said the passages do not answer"
    translated = engine.translate_queries(spark.createDataFrame([(1, "what is the level of the rivers in the north")], "query_id long, text string")).first()
    assert (translated["source_lang"], translated["target_lang"], translated["translation"]) == ("en", "fr", "niveau des rivières")


def test_requests(spark, engine):
    asked = spark.createDataFrame([(1, "sum up the water report"), (2, "compare the hills in the reports"), (3, "hello")], "request_id long, request string")
    got = {r["request_id"]: r["message"] for r in engine.run(asked).collect()}
    first, second = got[1].split("\n\n", 1)
    assert first.startswith("Step 1 of 2 - summary\nSummary of Water report (from ") and first.endswith("- Levels fell by 12 percent. (Water report, p. 1)")
    assert second.startswith("Step 2 of 2 - question\nThey fell by 12 percent [1].") and "Sources" in second
    assert got[2] == "Nothing passed the review.\nRemoved by the review (1): mixed up" and "- f: Forest report (O, 2020, en)" in got[3]
    accepted = spark.createDataFrame([(2, 0, 0, ["compare"], [["w"], ["f"]], ["HILLS"], None, None)], "request_id long, option int, step_no int, routes array<string>, reports array<array<string>>, topic_any array<string>, path_contains string, target_lang string")
    cases = asked.where("request_id > 1").withColumn("category", F.lit("c"))
    summary = engine.evaluate_plans(cases, accepted).first()
    assert (summary["right"], summary["total"], summary["stable"], summary["wrong"]) == (2, 4, 2, [3])
    traps = spark.createDataFrame([("t", "w", 1, [["Eleven", "crowns"]], "Eleven dams were closed.", "Twelve dams were closed.", None)], "id string, doc_id string, page int, quotes array<array<string>>, true string, trap string, borderline string")
    assert tuple(engine.evaluate_judge(traps).first()["traps_caught"]) == (0, 2)


def test_budget_and_records(spark, engine, tmp_path):
    """Two model calls a step and one for the plan: the second step cannot be paid, and the message says so."""
    from dataclasses import replace

    from docloom.sources import logs

    asked = spark.createDataFrame([(1, "sum up the water report"), (2, "compare the hills in the reports")], "request_id long, request string")
    short = Engine(spark, engine.root, replace(engine.settings, max_calls=3, trajectories=str(tmp_path / "t"), trace_path=str(tmp_path / "trace")), engine.model, engine.judge_model)
    got = {r["request_id"]: r["message"] for r in short.run(asked).collect()}
    assert got[1].startswith("Step 1 of 2 - summary") and "They fell" not in got[1]
    assert got[1].endswith("Not done: step 2 (question).\n\nThe limit of 3 model calls is reached.") and "limit" not in got[2]
    records = {(r["thread"], r["seq"]): r for r in logs.load_trajectories(spark, str(tmp_path / "t")).collect()}
    assert sorted(records) == [("1", 0), ("2", 0)] and records["1", 0]["kept"] == 1 and records["2", 0]["removed"] == 1 and all(r["ok"] and r["items"] == 2 for r in records.values())
    traced = {r["thread"]: r for r in logs.Trace(spark, str(tmp_path / "trace")).rows().collect()}
    assert traced["1"]["score"] == 1.0 and traced["2"]["score"] == 0.0 and traced["1"]["output"].startswith("Summary of Water report")


def test_translation_steps(spark, engine, tmp_path):
    """A plan that translates, then asks: refusals and open questions stop it; cached texts are not asked for again."""
    from dataclasses import replace

    asked_texts = []
    steps = lambda path: json.dumps({"steps": [{"route": "translate", "path": path, "target_lang": "fr"}, {"route": "question", "question": "river levels"}]})

    def model(prompts):
        rows = []
        for r in prompts.collect():
            said = r["messages"][-1]["content"]
            if "Request: " in said:
                rows.append((str(r["request_id"]), steps(f"{said.split('tr ')[1].split()[0]}.pdf")))
            elif "Question: " in said:
                rows.append((str(r["request_id"]), '{"answerable": false}'))
            else:
                blocks = json.loads(said[said.index("[{") : said.rindex("}]") + 2])
                asked_texts.extend(b["text"] for b in blocks)
                rows.append((str(r["request_id"]), json.dumps({"translations": [{"id": b["id"], "text": f"fr {b['text']}"} for b in blocks]})))
        kind = prompts.schema["request_id"].dataType.simpleString()
        return spark.createDataFrame(rows, "request_id string, reply string").select(F.col("request_id").cast(kind).alias("request_id"), "reply")

    text = "The water of the river falls in the summer and the dams of the hills are closed for the year"
    book = {"a.pdf": [(0, 0, text, None), (0, 1, "A-12", None), (1, 0, "The dams of the hills hold the water of the spring for the summer", None)], "b.pdf": [(None, None, None, "the file is not a PDF")], "long.pdf": [(p, 0, f"{text} {p}", None) for p in range(4)]}

    def files(paths):
        rows = [(r["request_id"], *b) for r in paths.collect() for b in book.get(r["path"], [])]
        return spark.createDataFrame(rows, "request_id long, page int, pos int, text string, refused string")

    glossaries = spark.createDataFrame([("en", "fr", "A-12", "A-12 bis")], "source_lang string, target_lang string, source string, target string")
    own = Engine(spark, engine.root, replace(engine.settings, confirm_pages=3), model, model, files=files, glossaries=glossaries)
    asked = spark.createDataFrame([(k, f"tr {name} now") for k, name in enumerate(["a", "b", "gone", "long"])], "request_id long, request string")
    got = {r["request_id"]: r["message"] for r in own.run(asked).collect()}
    assert "a.pdf: 3 blocks translated" in got[0] and ("Étape 2 sur 2" in got[0] or "Step 2 of 2" in got[0])
    assert "b.pdf: the file is not a PDF" in got[1] and "gone.pdf: the file is not there" in got[2] and "long.pdf: " in got[3]
    assert all("2 (question)" in got[k] for k in (1, 2, 3)) and len(asked_texts) == 2
    again = {r["request_id"]: r["message"] for r in own.run(asked.where("request_id in (0, 3)").withColumn("confirmed", F.lit(True))).collect()}
    assert "a.pdf: 3 blocks translated" in again[0] and "long.pdf: 4 blocks translated" in again[3] and len(asked_texts) == 6
    cached = own._translated(files(spark.createDataFrame([(7, "a.pdf")], "request_id long, path string")), "en", "fr").orderBy("page", "pos").collect()
    assert [r["translation"] for r in cached] == [f"fr {text}", "A-12 bis", f"fr {book['a.pdf'][2][2]}"] and len(asked_texts) == 6


def test_more_documents(spark, engine, tmp_path):
    """add makes one more version; an engine that is open stays at its own; cells find what the exact scan finds."""
    blocks = lambda rows: spark.createDataFrame([(d, 0, 0, text, 10.0, False, True, False) for d, text in rows], "doc_id string, page int, pos int, text string, size double, bold boolean, horizontal boolean, numeric boolean")
    titles = lambda *names: spark.createDataFrame([(d, f"Report {d}") for d in names], "doc_id string, title string")
    made = Engine(spark, str(tmp_path / "e"))
    made.build(blocks([("w", PAGES[0][2]), ("f", PAGES[1][2])]), titles("w", "f"))
    open_ = Engine(spark, made.root)
    assert open_.passages.count() == 2
    made.add(blocks([("x", "Wells run dry in summer when rain is late, and springs fail in the hills. " * 2), ("w", "again " * 40)]), titles("x", "w"))
    asked = spark.createDataFrame([(1, "dry wells and springs")], "query_id long, text string")
    for mode in ("bm25", "dense", "hybrid"):
        assert made.search(asked, 1, mode).first()["doc_id"] == "x" == made.search(asked, 1, mode, exact=False).first()["doc_id"]
        assert "x" not in {r["doc_id"] for r in open_.search(asked, 9, mode).collect()}
    assert made.passages.count() == 3 == made.vectors.count() and len(made.lexical.segments) == 2
    with pytest.raises(Exception, match="raised"):
        made.add(blocks([("y", "some text " * 20)]).withColumn("text", F.raise_error(F.lit("raised"))), titles("y"))
    made.refresh()
    assert made.catalogue.count() == 3 and made.version == 2


def test_evaluation_and_command_line(spark, engine, capsys, tmp_path):
    questions = spark.createDataFrame([("q1", "dams closed for repairs", "plain", [("w", [1])]), ("q2", "forest fires", "plain", [("f", [1])]), ("q3", "moon", "none", [("f", [7])])], "query_id string, text string, type string, expected array<struct<doc_id:string,pages:array<int>>>")
    measures, pairs = engine.evaluate(questions)
    whole = {r["system"]: r["hit5"] for r in measures.where("type is null").collect()}
    assert whole["bm25"] == pytest.approx(2 / 3, abs=1e-5) and len(whole) == 3 and pairs.count() == 3
    assert cli.main(["search", "dams", "--mode", "bm25", "--doc", "w"], engine) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0])["passage_id"].startswith("w:p1")
    cli.main(["ask", "river levels"], engine)
    assert json.loads(capsys.readouterr().out)["answerable"]
    cli.main(["--form", "tab", "run", "hello"], engine)
    assert capsys.readouterr().out.startswith("0\t")
    page = "<html lang='en'><title>Wells</title><h1>Wells and springs</h1><p>" + "Wells run dry in summer when rain is late. " * 4 + "</p></html>"
    spark.createDataFrame([(1, "http://x", page)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages")
    other = Engine(spark, f"{tmp_path}/index")
    cli.main(["build", f"{tmp_path}/pages"], other)
    assert json.loads(capsys.readouterr().out) == {"documents": 1, "passages": 1} and other.passages.first()["title"] == "Wells"
    cli.main(["extract", f"{tmp_path}/pages", "--pages", "1"], other)
    assert json.loads(capsys.readouterr().out)["translatable"] == 3
    (tmp_path / "q.jsonl").write_text('{"id": "a", "question": "dry wells", "type": "t", "expected": [{"doc_id": "1", "pages": [1]}]}\n')
    cli.main(["evaluate", f"{tmp_path}/q.jsonl"], other)
    assert '"hit1":1.0' in capsys.readouterr().out


def test_service(engine):
    import threading
    import time
    import urllib.error
    import urllib.request

    from docloom.service import Service, serve

    server = serve(engine, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(path, body=None):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_address[1]}{path}", None if body is None else json.dumps(body).encode())
        try:
            with urllib.request.urlopen(request, timeout=120) as answer:
                return answer.status, json.loads(answer.read())
        except urllib.error.HTTPError as error:
            return error.code, json.loads(error.read())

    try:
        assert call("/health") == (200, {"status": "ok"}) and [d["doc_id"] for d in call("/v1/documents")[1]] == ["f", "w"]
        status, hits = call("/v1/search", {"text": "dams closed", "mode": "bm25", "doc_ids": ["w"]})
        assert status == 200 and hits[0]["doc_id"] == "w" and call("/v1/ask", {"question": "river levels"})[1]["answerable"]
        assert call("/v1/ask", {"question": "x"})[0] == call("/v1/search", {"text": "dams", "doc_ids": ["nope"]})[0] == call("/v1/compare", {"doc_ids": ["w"], "topic": "hills"})[0] == 422
        assert [p["kept"] for p in call("/v1/summary", {"doc_id": "w", "lang": "en"})[1]] == [True, False] and call("/v1/nothing", {})[0] == call("/v1/agent/none")[0] == 404
        status, job = call("/v1/agent", {"request": "hello there"})
        for _ in range(240):
            state = call(f"/v1/agent/{job['id']}")[1]
            if state["status"] in ("done", "failed"):
                break
            time.sleep(0.5)
        assert status == 202 and state["status"] == "done" and "Forest report" in state["result"]
        left = {"job_id": "lost", "status": "running", "detail": "", "done": 0, "total": 0, "seq": 1}
        engine.spark.createDataFrame([tuple(left.values())], "job_id string, status string, detail string, done int, total int, seq long").withColumn("ts", F.current_timestamp()).write.mode("append").json(f"{engine.root}/jobs")
        again = Service(engine)
        assert again.state("lost") == {"status": "failed", "result": "interrupted by a restart"} and again.state(job["id"])["status"] == "done"
    finally:
        server.shutdown()
