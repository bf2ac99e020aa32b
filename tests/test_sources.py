"""Sources and sinks in a folder, settings, providers, translation and messages."""

import json

import pytest
from pyspark.sql import functions as F

from docloom import providers as P
from docloom.config import Settings
from docloom.functions import language
from docloom.operators import messages, planning, translate
from docloom.sources import corpus, files, logs


def test_corpus(spark, tmp_path):
    entries = [{"id": "w", "file": "w.pdf", "title": "Water", "org": "O", "year": 2020, "summary_pages": [1, 2]}, {"id": "f", "file": "gone.pdf", "title": "Forest", "org": "O"}]
    (tmp_path / "c.json").write_text(json.dumps(entries))
    (tmp_path / "bad.json").write_text(json.dumps([{"id": "x", "file": "x.pdf", "title": "X", "org": "O", "summary_pages": [1]}]))
    got = corpus.load_catalogue(spark, str(tmp_path / "c.json"))
    assert [r["id"] for r in got.orderBy("id").collect()] == ["f", "w"]
    with pytest.raises(Exception, match="not complete"):
        corpus.load_catalogue(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "w.pdf").write_bytes(b"%PDF-1.4 text")
    found, missing = corpus.files_of(spark, got, str(tmp_path / "raw"))
    assert [r["id"] for r in found.collect()] == ["w"] and [r["id"] for r in missing.collect()] == ["f"]
    files_ = [("a.pdf", b"%PDF-1", 6, 3), ("b.txt", b"x", 1, 1), ("c.PDF", b"%PDFx", 99, 1), ("d.pdf", b"GIF8", 4, 1), ("e.pdf", b"%PDF /Encrypt", 9, 1), ("f.pdf", b"%PDF", 4, None), ("g.pdf", b"%PDF", 4, 0), ("h.pdf", b"%PDF", 4, 99)]
    checked = {r["file"]: (r["refused"], r["needs_confirmation"]) for r in corpus.check_uploads(spark.createDataFrame(files_, "file string, content binary, length long, pages int"), 50, 30, 2).collect()}
    assert checked["a.pdf"] == (None, True) and [checked[f"{c}.pdf" if c != "c" else "c.PDF"][0] for c in "cdefgh"] == ["the file is too large", "the file is not a PDF", "password-protected PDFs are not supported", "the PDF could not be opened", "the PDF has no pages", "the PDF has more than 30 pages"] and checked["b.txt"][0]
    (tmp_path / "p.jsonl").write_text('{"passage_id": "w:p1:0", "doc_id": "w", "page": 1, "text": "t"}\n\n')
    passages = corpus.load_passages(spark, str(tmp_path / "p.jsonl"))
    corpus.save_passages(passages, str(tmp_path / "out"))
    corpus.save_passages(passages, str(tmp_path / "out"))
    assert corpus.load_passages(spark, str(tmp_path / "out")).count() == 1
    (tmp_path / "g.json").write_text('{"river": "fleuve", "IPCC": "GIEC"}')
    assert {r["source"]: r["target"] for r in corpus.load_glossary(spark, str(tmp_path / "g.json")).collect()} == {"river": "fleuve", "IPCC": "GIEC"}
    (tmp_path / "h.json").write_text('{"river": 3}')
    with pytest.raises(Exception, match="object of strings"):
        corpus.load_glossary(spark, str(tmp_path / "h.json")).collect()


def test_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.txt").write_text("x")
    assert [(r["path"], r["bytes"]) for r in files.list_objects(spark, f"file://{tmp_path}/a").collect()] == [("b/x.txt", 1)]
    assert files.copy_folder(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/c") and not files.copy_folder(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/c")
    assert (tmp_path / "c" / "b" / "x.txt").read_text() == "x"
    df = spark.createDataFrame([("gs://b/x/y/",), ("gs://b",), ("http://b/x",), ("gs:///x",)], "u string")
    assert [r[0] and tuple(r[0]) for r in df.select(files.bucket_and_prefix(F.col("u"))).collect()] == [("b", "x/y/"), ("b", ""), None, None]
    df = spark.createDataFrame([("p/a/b",), ("p/",), ("p/../z",), ("p/a..b",), ("p//z",)], "n string")
    assert [tuple(r[0]) for r in df.select(files.relative(F.col("n"), F.lit("p/"))).collect()] == [("a/b", True), (None, True), ("../z", False), ("a..b", True), ("/z", False)]


def test_logs(spark, tmp_path):
    cache = logs.Cache(spark, f"{tmp_path}/cache", "m", "v1")
    asked = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k2", "b")], "key string, text string")
    seen = []

    def work(rows):
        seen.append(sorted(r["key"] for r in rows.collect()))
        return rows.select("key", F.upper("text").alias("value"))

    assert {r["key"]: r["value"] for r in cache.through(asked, work).collect()} == {"k1": "A", "k2": "B"}
    (tmp_path / "cache" / "damaged.json").write_text('{"key": "k9", "val')
    cache.through(asked.union(spark.createDataFrame([("k3", "c")], "key string, text string")), work)
    assert seen == [["k1", "k2"], ["k3"]] and logs.Cache(spark, f"{tmp_path}/cache", "m", "v2").rows().count() == 0
    jobs = logs.Jobs(spark, f"{tmp_path}/jobs")
    assert logs.run_job(jobs, "j1", lambda tell: tell(1, 2) or "fine") == "done" and logs.run_job(jobs, "j2", lambda tell: 1 / 0) == "failed"
    jobs.put(spark.createDataFrame([("j3", "running", "", 1, 2, 1)], "job_id string, status string, detail string, done int, total int, seq long").withColumn("ts", F.current_timestamp()))
    jobs.recover()
    now = {r["job_id"]: (r["status"], r["detail"]) for r in jobs.now().collect()}
    assert now["j1"] == ("done", "fine") and now["j2"][1].startswith("ZeroDivisionError") and now["j3"] == ("failed", "interrupted by a restart")
    trace, off = logs.Trace(spark, f"{tmp_path}/trace"), logs.Trace(spark, None)
    for t in (trace, off):
        t.note("r1", "score", "kept", score=0.5)
        t.flush()
    assert trace.rows().count() == 1 and off.rows().count() == 0 and not off.enabled
    records = spark.createDataFrame([("t", 0, "plan", 1.5)], "thread string, seq int, node string, seconds double").withColumn("ts", F.lit("2024-05-01 10:00:00").cast("timestamp"))
    logs.save_trajectories(records, f"{tmp_path}/runs")
    assert [(r["node"], str(r["day"])) for r in logs.load_trajectories(spark, f"{tmp_path}/runs").collect()] == [("plan", "2024-05-01")]
    iso, part = records.select(*logs.stamp(F.col("ts"))).first()
    assert iso.startswith("2024-05-01T10:00:00") and part == "20240501-100000"
    assert json.loads(records.select(logs.json_line(a=F.col("seq"), b=F.lit(None).cast("string"))).first()[0]) == {"a": 0}


def answer(text, status=200, **headers):
    body = {"choices": [{"message": {"content": text}}], "usage": {"prompt_tokens": 10, "completion_tokens": 2}} if status == 200 else {"error": {"message": text}}
    return status, headers, json.dumps(body)


def test_chat():
    script, waits = [], []
    chat = lambda **s: P.Chat(Settings(model="m", **s), lambda url, headers, body: script.pop(0), waits.append, lambda: 0.0)
    script[:] = [answer("busy", 429, **{"Retry-After": "7"}), answer("not json"), answer('{"x": 1}')]
    c = chat()
    assert c.complete([]) == {"x": 1} and waits[0] == 7.0 and (c.usage.requests, c.usage.retries, c.usage.tokens_in) == (3, 2, 20) and dict(c.usage.errors) == {"HTTP 429": 1, "invalid answer": 1}
    script[:] = [answer("no key", 401)]
    with pytest.raises(P.Refused, match="no key"):
        chat().complete([])
    script[:] = [answer("down", 503)] * 3
    with pytest.raises(P.ChatError, match="after 3 attempts"):
        chat(max_retries=2).complete([])
    script[:] = [answer("{}")]
    c = chat(max_calls=1)
    c.complete([])
    with pytest.raises(P.BudgetExceeded):
        c.complete([])
    policy, busy, down = P.RetryPolicy(4, 2, lambda a, b: 0.0), P.Failure("HTTP 429", 429), P.Failure("HTTP 503", 503)
    assert [policy.next_wait([busy] * n) for n in range(1, 8)] == [5, 10, 20, 40, 60, 60, None]  # two cost nothing, four are retried
    assert [policy.next_wait([down] * n) for n in range(1, 6)] == [1, 2, 4, 8, None]
    assert policy.next_wait([down, busy, down]) == 2 and policy.next_wait([busy, down, busy]) == 10
    assert policy.next_wait([P.Failure("HTTP 401", 401)]) is None and P.Failure("ReadTimeout").final is False
    assert policy.next_wait([P.Failure("HTTP 429", 429, "999")]) == 60 and policy.next_wait([P.Failure("HTTP 503", 503, "soon")]) == 1
    assert P.RetryPolicy(9, 0).next_wait([down]) > 1
    said = {"{": "{", '[{"error": {"message": " why "}}]': "why", '{"detail": "d", "error": "e"}': "d", "[]": "", '{"error": {"code": 3}}': "", '{"message": ""}': ""}
    assert {body: P.error_words(body) for body in said} == said


def test_embedders(spark):
    texts = ["a" * 30, "b" * 30, "c"]
    sent = []

    def transport(url, headers, body):
        sent.append(len(body["input"]))
        rows = [{"index": k, "embedding": [3.0, 4.0 + k]} for k in range(len(body["input"]))]
        return 200, {}, json.dumps({"data": rows[::-1], "usage": {"prompt_tokens": 5}})

    remote = P.RemoteEmbedder(Settings(model="m", embed_batch_chars=60, embed_batch_items=9), 2, transport, lambda s: None)
    got = remote.embed_documents(texts)
    assert sent == [2, 1] and got[0] == [0.6, 0.8] and remote.tokens == 10
    local = P.LocalEmbedder("l", 1, lambda ts: [[float(len(t.split()))] for t in ts], "query: ", "passage: ", most_tokens=3)
    assert local.embed_query("a b c d") == [1.0] and local._cut("a b c d") == "a b c"
    assert sum(x * x for x in P.HashEmbedder().embed_query("rivers and rivers")) == pytest.approx(1) and P.unit([0.0]) == [0.0]
    with pytest.raises(ValueError, match="unknown embedder"):
        P.build_embedder(Settings(embedder="x"))
    rows = P.translate(spark.createDataFrame([("a <s1>b</s1> rivers run",)], "text string"), lambda: P.build_translator("fake", Settings()), "en", "fr").first()
    assert rows["translation"] == P.pseudo("a <s1>b</s1> rivers run") and rows["translation"].startswith("A <s1>B</s1> RIVERS RUN a")
    with pytest.raises(Exception, match="gave 1 translations"):
        short = type("Short", (P.Translator,), {"translate_blocks": lambda self, texts, s, t: ["x"]})
        P.translate(spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1), short, "en", "fr").collect()


def test_settings():
    s = Settings.from_env({"DOCLOOM_MODEL": "m", "DOCLOOM_TOP_K": "7", "DOCLOOM_PRICE_IN_USD": "0.5", "DOCLOOM_API_KEY": "secret"})
    assert s.top_k == 7 and s.price_in_usd == 0.5 and s.prices is None and "secret" not in repr(s) and s.url.startswith("http") and s.model_name == "m"
    with pytest.raises(ValueError):
        Settings.from_env({"DOCLOOM_PROVIDER": "nobody"})
    with pytest.raises(ValueError):
        _ = Settings(provider="custom").url


def test_translation(spark):
    glossary = spark.createDataFrame([("water table", "nappe"), ("TS", "RT"), ("river", "fleuve"), ("C++", "C++"), ("°", "deg")], "source string, target string")
    texts = spark.createDataFrame([(1, "The Water Table results"), (2, "TS and rivers, C++ at 5 °"), (3, "river")], "id long, text string")
    got = {(r["id"], r["source"]) for r in translate.relevant_terms(texts, glossary).collect()}
    assert got == {(1, "water table"), (2, "TS"), (2, "C++"), (2, "°"), (3, "river")}
    done, todo = translate.kept_locally(spark.createDataFrame([(1, " river "), (2, "SSP1-2.6"), (3, "A river")], "id long, text string"), glossary)
    assert {r["id"]: r["translation"] for r in done.collect()} == {1: "fleuve", 2: "SSP1-2.6"} and [r["id"] for r in todo.collect()] == [3]
    blocks = spark.createDataFrame([("p", k, "x" * n) for k, n in enumerate([4, 4, 9, 1, 1, 1])] + [("q", 0, "y")], "page string, pos int, text string")
    assert [(r["page"], r["batch"]) for r in translate.batches(blocks, "page", "pos", 8, 2).orderBy("page", "pos").collect()] == [("p", 0), ("p", 0), ("p", 1), ("p", 2), ("p", 2), ("p", 3), ("q", 0)]
    asked = spark.createDataFrame([("b", k, f"text {k}") for k in range(3)], "batch_id string, pos int, text string")
    calls = []

    def ask(prompts):
        rows = prompts.collect()
        calls.append([len(json.loads(r["messages"][1]["content"])["blocks"]) for r in rows])
        return spark.createDataFrame([(r["batch_id"], json.dumps({"translations": [{"id": 0, "text": "T" + json.loads(r["messages"][1]["content"])["blocks"][0]["text"]}]})) for r in rows], "batch_id string, reply string")

    none = spark.createDataFrame([], "batch_id string, source string, target string")
    out = translate.translate_all(asked, ask, none, "English", "French")
    assert {r["pos"]: r["translation"] for r in out.collect()} == {k: f"Ttext {k}" for k in range(3)} and calls == [[3], [2], [1]]
    with pytest.raises(RuntimeError, match="untranslated"):
        translate.translate_all(asked, ask, none, "English", "French", rounds=2)
    rows = [(1, "a <s1>b</s1>", "x <s1>b</s1>"), (2, "a <s1>dam</s1> c", "un dam c"), (3, "a <s1>lake</s1> c", "rien"), (4, "a <s1>hill</s1> c", "rien <s1>de</s1> <s2>x</s2>")]
    again = lambda df: df.where("id = 3").select("id", F.lit("un <s1>lac</s1>").alias("retry"))
    fixed = translate.repair(spark.createDataFrame(rows, "id long, text string, translation string"), spark.createDataFrame([(9, "a", "b")], "id long, source string, target string"), again)
    assert {r["id"]: (r["translation"], r["repair"]) for r in fixed.collect()} == {1: ("x <s1>b</s1>", "none"), 2: ("un <s1>dam</s1> c", "restored"), 3: ("un <s1>lac</s1>", "asked"), 4: ("rien de x", "dropped")}
    assert translate.usage(fixed, done).first().asDict() == {"tags_restored": 1, "tag_repairs": 1, "tag_fallbacks": 1, "kept_locally": 2}


def test_language(spark):
    texts = {"The water of the rivers is high and it rises with the rain": "en", "Les eaux des rivières sont hautes et la pluie est dans le nord": "fr", "Das Wasser der Flüsse ist hoch und der Regen ist nicht weit": "de", "Las aguas de los ríos son altas y el agua es como la lluvia": "es", "Le acque dei fiumi sono alte e la pioggia non è più nel nord": "it", "As águas dos rios são altas e não há mais chuva no norte do país": "pt", "SSP1": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["c"] for r in df.select("t", language.classify(F.col("t")).alias("c")).collect()}
    assert {t: c["language"] for t, c in got.items()} == texts and got["SSP1"]["confidence"] == 0.0 and all(c["confidence"] > 0.6 for t, c in got.items() if t != "SSP1")
    asked = spark.createDataFrame([("Résume le rapport",), ("SSP1-1.9?",), ("Sum up the report",)], "t string")
    assert [tuple(r) for r in asked.select(language.request_language(F.col("t")), language.question_language(F.col("t"))).collect()] == [("fr", "fr"), ("fr", "en"), ("en", "en")]
    english = [*texts][0]
    cases = [("en-GB", english, ("en", 1.0, "metadata")), (None, english, ("en", "text")), ("fr_FR", "x", ("fr", 0.9, "metadata")), ("xx", "x", (None, 0.0, "none")), ("fr", english, ("en", "text"))]
    rows = spark.createDataFrame([(m, t) for m, t, _ in cases], "m string, t string").select(language.detect(F.col("m"), F.col("t")).alias("d")).collect()
    for row, (_, _, want) in zip(rows, cases, strict=True):
        d = row["d"]
        assert (d["language"], d["confidence"], d["method"]) == want if len(want) == 3 else (d["language"], d["method"]) == want
    pages = spark.createDataFrame([("d", 0, "a\n b"), ("d", 1, "c" * 5000), ("d", 2, "never"), ("e", 0, "x"), ("e", 1, "y"), ("e", 2, "z"), ("e", 3, "w")], "doc_id string, page int, text string")
    samples = {r["doc_id"]: r["sample"] for r in language.text_sample(pages).collect()}
    assert samples["e"] == "x y z" and samples["d"].startswith("a b ccc") and len(samples["d"]) == 5000


def test_messages(spark):
    source = "struct<n:int,title:string,page:int,quotes:array<string>,excerpt:string>"
    src = lambda n, p: (n, "Water", p, ["q1", "q2"], "whole")
    df = spark.createDataFrame([("Levels fell [1] .", [src(1, 3), src(2, 3), src(3, 4)], "Land", [("Water", "Dry [2].", [src(1, 3)]), ("Forest", "Wet.", [src(2, 9)])], "Nothing on Hills.")], f"text string, sources array<{source}>, aspect string, sides array<struct<title:string,says:string,sources:array<{source}>>>, note string")
    line, comparison, quotes, excerpts = df.select(messages.point_line(F.col("text"), F.col("sources")), messages.comparison_lines(F.col("aspect"), F.col("sides"), F.col("note")), *messages.judged_quotes(F.col("sources"))).first()
    assert line == "- Levels fell. (Water, p. 3; Water, p. 4)"
    assert comparison == "- **Land**\n    - Water: Dry.\n    - Forest: Wet.\n    - Nothing on Hills.\n    - (Water, p. 3; Water, p. 9)"
    assert quotes[:2] == ["Water, p. 3: q1", "Water, p. 3: q2"] and excerpts == ["Water, p. 3: whole", "Water, p. 4: whole"]
    ex = spark.createDataFrame([(1, 2, "w", "w", "Water", 5, "Dams", "two"), (1, 1, "w", "w", "Water", 4, None, "one")], "request_id int, n int, passage_id string, doc_id string, title string, page int, section string, text string")
    said = messages.answer_messages(spark.createDataFrame([(1, "What is the height of the dams that are in the north?")], "request_id int, question string"), ex).first()["messages"][1]["content"]
    assert said.startswith("Question: What") and "[1] (Water, p. 4)\none\n\n[2] (Water, p. 5 — Dams)\ntwo" in said and said.endswith("English, even where the excerpts are not.")
    catalogue = spark.createDataFrame([("w", "Water", "O", None, "en"), ("f", "Forest", "P", 2020, None)], "doc_id string, title string, org string, year int, lang string")
    assert messages.catalogue_lines(catalogue).first()[0] == "- f: Forest (P, 2020, ?)\n- w: Water (O, ?, en)"
    items = spark.createDataFrame([(1, 1, "S", ["q"], ["e" * 2000])], "request_id int, n int, statement string, quotes array<string>, excerpts array<string>")
    judge = messages.judge_messages(spark.createDataFrame([(1, "asked", "en")], "request_id int, request string, lang string"), items).first()["messages"]
    assert "in English" in judge[0]["content"] and judge[1]["content"] == "Request: asked\n\n[1] Statement: S\n    Quote: q\n    Passage: " + "e" * 1500
    plans = spark.createDataFrame([(1, 0, "question", "en", 2), (1, 1, "summarize", "en", 2), (2, 0, "question", "en", 0)], "request_id int, step_no int, route string, lang string, dropped int")
    sections = spark.createDataFrame([(1, 0, "first"), (2, 0, "only")], "request_id int, step_no int, section string")
    told = {r["request_id"]: r["message"] for r in messages.respond(plans, sections).collect()}
    assert told[2] == "only" and told[1] == "Step 1 of 2 - question\nfirst\n\nNot done: step 2 (summary).\n\nOnly 5 steps are run at once; 2 were left out."
    points = spark.createDataFrame([(1, 0, "- a", True, True, None), (1, 1, "- b", True, False, "wrong"), (2, 0, "- c", False, True, None)], "request_id int, point_no int, line string, judged boolean, faithful boolean, problem string")
    heads = spark.createDataFrame([(1, "en", "Head"), (2, "en", "Head"), (3, "en", "Head")], "request_id int, lang string, head string")
    shown = {r["request_id"]: r["section"] for r in messages.render_points(points, heads).collect()}
    assert shown == {1: "Head\n- a\nRemoved by the review (1): wrong", 2: "Head\n- c\n(These points were not reviewed.)", 3: "Nothing passed the review."}
    replied = spark.createDataFrame([(1, "en", True, "It fell.", [src(1, 3)], True, True, None), (2, "en", True, "x", [src(1, 3)], True, False, "no such year"), (3, "fr", False, None, None, None, None, None)], f"request_id int, lang string, answerable boolean, answer string, sources array<{source}>, judged boolean, faithful boolean, problem string")
    shown = {r["request_id"]: r["section"] for r in messages.render_answers(replied).collect()}
    assert shown[1] == "It fell.\n\nSources :\n[1] Water, p. 3 — « q1 »" and shown[2] == "The review rejected the answer: no such year" and shown[3].startswith("La réponse")
    results = spark.createDataFrame([("a", "x", 1, True, "s", None)], "id string, category string, run int, ok boolean, signature string, fixed_by_code boolean")
    report = messages.routing_report(planning.routing_summary(results), spark.createDataFrame([(1.0, 0.1), (3.0, 0.2)], "seconds double, cost double")).first()[0]
    assert "Right plans: 1 / 1" in report and "median and longest: 3.0 s, 3.0 s" in report and "| x | 1 / 1 |" in report
    assert [r[0] for r in spark.createDataFrame([(2, 10, 5, 0.5), (1, 1, 1, None)], "c int, i int, o int, d double").select(messages.usage_line(*map(F.col, "ciod"))).collect()] == ["2 calls, 10 tokens in, 5 out, $0.5000", "1 calls, 1 tokens in, 1 out"]
    prompt = messages.translation_messages(spark.createDataFrame([(1, ["a <s1>b</s1>"], {"a": "z"})], "batch_id int, texts array<string>, terms map<string,string>"), F.lit("English"), F.lit("French")).first()["messages"]
    assert "  - a -> z\n" in prompt[0]["content"] and json.loads(prompt[1]["content"]) == {"blocks": [{"id": 0, "text": "a <s1>b</s1>"}]}
    assert spark.range(1).select(messages.repair_note(F.array(F.lit("<s1>a</s1><s1>b</s1>")))).first()[0].endswith("- id 0: <s1>…</s1> x2")
