"""The whole engine on a folder: index documents, answer, summarise, compare and plan for tables of requests at once.

A model is a function from (request_id, messages) to (request_id, reply): providers.replies of a chat client, or a table
of replies in tests. All requests go through each step together; a driver loop runs only over the steps of plans.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import providers, schemas
from .config import Settings
from .functions import language
from .operators import chunk, dense, evaluate, grounding, lexical, messages, planning, replies, search, translate
from .operators.search import MODES
from .sources import corpus, html, logs
from .sources.snapshots import Change, Snapshots
from .sources.vectors import VectorTable, point_id
from .storage import written

Model = Callable[[DataFrame], DataFrame]
POINTS, COMPARE_POINTS, PER_DOCUMENT, SUMMARY_PASSAGES, SUMMARY_CHARS = 5, 3, 5, 8, 24_000


class Engine:
    """Shared resources, opened when first used; all of them can be given instead."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, model: Model | None = None, judge: Model | None = None, embedder: Callable[[], providers.Embedder] | None = None, files: Callable[[DataFrame], DataFrame] | None = None, renderer: Callable[[DataFrame], DataFrame] | None = None, glossary: DataFrame | None = None, glossaries: DataFrame | None = None):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings or Settings()
        self.snapshots = Snapshots(spark, root)
        own = self.settings
        self.model = model or (lambda prompts: providers.replies(prompts, lambda: providers.tools_chat(own)))
        self.judge_model = judge or (self.model if model else lambda prompts: providers.replies(prompts, lambda: providers.supervisor_chat(own, own.max_calls)))
        self.files, self.renderer, self.glossary = files, renderer, glossary
        self.glossaries = glossaries if glossaries is not None else spark.createDataFrame([], "source_lang string, target_lang string, source string, target string")
        self._replies: list[DataFrame] = []
        self._judged: list[DataFrame] = []
        self.embedder = embedder or (lambda: providers.build_embedder(own))

    @cached_property
    def version(self) -> int | None:
        """The version of the folder that is open; passages, index and vectors are all of it. refresh opens the latest."""
        return self.snapshots.latest()

    def refresh(self) -> None:
        for name in ("version", "passages", "catalogue", "lexical", "cells"):
            self.__dict__.pop(name, None)

    @cached_property
    def passages(self) -> DataFrame:
        return self.snapshots.read("passages", self.version)

    @cached_property
    def catalogue(self) -> DataFrame:
        return self.snapshots.read("catalogue", self.version)

    @cached_property
    def lexical(self) -> lexical.Index:
        return lexical.Index(self.spark, self.root, self.version)

    def vectors_at(self, version: int | None) -> VectorTable:
        model = self.embedder()
        return VectorTable(self.spark, self.root, model.name, model.dim, version)

    @property
    def vectors(self) -> VectorTable:
        return self.vectors_at(self.version)

    # Index ------------------------------------------------------------------------------------------------------------

    def build(self, blocks: DataFrame, catalogue: DataFrame) -> None:
        """Passages of blocks, their lexical index, and vectors of those that have none yet, as one new version.

        catalogue: doc_id, title, and org, year, lang, file, summary_pages where known. If anything fails, the folder
        stays as it was.
        """
        catalogue = self._catalogue(catalogue)
        with self.snapshots.change() as change:
            change.replace("catalogue", catalogue)
            change.replace("passages", self._passages(blocks, catalogue))
            lexical.clear(change)
            change.state["tables"].pop("cells", None)
            change.facts.pop("centroids", None)
            self._index(change, change.read("passages"))
        self.refresh()

    def add(self, blocks: DataFrame, catalogue: DataFrame) -> None:
        """More documents, as one new version: their passages and one more segment of the index. Documents whose id is
        known are left out."""
        with self.snapshots.change() as change:
            known = change.read("catalogue").select("doc_id")
            catalogue = written(self._catalogue(catalogue).join(known, "doc_id", "left_anti"), "catalogue")
            change.append("catalogue", catalogue)
            folder = change.append("passages", self._passages(blocks.join(catalogue.select("doc_id"), "doc_id", "left_semi"), catalogue))
            self._index(change, self.spark.read.schema(change.read("passages").schema).parquet(f"{self.root}/{folder}"))
        self.refresh()

    def _catalogue(self, catalogue: DataFrame) -> DataFrame:
        columns = {"org": "string", "year": "int", "lang": "string", "file": "string", "summary_pages": "array<int>"}
        for name, kind in columns.items():
            if name not in catalogue.columns:
                catalogue = catalogue.withColumn(name, F.lit(None).cast(kind))
        return catalogue.select("doc_id", "title", *columns)

    def _passages(self, blocks: DataFrame, catalogue: DataFrame) -> DataFrame:
        found = chunk.passages(blocks, self.settings.chunk_chars, self.settings.chunk_overlap).join(catalogue.select("doc_id", "title", "lang"), "doc_id", "left")
        return found.withColumn("embed_text", chunk.embed_text(F.col("title"), F.col("section"), F.col("text")))

    def _index(self, change: Change, passages: DataFrame) -> None:
        lexical.add(change, passages, text=F.col("embed_text"))
        lexical.merge_tiers(change)
        table = self.vectors_at(None)
        table.index(passages, lambda rows: providers.embed(rows, self.embedder, "embed_text"), change)
        keyed = passages.select("passage_id", point_id(table.model, F.col("embed_text")).alias("point_id"))
        stored = change.read(table.name).join(keyed.select("point_id", F.col("passage_id").alias("id")), "point_id")
        dense.Cells.add_to(change, stored.select("id", "doc_id", "v"))

    def build_pages(self, pages: DataFrame) -> None:
        """The same for web pages (page_id, url, html)."""
        titled = F.coalesce(F.nullif(html.plain(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")), F.col("url"))
        self.build(html.blocks(pages), pages.select(F.col("page_id").alias("doc_id"), titled.alias("title"), language.metadata_language(html.page_language(F.col("html"))).alias("lang"), F.col("url").alias("file")))

    # Search and answers -----------------------------------------------------------------------------------------------

    @cached_property
    def cells(self) -> dense.Cells:
        return dense.Cells(self.spark, self.root, self.version)

    def search(self, queries: DataFrame, top_k: int | None = None, mode: str = "hybrid", exact: bool = True) -> DataFrame:
        """Hits of (query_id, text[, doc_ids]). exact: all vectors are scored, else those of each query's nearest cells."""
        own = lambda rows: providers.embed(rows, self.embedder, "text", queries=True)
        return search.search(self.passages, queries, self.lexical, self.vectors.rows(), own, mode, top_k or self.settings.top_k, self.settings.candidates, None if exact else self.cells)

    def ask(self, questions: DataFrame, top_k: int | None = None) -> DataFrame:
        """Answers of (request_id, question): grounding.answers, with the reply's error. A refusal is an answer."""
        hits = written(self.search(questions.select(F.col("request_id").alias("query_id"), F.col("question").alias("text")), top_k), "hits")
        excerpts = search.excerpts(hits)
        replied = self._said(self.model, messages.answer_messages(questions, excerpts), "replies")
        read = questions.join(replied, "request_id", "left").select("request_id", "question", replies.answer(F.col("reply")).alias("a")).select("request_id", "question", "a.answerable", "a.answer", "a.evidence")
        return grounding.answers(read, excerpts)

    # Summaries and comparisons ------------------------------------------------------------------------------------------

    def summarize(self, requests: DataFrame, max_points: int = POINTS) -> tuple[DataFrame, DataFrame]:
        """(points, excerpts) of (request_id, doc_id, focus or null, lang).

        Without a focus a report's own summary pages are read, evenly spread, if its catalogue entry has them; else the
        passages that a search within the report finds. Points are checked; of those kept the first max_points stay.
        """
        rows = requests.join(self.catalogue.select("doc_id", "title", "summary_pages"), "doc_id", "left").withColumn("focus", F.nullif(F.trim("focus"), F.lit("")))
        rows = rows.withColumn("own", F.col("focus").isNull() & F.col("summary_pages").isNotNull())
        focus = F.coalesce("focus", F.when(F.col("lang") == "en", messages.DEFAULT_FOCUS["en"]).otherwise(messages.DEFAULT_FOCUS["fr"]))
        rows = rows.withColumn("focus", focus)
        first, last = F.get("summary_pages", F.lit(0)), F.get("summary_pages", F.lit(1))
        own = rows.where("own").select("request_id", "doc_id", first.alias("first"), last.alias("last")).join(self.passages, "doc_id").where(F.col("page").between(F.col("first"), F.col("last")))
        place = F.split_part("passage_id", F.lit(":"), F.lit(-1)).cast("int")
        own = search.spread(own.withColumn("place", place), "request_id", ["place"], SUMMARY_CHARS)
        found = self.search(rows.where("not own").select(F.col("request_id").alias("query_id"), F.col("focus").alias("text"), F.array("doc_id").alias("doc_ids")), SUMMARY_PASSAGES)
        found = found.withColumnRenamed("query_id", "request_id").withColumnRenamed("rank", "place")
        columns = ["request_id", "passage_id", "doc_id", "title", "page", "section", "text", "place"]
        both = own.select(columns).unionByName(found.select(columns))
        excerpts = written(both.withColumn("n", F.row_number().over(Window.partitionBy("request_id").orderBy("place"))).drop("place"), "excerpts")
        where = F.when(F.col("own"), F.format_string("Excerpts of the report's own summary (pages %d to %d)", first, last)).otherwise("Excerpts of the report most relevant to the focus")
        asked = rows.select("request_id", "title", "focus", where.alias("where"), "lang")
        replied = self._said(self.model, messages.summary_messages(asked, excerpts, max_points), "replies")
        points = replied.select("request_id", F.posexplode(replies.points(F.col("reply"))["points"]).alias("point_no", "p")).select("request_id", "point_no", "p.text", "p.evidence")
        checked = grounding.check_points(points.join(rows.select("request_id", F.col("focus").alias("request")), "request_id"), excerpts)
        return written(first_points(checked, max_points), "points"), excerpts

    def compare(self, requests: DataFrame, max_points: int = COMPARE_POINTS) -> tuple[DataFrame, DataFrame]:
        """(points, excerpts) of (request_id, doc_ids, topic, lang): two or three reports, each searched on its own."""
        documents = requests.select("request_id", "topic", "lang", F.posexplode(F.array_distinct("doc_ids")).alias("place", "doc_id"))
        asked = documents.select(F.struct("request_id", "doc_id").alias("k"), F.col("topic").alias("text"), F.array("doc_id").alias("doc_ids")).withColumn("query_id", F.to_json("k"))
        hits = self.search(asked.drop("k"), PER_DOCUMENT).join(asked.select("query_id", "k.request_id"), "query_id")
        excerpts, reports = (written(t, n) for t, n in zip(search.report_ranges(hits, documents.select("request_id", "place", "doc_id")), ("excerpts", "reports"), strict=True))
        replied = self._said(self.model, messages.compare_messages(requests, reports, excerpts, max_points), "replies")
        points = replied.select("request_id", F.posexplode(replies.comparison(F.col("reply"))["points"]).alias("point_no", "p")).select("request_id", "point_no", "p.*")
        checked = grounding.check_comparison(points.join(requests.select("request_id", F.col("topic").alias("request"), "lang"), "request_id"), reports, excerpts)
        return written(first_points(checked, max_points), "points"), excerpts

    def translate_queries(self, queries: DataFrame) -> DataFrame:
        """(query_id, text, source_lang, target_lang, translation): each question in the other language of the corpus."""
        source = language.query_language(F.col("text"))
        rows = queries.withColumn("source_lang", source).withColumn("target_lang", language.other_language(F.col("source_lang")))
        name = F.when(F.col("target_lang") == "en", "English").otherwise("French")
        prompt = messages.chat_messages(F.lit('Translate the query. Reply with JSON: {"translation": str}'), F.concat(F.lit("Target language: "), name, F.lit("\n\nQuery: "), "text"))
        replied = self.model(rows.select(F.col("query_id").alias("request_id"), prompt.alias("messages")))
        return rows.join(replied.select(F.col("request_id").alias("query_id"), replies.translated_query(F.col("reply")).alias("translation")), "query_id", "left")

    # Requests -----------------------------------------------------------------------------------------------------------

    def plan(self, requests: DataFrame) -> DataFrame:
        """Checked steps of (request_id, request)."""
        rows = requests.withColumn("lang", language.request_language(F.col("request")))
        replied = self.model(messages.router_messages(rows, self.catalogue, self.settings.max_steps))
        read = rows.join(replied.select("request_id", replies.steps(F.col("reply"))["steps"].alias("steps")), "request_id", "left").withColumn("steps", F.coalesce("steps", F.array().cast(replies.STEPS)))
        return planning.check_plans(planning.step_cap(read, self.settings.max_steps), self.catalogue.withColumn("doc_id", F.col("doc_id").cast("string")))

    def judge(self, items: DataFrame, requests: DataFrame) -> DataFrame:
        """items (request_id, n, statement, quotes, excerpts) with judged, faithful, problem; no reply keeps all, unjudged."""
        replied = self._said(self.judge_model, messages.judge_messages(requests, items), "verdicts")
        read = replied.select("request_id", replies.verdicts(F.col("reply")).alias("v"))
        verdicts = read.select("request_id", F.posexplode("v.verdicts").alias("pos", "x")).select("request_id", "pos", "x.*")
        return grounding.judge_join(items, verdicts, read.select("request_id", F.col("v.valid").alias("judged")))

    def run(self, requests: DataFrame) -> DataFrame:
        """(request_id, message) of (request_id, request[, confirmed]): planned, run step by step, reviewed, rendered.

        Step k of all requests runs together. planning.chain says from what the steps before gave which of them run: a
        request stops after a failed step, a question to the user or a request out of scope, and before a step for which
        its model calls do not suffice; what was not done is said. confirmed answers an earlier question whether a long
        file shall be translated. Every step is recorded if the settings name a folder for trajectories.
        """
        requests = requests if "confirmed" in requests.columns else requests.withColumn("confirmed", F.lit(None).cast("boolean"))
        plans = written(self.plan(requests).join(requests.select("request_id", "confirmed"), "request_id"), "plans")
        last = plans.agg(F.max("step_no")).first()[0]
        kind = plans.schema["request_id"].dataType.simpleString()
        sections = self.spark.createDataFrame([], f"request_id {kind}, step_no int, section string")
        results = self.spark.createDataFrame([], f"request_id {kind}, step_no int, failed boolean, calls int")
        # the plan itself was one call
        limit = None if self.settings.max_calls is None else self.settings.max_calls - 1
        for k in range((last if last is not None else -1) + 1):
            began = time.monotonic()
            now = written(planning.chain(plans, results, limit).where((F.col("step_no") == k) & F.col("done")).drop("done", "why"), "step")
            if now.isEmpty():
                break
            self._replies = []
            part, lost = self._step(now)
            part, lost = written(part, "section"), written(lost, "failed")
            calls = None
            for replied in self._replies:
                calls = replied if calls is None else calls.unionByName(replied)
            spent = calls.groupBy("request_id").agg(F.count("*").cast("int").alias("calls")) if calls is not None else now.select("request_id", F.lit(0).alias("calls"))
            made = now.select("request_id", "step_no").join(lost.select("request_id", F.lit(True).alias("failed")).distinct(), "request_id", "left").join(spent, "request_id", "left")
            made = written(made.select("request_id", "step_no", F.coalesce("failed", F.lit(False)).alias("failed"), F.coalesce("calls", F.lit(0)).alias("calls")), "results")
            results = results.unionByName(made)
            sections = sections.unionByName(part.withColumn("step_no", F.lit(k)).select("request_id", "step_no", "section"))
            self._record(now, part, made, k, time.monotonic() - began)
        ended = planning.chain(plans, results, limit)
        short = ended.where("why = 'budget'").select("request_id", "lang").distinct()
        notes = short.select("request_id", planning.message(F.col("lang"), "budget", n=F.lit(self.settings.max_calls)).alias("note"))
        return messages.respond(plans, sections, notes, max_steps=self.settings.max_steps)

    def _record(self, steps: DataFrame, parts: DataFrame, results: DataFrame, k: int, seconds: float) -> None:
        """Appends one step of all requests to the folders of trajectories and of traces; all share the step's time."""
        points, judged_now, self._judged = None, self._judged, []
        if not self.settings.trajectories and not self.settings.trace_path:
            return
        for judged in judged_now:
            points = judged if points is None else points.unionByName(judged)
        rows = steps.select("request_id", "route").join(results.drop("step_no"), "request_id").join(parts.groupBy("request_id").agg(F.max("section").alias("section")), "request_id", "left")
        if points is not None:
            per = points.groupBy("request_id").agg(F.count_if("faithful").cast("int").alias("kept"), F.count_if(~F.col("faithful")).cast("int").alias("removed"), F.bool_and("judged").alias("judged"))
            rows = rows.join(per, "request_id", "left")
        else:
            rows = rows.withColumns({"kept": F.lit(None).cast("int"), "removed": F.lit(None).cast("int"), "judged": F.lit(None).cast("boolean")})
        rows = written(rows, "records")
        if self.settings.trace_path:
            score = F.try_divide(F.col("kept"), F.col("kept") + F.col("removed")).cast("double")
            noted = {"thread": F.col("request_id").cast("string"), "kind": F.lit("step"), "name": F.col("route"), "output": F.col("section"), "score": score, "level": F.when(F.col("failed"), "ERROR"), "ts": F.current_timestamp()}
            logs.append(rows.select(*((noted[f.name] if f.name in noted else F.lit(None).cast(f.dataType)).alias(f.name) for f in schemas.TRACE.fields)), self.settings.trace_path)
        if not self.settings.trajectories:
            return
        own = {"thread": F.col("request_id").cast("string"), "seq": F.lit(k), "node": F.col("route"), "tool": F.when(F.col("route").isin(*planning.JUDGED, "translate"), F.col("route")), "seconds": F.lit(round(seconds, 3)), "kept": F.col("kept"), "removed": F.col("removed"), "judged": F.col("judged"), "ok": ~F.col("failed"), "items": F.col("calls"), "ts": F.current_timestamp()}
        logs.save_trajectories(rows.select(*(own[f.name].alias(f.name) if f.name in own else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.TRAJECTORY.fields if f.name != "day")), self.settings.trajectories)

    def _said(self, model: Model, prompts: DataFrame, name: str) -> DataFrame:
        """The replies of a model, written, and counted for the step under way."""
        replied = written(model(prompts), name)
        self._replies.append(replied.select("request_id"))
        return replied

    def _step(self, step: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(sections, requests that stop) of one step of every request."""
        lang = F.col("lang")
        listing = F.broadcast(messages.catalogue_lines(self.catalogue))  # one row
        asked = step.where("route in ('clarify', 'out_of_scope')").crossJoin(listing)
        head = F.when(F.col("route") == "clarify", F.col("reply")).otherwise(planning.message(lang, "out_of_scope"))
        plain = asked.select("request_id", F.concat(head, F.lit("\n"), planning.message(lang, "available"), F.lit(" :\n"), "catalogue").alias("section"))
        sections, stop = plain, plain.select("request_id")
        files = step.where("route = 'translate'")
        if not files.isEmpty():
            told, failed = self.translate(files)
            sections, stop = sections.unionByName(told), stop.unionByName(failed)
        questions = step.where("route = 'question'")
        if not questions.isEmpty():
            sections = sections.unionByName(self._answered(questions))
        for route, work in (("summarize", self._summarized), ("compare", self._compared)):
            rows = step.where(F.col("route") == route)
            if not rows.isEmpty():
                sections = sections.unionByName(work(rows))
        return sections, stop

    # Translation of files ----------------------------------------------------------------------------------------------

    def translate(self, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(sections, requests that stop) of translation steps (request_id, path, target_lang, lang, confirmed).

        The reader of files gives (request_id, page, pos, text, refused). Refused files, those in an unknown language or
        in the target's already, and long ones without a yes stop their request. The rest is translated with the glossary
        of its languages; texts that were translated before come from the cache. What is translated is a table, which the
        renderer, if there is one, turns into files.
        """
        if self.files is None:
            told = steps.select("request_id", F.concat("path", F.lit(": no reader of files is set up")).alias("section"))
            return told, told.select("request_id")
        blocks = written(self.files(steps.select("request_id", "path")), "blocks")
        pages = blocks.where("refused is null").groupBy("request_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda b: b["text"]), "\n").alias("text"))
        read = language.document_languages(pages.withColumnRenamed("request_id", "doc_id"), steps.select(F.col("request_id").alias("doc_id"), F.lit(None).cast("string").alias("stated")))
        per = blocks.groupBy("request_id").agg(F.max("refused").alias("refused"), F.countDistinct("page").alias("pages"))
        known = steps.join(per, "request_id", "left").join(read.select(F.col("doc_id").alias("request_id"), F.col("language").alias("source")), "request_id", "left")
        known = known.select("request_id", "path", "lang", F.coalesce("refused", F.when(F.col("pages").isNull(), "the file is not there")).alias("refused"), (F.col("pages") > self.settings.confirm_pages).alias("needs_confirmation"), "confirmed", "source", F.col("target_lang").alias("target"), F.lit(False).alias("done"), F.lit(None).cast("string").alias("failed"))
        state = written(planning.translation_step(known), "files")
        go = state.where("step = 'rebuild'").select("request_id", "source", "target")
        done = None
        for source, target in go.select("source", "target").distinct().collect():  # pairs of the few languages
            some = blocks.join(go.where((F.col("source") == source) & (F.col("target") == target)).select("request_id"), "request_id")
            one = written(self._translated(some, source, target), "translated")
            done = one if done is None else done.unionByName(one)
        asks = F.when(F.col("step") == "needs_confirmation", F.when(F.col("lang") == "en", "this file is long; shall it be translated?").otherwise("ce fichier est long ; faut-il le traduire ?")).when(F.col("step") == "cancelled", F.when(F.col("lang") == "en", "not translated").otherwise("non traduit")).otherwise(F.col("message"))
        stopped = state.where("step <> 'rebuild'")
        sections = stopped.select("request_id", F.concat("path", F.lit(": "), asks).alias("section"))
        if done is not None:
            made = self.renderer(done.join(state.select("request_id", "path"), "request_id")) if self.renderer else done.groupBy("request_id").agg(F.concat(F.count("*").cast("string"), F.lit(" blocks translated")).alias("file"))
            sections = sections.unionByName(state.where("step = 'rebuild'").join(made, "request_id").select("request_id", F.concat("path", F.lit(": "), "file").alias("section")))
        return sections, stopped.select("request_id")

    def _translated(self, blocks: DataFrame, source: str, target: str) -> DataFrame:
        """blocks (request_id, page, pos, text) with `translation`, from the cache where it has the text."""
        cache = logs.Cache(self.spark, f"{self.root}/translations", self.settings.model or "", translate.PROMPT_VERSION)
        glossary = corpus.glossary_for(self.glossaries, self.glossary, source, target)
        keyed = blocks.withColumn("key", logs.cache_key(translate.PROMPT_VERSION, self.settings.model or "", source, target, F.col("text")))

        def ask(prompts: DataFrame) -> DataFrame:
            replied = written(self.model(prompts.select(F.col("batch_id").alias("request_id"), "messages")), "replies")
            own = blocks.select("request_id").distinct()  # a batch is named after its request and page
            self._replies.append(own.join(replied.select(F.split_part("request_id", F.lit("/"), F.lit(1)).alias("own")), F.col("own") == own["request_id"].cast("string")).select("request_id"))
            return replied.withColumnRenamed("request_id", "batch_id")

        def work(missing: DataFrame) -> DataFrame:
            rows = written(missing.withColumn("group", F.concat_ws("/", F.col("request_id").cast("string"), "page")).select("group", "pos", "text", "key"), "missing")
            got, _ = translate.translate_blocks(rows, glossary, ask, source, target, "group", "pos")
            return rows.join(got.select("group", "pos", "translation"), ["group", "pos"]).select("key", F.col("translation").alias("value"))

        return cache.through(keyed, work).select("request_id", "page", "pos", "text", F.col("value").alias("translation"))

    def _answered(self, rows: DataFrame) -> DataFrame:
        found = written(self.ask(rows.select("request_id", "question")), "answers")
        quotes, excerpts = messages.judged_quotes(F.col("sources"))
        items = found.where("answerable").select("request_id", F.lit(1).alias("n"), F.col("answer").alias("statement"), quotes.alias("quotes"), excerpts.alias("excerpts"))
        judged = self.judge(items, rows.select("request_id", "request", "lang")).select("request_id", "judged", "faithful", "problem")
        self._judged.append(judged.select("request_id", "faithful", "judged"))
        return messages.render_answers(found.join(judged, "request_id", "left").join(rows.select("request_id", "lang"), "request_id"))

    def _reviewed(self, rows: DataFrame, points: DataFrame, line, statement, sources) -> DataFrame:
        quotes, excerpts = messages.judged_quotes(sources)
        kept = points.where("kept").withColumn("n", F.col("point_no") + 1)
        items = kept.select("request_id", "n", statement.alias("statement"), quotes.alias("quotes"), excerpts.alias("excerpts"))
        judged = self.judge(items, rows.select("request_id", "request", "lang")).select("request_id", "n", "judged", "faithful", "problem")
        self._judged.append(judged.select("request_id", "faithful", "judged"))
        return kept.withColumn("line", line).join(judged, ["request_id", "n"])

    def _summarized(self, rows: DataFrame) -> DataFrame:
        points, excerpts = self.summarize(rows.select("request_id", F.get("doc_ids", F.lit(0)).alias("doc_id"), F.col("topic").alias("focus"), "lang"))
        reviewed = self._reviewed(rows, points, messages.point_line(F.col("text"), F.col("sources")), F.col("text"), F.col("sources"))
        counts = excerpts.groupBy("request_id").agg(F.count("*").alias("n"), F.first("title").alias("title"))
        head = F.concat(planning.message(F.col("lang"), "summary", title=F.col("title")), F.lit(" ("), planning.message(F.col("lang"), "from_search", n=F.col("n")), F.lit(") :"))
        return messages.render_points(reviewed, rows.select("request_id", "lang").join(counts, "request_id", "left").select("request_id", "lang", head.alias("head")))

    def _compared(self, rows: DataFrame) -> DataFrame:
        points, _ = self.compare(rows.select("request_id", "doc_ids", F.coalesce(F.nullif("topic", F.lit("")), F.col("question")).alias("topic"), "lang"))
        line = messages.comparison_lines(F.col("aspect"), F.col("sides"), F.col("note"))
        reviewed = self._reviewed(rows, points, line, grounding.claims(F.col("aspect"), F.col("sides")), messages.point_sources(F.col("sides")))
        head = F.concat(planning.message(F.col("lang"), "comparison", topic=F.coalesce(F.nullif("topic", F.lit("")), F.col("question"))), F.lit(" :"))
        return messages.render_points(reviewed, rows.select("request_id", "lang", head.alias("head")))

    # Evaluation ---------------------------------------------------------------------------------------------------------

    def evaluate(self, questions: DataFrame, modes: tuple[str, ...] = MODES, depth: int = 10) -> tuple[DataFrame, DataFrame]:
        """(measures, pairs) of search modes. questions (query_id, text, type, expected array<struct<doc_id, pages>>)."""
        expected = questions.select("query_id", F.explode("expected").alias("e")).select("query_id", F.col("e.doc_id").alias("doc_id"), F.explode("e.pages").alias("page"))
        ranks = None
        for mode in modes:
            hits = self.search(questions.select("query_id", "text"), depth, mode).select("query_id", "rank", "doc_id", "page")
            per = evaluate.first_pages(hits, expected, questions).join(questions.select("query_id", "type"), "query_id").withColumn("system", F.lit(mode))
            ranks = per if ranks is None else ranks.unionByName(per)
        ranks = written(ranks, "ranks")
        return evaluate.summary(ranks, ["system", "type"]).unionByName(evaluate.summary(ranks, ["system"]).withColumn("type", F.lit(None).cast("string"))), evaluate.paired(ranks)

    def evaluate_plans(self, cases: DataFrame, accepted: DataFrame, runs: int = 2) -> DataFrame:
        """planning.routing_summary of cases (request_id, request, category), each planned `runs` times."""
        results = None
        for n in range(runs):
            plans = written(self.plan(cases.select("request_id", "request")), "plans")
            one = planning.plan_matches(plans, accepted).join(planning.signatures(plans), "request_id").join(cases.select("request_id", "category"), "request_id")
            one = one.select(F.col("request_id").alias("id"), "category", F.lit(n).alias("run"), "ok", "signature", F.lit(False).alias("fixed_by_code"))
            results = one if results is None else results.unionByName(one)
        return planning.routing_summary(written(results, "results"))

    def evaluate_judge(self, cases: DataFrame, runs: int = 2) -> DataFrame:
        """planning.judge_summary of planning.judge_items over the passages, each judged `runs` times, alone."""
        items = planning.judge_items(cases, self.passages.withColumn("doc_id", F.col("doc_id").cast("string"))).where("error is null").withColumn("request_id", F.concat_ws("/", "id", "kind"))
        requests = items.select("request_id", F.lit("").alias("request"), F.lit("en").alias("lang"))
        results = None
        for _ in range(runs):
            one = self.judge(items.withColumn("n", F.lit(1)), requests).select(F.col("request_id").alias("item"), "kind", "judged", (~F.col("faithful")).alias("removed"))
            one = written(one, "judged")
            results = one if results is None else results.unionByName(one)
        return planning.judge_summary(results)


def first_points(points: DataFrame, most: int) -> DataFrame:
    """All rejected points, and of those kept the first `most` of each request."""
    n = F.row_number().over(Window.partitionBy("request_id", "kept").orderBy("point_no"))
    return points.withColumn("__n", n).where(~F.col("kept") | (F.col("__n") <= most)).drop("__n")

