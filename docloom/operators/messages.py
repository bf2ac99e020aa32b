"""Prompts, rendered results and reports as string columns; rows that make up one text are joined in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.language import classify
from . import planning as P

LANGUAGES = {"fr": "French", "en": "English"}
EXCERPT_CHARS, DEFAULT_FOCUS = 1500, {"fr": "messages principaux", "en": "main messages"}
ANSWER_RULES = 'Answer from the numbered excerpts only; quote the sentence behind each fact and cite it as [n]. Reply with JSON: {"answerable": bool, "answer": str, "evidence": [{"n": int, "quote": str}]}'
SUMMARY_RULES = 'Give at most {max} points in {language}, each with its quotes. Reply with JSON: {"points": [{"text": str, "evidence": [{"n": int, "quote": str}]}]}'
COMPARE_RULES = 'Give at most {max} points in {language}; one side per report. Reply with JSON: {"points": [{"kind": str, "aspect": str, "sides": [{"report": str, "says": str, "evidence": [{"n": int, "quote": str}]}]}]}'
ROUTER_RULES = "Plan at most {max} steps for the request, with these reports:\n{catalogue}"
JUDGE_RULES = 'Say of each item if its passages bear it out; write the problem in {language}. Reply with JSON: {"items": [{"n": int, "faithful": bool, "problem": str}]}'
TRANSLATE_RULES = 'Translate every block from {source} to {target}; keep style tags as they are.\n{glossary}Reply with JSON: {"translations": [{"id": int, "text": str}]}'
NOT_FOUND = {"fr": "La réponse n'est pas dans les rapports indexés.", "en": "The indexed reports do not hold the answer."}


def joined(rows: DataFrame, by: list[str], order: list[str], text: Column, separator: str, name: str) -> DataFrame:
    """One text per group, of its rows' texts in order."""
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("__t")))), lambda r: r["__t"]), separator).alias(name))


def excerpt_blocks(excerpts: DataFrame) -> DataFrame:
    """(request_id, excerpts): numbered excerpts with title, page and section."""
    section = F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit(" — "), "section")).otherwise("")
    block = F.concat(F.format_string("[%d] (%s, p. %d", "n", "title", "page"), section, F.lit(")\n"), F.col("text"))
    return joined(excerpts, ["request_id"], ["n"], block, "\n\n", "excerpts")


def chat_messages(system: Column, user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def answer_messages(questions: DataFrame, excerpts: DataFrame) -> DataFrame:
    """(request_id, messages) of questions (request_id, question), with the language of the answer said where it is known."""
    rows = questions.join(excerpt_blocks(excerpts), "request_id")
    code = classify(F.col("question"))["language"]
    say = lambda name: F.lit(f"\n\nWrite the whole answer in {name}, even where the excerpts are not.")
    spoken = F.when(code == "fr", say("French")).when(code == "en", say("English")).otherwise("")
    return rows.select("request_id", chat_messages(F.lit(ANSWER_RULES), F.concat(F.lit("Question: "), "question", F.lit("\n\nExcerpts:\n\n"), "excerpts", spoken)).alias("messages"))


def _filled(template: str, **values: Column) -> Column:
    text = F.lit(template)
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    return text


def _language(code: Column) -> Column:
    return F.when(code == "en", "English").otherwise("French")


def summary_messages(requests: DataFrame, excerpts: DataFrame, max_points: int = 5) -> DataFrame:
    """requests (request_id, title, focus, where, lang) -> (request_id, messages)."""
    user = F.concat(F.lit("Report: "), "title", F.lit("\nFocus: "), "focus", F.lit("\n\n"), "where", F.lit(":\n\n"), "excerpts")
    return requests.join(excerpt_blocks(excerpts), "request_id").select("request_id", chat_messages(_filled(SUMMARY_RULES, max=F.lit(max_points), language=_language(F.col("lang"))), user).alias("messages"))


def compare_messages(requests: DataFrame, reports: DataFrame, excerpts: DataFrame, max_points: int = 5) -> DataFrame:
    """requests (request_id, topic, lang) -> (request_id, messages), with the excerpt numbers of each report."""
    line = F.format_string("- %s = %s: excerpts %d to %d", "label", "title", "first", "last")
    rows = requests.join(joined(reports, ["request_id"], ["label"], line, "\n", "listing"), "request_id").join(excerpt_blocks(excerpts), "request_id")
    user = F.concat(F.lit("Topic: "), "topic", F.lit("\n\nReports compared:\n"), "listing", F.lit("\n\nExcerpts:\n\n"), "excerpts")
    return rows.select("request_id", chat_messages(_filled(COMPARE_RULES, max=F.lit(max_points), language=_language(F.col("lang"))), user).alias("messages"))


def catalogue_lines(catalogue: DataFrame) -> DataFrame:
    """One row, `catalogue`: a line per report, in order of its id."""
    unknown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    line = F.concat(F.lit("- "), "doc_id", F.lit(": "), "title", F.lit(" ("), "org", F.lit(", "), unknown("year"), F.lit(", "), unknown("lang"), F.lit(")"))
    return joined(catalogue, [], ["doc_id"], line, "\n", "catalogue")


def router_messages(requests: DataFrame, catalogue: DataFrame, max_steps: int = P.MAX_STEPS) -> DataFrame:
    rows = requests.crossJoin(F.broadcast(catalogue_lines(catalogue)))  # one row
    listed = F.when(F.col("catalogue") == "", "(none)").otherwise(F.col("catalogue"))
    return rows.select("request_id", chat_messages(_filled(ROUTER_RULES, max=F.lit(max_steps), catalogue=listed), F.concat(F.lit("Request: "), "request")).alias("messages"))


def judge_messages(requests: DataFrame, items: DataFrame) -> DataFrame:
    """items (request_id, n, statement, quotes, excerpts) -> (request_id, messages); passages are cut."""
    lines = lambda name, texts: F.transform(texts, lambda t: F.concat(F.lit(f"    {name}: "), t))
    cut = F.transform("excerpts", lambda e: F.substring(e, 1, EXCERPT_CHARS))
    block = F.array_join(F.concat(F.array(F.format_string("[%d] Statement: %s", "n", "statement")), lines("Quote", F.col("quotes")), lines("Passage", cut)), "\n")
    rows = requests.join(joined(items, ["request_id"], ["n"], block, "\n\n", "items"), "request_id")
    return rows.select("request_id", chat_messages(_filled(JUDGE_RULES, language=_language(F.col("lang"))), F.concat(F.lit("Request: "), "request", F.lit("\n\n"), "items")).alias("messages"))


def translation_messages(batches: DataFrame, source: Column, target: Column) -> DataFrame:
    """batches (batch_id, texts, terms map) -> (batch_id, messages): blocks as JSON, and only the terms that they need."""
    entries = F.transform(F.array_sort(F.map_entries("terms")), lambda e: F.concat(F.lit("  - "), e["key"], F.lit(" -> "), e["value"]))
    glossary = F.when(F.size("terms") > 0, F.concat(F.lit("Use these translations:\n"), F.array_join(entries, "\n"), F.lit("\n"))).otherwise("")
    blocks = F.to_json(F.struct(F.transform("texts", lambda t, i: F.struct(i.alias("id"), t.alias("text"))).alias("blocks")))
    return batches.select("batch_id", chat_messages(_filled(TRANSLATE_RULES, source=source, target=target, glossary=glossary), blocks).alias("messages"))


def repair_note(texts: Column) -> Column:
    """What is added to a prompt for blocks whose style tags came back broken: the tags that each must have."""
    from ..functions.markup import opening_tags

    tags = lambda t: F.array_join(F.transform(opening_tags(t), lambda o: F.concat(o["tag"], F.lit("…"), F.replace(o["tag"], F.lit("<"), F.lit("</")), F.lit(" x"), o["n"].cast("string"))), ", ")
    lines = F.transform(texts, lambda t, i: F.concat(F.lit("- id "), i.cast("string"), F.lit(": "), tags(t)))
    return F.concat(F.lit("\nThe style tags of these blocks were changed before. Each needs exactly these, around the matching words:\n"), F.array_join(lines, "\n"))


# Results ----------------------------------------------------------------------------------------------------------


def places(sources: Column) -> Column:
    """Title and page of sources, each once."""
    return F.array_join(F.array_distinct(F.transform(sources, lambda s: F.format_string("%s, p. %d", s["title"], s["page"]))), "; ")


def point_sources(sides: Column) -> Column:
    """The sources of all sides of a comparison point."""
    return F.flatten(F.transform(sides, lambda s: s["sources"]))


def point_line(text: Column, sources: Column) -> Column:
    return F.concat(F.lit("- "), X.without_markers(text), F.lit(" ("), places(sources), F.lit(")"))


def comparison_lines(aspect: Column, sides: Column, note: Column) -> Column:
    """A comparison point: its aspect, a line per report, what was read of the others, and the pages."""
    head = F.when(aspect != "", F.concat(F.lit("- **"), aspect, F.lit("**"))).otherwise("-")
    lines = F.transform(sides, lambda s: F.concat(F.lit("    - "), s["title"], F.lit(": "), X.without_markers(s["says"])))
    extra = F.when(note.isNotNull(), F.array(F.concat(F.lit("    - "), note))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(head), lines, extra, F.array(F.concat(F.lit("    - ("), places(point_sources(sides)), F.lit(")")))), "\n")


def judged_quotes(sources: Column) -> tuple[Column, Column]:
    """(quotes, excerpts) of sources, as a judge reads them: each quote and each passage with its place."""
    where = lambda s: F.format_string("%s, p. %d: ", s["title"], s["page"])
    quotes = F.flatten(F.transform(sources, lambda s: F.transform(s["quotes"], lambda q: F.concat(where(s), q))))
    return quotes, F.array_distinct(F.transform(sources, lambda s: F.concat(where(s), s["excerpt"])))


def render_answers(answers: DataFrame) -> DataFrame:
    """answers (request_id, lang, answerable, answer, sources, judged, faithful, problem) -> (request_id, section)."""
    lang = F.col("lang")
    said = F.transform("sources", lambda s: F.concat(F.format_string("[%d] %s, p. %d — « ", s["n"], s["title"], s["page"]), F.get(s["quotes"], F.lit(0)), F.lit(" »")))
    listed = F.when(F.size("sources") > 0, F.concat(F.lit("\n\n"), P.message(lang, "sources"), F.lit(" :\n"), F.array_join(said, "\n"))).otherwise("")
    text = F.when(F.col("answerable"), F.concat("answer", listed)).otherwise(F.when(lang == "en", NOT_FOUND["en"]).otherwise(NOT_FOUND["fr"]))
    footer = F.when(~F.coalesce("judged", F.lit(True)), F.concat(F.lit("\n"), P.message(lang, "not_judged"))).otherwise("")
    removed = F.col("answerable") & ~F.coalesce("faithful", F.lit(True))
    return answers.select("request_id", F.when(removed, P.message(lang, "answer_removed", problem=F.col("problem"))).otherwise(F.concat(text, footer)).alias("section"))


def render_points(points: DataFrame, heads: DataFrame) -> DataFrame:
    """points (request_id, point_no, line, judged, faithful, problem), heads (request_id, lang, head) -> (request_id, section).

    Kept lines below the head; what the review removed and why; a note where there was no review.
    """
    ordered = lambda c, when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("point_no", F.col(c).alias("x"))))), lambda r: r["x"])
    per = points.groupBy("request_id").agg(ordered("line", F.col("faithful")).alias("kept"), ordered("problem", ~F.col("faithful")).alias("gone"), F.bool_and("judged").alias("judged"))
    lang, none = F.col("lang"), F.array().cast("array<string>")
    rows = heads.join(per, "request_id", "left").withColumn("kept", F.coalesce("kept", none)).withColumn("gone", F.coalesce("gone", none))
    body = F.when(F.size("kept") > 0, F.concat(F.array(F.col("head")), "kept")).otherwise(F.array(P.message(lang, "nothing_kept")))
    removed = F.when(F.size("gone") > 0, F.array(P.message(lang, "removed", n=F.size("gone"), problems=F.array_join("gone", " ; ")))).otherwise(none)
    footer = F.when(~F.coalesce("judged", F.lit(True)), F.array(P.message(lang, "not_judged"))).otherwise(none)
    return rows.select("request_id", F.array_join(F.concat(body, removed, footer), "\n").alias("section"))


def respond(plans: DataFrame, sections: DataFrame, notes: DataFrame | None = None, max_steps: int = P.MAX_STEPS) -> DataFrame:
    """(request_id, message): the sections of the steps that were done, with headings if there are several steps, then
    what was not done, notes, and how many steps were too many. sections: (request_id, step_no, section)."""
    n = plans.groupBy("request_id").agg(F.count("*").alias("n"), F.first("lang").alias("lang"), F.max("dropped").alias("dropped"))
    rows = plans.select("request_id", "step_no", "route", "lang").join(sections, ["request_id", "step_no"], "left").join(n.select("request_id", "n"), "request_id")
    name, at = P.label(F.col("lang"), F.col("route")), F.col("step_no") + 1
    part = F.when(F.col("section").isNotNull(), F.when(F.col("n") == 1, F.col("section")).otherwise(F.concat(P.message(F.col("lang"), "step", i=at, n=F.col("n"), label=name), F.lit("\n"), "section")))
    skipped = F.when(F.col("section").isNull(), P.message(F.col("lang"), "step_ref", i=at, label=name))
    lists = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("step_no", c.alias("x"))))), lambda r: r["x"])
    per = rows.groupBy("request_id").agg(lists(part).alias("parts"), lists(skipped).alias("skipped")).join(n, "request_id")
    per = per.join(notes, "request_id", "left") if notes is not None else per.withColumn("note", F.lit(None).cast("string"))
    none = F.array().cast("array<string>")
    optional = lambda when, text: F.when(when, F.array(text)).otherwise(none)
    lang = F.col("lang")
    all_ = F.concat("parts", optional(F.size("skipped") > 0, P.message(lang, "not_done", steps=F.array_join("skipped", ", "))), optional(F.col("note").isNotNull(), F.col("note")), optional(F.col("dropped") > 0, P.message(lang, "too_many", max=F.lit(max_steps), n=F.col("dropped"))))
    return per.select("request_id", F.array_join(all_, "\n\n").alias("message"))


# Reports ----------------------------------------------------------------------------------------------------------


def routing_report(summary: DataFrame, calls: DataFrame) -> DataFrame:
    """One row, `report`: Markdown of a routing summary; calls (seconds, cost) give the upper median and the longest."""
    seconds = calls.agg(F.array_sort(F.collect_list("seconds")).alias("s"), F.round(F.sum("cost"), 4).alias("cost"))
    middle = F.get("s", F.floor(F.size("s") / 2).cast("int"))
    lines = F.transform(F.map_entries("by_category"), lambda e: F.format_string("| %s | %d / %d |", e["key"], e["value"]["right"], e["value"]["total"]))
    text = F.concat(
        F.format_string("Right plans: %d / %d\nSame plan in all runs: %d / %d\nCall, median and longest: %.1f s, %.1f s\n\n| Category | Right |\n|-|-|\n", "right", "total", "stable", "cases", middle, F.array_max("s")),
        F.array_join(lines, "\n"), F.when(F.size("wrong") > 0, F.concat(F.lit("\n\nWrong: "), F.array_join("wrong", ", "))).otherwise(""),
    )
    return summary.crossJoin(seconds).select(text.alias("report"))  # one row each


def judge_report(summary: DataFrame) -> DataFrame:
    kind = lambda name, c: F.format_string(f"| {name} | %d / %d |", F.col(f"{c}.removed"), F.col(f"{c}.total"))
    text = F.concat_ws("\n", F.lit("| Removed | of |\n|-|-|"), kind("traps", "traps_caught"), kind("true", "true_removed"), kind("borderline", "borderline_removed"), F.format_string("Same verdict in all runs: %d / %d; not judged: %d", "constant", "items", "not_judged"))
    return summary.select(text.alias("report"))


def usage_line(calls: Column, tokens_in: Column, tokens_out: Column, cost: Column) -> Column:
    return F.concat(F.format_string("%d calls, %d tokens in, %d out", calls, tokens_in, tokens_out), F.when(cost.isNotNull(), F.format_string(", $%.4f", cost)).otherwise(""))
