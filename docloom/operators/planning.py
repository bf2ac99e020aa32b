"""Plans checked by code, runs recorded and summed up, and the scores of planning and of judging.

Tables:

    steps     request_id, step_no, route, question, doc_ids, topic, path, target_lang, reply (as replies.steps reads
              them), request (what was asked), lang
    catalogue doc_id, title, org, year, lang, file
    accepted  request_id, option, step_no, routes, reports array<array<string>>, topic_any, path_contains, target_lang
    updates   thread, run_no, seq, ts, node: what a running graph reports; a run of a thread begins or resumes at a start
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUTES = ("question", "summarize", "compare", "translate", "clarify", "out_of_scope")
JUDGED = ("question", "summarize", "compare")
MAX_STEPS = 5
PAUSE = "__interrupt__"

MESSAGES = {
    "en": {
        "unknown": "No such report: {ids}.", "which_one": "Which report do you mean?", "which_ones": "Which two or three reports should be compared?", "which_file": "Which PDF should be translated?",
        "out_of_scope": "This service works on the reports it has indexed.", "available": "Reports available", "not_judged": "(These points were not reviewed.)", "answer_removed": "The review rejected the answer: {problem}",
        "sources": "Sources", "summary": "Summary of {title}", "from_author_summary": "from its own summary, pages {first} to {last}", "from_search": "from {n} passages", "comparison": "Comparison: {topic}",
        "nothing_kept": "Nothing passed the review.", "removed": "Removed by the review ({n}): {problems}", "step": "Step {i} of {n} - {label}", "step_ref": "step {i} ({label})", "not_done": "Not done: {steps}.",
        "too_many": "Only {max} steps are run at once; {n} were left out.", "budget": "The limit of {n} model calls is reached.",
    },
    "fr": {
        "unknown": "Rapport inconnu : {ids}.", "which_one": "De quel rapport s'agit-il ?", "which_ones": "Quels deux ou trois rapports faut-il comparer ?", "which_file": "Quel PDF faut-il traduire ?",
        "out_of_scope": "Ce service porte sur les rapports qu'il a indexés.", "available": "Rapports disponibles", "not_judged": "(Ces points n'ont pas été relus.)", "answer_removed": "La relecture a écarté la réponse : {problem}",
        "sources": "Sources", "summary": "Résumé de {title}", "from_author_summary": "d'après son propre résumé, pages {first} à {last}", "from_search": "d'après {n} passages", "comparison": "Comparaison : {topic}",
        "nothing_kept": "Rien n'a passé la relecture.", "removed": "Écartés par la relecture ({n}) : {problems}", "step": "Étape {i} sur {n} - {label}", "step_ref": "étape {i} ({label})", "not_done": "Non fait : {steps}.",
        "too_many": "Au plus {max} étapes à la fois ; {n} laissées de côté.", "budget": "La limite de {n} appels au modèle est atteinte.",
    },
}
LABELS = {"en": dict(zip(ROUTES, ("question", "summary", "comparison", "translation", "question to you", "out of scope"), strict=True)), "fr": dict(zip(ROUTES, ("question", "résumé", "comparaison", "traduction", "question pour vous", "hors sujet"), strict=True))}


def message(lang: Column, key: str, **values: Column) -> Column:
    """A message in the language of lang (French unless it is English), with its {names} filled in."""
    text = F.when(lang == "en", MESSAGES["en"][key]).otherwise(MESSAGES["fr"][key])
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    return text


def label(lang: Column, route: Column) -> Column:
    found = F.lit(None).cast("string")
    for r in ROUTES:
        found = F.when(route == r, F.when(lang == "en", LABELS["en"][r]).otherwise(LABELS["fr"][r])).otherwise(found)
    return found


def is_yes(answer: Column) -> Column:
    return F.coalesce(F.lower(F.trim(answer)).isin("oui", "o", "yes", "y", "true", "1"), F.lit(False))


# Checking plans ---------------------------------------------------------------------------------------------------


def step_cap(replies: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """replies (request_id, request, lang, steps) -> the first max_steps steps as rows, with `dropped`.

    A reply without steps asks what is wanted, in one clarify step.
    """
    none = F.struct(F.lit("clarify").alias("route"), *(F.lit("").alias(f) for f in ("question",)), F.array().cast("array<string>").alias("doc_ids"), *(F.lit("").alias(f) for f in ("topic", "path", "target_lang", "reply")))
    listed = F.when(F.size("steps") > 0, F.col("steps")).otherwise(F.array(none))
    rows = replies.select("request_id", "request", "lang", F.greatest(F.size("steps") - max_steps, F.lit(0)).alias("dropped"), F.posexplode(F.slice(listed, 1, max_steps)).alias("step_no", "s"))
    return rows.select("request_id", "step_no", "s.*", "request", "lang", "dropped")


def check_plans(steps: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Each step made safe: what is missing or unknown becomes a question to the user. Keeps the columns of steps."""
    key = ["request_id", "step_no"]
    ids = F.array_distinct(F.filter(F.transform("doc_ids", lambda i: F.trim(i)), lambda i: i != ""))
    rows = steps.withColumn("doc_ids", ids)
    asked = rows.select(*key, F.posexplode("doc_ids").alias("pos", "doc_id")).join(catalogue.select("doc_id", "file", F.lit(True).alias("known")), "doc_id", "left")
    per = asked.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("known").isNull(), F.struct("pos", "doc_id")))), lambda x: x["doc_id"]).alias("unknown"), F.min_by("file", "pos").alias("file"),
    )
    rows = rows.join(per, key, "left").withColumn("unknown", F.coalesce("unknown", F.array().cast("array<string>")))
    route = F.when(F.col("route").isin(*ROUTES), F.col("route")).otherwise("clarify")
    path = F.regexp_replace(F.trim("path"), "^[\"']+|[\"']+$", "")
    n, by_id = F.size("doc_ids"), (F.col("route") == "translate") & (F.col("path") == "") & (F.size("doc_ids") > 0)
    rows = rows.withColumn("route", route).withColumn("path", path)
    say = lambda key: F.coalesce(F.nullif("reply", F.lit("")), message(F.col("lang"), key))
    unknown = lambda ids: message(F.col("lang"), "unknown", ids=F.array_join(ids, ", "))
    ask = (
        F.when(F.col("route").isin("summarize", "compare") & (F.size("unknown") > 0), unknown(F.col("unknown")))
        .when(by_id & ((F.size("unknown") > 0) | F.col("file").isNull()), unknown(F.when(F.size("unknown") > 0, F.col("unknown")).otherwise(F.col("doc_ids"))))
        .when((F.col("route") == "summarize") & (n != 1), say("which_one")).when((F.col("route") == "compare") & ~n.between(2, 3), say("which_ones"))
        .when((F.col("route") == "translate") & (F.col("path") == "") & ~by_id, say("which_file")).when(F.col("route") == "clarify", say("which_one"))
    )
    rows = rows.withColumn("ask", ask).withColumn("path", F.when(by_id, F.col("file")).otherwise(F.col("path")))
    bad, none = F.col("ask").isNotNull(), F.array().cast("array<string>")
    plain = lambda c, other="": F.when(bad, other).otherwise(c)
    return rows.select(
        *key, plain(F.col("route"), "clarify").alias("route"), plain(F.coalesce(F.nullif(F.trim("question"), F.lit("")), F.col("request"))).alias("question"), F.when(bad, none).otherwise(F.col("doc_ids")).alias("doc_ids"), plain(F.trim("topic")).alias("topic"),
        plain(F.col("path")).alias("path"), plain(F.when(F.col("target_lang").isin("fr", "en"), F.col("target_lang")).otherwise("fr"), "fr").alias("target_lang"), F.when(bad, F.col("ask")).otherwise("").alias("reply"), "request", "lang",
        *(c for c in ("dropped",) if c in steps.columns),
    )


def translation_step(files: DataFrame) -> DataFrame:
    """Where a translation goes next: files (refused, needs_confirmation, confirmed, source, target, done, failed) with
    `step` and `message`. A refusal, an unknown or equal language ends it; long files wait for a yes; then it is rebuilt
    and checked.
    """
    same = F.col("source") == F.col("target")
    step = (
        F.when(F.col("refused").isNotNull(), "refused").when(F.col("source").isNull() | same, "refused").when(F.col("needs_confirmation") & F.col("confirmed").isNull(), "needs_confirmation")
        .when(F.col("needs_confirmation") & ~F.col("confirmed"), "cancelled").when(F.col("failed").isNotNull(), "failed").when(F.col("done"), "verify").otherwise("rebuild")
    )
    why = F.when(F.col("refused").isNotNull(), F.col("refused")).when(F.col("source").isNull(), "the language of the document is not known").when(same, "the document is in that language already").when(F.col("failed").isNotNull(), F.col("failed"))
    return files.withColumn("step", step).withColumn("message", F.when(F.col("step").isin("refused", "failed"), why))


def tool_choices(calls: DataFrame) -> DataFrame:
    """calls (tool, expected) -> one row: how many cases chose the expected tool, and those that did not."""
    right = F.coalesce(F.col("tool") == F.col("expected"), F.lit(False))
    wrong = F.when(~right, F.concat_ws(" for ", F.coalesce("tool", F.lit("none")), "expected"))
    return calls.agg(F.count_if(right).alias("right"), F.count("*").alias("total"), F.array_sort(F.collect_list(wrong)).alias("wrong"))


def signatures(plans: DataFrame) -> DataFrame:
    """(request_id, signature): what each plan does, as "summarize(a) > compare(b,c)"."""
    file = F.element_at(F.split("path", "/"), -1)
    args = F.when(F.size("doc_ids") > 0, F.array_join(F.array_sort("doc_ids"), ",")).otherwise(file)
    part = F.concat("route", F.lit("("), args, F.lit(")"))
    return plans.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_no", part.alias("part")))), lambda x: x["part"]), " > ").alias("signature"))


def step_fits() -> Column:
    """Does a step (route, doc_ids, topic, path, target_lang) fit what is accepted (want.*)? Null conditions hold."""
    groups = F.col("want.reports")
    reports = groups.isNull() | ((F.size(F.array_distinct("doc_ids")) == F.size(groups)) & F.forall(groups, lambda g: F.arrays_overlap(F.col("doc_ids"), g)))
    topic = F.coalesce(F.size("want.topic_any"), F.lit(0)) <= 0
    topic = topic | F.exists("want.topic_any", lambda w: F.contains(F.lower("topic"), F.lower(w)))
    path = F.coalesce(F.col("want.path_contains"), F.lit("")) == ""
    lang = F.coalesce(F.col("want.target_lang"), F.lit("")) == ""
    return F.array_contains("want.routes", F.col("route")) & reports & topic & (path | F.contains(F.lower("path"), F.lower("want.path_contains"))) & (lang | (F.col("target_lang") == F.col("want.target_lang")))


def plan_matches(plans: DataFrame, accepted: DataFrame) -> DataFrame:
    """(request_id, ok): is some accepted option of as many steps met step by step?"""
    n = plans.groupBy("request_id").agg(F.count("*").alias("n"))
    want = accepted.select("request_id", "option", "step_no", F.struct("routes", "reports", "topic_any", "path_contains", "target_lang").alias("want"))
    met = want.join(plans, ["request_id", "step_no"], "left").withColumn("fits", F.coalesce(step_fits(), F.lit(False)))
    per = met.groupBy("request_id", "option").agg(F.bool_and("fits").alias("fits"), F.count("*").alias("wanted"))
    ok = n.join(per, "request_id", "left").groupBy("request_id").agg(F.bool_or(F.coalesce(F.col("fits") & (F.col("wanted") == F.col("n")), F.lit(False))).alias("ok"))
    return ok


# Scores -----------------------------------------------------------------------------------------------------------


def routing_summary(results: DataFrame) -> DataFrame:
    """results (id, category, run, ok, signature, fixed_by_code) -> one row of totals over cases and runs.

    Cases are stable if all their runs have one signature; unstable ones are listed only when there are several runs.
    """
    cases = results.groupBy("id").agg(F.countDistinct("signature").alias("kinds"), F.bool_and("ok").alias("right"), F.bool_or(F.coalesce("fixed_by_code", F.lit(False))).alias("fixed"))
    listed = cases.agg(
        F.count_if(F.col("kinds") == 1).alias("stable"), F.count("*").alias("cases"), F.array_sort(F.collect_list(F.when(F.col("kinds") > 1, F.col("id")))).alias("unstable"),
        F.array_sort(F.collect_list(F.when(~F.col("right"), F.col("id")))).alias("wrong"), F.array_sort(F.collect_list(F.when(F.col("fixed"), F.col("id")))).alias("fixed_by_code"),
    )
    total = results.agg(F.count_if("ok").alias("right"), F.count("*").alias("total"), F.countDistinct("run").alias("runs"))
    by = results.groupBy("category").agg(F.struct(F.count_if("ok").alias("right"), F.count("*").alias("total")).alias("score")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "score")))).alias("by_category"))
    out = total.crossJoin(listed).crossJoin(by)  # one row each
    return out.withColumn("unstable", F.when(F.col("runs") > 1, F.col("unstable")).otherwise(F.array().cast(listed.schema["unstable"].dataType)))


def judge_summary(results: DataFrame) -> DataFrame:
    """results (item, kind, judged, removed) -> one row: removed of all judged by kind, items judged alike, and the rest."""
    seen = results.where("judged")
    of = lambda kind: F.struct(F.count_if((F.col("kind") == kind) & F.col("removed")).alias("removed"), F.count_if(F.col("kind") == kind).alias("total"))
    kinds = seen.agg(of("trap").alias("traps_caught"), of("true").alias("true_removed"), of("borderline").alias("borderline_removed"))
    items = seen.groupBy("item").agg(F.countDistinct("removed").alias("kinds")).agg(F.count_if(F.col("kinds") == 1).alias("constant"), F.count("*").alias("items"), F.array_sort(F.collect_list(F.when(F.col("kinds") > 1, F.col("item")))).alias("changing"))
    return kinds.crossJoin(items).crossJoin(results.agg(F.count_if(~F.col("judged")).alias("not_judged")))  # one row each


def sentences(text: Column) -> Column:
    """Sentences of a passage for evaluation: an end mark, perhaps a footnote's number, then a capital letter."""
    parts = F.split(text, r"(?<=[.!?])\d{0,2}\s+(?=[A-ZÀ-ÖØ-Þ«(])")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def judge_items(cases: DataFrame, passages: DataFrame) -> DataFrame:
    """cases (id, doc_id, page or null, quotes array<array<string>>, true, trap, borderline) -> items for a judge.

    A case's passage is the first of its document (and page) that holds every word of every quote; each group of words
    gives as quote the passage's first sentence with all of them. Rows (id, kind, statement, quotes, excerpts, error);
    a case without its passage or a quote is one row with its error.
    """
    words = F.flatten("quotes")
    found = cases.alias("c").join(passages.select("passage_id", F.col("doc_id").alias("d"), "title", F.col("page").alias("p"), "text"), (F.col("c.doc_id") == F.col("d")) & (F.col("c.page").isNull() | (F.col("c.page") == F.col("p"))))
    number = F.split_part("passage_id", F.lit(":"), F.lit(-1)).cast("long")
    found = found.where(F.forall(words, lambda w: F.contains("text", w))).groupBy("id").agg(F.min_by(F.struct("passage_id", "title", F.col("p").alias("page"), "text"), F.struct("p", number)).alias("at"))
    rows = cases.join(found, "id", "left").withColumn("own", sentences(F.col("at.text")))
    pick = lambda group: F.get(F.filter("own", lambda s: F.forall(group, lambda w: F.contains(s, w))), F.lit(0))
    rows = rows.withColumn("picked", F.transform("quotes", pick))
    error = F.when(F.col("at").isNull(), "no passage has all words").when(F.exists("picked", F.isnull), "no sentence has all words of a quote")
    where = F.format_string("%s, p. %d", "at.title", "at.page")
    rows = rows.withColumn("error", error).withColumn("where", where)
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("statement")) for k in ("true", "trap", "borderline")))
    usable = F.when(F.col("error").isNotNull(), F.slice(kinds, 1, 1)).otherwise(F.filter(kinds, lambda k: F.coalesce(k["statement"], F.lit("")) != ""))
    out = rows.select("id", "error", "where", "picked", "at", F.explode(usable).alias("k"))
    good = F.col("error").isNull()
    return out.select(
        "id", F.when(good, F.col("k.kind")).alias("kind"), F.when(good, F.col("k.statement")).alias("statement"), F.when(good, F.transform("picked", lambda q: F.concat("where", F.lit(": "), q))).alias("quotes"),
        F.when(good, F.array(F.concat("where", F.lit(": "), "at.text"))).alias("excerpts"), "error",
    )


def answer_metrics(answers: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """answers (request_id, answerable, given, cited: arrays of places) and expected (request_id, places) -> counts.

    found: an expected place was given; cited: answered and an expected place cited; refused: not answerable and asked
    without expected places. Columns `by` come from answers.
    """
    rows = answers.join(expected, "request_id", "left").withColumn("places", F.coalesce("places", F.array().cast(answers.schema["given"].dataType)))
    asked = F.size("places") > 0
    found, cited = F.arrays_overlap("given", "places"), F.col("answerable") & F.arrays_overlap("cited", "places")
    return rows.groupBy(*by).agg(
        F.count_if(asked).alias("asked"), F.count_if(asked & found).alias("found"), F.count_if(asked & F.col("answerable")).alias("answered"), F.count_if(asked & cited).alias("cited"), F.count_if(asked & found & cited).alias("cited_when_given"),
        F.count_if(~asked & ~F.col("answerable")).alias("refused"), F.count_if(~asked).alias("unanswerable"),
    )


# Runs -------------------------------------------------------------------------------------------------------------


def node_durations(updates: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Updates with `seconds` since the one before in the same run, or since the run's start; pauses drop out.

    starts (thread, run_no, ts): when each run began, if that is known; else a run begins with its first update. The wait
    between a pause and the resumed run is in no duration.
    """
    run = Window.partitionBy("thread", "run_no").orderBy("ts", "seq")
    rows = updates.withColumn("began", F.col("ts")) if starts is None else updates.join(starts.select("thread", "run_no", F.col("ts").alias("began")), ["thread", "run_no"])
    before = F.coalesce(F.lag("ts").over(run), F.col("began"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = rows.withColumn("seconds", F.round((micros(F.col("ts")) - micros(before)) / 1e6, 3))
    return rows.where(F.col("node") != PAUSE).drop("began")


def run_totals(records: DataFrame, calls: DataFrame, price_in: float | None = None, price_out: float | None = None) -> DataFrame:
    """records (thread, seconds, kept, removed, node) and calls (thread, tokens_in, tokens_out) -> one row per thread.

    Cost needs both prices. kept_ratio is that of judge nodes, null if nothing was judged.
    """
    judge = F.col("node") == "judge"
    kept, removed = F.coalesce(F.sum(F.when(judge, F.col("kept"))), F.lit(0)), F.coalesce(F.sum(F.when(judge, F.col("removed"))), F.lit(0))
    per = records.groupBy("thread").agg(F.round(F.sum("seconds"), 3).alias("duration_s"), F.count("*").alias("nodes"), kept.alias("kept"), removed.alias("removed"))
    spent = calls.groupBy("thread").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    rows = per.join(spent, "thread", "left").fillna(0, ["calls", "tokens_in", "tokens_out"])
    cost = F.round((F.col("tokens_in") * F.lit(price_in) + F.col("tokens_out") * F.lit(price_out)) / 1e6, 6) if price_in is not None and price_out is not None else F.lit(None).cast("double")
    return rows.withColumn("kept_ratio", F.try_divide(F.col("kept"), F.col("kept") + F.col("removed"))).withColumn("cost_usd", cost)


def tool_times(records: DataFrame) -> DataFrame:
    """records (thread, tool, seconds) -> seconds of each run's tools and of all its nodes."""
    return records.groupBy("thread").agg(F.round(F.coalesce(F.sum(F.when(F.col("tool").isNotNull(), F.col("seconds"))), F.lit(0.0)), 3).alias("tools_s"), F.round(F.sum("seconds"), 3).alias("all_s"))


def chain(plans: DataFrame, results: DataFrame, limit: int | None = None) -> DataFrame:
    """Which steps of each request run: plans with `done` and, for those that do not, `why`.

    results (request_id, step_no, failed, calls): what a step would do. Steps run in order until one fails (clarify and
    out_of_scope count as failed); before a step that is judged, a model call has to be left within the limit.
    """
    key = ["request_id", "step_no"]
    rows = plans.join(results, key, "left")
    failed = F.coalesce("failed", F.lit(False)) | F.col("route").isin("clarify", "out_of_scope")
    ahead = Window.partitionBy("request_id").orderBy("step_no").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("request_id").orderBy("step_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("after_failure", F.coalesce(F.bool_or(failed).over(ahead), F.lit(False)))
    spent = F.coalesce(F.sum(F.coalesce("calls", F.lit(0))).over(ahead), F.lit(0))
    short = F.lit(False) if limit is None else F.col("route").isin(*JUDGED) & (spent + 1 > limit) & (F.col("step_no") > F.min("step_no").over(Window.partitionBy("request_id")))
    rows = rows.withColumn("short", short)
    no_money = F.bool_or("short").over(upto)
    why = F.when(F.col("after_failure"), "a step failed").when(no_money, "budget")
    return rows.withColumn("why", why).withColumn("done", F.col("why").isNull()).drop("after_failure", "short", "failed", "calls")
