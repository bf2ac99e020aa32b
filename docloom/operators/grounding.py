"""Replies held against the excerpts they cite: quotes, figures, whole points, and comparisons of reports.

Tables (request_id names a request, its excerpts are numbered from 1):

    excerpts  request_id, n, passage_id, doc_id, title, page, section, text
    points    request_id, point_no, text, evidence array<struct<n, quote>>, request (what was asked)
    reports   request_id, label, doc_id, title, first, last (the excerpt numbers of a compared report)

Every check is a join on the request and the excerpt's number, so all requests are checked at once; only the match of a
quote within one passage is a sequential kernel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.kernels import quote_in_passage, unsupported_numbers

POINT = ["request_id", "point_no"]
NO_QUOTE, NO_FIGURE = "no quote found in its excerpt", "figures not in the cited excerpts: "

# Phrases that say what a report does not contain, in French and English.
_SAYS_FR = r"mention\w*|pr[ée]cis\w*|fourni\w*|donn\w*|[ée]voqu\w*|abord\w*|indiqu\w*|chiffr\w*|trait\w*|parl\w*|d[ée]taill\w*|quantifi\w*|cit\w*"
ABSENCE = "|".join([
    rf"\bn(?:e\b|['’])\s*(?:\w+\s+){{0,2}}?(?:{_SAYS_FR})\s+(?:\w+\s+)?(?:pas|aucun\w*|jamais|rien)\b",
    rf"\bsans\s+(?:les?\s+|la\s+|l['’]\s*)?(?:{_SAYS_FR})",
    r"\baucune?\s+(?:chiffre|donn[ée]e|mention|pr[ée]cision|valeur|pourcentage|estimation)",
    r"\bpas\s+de\s+(?:chiffres?|donn[ée]es|mention|pr[ée]cision|pourcentages?)",
    rf"\bn(?:e\b|['’])\s*(?:est|sont)\s+pas\s+(?:\w+\s+)?(?:{_SAYS_FR})",
    r"\b(?:reste|est|demeure)\s+(?:muet|silencieux)|\bpasse\s+sous\s+silence",
    r"\b(?:does|do|did)\s*(?:n['’]t|\s+not)\s+(?:\w+\s+)?(?:mention|specify|provide|give|discuss|address|quantify|state|detail|cover|include)",
    r"\bwithout\s+(?:mentioning|specifying|giving|providing|quantifying|stating)",
    r"\bno\s+(?:specific\s+|precise\s+|explicit\s+)?(?:figures?|mention|data|numbers?|values?|percentages?|estimates?|details?)\b",
    r"\b(?:is|are|was|were)\s*(?:n['’]t|\s+not)\s+(?:\w+\s+)?(?:mentioned|specified|provided|given|discussed|addressed|quantified|stated|detailed|covered)\b",
    r"\bis\s+silent\b|\bsilent\s+on\b",
])

# What was read of a report that a point does not name, for one passage and for several.
ABSENCE_NOTE = {
    "fr": ("Rien sur ce point dans le passage consulté de {title}.", "Rien sur ce point dans les {n} passages consultés de {title}."),
    "en": ("Nothing on this in the passage of {title} that was read.", "Nothing on this in the {n} passages of {title} that were read."),
}


def absence_claim(text: Column) -> Column:
    """The first phrase that says what a report does not contain; null without one."""
    return F.regexp_substr(text, F.lit(f"(?iU){ABSENCE}"))


def absence_note(lang: Column, title: Column, n: Column) -> Column:
    note = None
    for code, (one, many) in ABSENCE_NOTE.items():
        said = F.replace(F.replace(F.when(n == 1, one).otherwise(many), F.lit("{title}"), title), F.lit("{n}"), n.cast("string"))
        note = F.when(lang == code, said) if note is None else note.when(lang == code, said)
    return note


def verified_evidence(points: DataFrame, excerpts: DataFrame) -> DataFrame:
    """One row per evidence item: POINT, pos, n, quote, and found: does that excerpt hold the quote?

    An item whose number no excerpt of the request has is not found.
    """
    asked = points.select(*POINT, F.posexplode("evidence").alias("pos", "e")).select(*POINT, "pos", "e.n", "e.quote")
    read = excerpts.select("request_id", "n", F.col("text").alias("passage"))
    return asked.join(read, ["request_id", "n"], "left").select(*POINT, "pos", "n", "quote", F.coalesce(quote_in_passage(F.col("quote"), F.col("passage")), F.lit(False)).alias("found"))


def _per_point(items: DataFrame) -> DataFrame:
    """Quotes of each point: verified ones by excerpt, and those that failed, in order."""
    said = F.format_string("[%d] %s", "n", "quote")
    lists = items.groupBy(*POINT).agg(
        F.array_sort(F.collect_list(F.when(F.col("found"), F.struct("n", "pos", F.trim("quote").alias("quote"))))).alias("good"),
        F.array_sort(F.collect_list(F.when(~F.col("found"), F.struct("pos", said.alias("said"))))).alias("bad"),
        F.array_sort(F.collect_list(F.struct("pos", said.alias("said")))).alias("all"),
    )
    numbers = F.array_distinct(F.transform("good", lambda g: g["n"]))
    quotes = F.map_from_entries(F.transform(numbers, lambda n: F.struct(n, F.transform(F.filter("good", lambda g: g["n"] == n), lambda g: g["quote"]))))
    return lists.select(*POINT, numbers.alias("cited"), quotes.alias("verified"), F.transform("bad", lambda b: b["said"]).alias("bad_quotes"), F.transform("all", lambda b: b["said"]).alias("quotes"))


def where_found(figures: DataFrame, excerpts: DataFrame) -> DataFrame:
    """(POINT, found_elsewhere): for each figure of a point, the numbers of the request's excerpts that hold it.

    figures: POINT, figures array<string>. Only points with a figure that their excerpts lack get here.
    """
    pairs = figures.select(*POINT, F.explode("figures").alias("figure")).join(excerpts.select("request_id", "n", "text"), "request_id")
    held = pairs.withColumn("held", F.size(unsupported_numbers(F.col("figure"), F.col("text"))) == 0)
    per = held.groupBy(*POINT, "figure").agg(F.array_sort(F.collect_list(F.when(F.col("held"), F.col("n")))).alias("ns"))
    return per.groupBy(*POINT).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("figure", "ns")))).alias("found_elsewhere"))


def check_points(points: DataFrame, excerpts: DataFrame) -> DataFrame:
    """Each point with kept, reason, its text as kept, sources, and what a rejection needs to be understood.

    Kept: POINT, kept, reason, text (only [n] of verified excerpts), raw_text, sources, quotes, bad_quotes,
    found_elsewhere. A point is rejected without a verified quote, or with a figure that neither the excerpts it
    relies on nor the request holds.
    """
    per = points.select(*POINT, "text", "request").join(_per_point(verified_evidence(points, excerpts)), POINT, "left")
    empty = F.array().cast("array<string>")
    per = per.withColumn("cited", F.coalesce("cited", F.array().cast("array<int>"))).withColumn("quotes", F.coalesce("quotes", empty)).withColumn("bad_quotes", F.coalesce("bad_quotes", empty))
    source = F.struct("n", "passage_id", "doc_id", "title", "page", "section", F.col("passage").alias("excerpt"), F.col("verified")[F.col("n")].alias("quotes"))
    read = excerpts.select("request_id", "n", "passage_id", "doc_id", "title", "page", "section", F.col("text").alias("passage"))
    cited = per.select(*POINT, "verified", F.explode("cited").alias("n")).join(read, ["request_id", "n"])
    sources = cited.groupBy(*POINT).agg(F.array_sort(F.collect_list(source)).alias("sources"))
    per = per.join(sources, POINT, "left")
    support = F.concat_ws(" ", F.concat_ws(" ", F.transform("sources", lambda s: s["excerpt"])), F.col("request"))
    per = per.withColumn("figures", F.when(F.size("cited") > 0, unsupported_numbers(F.col("text"), support)).otherwise(empty))
    per = per.join(where_found(per.where(F.size("figures") > 0), excerpts), POINT, "left")
    reason = F.when(F.size("cited") == 0, NO_QUOTE).when(F.size("figures") > 0, F.concat(F.lit(NO_FIGURE), F.array_join("figures", ", ")))
    kept = reason.isNull()
    return per.select(
        *POINT, kept.alias("kept"), reason.alias("reason"), F.when(kept, X.keep_markers(F.col("text"), F.col("cited"))).otherwise(F.col("text")).alias("text"), F.col("text").alias("raw_text"),
        F.when(kept, F.col("sources")).alias("sources"), "quotes", "bad_quotes", "found_elsewhere",
    )


def answers(replies: DataFrame, excerpts: DataFrame) -> DataFrame:
    """Replies to questions with their evidence and figures checked: request_id, answerable, answer, sources and the
    diagnostics retrieved, model_answerable, rejected_quotes, unsupported_numbers, reason of a refusal.

    replies: request_id, question, answerable, answer, evidence (as replies.answer reads them).
    """
    points = replies.select("request_id", F.lit(0).alias("point_no"), F.col("answer").alias("text"), "evidence", F.col("question").alias("request"), "answerable")
    checked = check_points(points, excerpts).drop("point_no")
    retrieved = excerpts.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "passage_id"))), lambda x: x["passage_id"]).alias("retrieved"))
    rows = replies.select("request_id", F.col("answerable").alias("model_answerable")).join(checked, "request_id").join(retrieved, "request_id", "left")
    none = F.array().cast("array<string>")
    figures = F.when(F.startswith("reason", F.lit(NO_FIGURE)), F.split(F.substring("reason", len(NO_FIGURE) + 1, 1 << 20), ", ")).otherwise(none)
    good = F.col("model_answerable") & F.col("kept")
    rows = rows.select(
        "request_id", good.alias("answerable"), F.when(good, F.col("text")).alias("answer"), F.when(good, F.col("sources")).alias("sources"), F.coalesce("retrieved", none).alias("retrieved"),
        "model_answerable", F.col("bad_quotes").alias("rejected_quotes"), figures.alias("unsupported_numbers"),
    )
    return rows.withColumn("refusal", refusal_reason())


def refusal_reason() -> Column:
    """Why an answer of `answers` refuses, first cause first; null if it does not."""
    cut = F.transform("rejected_quotes", lambda q: F.substring(q, 1, 80))
    return (
        F.when(F.col("answerable"), None).when(F.size("retrieved") == 0, "no passage found").when(~F.col("model_answerable"), "the model said the passages do not answer")
        .when(F.size("unsupported_numbers") > 0, F.concat(F.lit("figures not in the quotes: "), F.array_join("unsupported_numbers", ", ")))
        .when(F.size("rejected_quotes") > 0, F.concat(F.lit("quotes not found in their passage: "), F.array_join(cut, " | "))).otherwise("no verified quote")
    )


def rejected_text(kind: Column, aspect: Column, sides: Column) -> Column:
    return F.format_string("[%s] %s — %s", kind, aspect, F.array_join(F.transform(sides, lambda s: F.concat(s["report"], F.lit(": "), s["says"])), " | "))


def check_comparison(points: DataFrame, reports: DataFrame, excerpts: DataFrame) -> DataFrame:
    """Comparison points with kept, reason, sides as kept, and a note for a point of one report only.

    points: POINT, kind, aspect, sides array<struct<report, says, evidence>>, request, lang. First the labels are
    checked (known, one side each, as many sides as the kind needs), then each side in order: no claim of absence, only
    excerpts of its own report, and all checks of a point. The first failure rejects the whole point. Report names of
    what is kept come from the reports table.
    """
    known = reports.groupBy("request_id").agg(F.collect_set("label").alias("labels"))
    rows = points.join(known, "request_id", "left").withColumn("own", F.transform("sides", lambda s: F.upper(F.trim(s["report"]))))
    n = F.size("own")
    form = (
        F.when(F.size(F.array_except("own", F.coalesce("labels", F.array().cast("array<string>")))) > 0, F.concat(F.lit("unknown report label in ['"), F.array_join("own", "', '"), F.lit("']")))
        .when(F.size(F.array_distinct("own")) < n, "two sides for the same report")
        .when(F.col("kind").isin("agreement", "difference") & (n < 2), F.format_string("%s: needs one side per report (has %d)", "kind", n))
        .when((F.col("kind") == "only_in") & (n != 1), "only_in: one side only (several reports: agreement or difference?)")
    )
    rows = rows.withColumn("form", form)
    side = rows.where("form is null").select(*POINT, "aspect", "request", F.posexplode("sides").alias("side_no", "s"))
    side = side.select(*POINT, "side_no", "aspect", "request", F.upper(F.trim("s.report")).alias("label"), F.col("s.says").alias("says"), F.col("s.evidence").alias("evidence"))
    side = side.join(reports.select("request_id", "label", "doc_id", "title", "first", "last"), ["request_id", "label"])
    claim = absence_claim(F.col("says"))
    outside = F.filter("evidence", lambda e: ~e["n"].between(F.col("first"), F.col("last")))
    listed = F.concat(F.lit("["), F.array_join(F.transform(outside, lambda e: e["n"].cast("string")), ", "), F.lit("]"))
    early = F.when(claim.isNotNull(), F.concat(F.lit("side "), F.col("label"), F.lit(': absence claim ("'), claim, F.lit('")'))).when(
        F.size(outside) > 0, F.concat(F.lit("side "), F.col("label"), F.lit(" ("), F.col("title"), F.lit(") quotes excerpts "), listed, F.lit(" of another report: wrong attribution"))
    )
    side = side.withColumn("early", early)
    # a side is a point of its own, told apart by its number
    single = side.where("early is null").select("request_id", F.struct("point_no", "side_no").alias("point_no"), F.col("says").alias("text"), "evidence", F.concat_ws(" ", "request", "aspect").alias("request"))
    checked = check_points(single, excerpts).select("request_id", "point_no.point_no", "point_no.side_no", "kept", "reason", "text", "sources")
    sides = side.select(*POINT, "side_no", "label", "doc_id", "title", "early").join(checked, [*POINT, "side_no"], "left")
    per = sides.groupBy(*POINT).agg(
        F.min_by(F.struct(F.coalesce("early", "reason").alias("reason"), "label", F.col("early").isNull().alias("late")), F.when(F.coalesce("early", "reason").isNotNull(), F.col("side_no"))).alias("bad"),
        F.array_sort(F.collect_list(F.struct("side_no", "doc_id", "title", F.col("text").alias("says"), "sources"))).alias("kept_sides"), F.collect_set("label").alias("used"),
    )
    others = rows.where("form is null and kind = 'only_in'").select(*POINT, "lang", "own").join(reports, "request_id").where(~F.array_contains("own", F.col("label")))
    said = F.struct("label", absence_note(F.col("lang"), F.col("title"), F.col("last") - F.col("first") + 1).alias("note"))
    notes = others.groupBy(*POINT).agg(F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["note"]), " ").alias("note"))
    out = rows.select(*POINT, "kind", F.trim("aspect").alias("aspect"), "form", rejected_text(F.col("kind"), F.col("aspect"), F.col("sides")).alias("rejected")).join(per, POINT, "left").join(notes, POINT, "left")
    reason = F.coalesce("form", "bad.reason")
    kept = reason.isNull()
    text = F.when(F.col("bad.late"), F.concat("rejected", F.lit(" (side "), F.col("bad.label"), F.lit(")"))).otherwise(F.col("rejected"))
    return out.select(
        *POINT, "kind", "aspect", kept.alias("kept"), reason.alias("reason"), F.when(kept, F.transform("kept_sides", lambda s: F.struct(s["doc_id"].alias("doc_id"), s["title"].alias("title"), s["says"].alias("says"), s["sources"].alias("sources")))).alias("sides"),
        F.when(kept, F.col("note")).alias("note"), F.when(~kept, text).alias("rejected_text"),
    )


def claims(aspect: Column, sides: Column) -> Column:
    """What the reports say, as a judge reads it: the aspect, then each title with what its report says."""
    return F.concat(F.when(aspect != "", F.concat(aspect, F.lit(". "))).otherwise(""), F.array_join(F.transform(sides, lambda s: F.concat(s["title"], F.lit(": "), s["says"])), " "))


def judge_join(items: DataFrame, verdicts: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """items (request_id, n, ...) with judged, faithful and problem.

    Verdicts (request_id, n, faithful, problem) of unknown numbers drop out; of several on one item the last by pos
    holds, if they have one; an item without a verdict is faithful. judged (request_id, judged): requests of whose
    judge there is no reply keep all, as not judged.
    """
    both = F.struct("faithful", "problem")
    last = verdicts.groupBy("request_id", "n").agg((F.max_by(both, "pos") if "pos" in verdicts.columns else F.any_value(both)).alias("v"))
    rows = items.join(last, ["request_id", "n"], "left")
    if judged is not None:
        rows = rows.join(judged.select("request_id", F.col("judged").alias("__judged")), "request_id", "left")
    seen = F.coalesce("__judged", F.lit(True)) if judged is not None else F.lit(True)
    out = rows.withColumn("judged", seen).withColumn("faithful", ~seen | F.coalesce("v.faithful", F.lit(True))).withColumn("problem", F.when(~F.col("faithful"), F.col("v.problem")))
    return out.drop("v", "__judged")
