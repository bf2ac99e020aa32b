"""Replies about benchmark passages, written so that what has to be kept and rejected is known.

Excerpt 1 of a request is its passage, excerpt 2 the next passage. Replies come in seven kinds by the item's number:
0 and 3 are good, 1 quotes the other passage, 2 has a figure of its own, 4 cites an excerpt that is not there, 5 is no
JSON, 6 leaves out two words of the quote.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import text as X
from ..functions.kernels import unsupported_numbers
from ..operators import grounding as G
from ..operators import messages, translate
from ..operators import replies as R
from .registry import Tables, query

FIGURE = "74318"
_BASE = """b AS (SELECT item_id, item_id % 7 AS kind, text, string_split(text, ' ') AS w, lead(text) OVER (ORDER BY item_id) AS after, first_value(text) OVER (ORDER BY item_id) AS head FROM benchmark),
q AS (SELECT item_id, kind, text, coalesce(after, head) AS other, array_to_string(w[5:20], ' ') AS quote, array_to_string(list_concat(w[5:9], w[12:20]), ' ') AS gapped, array_to_string(string_split(coalesce(after, head), ' ')[5:20], ' ') AS foreign_quote FROM b),
r AS (SELECT *, CASE kind WHEN 1 THEN foreign_quote WHEN 6 THEN gapped ELSE quote END AS said, CASE kind WHEN 4 THEN 9 ELSE 1 END AS n, kind NOT IN (1, 4, 5) AS held FROM q)"""


def excerpts(t: Tables):
    """Two excerpts of each item: its passage and the next one, the first after the last."""
    order = Window.orderBy("item_id")  # of the few hundred items
    rows = t.benchmark.select("item_id", "text", F.coalesce(F.lead("text").over(order), F.first("text").over(order)).alias("other"))
    both = rows.select("item_id", F.posexplode(F.array("text", "other")).alias("pos", "text"))
    n = F.col("pos") + 1
    return both.select(F.col("item_id").alias("request_id"), n.alias("n"), F.format_string("i%d:p%d:0", "item_id", n).alias("passage_id"), F.format_string("i%d", "item_id").alias("doc_id"), F.format_string("Item %d", "item_id").alias("title"), n.alias("page"), F.lit(None).cast("string").alias("section"), "text")


def written_replies(t: Tables):
    """(request_id, kind, question, reply)."""
    both = excerpts(t).groupBy("request_id").agg(F.max(F.when(F.col("n") == 1, F.col("text"))).alias("text"), F.max(F.when(F.col("n") == 2, F.col("text"))).alias("other"))
    rows = both.withColumn("kind", (F.col("request_id") % 7).cast("int"))
    words = lambda c, first, count: F.slice(F.split(c, " "), first, count)
    said = F.when(F.col("kind") == 1, F.array_join(words(F.col("other"), 5, 16), " ")).when(F.col("kind") == 6, F.array_join(F.concat(words(F.col("text"), 5, 5), words(F.col("text"), 12, 9)), " ")).otherwise(F.array_join(words(F.col("text"), 5, 16), " "))
    answer = F.when(F.col("kind") == 2, f"It is so [1], in {FIGURE} cases.").otherwise("It is so [1] **indeed** [2] .")
    item = F.struct(F.when(F.col("kind") == 4, 9).otherwise(1).alias("n"), said.alias("quote"))
    good = F.to_json(F.struct(F.lit(True).alias("answerable"), answer.alias("answer"), F.array(item).alias("evidence")))
    return rows.select("request_id", "kind", F.lit("Is it so?").alias("question"), F.when(F.col("kind") == 5, "{so it is").otherwise(good).alias("reply"))


def parsed(t: Tables):
    return written_replies(t).select("request_id", "kind", "question", R.answer(F.col("reply")).alias("a")).select("request_id", "kind", "question", "a.*")


def points(t: Tables):
    return parsed(t).select("request_id", F.lit(0).alias("point_no"), F.col("answer").alias("text"), "evidence", F.col("question").alias("request"))


@query(f"WITH {_BASE} SELECT item_id, kind <> 5 AS valid, kind <> 5 AS answerable, CASE kind WHEN 5 THEN '' WHEN 2 THEN 'It is so [1], in {FIGURE} cases.' ELSE 'It is so [1] **indeed** [2] .' END AS answer, CAST(CASE kind WHEN 5 THEN 0 ELSE 1 END AS INT) AS items FROM r")
def reply_parse(t: Tables):
    return parsed(t).select(F.col("request_id").alias("item_id"), "valid", "answerable", "answer", F.size("evidence").alias("items"))


@query(f"WITH {_BASE} SELECT item_id, CAST(n AS INT) AS n, said AS quote, held AS found FROM r WHERE kind <> 5")
def evidence_join(t: Tables):
    return G.verified_evidence(points(t), excerpts(t)).select(F.col("request_id").alias("item_id"), "n", "quote", "found")


@query(f"WITH {_BASE} SELECT item_id, CASE WHEN kind = 2 AND NOT regexp_matches(text, '(^|[^0-9.]){FIGURE}([^0-9.]|[.]([^0-9]|$)|$)') THEN '{FIGURE}' ELSE '' END AS figures FROM r WHERE kind <> 5")
def unsupported_figures(t: Tables):
    rows = parsed(t).where("valid").join(excerpts(t).where("n = 1").select("request_id", "text"), "request_id")
    return rows.select(F.col("request_id").alias("item_id"), F.array_join(unsupported_numbers(F.col("answer"), F.col("text")), ",").alias("figures"))


@query(f"""WITH {_BASE} SELECT item_id, held AND kind <> 2 AS kept, CASE WHEN NOT held THEN 'no quote found in its excerpt' WHEN kind = 2 THEN 'figures not in the cited excerpts: {FIGURE}' END AS reason,
CASE WHEN held AND kind <> 2 THEN 'It is so [1] indeed.' WHEN kind = 5 THEN '' WHEN kind = 2 THEN 'It is so [1], in {FIGURE} cases.' ELSE 'It is so [1] **indeed** [2] .' END AS text FROM r""")
def point_reasons(t: Tables):
    return G.check_points(points(t), excerpts(t)).select(F.col("request_id").alias("item_id"), "kept", "reason", "text")


@query(f"""WITH {_BASE} SELECT item_id, held AND kind <> 2 AS answerable, CASE WHEN held AND kind <> 2 THEN NULL WHEN kind = 5 THEN 'the model said the passages do not answer' WHEN kind = 2 THEN 'figures not in the quotes: {FIGURE}'
ELSE 'quotes not found in their passage: ' || left('[' || n || '] ' || said, 80) END AS refusal, CASE WHEN held AND kind <> 2 THEN 'i' || item_id || ':p1:0' END AS source FROM r""")
def grounded_answers(t: Tables):
    rows = G.answers(parsed(t), excerpts(t))
    return rows.select(F.col("request_id").alias("item_id"), "answerable", "refusal", F.get("sources", F.lit(0))["passage_id"].alias("source"))


#: Sides of comparison points by the item's number: who says what, from which excerpt.
_REASON = """CASE item_id % 8 WHEN 1 THEN 'agreement: needs one side per report (has 1)' WHEN 2 THEN 'two sides for the same report' WHEN 3 THEN 'unknown report label in [''A'', ''C'']'
WHEN 4 THEN 'side B: absence claim ("does not mention")' WHEN 5 THEN 'side A (First) quotes excerpts [2] of another report: wrong attribution' WHEN 6 THEN 'no quote found in its excerpt' END"""


@query(f"""WITH {_BASE} SELECT item_id, item_id % 8 IN (0, 7) AS kept, {_REASON} AS reason, CASE WHEN item_id % 8 = 7 THEN 'Nothing on this in the passage of Second that was read.' END AS note FROM r""")
def comparison_check(t: Tables):
    """Points of each kind of fault, two excerpts as two reports."""
    texts = excerpts(t).groupBy("request_id").agg(F.max(F.when(F.col("n") == 1, F.col("text"))).alias("one"), F.max(F.when(F.col("n") == 2, F.col("text"))).alias("two"))
    quote = lambda c: F.array_join(F.slice(F.split(c, " "), 5, 16), " ")

    def side(label: str, n: int, text, says: str = "It is so."):
        return F.struct(F.lit(label).alias("report"), F.lit(says).alias("says"), F.array(F.struct(F.lit(n).alias("n"), text.alias("quote"))).alias("evidence"))

    one, two, k = quote(F.col("one")), quote(F.col("two")), F.col("request_id") % 8
    a, b = side(" a", 1, one), side("B", 2, two)
    sides = (
        F.when(k == 1, F.array(a)).when(k == 2, F.array(a, a)).when(k == 3, F.array(a, side("C", 2, two))).when(k == 4, F.array(a, side("B", 2, two, "It does not mention it."))).when(k == 5, F.array(side("A", 2, two), b))
        .when(k == 6, F.array(a, side("B", 2, one))).when(k == 7, F.array(a)).otherwise(F.array(a, b))
    )
    rows = texts.select("request_id", F.lit(0).alias("point_no"), F.when(k == 7, "only_in").otherwise("agreement").alias("kind"), F.lit("Aspect").alias("aspect"), sides.alias("sides"), F.lit("").alias("request"), F.lit("en").alias("lang"))
    report = lambda label, title, n: F.struct(F.lit(label).alias("label"), F.lit(f"d{n}").alias("doc_id"), F.lit(title).alias("title"), F.lit(n).alias("first"), F.lit(n).alias("last"))
    reports = texts.select("request_id", F.explode(F.array(report("A", "First", 1), report("B", "Second", 2))).alias("r")).select("request_id", "r.*")
    return G.check_comparison(rows, reports, excerpts(t)).select(F.col("request_id").alias("item_id"), "kept", "reason", "note")


@query("SELECT item_id, trim(regexp_replace(regexp_replace(text || ' [1] and [2] [7] **bold** , end', '\\[[27]\\]|\\*\\*', '', 'g'), '\\s+([.,;])', '\\1', 'g')) AS clean, trim(regexp_replace(regexp_replace(text || ' [1] and [2] , end', '\\s*\\[\\d{1,2}\\]', '', 'g'), '\\s+([.,;:])', '\\1', 'g')) AS shown FROM benchmark")
def marker_cleanup(t: Tables):
    clean = X.keep_markers(F.concat("text", F.lit(" [1] and [2] [7] **bold** , end")), F.array(F.lit(1)))
    return t.benchmark.select("item_id", clean.alias("clean"), X.without_markers(F.concat("text", F.lit(" [1] and [2] , end"))).alias("shown"))


#: Sentences, and the phrase in them that says what a report does not contain.
CLAIMS = (
    ("The report does not mention it.", "does not mention"), ("Le rapport ne donne aucun détail.", "ne donne aucun"), ("No explicit figures are there.", "No explicit figures"), ("The costs weren't quantified.", "weren't quantified"),
    ("Ce plan n'est pas précisé.", "n'est pas précisé"), ("It is not compatible with growth.", None), ("The text is silent on it.", "is silent"), ("Sans les chiffrer, il avance.", "Sans les chiffrer"),
)
_CLAIMS = ", ".join(f"({k}, {'NULL' if c is None else chr(39) + c.replace(chr(39), chr(39) * 2) + chr(39)})" for k, (_, c) in enumerate(CLAIMS))


@query(f"WITH c AS (SELECT * FROM (VALUES {_CLAIMS}) AS v(k, claim)) SELECT conv_id, turn, claim FROM conversations JOIN c ON k = (conv_id + turn) % {len(CLAIMS)}")
def absence_claims(t: Tables):
    tail = F.get(F.array(*(F.lit(s) for s, _ in CLAIMS)), ((F.col("conv_id") + F.col("turn")) % len(CLAIMS)).cast("int"))
    return t.conversations.select("conv_id", "turn", G.absence_claim(F.concat_ws(" ", "text", tail)).alias("claim"))


_GLOSSARY = "g AS (SELECT DISTINCT term FROM (SELECT unnest(string_split(regexp_replace(text, '[^A-Za-z ]', ' ', 'g'), ' ')) AS term FROM benchmark) WHERE length(term) >= 7)"


@query(f"""WITH {_GLOSSARY}, w AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS word FROM conversations)
SELECT DISTINCT conv_id, turn, term FROM w JOIN g ON lower(word) = lower(term) WHERE term <> upper(term) OR word = term""")
def glossary_relevant(t: Tables):
    """Terms, the long words of all items, that occur in turns of conversations."""
    words = F.explode(F.split(F.regexp_replace("text", "[^A-Za-z ]", " "), " "))
    glossary = t.benchmark.select(words.alias("source")).where(F.length("source") >= 7).distinct().withColumn("target", F.upper("source"))
    texts = t.conversations.select(F.struct("conv_id", "turn").alias("id"), "text")
    return translate.relevant_terms(texts, glossary).select("id.conv_id", "id.turn", F.col("source").alias("term"))


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT conv_id, turn, i, 0 AS batch, n AS held, 1 AS items FROM t WHERE i = 1
UNION ALL SELECT t.conv_id, t.turn, t.i, CASE WHEN items >= 3 OR held + n > 400 THEN batch + 1 ELSE batch END, CASE WHEN items >= 3 OR held + n > 400 THEN n ELSE held + n END, CASE WHEN items >= 3 OR held + n > 400 THEN 1 ELSE items + 1 END
FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1) SELECT conv_id, turn, batch FROM f""")
def text_batches(t: Tables):
    return translate.batches(t.conversations.select("conv_id", "turn", "text"), "conv_id", "turn", 400, 3).select("conv_id", "turn", "batch")


@query("SELECT page_id, array_to_string(list_sort(regexp_extract_all(replace(replace(html, '<b>', '<s1>'), '</b>', '</s1>'), '</?s\\d+>')), ',') AS tags FROM pages")
def tag_multiset(t: Tables):
    marked = F.replace(F.replace("html", F.lit("<b>"), F.lit("<s1>")), F.lit("</b>"), F.lit("</s1>"))
    return t.pages.select("page_id", F.array_join(M.tag_multiset(marked), ",").alias("tags"))


_RUN = "SELECT item_id, '<s1>' || regexp_extract(text, '^(\\S+)', 1) || '</s1>' || substr(text, length(regexp_extract(text, '^(\\S+)', 1)) + 1) AS marked, regexp_extract(text, '^(\\S+)', 1) AS lead FROM benchmark WHERE regexp_matches(text, '^[A-Za-z]+ ')"


@query(f"WITH m AS ({_RUN}) SELECT item_id, marked AS restored, marked AS pruned FROM m")
def tag_repair(t: Tables):
    """The tags of a styled first word, put back after they were lost, and kept where others were added."""
    rows = t.benchmark.where(F.col("text").rlike("^[A-Za-z]+ ")).select("item_id", "text", F.regexp_replace("text", r"^(\S+)", "<s1>$1</s1>").alias("marked"))
    none = F.create_map().cast("map<string,string>")
    return rows.select("item_id", M.repair_tags(F.col("marked"), F.col("text"), none).alias("restored"), M.repair_tags(F.col("marked"), F.regexp_replace("marked", r" (\S+)$", " <s2>$1</s2>"), none).alias("pruned"))


@query(f"""WITH m AS ({_RUN}) SELECT item_id, replace(replace(replace(replace(replace(replace(replace(marked, '<s1>', chr(1)), '</s1>', chr(2)), '&', '&amp;'), '"', '&quot;'), '''', '&#x27;'), chr(1), '<span style="color: #0000ff; font-weight: bold; font-style: normal">'), chr(2), '</span>') AS html FROM m""")
def markup_spans(t: Tables):
    rows = t.benchmark.where(F.col("text").rlike("^[A-Za-z]+ ")).select("item_id", F.regexp_replace("text", r"^(\S+)", "<s1>$1</s1>").alias("marked"))
    style = F.create_map(F.lit("s1"), F.struct(F.lit("Body").alias("font"), F.lit(255).alias("color"), F.lit(True).alias("bold"), F.lit(False).alias("italic"), F.lit(None).cast("string").alias("position")))
    return rows.select("item_id", M.html(F.col("marked"), style).alias("html"))


@query("SELECT conv_id, string_agg('[' || (turn + 1) || '] (' || role || ', p. ' || turn || CASE WHEN turn % 2 = 1 THEN ' — part ' || turn ELSE '' END || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS excerpts FROM conversations GROUP BY conv_id")
def excerpt_prompt(t: Tables):
    rows = t.conversations.select(F.col("conv_id").alias("request_id"), (F.col("turn") + 1).alias("n"), F.col("role").alias("title"), F.col("turn").alias("page"), F.when(F.col("turn") % 2 == 1, F.format_string("part %d", "turn")).alias("section"), "text")
    return messages.excerpt_blocks(rows).withColumnRenamed("request_id", "conv_id")


@query("SELECT conv_id, CAST(count(*) FILTER (turn < 4) AS INT) AS items, bool_or(turn < 4) AS valid FROM conversations GROUP BY conv_id")
def translation_reply(t: Tables):
    """Replies with more ids than were asked for: those in range count."""
    listed = t.conversations.groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").alias("id"), "text")).alias("translations"))
    read = R.translations(F.to_json(F.struct("translations")), F.lit(4))
    return listed.select("conv_id", F.size(read["items"]).alias("items"), read["valid"].alias("valid"))
