"""Text, language and chunking queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import language
from ..functions import text as X
from ..operators import chunk
from ..operators.langid import LanguageModel
from ..sources import corpus, html
from .registry import Tables, query

_LINES = """lines AS (SELECT doc_id, CAST(u.pos AS INT) AS pos, CAST(u.pos // 40 AS INT) AS page, a[u.pos + 1] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), unnest(range(len(a))) AS u(pos)),
sized AS (SELECT *, CASE WHEN length(text) < 40 THEN 12.0 WHEN length(text) % 7 = 0 THEN 7.0 ELSE 10.0 END AS size, length(text) < 40 AND pos % 5 = 0 AS bold FROM lines)"""
_NORM = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_BODY = """body AS (SELECT doc_id, coalesce(median(size), 10.0) AS body FROM (SELECT doc_id, size, unnest(range(length(text))) FROM sized) GROUP BY doc_id)"""
_SKIP = f"""skip AS (SELECT doc_id, line FROM (SELECT doc_id, lower({_NORM}) AS line, count(DISTINCT page) AS pages FROM sized WHERE length(text) < 80 GROUP BY ALL) JOIN (SELECT doc_id, count(DISTINCT page) AS n FROM sized GROUP BY doc_id) USING (doc_id) WHERE pages >= greatest(3, 0.2 * n))"""
_HEAD = "length(trim(text)) BETWEEN 3 AND 120 AND NOT regexp_matches(trim(text), '[.,;:]$') AND (bold OR size >= 1.15 * body)"


def _lines(t: Tables):
    return chunk.lines(t.documents)


@query(f"WITH {_LINES}, {_SKIP} SELECT doc_id, line FROM skip")
def boilerplate_lines(t: Tables):
    return chunk.boilerplate(_lines(t))


_CELLS = """cells AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_custkey AS VARCHAR) || ' °C' WHEN 1 THEN '+' || o_custkey || ',5 %' WHEN 2 THEN o_orderpriority WHEN 3 THEN '' WHEN 4 THEN o_custkey || chr(160) || '000 kg' ELSE '(' || o_custkey || ' – 9)' END AS text FROM orders)"""


@query(f"WITH {_CELLS} SELECT o_orderkey, regexp_full_match(regexp_replace(replace(text, chr(160), ' '), '[°º]\\s?[CFK]\\b', ' ', 'g'), '[\\d\\s.,;:%°+\\-–—−()\\[\\]/×*≈<>~$€£]+') AS is_numeric FROM cells")
def numeric_lines(t: Tables):
    """Cells of a table with figures, units, names and nothing."""
    key, k = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 6
    cell = F.when(k == 0, F.concat(key, F.lit(" °C"))).when(k == 1, F.concat(F.lit("+"), key, F.lit(",5 %"))).when(k == 2, F.col("o_orderpriority")).when(k == 3, "").when(k == 4, F.concat(key, F.lit("\u00a0000 kg"))).otherwise(F.concat(F.lit("("), key, F.lit(" – 9)")))
    return t.orders.select("o_orderkey", X.is_numeric(cell).alias("is_numeric"))


@query(f"WITH {_LINES} SELECT doc_id, pos, regexp_matches(text, '\\p{{L}}{{2,}}') AS words, regexp_matches(text, '(\\.\\s?){{6,}}') AS leader FROM lines")
def word_filter(t: Tables):
    return _lines(t).select("doc_id", "pos", X.has_words(F.col("text")).alias("words"), X.dot_leader(F.col("text")).alias("leader"))


@query(f"WITH {_LINES}, {_BODY} SELECT doc_id, round(body, 3) AS body FROM body")
def weighted_body_size(t: Tables):
    return chunk.body_size(_lines(t)).select("doc_id", F.round("body", 3).alias("body"))


@query(f"WITH {_LINES}, {_BODY} SELECT doc_id, pos, {_HEAD} AS heading, size < 0.85 * body AS note FROM sized JOIN body USING (doc_id)")
def heading_flags(t: Tables):
    rows = _lines(t)
    return rows.join(chunk.body_size(rows), "doc_id").select("doc_id", "pos", chunk.heading(F.col("body")).alias("heading"), (F.col("size") < 0.85 * F.col("body")).alias("note"))


@query(f"""WITH {_LINES}, {_BODY}, {_SKIP} SELECT s.doc_id, pos, {_NORM} AS text FROM sized s JOIN body USING (doc_id) WHERE regexp_matches({_NORM}, '\\p{{L}}{{2,}}') AND NOT regexp_matches({_NORM}, '(\\.\\s?){{6,}}')
  AND NOT EXISTS (SELECT 1 FROM skip k WHERE k.doc_id = s.doc_id AND k.line = lower({_NORM}))""")
def page_units(t: Tables):
    return chunk.units(_lines(t)).select("doc_id", "pos", "text")


_SPLIT = """CASE WHEN length(text) <= 1000 THEN [text] ELSE (SELECT list_concat(z.out, CASE WHEN z.line <> '' THEN [z.line] ELSE [] END) FROM (SELECT list_reduce(
  list_transform(string_split(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {'out': CAST([] AS VARCHAR[]), 'line': s}),
  lambda a, x: CASE WHEN (CASE WHEN length(x.line) > 1000 THEN '' ELSE a.line END) <> '' AND length(CASE WHEN length(x.line) > 1000 THEN '' ELSE a.line END) + 1 + length(x.line) > 1000
    THEN {'out': list_concat(a.out, [a.line]), 'line': x.line}
    ELSE {'out': list_concat(a.out, list_transform(range(0, greatest(length(x.line) - 1, 0) // 1000), lambda i: trim(CASE WHEN i = 0 THEN a.line ELSE '' END || ' ' || substr(x.line, i * 1000 + 1, 1000)))),
      'line': trim(CASE WHEN length(x.line) > 1000 THEN '' ELSE a.line END || ' ' || substr(x.line, (greatest(length(x.line) - 1, 0) // 1000) * 1000 + 1))} END,
  {'out': CAST([] AS VARCHAR[]), 'line': ''}) AS z)) END"""
# a page's pieces are walked one by one; a row of walk is a piece, the range that begins before it, and the range it ends
_CHUNKS = f"""u AS (SELECT s.doc_id, page, pos, {_NORM} AS text, size < 0.85 * body AS note, ({_HEAD}) AND NOT size < 0.85 * body AS heading FROM sized s JOIN body USING (doc_id)
  WHERE regexp_matches({_NORM}, '\\p{{L}}{{2,}}') AND NOT regexp_matches({_NORM}, '(\\.\\s?){{6,}}') AND NOT EXISTS (SELECT 1 FROM skip k WHERE k.doc_id = s.doc_id AND k.line = lower({_NORM}))),
cut AS (SELECT doc_id, page, pos, note, heading AND length(text) <= 1000 AS heading, {_SPLIT} AS parts FROM u),
piece AS (SELECT doc_id, page, note, heading, parts[i + 1] AS text, row_number() OVER (PARTITION BY doc_id, page ORDER BY note, pos, i) - 1 AS k FROM cut, unnest(range(len(parts))) AS t(i)),
p AS (SELECT *, coalesce(sum(length(text) + 1) OVER w, 0) AS c, coalesce(sum(CAST(heading AS INT)) OVER w, 0) AS h, count(*) OVER (PARTITION BY doc_id, page) AS n,
  heading OR (note AND NOT coalesce(lag(note) OVER (PARTITION BY doc_id, page ORDER BY k), true)) AS opens FROM piece WINDOW w AS (PARTITION BY doc_id, page ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pages AS (SELECT doc_id, page, list(c ORDER BY k) AS cs, list(h ORDER BY k) AS hs FROM p GROUP BY ALL),
walk AS (SELECT doc_id, page, CAST(-1 AS BIGINT) AS k, CAST(0 AS BIGINT) AS first, CAST(NULL AS BIGINT) AS f, CAST(NULL AS BIGINT) AS e FROM pages
  UNION ALL SELECT doc_id, page, k, CASE WHEN full_ THEN first + len(list_filter(cs[first + 1 : k], lambda x: x < c - 151)) WHEN shut THEN k ELSE first END, CASE WHEN shut OR full_ THEN first END, CASE WHEN shut OR full_ THEN k END
  FROM (SELECT *, NOT shut AND first < k AND c - cs[first + 1] + 1 + length(text) > 1000 AS full_ FROM (SELECT p.*, walk.first, pages.cs, opens AND p.h - hs[walk.first + 1] < p.k - walk.first AS shut
    FROM walk JOIN p ON p.doc_id = walk.doc_id AND p.page = walk.page AND p.k = walk.k + 1 JOIN pages ON pages.doc_id = p.doc_id AND pages.page = p.page))),
ranges AS (SELECT doc_id, page, f, e FROM walk WHERE e IS NOT NULL UNION ALL SELECT doc_id, page, first, k + 1 FROM walk QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY k DESC) = 1),
texts AS (SELECT r.doc_id, r.page, r.e, string_agg(text, ' ' ORDER BY k) FILTER (k >= f) AS text, arg_max(text, k) FILTER (heading) AS title FROM ranges r JOIN p ON p.doc_id = r.doc_id AND p.page = r.page AND p.k < r.e GROUP BY ALL),
named AS (SELECT *, last_value(title IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM texts)"""


@query(f"""WITH RECURSIVE {_LINES}, {_BODY}, {_SKIP}, {_CHUNKS} SELECT doc_id || ':p' || (page + 1) || ':' || (row_number() OVER (PARTITION BY doc_id ORDER BY page, e) - 1) AS passage_id, doc_id, page + 1 AS page, section, text FROM named WHERE length(text) >= 80""")
def overlap_chunks(t: Tables):
    return chunk.passages(_lines(t))


@query(f"""WITH {_LINES}, {_BODY}, h AS (SELECT doc_id, pos, CASE WHEN {_HEAD} THEN trim(text) END AS own FROM sized JOIN body USING (doc_id))
SELECT doc_id, pos, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM h""")
def passage_sections(t: Tables):
    rows = _lines(t)
    own = F.when(chunk.heading(F.col("body")), F.trim("text"))
    carried = F.last(own, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(chunk.body_size(rows), "doc_id").select("doc_id", "pos", carried.alias("section"))


@query("SELECT doc_id, u.n AS part, s[u.n + 1] AS sentence FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents), unnest(range(len(s))) AS u(n)")
def sentence_split(t: Tables):
    return t.documents.select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("part", "sentence")).withColumn("part", F.col("part").cast("long"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_custkey || '000123.75' WHEN 1 THEN o_custkey || '999 t, 1.5' ELSE 'CO2: ' || o_custkey || ' 12 and 1234' END AS numbers FROM orders")
def number_normalise(t: Tables):
    """Figures with plain, no-break and narrow spaces between thousands and a decimal comma."""
    key, k = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.concat(key, F.lit("\u00a0000\u202f123,75"))).when(k == 1, F.concat(key, F.lit(" 999 t, 1,5"))).otherwise(F.concat(F.lit("CO2: "), key, F.lit(" 12 and 1\u00a0234")))
    return t.orders.select("o_orderkey", X.normalise_numbers(raw).alias("numbers"))


@query("SELECT doc_id, n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\\p{L}\\p{N}_.])(\\d+(?:[.,]\\d+)*)', 1)) AS n FROM documents)")
def number_extract(t: Tables):
    return t.documents.select("doc_id", F.explode(X.numbers(F.col("text"))).alias("n"))


_HTML = "regexp_replace(regexp_replace(html, '</?s\\d+>', '', 'g'), '</?(?:sub|sup|b|i|em|strong)>|<br\\s*/?>', '', 'gi')"


@query(f"SELECT page_id, md5({_HTML}) AS digest, CAST(length({_HTML}) AS INT) AS n FROM pages")
def tags_stripped(t: Tables):
    plain = X.strip_tags(F.col("html"))
    return t.pages.select("page_id", F.md5(plain).alias("digest"), F.length(plain).alias("n"))


@query("SELECT w AS code, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^\\s]+')) AS w FROM documents) WHERE regexp_full_match(w, '[A-Z][A-Z0-9]{1,5}(?:[-.][A-Z0-9.]{1,5})?') GROUP BY w")
def codes_kept(t: Tables):
    words = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("code"))
    return words.where(X.is_code(F.col("code"))).groupBy("code").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT item_id, trim(text) AS plain, text, CAST(ceil(length(trim(text)) * 0.2) AS INT) - 1 AS extra FROM benchmark)
SELECT item_id, CASE WHEN plain = '' OR extra < 1 THEN upper(replace(text, 'ß', 'ss')) ELSE rtrim(upper(replace(text, 'ß', 'ss'))) || ' ' || lower(rtrim(substr(plain || ' ' || plain, 1, extra))) END AS text FROM s""")
def pseudo_translate(t: Tables):
    return t.benchmark.select("item_id", X.pseudo_translate(F.col("text")).alias("text"))


_JOINED = "CASE WHEN trim(raw) = '' THEN acc WHEN acc = '' THEN trim(raw) WHEN regexp_matches(acc, '\\p{L}-$') AND regexp_matches(trim(raw), '^\\p{Ll}') THEN left(acc, length(acc) - 1) || trim(raw) WHEN ends_with(acc, '-') THEN acc || trim(raw) ELSE acc || ' ' || trim(raw) END"


@query(f"SELECT doc_id, regexp_replace(list_reduce(string_split(text, chr(10)), lambda acc, raw: {_JOINED}, ''), '\\s+', ' ', 'g') AS text FROM documents")
def joined_lines(t: Tables):
    return t.documents.select("doc_id", X.join_lines(F.split("text", "\n")).alias("text"))


@query("SELECT page_id, CASE WHEN regexp_extract(html, '<html lang=\"([a-zA-Z]+)', 1) IN ('en', 'fr', 'de', 'es', 'it', 'pt') THEN regexp_extract(html, '<html lang=\"([a-zA-Z]+)', 1) END AS lang FROM pages")
def page_lang(t: Tables):
    return t.pages.select("page_id", language.metadata_language(html.page_language(F.col("html"))).alias("lang"))


_PROFILE = ", ".join(f"('{c}', '{w}')" for c, ws in language.WORDS.items() for w in ws.split())
_LETTERS = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS code, {f"length(lower(text)) - length(regexp_replace(lower(text), '[{language.LETTERS[c]}]', '', 'g'))" if language.LETTERS[c] else '0'} AS n FROM documents" for c in language.SUPPORTED)
_LANG = f"""prof AS (SELECT * FROM (VALUES {_PROFILE}) AS x(code, word)),
found AS (SELECT doc_id, code, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM documents) JOIN prof USING (word) GROUP BY ALL UNION ALL {_LETTERS}),
hits AS (SELECT doc_id, code, sum(n) AS n FROM found GROUP BY ALL),
best AS (SELECT doc_id, arg_min(code, (-n, code)) AS guess, max(n) AS top FROM hits GROUP BY doc_id),
share AS (SELECT doc_id, guess, round(1 / sum(exp(n - top)), 3) AS confidence FROM hits JOIN best USING (doc_id) GROUP BY doc_id, guess),
det AS (SELECT d.doc_id, d.lang, text, CASE WHEN length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) >= 20 THEN guess END AS guess, CASE WHEN length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) >= 20 THEN confidence ELSE 0.0 END AS confidence FROM documents d JOIN share USING (doc_id))"""


def _detected(t: Tables):
    return t.documents.select("doc_id", "lang", "text", language.classify(F.col("text")).alias("c")).select("doc_id", "lang", "text", F.col("c.language").alias("guess"), F.col("c.confidence").alias("confidence"))


@query(f"WITH {_LANG} SELECT doc_id, lang, guess, confidence FROM det")
def lang_detect(t: Tables):
    return _detected(t).drop("text")


@query(f"WITH {_LANG} SELECT lang, guess, count(*) AS n FROM det GROUP BY ALL")
def lang_confusion(t: Tables):
    return _detected(t).groupBy("lang", "guess").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS held_out, true AS enough FROM documents WHERE (doc_id * 7 + 3) % 5 = 0 AND lang IS NOT NULL")
def lang_model(t: Tables):
    """Held-out documents, and whether a model trained on the others names the language of at least 95 in a hundred."""
    out = (F.col("doc_id") * 7 + 3) % 5 == 0
    rows = t.documents.where("lang is not null")
    model = LanguageModel.fit(rows.where(~out))
    read = rows.where(out).select("lang", model.classify(F.col("text"))["language"].alias("guess"))
    return read.agg(F.count("*").alias("held_out"), (F.count_if(F.col("guess") == F.col("lang")) >= 0.95 * F.count("*")).alias("enough"))


_META = "CASE WHEN source = 'src1' THEN NULL WHEN source = 'src2' THEN 'EN_us' WHEN source = 'src3' THEN 'xx' ELSE lang END"


@query(f"""WITH {_LANG}, m AS (SELECT det.*, {_META} AS stated, CASE WHEN source = 'src2' THEN 'en' WHEN source NOT IN ('src1', 'src3') THEN det.lang END AS meta FROM det JOIN (SELECT doc_id, source FROM documents) USING (doc_id))
SELECT doc_id, CASE WHEN meta IS NOT NULL AND (guess IS NULL OR guess = meta OR confidence < 0.95) THEN meta ELSE guess END AS language,
CASE WHEN meta IS NOT NULL AND (guess IS NULL OR guess = meta OR confidence < 0.95) THEN CASE WHEN guess = meta THEN 1.0 WHEN guess IS NULL THEN 0.9 ELSE round(1 - confidence, 3) END ELSE confidence END AS confidence,
CASE WHEN meta IS NOT NULL AND (guess IS NULL OR guess = meta OR confidence < 0.95) THEN 'metadata' WHEN guess IS NOT NULL THEN 'text' ELSE 'none' END AS method, stated FROM m""")
def lang_arbitration(t: Tables):
    """What documents state of their language, by source: nothing, English, an unknown code, or the truth."""
    stated = F.when(F.col("source") == "src1", None).when(F.col("source") == "src2", "EN_us").when(F.col("source") == "src3", "xx").otherwise(F.col("lang"))
    rows = t.documents.select("doc_id", language.detect(stated, F.col("text")).alias("d"))
    return rows.select("doc_id", "d.language", "d.confidence", "d.method", F.col("d.metadata").alias("stated"))


@query(f"WITH {_LANG}, h AS (SELECT doc_id, coalesce(sum(n) FILTER (code = 'fr'), 0) AS fr, coalesce(sum(n) FILTER (code = 'en'), 0) AS en FROM hits GROUP BY doc_id) SELECT doc_id, CASE WHEN fr > en THEN 'fr' WHEN en > fr THEN 'en' ELSE 'fr' END AS request, CASE WHEN fr > en THEN 'fr' ELSE 'en' END AS question, CASE WHEN guess = 'fr' THEN 'fr' ELSE 'en' END AS own, CASE WHEN guess = 'fr' THEN 'en' ELSE 'fr' END AS other FROM h JOIN det USING (doc_id)")
def request_languages(t: Tables):
    text = F.col("text")
    own = language.query_language(text)
    return t.documents.select("doc_id", language.request_language(text).alias("request"), language.question_language(text).alias("question"), own.alias("own"), language.other_language(own).alias("other"))


@query(f"""WITH {_LINES}, p AS (SELECT doc_id, page, trim(regexp_replace(string_agg(text, chr(10) ORDER BY pos), '\\s+', ' ', 'g')) AS text FROM lines GROUP BY doc_id, page), r AS (SELECT *, row_number() OVER w AS i, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY page))
SELECT doc_id, md5(left(string_agg(text, ' ' ORDER BY page), 5000)) AS digest FROM r WHERE i <= 3 AND ahead < 5000 GROUP BY doc_id""")
def text_samples(t: Tables):
    """Samples of documents whose pages are 40 lines each."""
    pages = _lines(t).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda r: r["text"]), "\n").alias("text"))
    return language.text_sample(pages).select("doc_id", F.md5("sample").alias("digest"))


# lines of documents as blocks of a page: some rotated, some in a mathematical font
_KINDS = f"""WITH {_LINES}, b AS (SELECT *, CASE WHEN pos % 11 = 0 THEN 'CMMI10' ELSE 'Times' END AS font, pos % 13 <> 0 AS horizontal, regexp_full_match(text, '[\\d\\s.,;:%°+\\-–—−()\\[\\]/×*≈<>~$€£]+') AS num FROM sized),
k AS (SELECT *, CASE WHEN NOT horizontal THEN 'rotated' WHEN num THEN 'numeric' WHEN font = 'Times' AND regexp_matches(text, '\\p{{L}}{{2,}}') THEN 'translatable' ELSE 'other' END AS kind FROM b)"""


def _page_blocks(t: Tables):
    rows = _lines(t).withColumns({"font": F.when(F.col("pos") % 11 == 0, "CMMI10").otherwise("Times"), "horizontal": F.col("pos") % 13 != 0})
    return rows.withColumn("lines", F.array("text"))


@query(f"{_KINDS} SELECT doc_id, page, pos, kind FROM k WHERE page < 2")
def block_kinds(t: Tables):
    return corpus.block_kind(corpus.keep_pages(_page_blocks(t), 2)).select("doc_id", "page", "pos", "kind")


@query(f"{_KINDS} SELECT doc_id, count(*) AS blocks, count(*) FILTER (kind = 'translatable') AS translatable, count(*) FILTER (kind = 'numeric') AS numeric, count(*) FILTER (kind = 'rotated') AS rotated, CAST(sum(CASE WHEN kind = 'translatable' THEN length(text) ELSE 0 END) AS BIGINT) AS characters FROM k GROUP BY doc_id")
def extraction_counts(t: Tables):
    return corpus.extraction_summary(_page_blocks(t))


@query(f"{_KINDS} SELECT doc_id, page, count(*) AS blocks, CAST(count(*) AS BIGINT) AS lines, array_to_string(list_sort(list(DISTINCT round(size, 1))), ',') AS sizes, array_to_string(list_sort(list(DISTINCT font)), ',') AS fonts FROM k GROUP BY doc_id, page")
def page_dump(t: Tables):
    found = corpus.page_summary(_page_blocks(t))
    return found.select("doc_id", "page", "blocks", "lines", F.array_join(F.transform("sizes", lambda x: x.cast("string")), ",").alias("sizes"), F.array_join("fonts", ",").alias("fonts"))
