"""Plans, verdicts, runs, jobs, messages and sources over the test tables; SQL twins are written from the rules alone."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calls
from ..functions.blocks import font_family, is_bold, is_italic, is_math_font
from ..operators import evaluate, messages, planning, search
from ..operators import grounding as G
from ..operators import replies as R
from ..sources import corpus, files, logs
from .registry import Tables, query

# Requests: a conversation is a request, its turns are the steps of the router's reply, nations are the reports.
_STEPS = """steps AS MATERIALIZED (SELECT conv_id AS request_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step_no, turn, length(text) AS n FROM conversations),
capped AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS total, CASE turn % 6 WHEN 0 THEN 'question' WHEN 1 THEN 'summarize' WHEN 2 THEN 'compare' WHEN 3 THEN 'translate' WHEN 4 THEN 'dance' ELSE 'out_of_scope' END AS said FROM steps),
ids AS (SELECT *, n % 30 AS a, (n + 7) % 30 AS b, least(n % 4, 2) AS ids_n FROM capped WHERE step_no < 5),
d AS (SELECT *, CASE ids_n WHEN 0 THEN '' WHEN 1 THEN 'n' || a ELSE 'n' || a || ',n' || b END AS ids, concat_ws(', ', CASE WHEN ids_n > 0 AND a >= 25 THEN 'n' || a END, CASE WHEN ids_n > 1 AND b >= 25 THEN 'n' || b END) AS bad FROM ids),
c AS (SELECT *, CASE WHEN said IN ('summarize', 'compare') AND bad <> '' THEN 'No such report: ' || bad || '.' WHEN said = 'translate' AND ids_n > 0 AND bad <> '' THEN 'No such report: ' || bad || '.'
  WHEN said = 'translate' AND ids_n > 0 AND a % 2 = 1 THEN 'No such report: ' || replace(ids, ',', ', ') || '.' WHEN said = 'summarize' AND ids_n <> 1 THEN 'Which report do you mean?'
  WHEN said = 'compare' AND ids_n <> 2 THEN 'Which two or three reports should be compared?' WHEN said = 'translate' AND ids_n = 0 THEN 'Which PDF should be translated?' WHEN said = 'dance' THEN 'Which report do you mean?' END AS ask FROM d),
p AS (SELECT request_id, step_no, total, CASE WHEN ask IS NOT NULL THEN 'clarify' ELSE said END AS route, coalesce(ask, '') AS reply, CASE WHEN ask IS NOT NULL THEN '' ELSE ids END AS doc_ids, CASE WHEN ask IS NULL AND said = 'translate' THEN 'n' || a || '.pdf' ELSE '' END AS path FROM c)"""


def catalogue(t: Tables):
    """Nations as reports; those of odd keys have no file."""
    name = F.format_string("n%d", "n_nationkey")
    return t.nation.select(name.alias("doc_id"), F.col("n_name").alias("title"), F.lit("org").alias("org"), F.col("n_regionkey").alias("year"), F.lit(None).cast("string").alias("lang"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(name, F.lit(".pdf"))).alias("file"))


def plans(t: Tables):
    """Replies of a router with a step per turn, read and checked."""
    n, k = F.length("text"), F.col("turn") % 6
    route = F.when(k == 0, "question").when(k == 1, "summarize").when(k == 2, "compare").when(k == 3, "translate").when(k == 4, "dance").otherwise("out_of_scope")
    one, two = F.format_string("n%d", n % 30), F.format_string("n%d", (n + 7) % 30)
    ids = F.when(n % 4 == 0, F.array().cast("array<string>")).when(n % 4 == 1, F.array(one)).when(n % 4 == 2, F.array(one, two)).otherwise(F.array(one, two, one))
    step = F.struct(route.alias("route"), ids.alias("doc_ids"), F.lit(None).cast("string").alias("topic"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", step.alias("s")))), lambda x: x["s"])
    asked = t.conversations.groupBy(F.col("conv_id").alias("request_id")).agg(F.to_json(F.struct(listed.alias("steps")), {"ignoreNullFields": "false"}).alias("reply"))
    read = asked.select("request_id", F.lit("asked").alias("request"), F.lit("en").alias("lang"), R.steps(F.col("reply"))["steps"].alias("steps"))
    return planning.check_plans(planning.step_cap(read), catalogue(t))


@query(f"WITH {_STEPS} SELECT request_id, CAST(step_no AS INT) AS step_no, route, reply, doc_ids, path FROM p")
def plan_check(t: Tables):
    return plans(t).select("request_id", "step_no", "route", "reply", F.array_join("doc_ids", ",").alias("doc_ids"), "path")


@query(f"WITH {_STEPS} SELECT request_id, count(*) AS kept, CAST(max(greatest(total - 5, 0)) AS INT) AS dropped FROM p GROUP BY request_id")
def step_cap(t: Tables):
    return plans(t).groupBy("request_id").agg(F.count("*").alias("kept"), F.max("dropped").alias("dropped"))


_SIGNED = f"{_STEPS}, g AS (SELECT request_id, string_agg(route || '(' || CASE WHEN doc_ids <> '' THEN array_to_string(list_sort(string_split(doc_ids, ',')), ',') ELSE path END || ')', ' > ' ORDER BY step_no) AS signature, count(*) AS n FROM p GROUP BY request_id)"


@query(f"WITH {_SIGNED} SELECT request_id, signature FROM g")
def plan_signature(t: Tables):
    return planning.signatures(plans(t))


@query(f"WITH {_STEPS}, w AS (SELECT request_id, count(*) AS n, bool_and(route IN ('question', 'clarify')) AS ok FROM p GROUP BY request_id) SELECT request_id, ok AND n <= 3 AS ok FROM w")
def plan_match(t: Tables):
    """Accepted: one to three steps, each a question or a clarification."""
    option = F.explode(F.sequence(F.lit(1), F.lit(3)))
    want = t.conversations.select(F.col("conv_id").alias("request_id")).distinct().withColumn("option", option).withColumn("step_no", F.explode(F.sequence(F.lit(0), F.col("option") - 1)))
    none = F.lit(None)
    accepted = want.withColumn("routes", F.array(F.lit("question"), F.lit("clarify"))).withColumn("reports", none.cast("array<array<string>>")).withColumn("topic_any", none.cast("array<string>")).withColumn("path_contains", none.cast("string")).withColumn("target_lang", none.cast("string"))
    return planning.plan_matches(plans(t), accepted)


_RUNS = "runs AS (SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS id, 'c' || user_id % 3 AS category, event_id % 3 AS run, value < 12 AS ok, CASE WHEN value < 2 THEN 'a' ELSE 'b' END AS signature FROM events), cases AS (SELECT id, count(DISTINCT signature) AS kinds, bool_and(ok) AS ok FROM runs GROUP BY id)"


@query(f"""WITH {_RUNS} SELECT (SELECT count(*) FILTER (ok) FROM runs) AS right_plans, (SELECT count(*) FROM runs) AS total, count(*) FILTER (kinds = 1) AS stable, count(*) AS cases, md5(string_agg(id, ',' ORDER BY id) FILTER (kinds > 1)) AS unstable, md5(coalesce(string_agg(id, ',' ORDER BY id) FILTER (NOT ok), '')) AS wrong,
(SELECT string_agg(c, ';' ORDER BY c) FROM (SELECT category || ':' || count(*) FILTER (ok) || '/' || count(*) AS c FROM runs GROUP BY category)) AS by_category FROM cases""")
def routing_summary(t: Tables):
    user = F.lpad(F.col("user_id").cast("string"), 5, "0")
    runs = t.events.select(F.concat(F.lit("u"), user).alias("id"), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("category"), (F.col("event_id") % 3).alias("run"), (F.col("value") < 12).alias("ok"), F.when(F.col("value") < 2, "a").otherwise("b").alias("signature"), F.lit(None).cast("boolean").alias("fixed_by_code"))
    by = F.array_join(F.transform(F.map_entries("by_category"), lambda e: F.format_string("%s:%d/%d", e["key"], e["value"]["right"], e["value"]["total"])), ";")
    return planning.routing_summary(runs).select(F.col("right").alias("right_plans"), "total", "stable", "cases", F.md5(F.array_join("unstable", ",")).alias("unstable"), F.md5(F.array_join("wrong", ",")).alias("wrong"), by.alias("by_category"))


_JUDGED = "j AS (SELECT CAST(d.doc_id % 200 AS VARCHAR) AS item, CASE d.doc_id % 3 WHEN 0 THEN 'trap' WHEN 1 THEN 'true' ELSE 'borderline' END AS kind, l.doc_id IS NOT NULL AS judged, coalesce(l.toxic, 0) = 1 AS removed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query(f"""WITH {_JUDGED}, i AS (SELECT item, count(DISTINCT removed) AS kinds FROM j WHERE judged GROUP BY item) SELECT count(*) FILTER (judged AND kind = 'trap' AND removed) AS traps, count(*) FILTER (judged AND kind = 'trap') AS all_traps, count(*) FILTER (judged AND kind = 'true' AND removed) AS wrongly,
count(*) FILTER (judged AND kind = 'true') AS all_true, (SELECT count(*) FILTER (kinds = 1) FROM i) AS constant, (SELECT count(*) FROM i) AS items, count(*) FILTER (NOT judged) AS not_judged FROM j""")
def judge_summary(t: Tables):
    rows = t.documents.select("doc_id").join(t.labels.select("doc_id", "toxic", F.lit(True).alias("seen")), "doc_id", "left")
    k = F.col("doc_id") % 3
    results = rows.select((F.col("doc_id") % 200).cast("string").alias("item"), F.when(k == 0, "trap").when(k == 1, "true").otherwise("borderline").alias("kind"), F.coalesce("seen", F.lit(False)).alias("judged"), (F.coalesce("toxic", F.lit(0)) == 1).alias("removed"))
    got = planning.judge_summary(results)
    return got.select(F.col("traps_caught.removed").alias("traps"), F.col("traps_caught.total").alias("all_traps"), F.col("true_removed.removed").alias("wrongly"), F.col("true_removed.total").alias("all_true"), "constant", "items", "not_judged")


@query("SELECT d.doc_id, l.doc_id IS NULL OR l.quality = 1 AS faithful, CASE WHEN l.quality = 0 THEN 'poor' END AS problem FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def verdict_join(t: Tables):
    """Documents as items, labels as verdicts: an item without one is faithful."""
    items = t.documents.select(F.lit(0).alias("request_id"), F.col("doc_id").alias("n"))
    verdicts = t.labels.where("quality is not null").select(F.lit(0).alias("request_id"), F.col("doc_id").alias("n"), (F.col("quality") == 1).alias("faithful"), F.when(F.col("quality") == 0, "poor").alias("problem"))
    return G.judge_join(items, verdicts).select(F.col("n").alias("doc_id"), "faithful", "problem")


# Runs: a user's events are what a run reports; an error is a pause, after which the next run of the thread begins.
_UPDATES = """e AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run_no FROM events),
u AS (SELECT *, first_value(ts) OVER (PARTITION BY user_id, run_no ORDER BY ts, event_id) AS began FROM e)"""


def updates(t: Tables):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    run = F.coalesce(F.sum((F.col("event_type") == "error").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = t.events.select(F.col("user_id").alias("thread"), run.alias("run_no"), F.col("event_id").alias("seq"), "ts", F.when(F.col("event_type") == "error", planning.PAUSE).otherwise(F.col("event_type")).alias("node"), "value")
    return rows, rows.groupBy("thread", "run_no").agg(F.min("ts").alias("ts"))


@query(f"WITH {_UPDATES} SELECT event_id, round((epoch_us(ts) - coalesce(epoch_us(lag(ts) OVER (PARTITION BY user_id, run_no ORDER BY ts, event_id)), epoch_us(began))) / 1e6, 3) AS seconds FROM u QUALIFY event_type <> 'error'")
def node_durations(t: Tables):
    rows, _ = updates(t)
    return planning.node_durations(rows).select(F.col("seq").alias("event_id"), "seconds")


@query("""SELECT user_id, round(sum(value), 3) AS duration_s, count(*) AS nodes, CAST(coalesce(sum(CASE WHEN event_type = 'view' THEN event_id % 5 END), 0) AS BIGINT) AS kept, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS removed, count(*) FILTER (event_type = 'click') AS calls,
round((coalesce(sum(CASE WHEN event_type = 'click' THEN event_id END), 0) * 0.3 + count(*) FILTER (event_type = 'click') * 2.5) / 1e6, 6) AS cost_usd FROM events GROUP BY user_id""")
def run_totals(t: Tables):
    """Views are judge nodes that keep some points and remove one; clicks are model calls."""
    records = t.events.select(F.col("user_id").alias("thread"), F.when(F.col("event_type") == "view", "judge").otherwise("tool").alias("node"), F.col("value").alias("seconds"), (F.col("event_id") % 5).alias("kept"), F.lit(1).alias("removed"))
    called = t.events.where("event_type = 'click'").select(F.col("user_id").alias("thread"), F.col("event_id").alias("tokens_in"), F.lit(1).alias("tokens_out"))
    got = planning.run_totals(records, called, 0.3, 2.5)
    return got.select(F.col("thread").alias("user_id"), "duration_s", "nodes", "kept", "removed", "calls", "cost_usd")


@query("""WITH s AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spent FROM events),
m AS (SELECT *, coalesce(bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS lost, n > 1 AND event_type IN ('click', 'view') AND coalesce(spent, 0) + 1 > 12 AS short FROM s)
SELECT user_id, event_id, CASE WHEN lost THEN 'a step failed' WHEN bool_or(short) OVER (PARTITION BY user_id ORDER BY n) THEN 'budget' END AS why FROM m""")
def chain_stop(t: Tables):
    """A user's events as steps: errors fail, clicks and views are reviewed, each click is a model call of at most 12."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = t.events.select(F.col("user_id").alias("request_id"), n.alias("step_no"), "event_id", "event_type")
    steps = rows.select("request_id", "step_no", "event_id", F.when(F.col("event_type").isin("click", "view"), "question").otherwise("translate").alias("route"))
    results = rows.select("request_id", "step_no", (F.col("event_type") == "error").alias("failed"), (F.col("event_type") == "click").cast("int").alias("calls"))
    return planning.chain(steps, results, 12).select(F.col("request_id").alias("user_id"), "event_id", "why")


@query("""SELECT d.source, count(*) FILTER (l.quality = 1) AS asked, count(*) FILTER (l.quality = 1 AND d.doc_id % 2 = 0) AS found, count(*) FILTER (l.quality = 1 AND l.toxic = 0) AS answered, count(*) FILTER (l.quality = 1 AND l.toxic = 0 AND d.doc_id % 4 = 0) AS cited,
count(*) FILTER (l.quality = 1 AND l.toxic = 0 AND d.doc_id % 4 = 0) AS cited_when_given, count(*) FILTER (l.quality = 0 AND l.toxic = 1) AS refused, count(*) FILTER (l.quality = 0) AS unanswerable FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source""")
def answer_metrics(t: Tables):
    """Labelled documents as questions: good ones have an expected place, toxic ones are refused."""
    rows = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality", "toxic"), "doc_id")
    place, other = F.array(F.lit("p")), F.array(F.lit("q"))
    answers = rows.select(F.col("doc_id").alias("request_id"), "source", (F.col("toxic") == 0).alias("answerable"), F.when(F.col("doc_id") % 2 == 0, place).otherwise(other).alias("given"), F.when(F.col("doc_id") % 4 == 0, place).otherwise(other).alias("cited"))
    return planning.answer_metrics(answers, rows.where("quality = 1").select(F.col("doc_id").alias("request_id"), place.alias("places")), ["source"])


_STATUS = "CASE event_id % 6 WHEN 0 THEN 429 WHEN 1 THEN 500 WHEN 2 THEN 404 WHEN 3 THEN 200 WHEN 4 THEN 401 END"


def _status():
    k = F.col("event_id") % 6
    return F.when(k == 0, 429).when(k == 1, 500).when(k == 2, 404).when(k == 3, 200).when(k == 4, 401)


@query(f"SELECT event_id, coalesce({_STATUS} IN (429, 500), true) AS retry, CASE WHEN event_type = 'view' THEN least(value, 60.0) WHEN {_STATUS} = 429 THEN least(5 * pow(2, user_id % 7), 60) ELSE least(pow(2, user_id % 7), 30) END AS delay FROM events")
def retry_plan(t: Tables):
    wish = F.when(F.col("event_type") == "view", F.col("value"))
    return t.events.select("event_id", calls.retryable(_status()).alias("retry"), calls.retry_delay(F.col("user_id") % 7, _status(), wish).alias("delay"))


@query(f"SELECT CASE WHEN {_STATUS} >= 400 THEN 'HTTP ' || {_STATUS} WHEN event_type = 'error' THEN 'ConnectError' ELSE 'invalid answer' END AS kind, count(*) AS n FROM events GROUP BY 1")
def error_counts(t: Tables):
    kind = calls.failure_kind(_status(), F.when(F.col("event_type") == "error", "ConnectError"))
    return t.events.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority <> '1-URGENT' THEN round((o_custkey * 0.2 + o_orderkey * 0.4) / 1e6, 6) END AS cost FROM orders")
def cost_null_prices(t: Tables):
    price = F.when(F.col("o_orderpriority") != "1-URGENT", 0.2)
    return t.orders.select("o_orderkey", calls.cost(F.col("o_custkey"), F.col("o_orderkey"), price, F.lit(0.4)).alias("cost"))


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def live_state(t: Tables):
    """The last value of every key of a thread's state."""
    return t.events.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


_JOBS = "j AS (SELECT *, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'queued' WHEN 'error' THEN 'failed' ELSE 'done' END AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)"


def _jobs(t: Tables):
    status = F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "error", "failed").otherwise("done")
    return t.events.select(F.col("user_id").alias("job_id"), status.alias("status"), F.lit("").alias("detail"), F.col("ts"), F.col("event_id").alias("seq"))


@query(f"WITH {_JOBS} SELECT user_id, event_id, status FROM j WHERE r = 1")
def job_progress(t: Tables):
    return logs.latest(_jobs(t)).select(F.col("job_id").alias("user_id"), F.col("seq").alias("event_id"), "status")


@query(f"WITH {_JOBS} SELECT user_id, CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('queued', 'running') THEN 'interrupted by a restart' ELSE '' END AS detail FROM j WHERE r = 1")
def job_recovery(t: Tables):
    return logs.recovered(logs.latest(_jobs(t))).select(F.col("job_id").alias("user_id"), "status", "detail")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round((max(value) FILTER (i = (n + 1) // 2) + max(value) FILTER (i = n // 2 + 1)) / 2, 6) AS middle, max(value) FILTER (i = (n + 1) // 2) AS lower, max(value) FILTER (i = n // 2 + 1) AS upper FROM r GROUP BY event_type""")
def three_medians(t: Tables):
    return evaluate.medians(t.events, ["event_type"], "value")


@query("SELECT event_id, '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\",\"user\":' || user_id || '}' AS line FROM events")
def json_log(t: Tables):
    return t.events.select("event_id", logs.json_line(id=F.col("event_id"), kind=F.col("event_type"), user=F.col("user_id")).alias("line"))


@query("SELECT item_id, sha256('3|fake|en|fr|' || text) AS cache_key FROM benchmark")
def cache_keys(t: Tables):
    return t.benchmark.select("item_id", logs.cache_key("3", "fake", "en", "fr", F.col("text")).alias("cache_key"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND l_linenumber BETWEEN 2 AND 4")
def summary_pages(t: Tables):
    """Items as passages on numbered pages, urgent orders as reports whose own summary is on pages 2 to 4."""
    passages = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"))
    reports = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit(2), F.lit(4))).alias("summary_pages"))
    return search.summary_passages(passages, reports).select(F.col("doc_id").alias("l_orderkey"), F.col("page").alias("l_linenumber"))


@query("""WITH p AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS m, sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM conversations),
k AS (SELECT *, CAST(greatest(1, floor(m * 600.0 / total)) AS BIGINT) AS keep FROM p) SELECT conv_id, turn FROM k WHERE total <= 600 OR list_contains(list_transform(range(keep), lambda j: CAST(floor(j * (m / CAST(keep AS DOUBLE))) AS BIGINT)), i)""")
def spread_sample(t: Tables):
    return search.spread(t.conversations, "conv_id", ["turn"], 600).select("conv_id", "turn")


@query("SELECT 'hosts' AS name, string_agg('- n' || n_nationkey || ': ' || n_name || ' (org, ' || n_regionkey || ', ?)', chr(10) ORDER BY 'n' || n_nationkey) AS listed FROM nation")
def catalogue_listing(t: Tables):
    return messages.catalogue_lines(catalogue(t)).select(F.lit("hosts").alias("name"), F.col("catalogue").alias("listed"))


_URL = "'gs://' || regexp_replace(url, '^https?://', '')"


@query(f"SELECT page_id, regexp_extract({_URL}, '^gs://([^/]+)', 1) AS bucket, CASE WHEN trim(regexp_extract({_URL}, '^gs://[^/]+/(.*)$', 1), '/') = '' THEN '' ELSE trim(regexp_extract({_URL}, '^gs://[^/]+/(.*)$', 1), '/') || '/' END AS prefix FROM pages WHERE url IS NOT NULL")
def gs_urls(t: Tables):
    parts = files.bucket_and_prefix(F.concat(F.lit("gs://"), F.regexp_replace("url", "^https?://", "")))
    return t.pages.where("url is not null").select("page_id", parts.alias("p")).select("page_id", "p.bucket", "p.prefix")


@query("""WITH f AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'a.txt' ELSE 'b.PDF' END AS file, CASE page_id % 7 WHEN 1 THEN 'GIF8' ELSE '%PDF' END || coalesce(html, '') || CASE page_id % 7 WHEN 2 THEN '/Encrypt' ELSE '' END AS content, CASE page_id % 7 WHEN 3 THEN NULL WHEN 4 THEN 0 ELSE page_id % 60 + 1 END AS n FROM pages)
SELECT page_id, CASE WHEN file = 'a.txt' THEN 'only PDF files are accepted' WHEN strlen(content) > 4000 THEN 'the file is too large' WHEN left(content, 4) <> '%PDF' THEN 'the file is not a PDF' WHEN contains(content, '/Encrypt') THEN 'password-protected PDFs are not supported'
WHEN n IS NULL THEN 'the PDF could not be opened' WHEN n = 0 THEN 'the PDF has no pages' WHEN n > 30 THEN 'the PDF has more than 30 pages' ELSE 'confirm: ' || (n > 10) END AS outcome FROM f""")
def upload_checks(t: Tables):
    k = F.col("page_id") % 7
    content = F.concat(F.when(k == 1, "GIF8").otherwise("%PDF"), F.coalesce("html", F.lit("")), F.when(k == 2, "/Encrypt").otherwise("")).cast("binary")
    rows = t.pages.select("page_id", F.when(k == 0, "a.txt").otherwise("b.PDF").alias("file"), content.alias("content"), F.length(content).alias("length"), F.when(k == 4, 0).when(k != 3, F.col("page_id") % 60 + 1).alias("pages"))
    checked = corpus.check_uploads(rows, most_bytes=4000)
    return checked.select("page_id", F.coalesce("refused", F.concat(F.lit("confirm: "), F.col("needs_confirmation").cast("string"))).alias("outcome"))


_FONT = "CASE p_partkey % 6 WHEN 0 THEN 'ABCDEF+Lato-BoldItalic' WHEN 1 THEN 'Times-CnI' WHEN 2 THEN 'CMMI10' WHEN 3 THEN 'Courier' WHEN 4 THEN 'X+Sans-Medium' ELSE 'Georgia-Oblique' END"


@query(f"SELECT p_partkey, {_FONT} = 'ABCDEF+Lato-BoldItalic' OR p_size & 16 <> 0 AS bold, p_partkey % 6 IN (0, 1, 5) OR p_size & 2 <> 0 AS italic, p_partkey % 6 = 2 AS math, CASE p_partkey % 6 WHEN 1 THEN 'serif' WHEN 3 THEN 'monospace' WHEN 5 THEN 'serif' ELSE 'sans-serif' END AS family FROM part")
def font_styles(t: Tables):
    """Fonts dealt out to parts, with their sizes as style flags."""
    k, names = F.col("p_partkey") % 6, ["ABCDEF+Lato-BoldItalic", "Times-CnI", "CMMI10", "Courier", "X+Sans-Medium", "Georgia-Oblique"]
    font = F.get(F.array(*map(F.lit, names)), k.cast("int"))
    rows = t.part.select("p_partkey", font.alias("font"), F.col("p_size").cast("int").alias("flags"))
    return rows.select("p_partkey", is_bold(F.col("font"), F.col("flags")).alias("bold"), is_italic(F.col("font"), F.col("flags")).alias("italic"), is_math_font(F.col("font")).alias("math"), font_family(F.col("font")).alias("family"))


@query("SELECT a.r_name AS system_a, b.r_name AS system_b FROM region a JOIN region b ON a.r_name < b.r_name")
def system_pairs(t: Tables):
    return evaluate.pairs(t.region.select(F.col("r_name").alias("system")))
