"""Retrieval and evaluation queries: benchmark passages asked of documents, vectors of embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, tokens
from ..operators import evaluate
from ..functions.text import pseudo_translate
from ..operators.dense import Cells, dense_topk, text_vectors
from ..operators.retrieval import fuse, hash_embedding, l2_normalise, latest, missing, postings
from ..operators.lexical import FORMAT, Index, spread_out
from ..operators.patterns import found_in
from ..sources.snapshots import Conflict, versioned
from ..sources.vectors import point_id
from ..storage import path_for, written
from .registry import Tables, query

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def duck_tokens(name: str, table: str, key: str, text: str = "text") -> str:
    return f"""{name}_w AS (SELECT {key} AS id, unnest(regexp_extract_all(strip_accents(lower(coalesce({text}, ''))), '[a-z0-9]+(?:[.,\\-/][a-z0-9]+)*')) AS t FROM {table}),
{name} AS (SELECT id, CASE WHEN length(t) > 4 AND regexp_full_match(t, '[a-z]+') AND regexp_matches(t, '[^su][sx]$') THEN left(t, length(t) - 1) ELSE t END AS term FROM {name}_w WHERE length(t) > 1 AND t NOT IN ({_STOP}))"""


def duck_bm25(name: str, terms: str, k: int = 20, among: str = "") -> str:
    return f"""{name}_s AS (SELECT q.id AS query_id, p.id, round(sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * l.dl / s.avgdl))), 5) AS score
  FROM (SELECT DISTINCT id, term FROM {terms}) q JOIN post p USING (term) JOIN df d USING (term) JOIN dl l ON l.id = p.id, st s GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_s {among}) WHERE rank <= {k})"""


_INDEX = f"""{duck_tokens('tok', 'documents', 'doc_id')}, post AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id AS id, coalesce(n, 0) AS dl FROM documents LEFT JOIN (SELECT id, count(*) AS n FROM tok GROUP BY id) x ON x.id = doc_id),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)"""
_BM25 = f"{_INDEX}, {duck_tokens('qt', 'benchmark', 'item_id')}, {duck_bm25('lex', 'qt')}"


def duck_vectors(name: str, terms: str) -> str:
    bucket = "(strpos('0123456789abcdef', substr(md5(term), 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(md5(term), 2, 1)) - 1"
    return f"""{name}_c AS (SELECT id, {bucket} AS bucket, count(*) AS n FROM {terms} GROUP BY ALL),
{name} AS (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS x FROM {name}_c)"""


def duck_dense(name: str, vectors: str, asked: str, k: int = 20) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM
  (SELECT d.id AS query_id, v.doc_id AS id, round(coalesce(sum(a.x * d.x), 0), 5) AS score FROM (SELECT DISTINCT id FROM {asked}) q CROSS JOIN (SELECT DISTINCT id AS doc_id FROM {vectors}) v
   JOIN {asked} d ON d.id = q.id LEFT JOIN {vectors} a ON a.id = v.doc_id AND a.bucket = d.bucket GROUP BY ALL)) WHERE rank <= {k})"""


def duck_fuse(name: str, lists: list[str], k: int = 20) -> str:
    rows = " UNION ALL ".join(f"SELECT query_id, id, rank, {n} AS list FROM {x}" for n, x in enumerate(lists))
    ranks = ", ".join(f"min(CASE WHEN list = {n} THEN rank END) AS rank_{n}" for n in range(len(lists)))
    return f"""{name}_u AS ({rows}), {name} AS (SELECT * EXCLUDE (seen) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank FROM
  (SELECT query_id, id, round(sum(1.0 / (60 + CAST(rank AS DOUBLE))), 8) AS score, min(list * 1000 + rank) AS seen, {ranks} FROM {name}_u GROUP BY query_id, id)) WHERE rank <= {k})"""


_DENSE = f"{duck_vectors('dv', 'tok')}, {duck_vectors('qv', 'qt')}, {duck_dense('den', 'dv', 'qv')}"
_HYBRID = f"{_BM25}, {_DENSE}, {duck_fuse('hyb', ['den', 'lex'])}"
_TRUTH = "truth AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def index_of(t: Tables) -> Index:
    """The index of the documents: built once, then shared by all queries over the same files."""
    path = path_for(t.documents, f"index-{FORMAT}")
    index = Index(t.spark, path)
    try:
        return index if index.version is not None else Index.build(t.documents, path, "doc_id")
    except Conflict:  # another session was faster
        return Index(t.spark, path)


def lexical(t: Tables, index: Index | None = None, asked=None, k: int = 20, among=None):
    asked = t.benchmark if asked is None else asked
    return (index or index_of(t)).lexical(asked.select(F.col("item_id").alias("query_id"), "text"), k, among)


def dense_text(t: Tables, index: Index, asked=None, k: int = 20):
    own = text_vectors(t.benchmark if asked is None else asked, "item_id", "text").withColumnRenamed("id", "query_id")
    vectors = index.table("vectors", index.vectors)
    return dense_topk(vectors, own, k, same_ids=False)


def truth(t: Tables):
    """(query_id, id): documents that hold an item's text; all items are looked for in one pass over the documents."""
    items = t.benchmark.select(F.col("item_id").alias("pattern_id"), F.col("text").alias("pattern"), F.lit(True).alias("exact"))
    met = found_in(spread_out(t.documents.select(F.col("doc_id").alias("text_id"), "text")), items, whole_words=False)
    return met.select(F.col("pattern_id").alias("query_id"), F.col("text_id").alias("id"))


def systems(t: Tables):
    index = index_of(t)
    asked, true = t.benchmark.select(F.col("item_id").alias("query_id")), written(truth(t), "truth")
    lex, den = written(lexical(t, index), "lexical"), written(dense_text(t, index), "dense")
    named = {"bm25": lex, "dense": den, "hybrid": fuse([den, lex])}
    out = None
    for name, ranking in named.items():
        ranks = evaluate.first_hits(ranking, true, asked).withColumn("system", F.lit(name))
        out = ranks if out is None else out.unionByName(ranks)
    return out


_SYSTEMS = f"""{_HYBRID}, {_TRUTH}, allr AS (SELECT 'bm25' AS system, query_id, id, rank FROM lex UNION ALL SELECT 'dense', query_id, id, rank FROM den UNION ALL SELECT 'hybrid', query_id, id, rank FROM hyb),
ranks AS (SELECT s.system, item_id AS query_id, r.rank FROM benchmark CROSS JOIN (SELECT unnest(['bm25', 'dense', 'hybrid']) AS system) s
  LEFT JOIN (SELECT system, query_id, min(rank) AS rank FROM allr JOIN truth USING (query_id, id) GROUP BY ALL) r ON r.system = s.system AND r.query_id = item_id)"""
_MEASURES = "CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS hit1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS hit5, round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END), 6) AS mrr10"


@query(f"WITH {duck_tokens('tok', 'documents', 'doc_id')} SELECT id AS doc_id, term, count(*) AS tf FROM tok GROUP BY ALL")
def tok_terms(t: Tables):
    return postings(t.documents, "doc_id", "text").select(F.col("id").alias("doc_id"), "term", "tf")


@query(f"WITH {_INDEX} SELECT id AS doc_id, CAST(dl AS BIGINT) AS dl FROM dl")
def tok_doc_len(t: Tables):
    return t.documents.select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("dl"))


@query(f"WITH {_INDEX} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, st")
def term_df_idf(t: Tables):
    df = postings(t.documents, "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"))
    size = t.documents.agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(size)).select("term", "df", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


@query(f"WITH {_BM25} SELECT query_id AS item_id, id AS doc_id, score, rank FROM lex")
def bm25_top20(t: Tables):
    return lexical(t).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


@query(f"WITH {_INDEX}, {duck_tokens('qt', 'benchmark', 'item_id')}, {duck_bm25('lex', 'qt', 20, 'WHERE id IN (SELECT doc_id FROM documents WHERE source IN (' + chr(39) + 'src0' + chr(39) + ', ' + chr(39) + 'src3' + chr(39) + '))')} SELECT query_id AS item_id, id AS doc_id, score, rank FROM lex")
def bm25_doc_filter(t: Tables):
    among = t.documents.where(F.col("source").isin("src0", "src3")).select(F.col("doc_id").alias("id"))
    return lexical(t, among=among).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


@query(f"WITH {_BM25} SELECT query_id AS item_id, id AS doc_id, score, rank FROM lex")
def bm25_appended(t: Tables):
    """The same ranking from an index that grew by four segments, which a tier has merged."""
    path, parts = path_for(t.documents, f"appended-{FORMAT}"), 4
    index = Index(t.spark, path)
    for k in range(parts):
        if index.version is None or index.version <= k:
            some = t.documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) <= k)  # what is there already is left out
            index = index.add(some, "doc_id") if k else Index.build(some, path, "doc_id")
    return lexical(t, index).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


_EMB = """WITH p AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 5) AS score FROM embeddings q JOIN embeddings v
  ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id {0}) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p) WHERE rank <= 10"""


def _vectors(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


@query(_EMB.format(""))
def dense_top10(t: Tables):
    v = _vectors(t)
    return dense_topk(v, v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 10)


@query(_EMB.format("AND v.label IN (1, 4)"))
def dense_filtered(t: Tables):
    v = _vectors(t)
    return dense_topk(v.where("label IN (1, 4)"), v.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 10)


@query("SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def dense_cells_recall(t: Tables):
    """Queries, and whether the cells that a query probes by default hold at least nine tenths of its ten nearest."""
    v = _vectors(t).select("id", "v")
    asked = v.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    path = path_for(t.embeddings, "cells")
    cells = Cells(t.spark, path) if versioned(t.spark, path) else Cells.build(v, path)
    exact = dense_topk(v, asked, 10).select("query_id", "id")
    hits = exact.join(cells.topk(asked, 10).select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.agg(F.countDistinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


@query("""WITH p AS (SELECT q.vec_id AS query_id, q.label AS ql, v.label AS vl, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 5) DESC, v.vec_id) AS rank
  FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id) SELECT ql AS label, count(DISTINCT query_id) AS queries, round(avg(CASE WHEN ql = vl THEN 1.0 ELSE 0 END), 6) AS precision10 FROM p WHERE rank <= 10 GROUP BY ql""")
def dense_label_precision(t: Tables):
    labels = _vectors(t).select("id", "label")
    hits = dense_top10(t).join(labels.select("id", F.col("label").alias("vl")), "id").join(labels.select(F.col("id").alias("query_id"), "label"), "query_id")
    return hits.groupBy("label").agg(F.countDistinct("query_id").alias("queries"), F.round(F.avg((F.col("label") == F.col("vl")).cast("int")), 6).alias("precision10"))


@query(f"WITH {duck_tokens('tok', 'documents', 'doc_id')}, {duck_vectors('dv', 'tok')} SELECT id AS doc_id, CAST(bucket AS INT) AS bucket, n FROM dv_c")
def hash_embed(t: Tables):
    return hash_embedding(t.documents, "doc_id", "text").select(F.col("id").alias("doc_id"), "bucket", "n")


@query("SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 5) AS square, round(embedding[1] / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 5) AS first FROM embeddings")
def l2_normalised(t: Tables):
    unit = l2_normalise(F.col("embedding"))
    return t.embeddings.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 5).alias("square"), F.round(unit[0], 5).alias("first"))


@query(f"WITH {_HYBRID} SELECT query_id AS item_id, id AS doc_id, score, rank FROM hyb")
def rrf_hybrid(t: Tables):
    index = index_of(t)
    return fuse([dense_text(t, index), lexical(t, index)]).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


@query(f"WITH {_HYBRID} SELECT query_id AS item_id, id AS doc_id, rank, rank_0 AS dense_rank, rank_1 AS bm25_rank FROM hyb WHERE rank <= 5")
def hybrid_explain_ranks(t: Tables):
    index = index_of(t)
    return fuse([dense_text(t, index), lexical(t, index)], 5).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "rank", F.col("rank_0").alias("dense_rank"), F.col("rank_1").alias("bm25_rank"))


@query(f"WITH {_SYSTEMS} SELECT system, query_id AS item_id, rank FROM ranks")
def retrieval_hits(t: Tables):
    return systems(t).select("system", F.col("query_id").alias("item_id"), "rank")


@query(f"WITH {_SYSTEMS} SELECT system, CAST(query_id % 3 AS INT) AS kind, {_MEASURES} FROM ranks GROUP BY system, query_id % 3 UNION ALL SELECT system, NULL, {_MEASURES} FROM ranks GROUP BY system")
def hit_mrr_by_type(t: Tables):
    ranks = systems(t).withColumn("kind", (F.col("query_id") % 3).cast("int"))
    return evaluate.summary(ranks, ["system", "kind"]).unionByName(evaluate.summary(ranks, ["system"]).withColumn("kind", F.lit(None).cast("int")))


_P = """CASE WHEN {0} + {1} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, CAST(least({0}, {1}) AS BIGINT) + 1), lambda i: exp(lgamma({0} + {1} + 1) - lgamma(i + 1) - lgamma({0} + {1} - i + 1)) / pow(2.0, {0} + {1})))) END"""


@query(f"""WITH {_SYSTEMS}, c AS (SELECT a.system AS system_a, b.system AS system_b, count(*) FILTER (coalesce(a.rank <= 5, false) AND NOT coalesce(b.rank <= 5, false)) AS hit_wins, count(*) FILTER (NOT coalesce(a.rank <= 5, false) AND coalesce(b.rank <= 5, false)) AS hit_losses,
  count(*) FILTER (CASE WHEN a.rank <= 10 THEN a.rank ELSE 11 END < CASE WHEN b.rank <= 10 THEN b.rank ELSE 11 END) AS rank_wins, count(*) FILTER (CASE WHEN a.rank <= 10 THEN a.rank ELSE 11 END > CASE WHEN b.rank <= 10 THEN b.rank ELSE 11 END) AS rank_losses
  FROM ranks a JOIN ranks b ON a.query_id = b.query_id AND a.system < b.system GROUP BY ALL) SELECT *, round({_P.format('hit_wins', 'hit_losses')}, 6) AS hit_p, round({_P.format('rank_wins', 'rank_losses')}, 6) AS rank_p FROM c""")
def paired_mcnemar(t: Tables):
    return evaluate.paired(systems(t))


# the second wording of a question is its pseudo-translation
_UPPER = "rtrim(upper(replace(text, 'ß', 'ss')))"
_CUT = f"(SELECT item_id, CASE WHEN trim(text) = '' OR CAST(ceil(length(trim(text)) * 0.2) AS INT) < 2 THEN {_UPPER} ELSE {_UPPER} || ' ' || lower(rtrim(substr(trim(text) || ' ' || trim(text), 1, CAST(ceil(length(trim(text)) * 0.2) AS INT) - 1))) END AS text FROM benchmark)"
_STRATEGY = {"original": ["den", "lex"], "translated": ["den2", "lex2"], "both": ["den", "lex", "den2", "lex2"], "bm25_both": ["den", "lex", "lex2"], "bm25_x2": ["den", "lex", "lex"]}


@query(f"WITH {_BM25}, {_DENSE}, {duck_tokens('qt2', _CUT, 'item_id')}, {duck_bm25('lex2', 'qt2')}, {duck_vectors('qv2', 'qt2')}, {duck_dense('den2', 'dv', 'qv2')}, " + ", ".join(duck_fuse(f"f_{s}", lists, 10) for s, lists in _STRATEGY.items()) + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS strategy, query_id AS item_id, id AS doc_id, score, rank FROM f_{s}" for s in _STRATEGY) + ")")
def strategy_union(t: Tables):
    index, other = index_of(t), t.benchmark.withColumn("text", pseudo_translate(F.col("text")))
    lists = {"lex": lexical(t, index), "lex2": lexical(t, index, other), "den": dense_text(t, index), "den2": dense_text(t, index, other)}
    lists = {n: written(r, n) for n, r in lists.items()}
    out = None
    for name, parts in _STRATEGY.items():
        fused = fuse([lists[p] for p in parts], 10).select(F.lit(name).alias("strategy"), F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")
        out = fused if out is None else out.unionByName(fused)
    return out


@query("SELECT sha256('m1' || chr(10) || text) AS point_id, doc_id FROM documents WHERE lang <> 'en' AND sha256('m1' || chr(10) || text) NOT IN (SELECT sha256('m1' || chr(10) || text) FROM documents WHERE lang = 'en')")
def missing_vectors(t: Tables):
    """Documents in other languages whose text is not indexed yet, where the English ones are."""
    keyed = t.documents.select(point_id("m1", F.col("text")).alias("point_id"), "doc_id", "lang")
    return missing(keyed.where("lang <> 'en'"), keyed.where("lang = 'en'"), "point_id").drop("lang")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def upsert_latest(t: Tables):
    return latest(t.events, "user_id", [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "ts", "event_id")


@query("SELECT sha256(coalesce(text, '')) AS content, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(t: Tables):
    return t.documents.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("content")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).where("copies > 1")


@query(f"WITH {_TRUTH} SELECT query_id AS item_id, id AS doc_id FROM truth")
def grounded_contamination(t: Tables):
    return truth(t).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"))

