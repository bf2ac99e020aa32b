"""Event queries; tests hold their streaming forms against these."""

from pyspark.sql import functions as F

from ..streaming import runs
from .registry import Tables, query


@query("SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def event_tumbling(t: Tables):
    return runs.tumbling(t.events).select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query("""WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM m) SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 1800000000 AS "end", count(*) AS n FROM s GROUP BY user_id, session""")
def event_session(t: Tables):
    return runs.sessions(t.events).select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


_MOVE = "CASE f.status || '/' || e.event_type " + " ".join(f"WHEN '{a}/{b}' THEN '{c}'" for (a, b), c in runs.MOVES.items()) + " ELSE f.status END"


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS pos, 'queued' AS status, n FROM e UNION ALL SELECT f.user_id, e.pos, {_MOVE}, f.n FROM f JOIN e ON e.user_id = f.user_id AND e.pos = f.pos + 1)
SELECT user_id, status, pos AS seen FROM f WHERE pos = n""")
def run_state(t: Tables):
    return runs.run_states_batch(t.events)
