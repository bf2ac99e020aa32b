import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from docloom.streaming import runs

SF = "/root/testdata/sf0.001"


def _stream(spark, tmp_path, name="events"):
    events = spark.read.parquet(f"{SF}/{name}.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    return events, spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))


def test_windows_match_batch(spark, tmp_path):
    events, stream = _stream(spark, tmp_path)
    runs.tumbling(stream, late="1 hour").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    want = {tuple(r) for r in runs.tumbling(events).select("start", "event_type", "n").collect()}
    assert {tuple(r) for r in spark.table("windows").select("start", "event_type", "n").collect()} == want


def _states(spark, tmp_path, parts, **options):
    """(key -> last status and count, all rows) after the parts have arrived one after the other; the last row of all is far later."""
    kinds = "event_id long, ts timestamp, user_id long, event_type string"
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, kinds).coalesce(1).write.json(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
    found = []
    query = runs.run_states(stream, **options).writeStream.outputMode("update").foreachBatch(lambda b, i: found.extend((i, *r) for r in b.collect()))
    query.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    return {k: (s, n) for _, k, s, n in sorted(found, key=lambda x: x[0])}, found


def test_run_states_in_any_order(spark, tmp_path):
    """Events dealt to micro-batches out of order, and a key with more rows than an Arrow batch."""
    rng = random.Random(3)
    at = lambda minute: datetime(2024, 1, 1) + timedelta(minutes=minute)
    kinds = ["view", "click", "signup", "purchase", "error"]
    events = [(n, at(rng.randrange(600)), rng.randrange(9), rng.choice(kinds[:3] if rng.random() < 0.9 else kinds)) for n in range(900)]
    events += [(1000 + n, at(n), 77, kinds[n % 3]) for n in range(150)]
    parts, order = [[] for _ in range(4)], sorted(events, key=lambda e: e[1] + timedelta(minutes=rng.randrange(300)))
    for n, e in enumerate(order):
        parts[n * 4 // len(order)].append(e)
    for p in parts:
        rng.shuffle(p)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        last, found = _states(spark, tmp_path, [*parts, [(-1, at(100_000), -1, "view")]], late="12 hours")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    batch = spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string")
    assert {k: v for k, v in last.items() if k >= 0} == {r["user_id"]: (r["status"], r["seen"]) for r in runs.run_states_batch(batch).collect()}
    assert last[77][1] == 150


def test_run_states_forget(spark, tmp_path):
    at = lambda hour: datetime(2024, 1, 1) + timedelta(hours=hour)
    parts = [[(1, at(1), 5, "view"), (2, at(3), 5, "click")], [(3, at(30), 6, "view")], [(4, at(60), 5, "view")], [(5, at(61), -1, "view")], [(6, at(90), -1, "view")]]
    last, found = _states(spark, tmp_path, parts, late="1 hour", forget_ms=10 * 3600 * 1000)
    assert [(s, n) for _, k, s, n in sorted(found) if k == 5] == [("running", 1), ("needs_confirmation", 2), ("forgotten", 2), ("running", 1), ("forgotten", 1)]


def test_index_is_incremental(spark, tmp_path):
    docs, stream = _stream(spark, tmp_path, "documents")
    for _ in range(2):
        runs.index_new(stream, str(tmp_path / "index"), str(tmp_path / "check")).awaitTermination()
    docs.limit(5).write.mode("append").parquet(str(tmp_path / "in"))
    runs.index_new(stream, str(tmp_path / "index"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "index"))
    assert got.count() == docs.count() == got.select(F.countDistinct("doc_id")).first()[0]


def test_live_state_and_progress(spark, tmp_path):
    from docloom.sources.logs import Trace

    events, stream = _stream(spark, tmp_path)
    listener = runs.Progress(Trace(spark, str(tmp_path / "trace")))
    spark.streams.addListener(listener)
    try:
        runs.live_state(stream).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    assert {tuple(r) for r in spark.table("live").collect()} == {tuple(r) for r in runs.live_state(events).collect()}
    listener.trace.flush()
    assert {"started", "progress", "ended"} >= {r["name"] for r in listener.trace.rows().collect()} >= {"started"}
