"""A small HTTP facade over an engine, of the standard library: JSON in, JSON out; long requests are jobs to be polled.

    GET  /health            GET  /v1/documents
    POST /v1/search {text, top_k?, mode?, doc_ids?}        POST /v1/ask {question, top_k?}
    POST /v1/summary {doc_id, focus?, lang?}               POST /v1/compare {doc_ids, topic, lang?}
    POST /v1/agent {request} -> {id}                       GET  /v1/agent/ID -> {status, result}
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import Engine
from .operators.search import MODES
from .sources import logs

MOST_CHARS, LEAST_CHARS, MOST_HITS = 500, 3, 10


class Invalid(ValueError):
    """The request cannot be used; its text goes back with status 422."""


def text_of(body: dict, name: str) -> str:
    value = body.get(name)
    if not isinstance(value, str) or not LEAST_CHARS <= len(value.strip()) <= MOST_CHARS:
        raise Invalid(f"{name}: a text of {LEAST_CHARS} to {MOST_CHARS} characters")
    return value.strip()


def top_of(body: dict) -> int | None:
    value = body.get("top_k")
    if value is not None and (not isinstance(value, int) or not 1 <= value <= MOST_HITS):
        raise Invalid(f"top_k: 1 to {MOST_HITS}")
    return value


def rows_of(df: DataFrame) -> list[dict]:
    """The few rows of one request's result."""
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns))).collect()]


class Service:
    """What the routes do; agent requests run one after another in the background, their states are a table of the folder.

    Jobs that an earlier process left unfinished count as failed once a service is made for its folder.
    """

    def __init__(self, engine: Engine):
        self.engine, self.pool, self.jobs = engine, ThreadPoolExecutor(1), logs.Jobs(engine.spark, f"{engine.root}/jobs")
        self.jobs.recover()

    def documents(self) -> list[dict]:
        return rows_of(self.engine.catalogue.orderBy("doc_id"))

    def known(self, ids: list) -> list[str]:
        if not isinstance(ids, list) or not all(isinstance(i, str) for i in ids):
            raise Invalid("doc_ids: a list of texts")
        held = {str(d["doc_id"]) for d in self.documents()}
        if lost := [i for i in ids if i not in held]:
            raise Invalid(f"unknown document(s): {', '.join(lost)}")
        return [*dict.fromkeys(ids)]

    def search(self, body: dict) -> list[dict]:
        mode = body.get("mode", "hybrid")
        if mode not in MODES:
            raise Invalid(f"mode: one of {', '.join(MODES)}")
        asked = self.engine.spark.createDataFrame([(0, text_of(body, "text"), self.known(body.get("doc_ids") or []))], "query_id long, text string, doc_ids array<string>")
        kind = self.engine.passages.schema["doc_id"].dataType
        asked = asked.withColumn("doc_ids", F.transform("doc_ids", lambda d: d.cast(kind)))
        return rows_of(self.engine.search(asked, top_of(body), mode).orderBy("rank").drop("query_id", "embed_text"))

    def ask(self, body: dict) -> dict:
        asked = self.engine.spark.createDataFrame([(0, text_of(body, "question"))], "request_id long, question string")
        return rows_of(self.engine.ask(asked, top_of(body)))[0]

    def summary(self, body: dict) -> list[dict]:
        (doc,) = self.known([body.get("doc_id")])
        asked = self.engine.spark.createDataFrame([(0, doc, body.get("focus"), body.get("lang", "fr"))], "request_id long, doc_id string, focus string, lang string")
        return rows_of(self.engine.summarize(asked)[0].orderBy("point_no"))

    def compare(self, body: dict) -> list[dict]:
        ids = self.known(body.get("doc_ids"))
        if not 2 <= len(ids) <= 3:
            raise Invalid("doc_ids: two or three different reports")
        asked = self.engine.spark.createDataFrame([(0, ids, text_of(body, "topic"), body.get("lang", "fr"))], "request_id long, doc_ids array<string>, topic string, lang string")
        return rows_of(self.engine.compare(asked)[0].orderBy("point_no"))

    def start(self, body: dict) -> dict:
        request, name = text_of(body, "request"), uuid.uuid4().hex
        self.jobs.put(self.engine.spark.createDataFrame([(name, "queued", "", 0, 0, 0)], "job_id string, status string, detail string, done int, total int, seq long").withColumn("ts", F.current_timestamp()))

        def work(tell) -> str:
            return rows_of(self.engine.run(self.engine.spark.createDataFrame([(0, request)], "request_id long, request string")))[0]["message"]

        self.pool.submit(logs.run_job, self.jobs, name, work)
        return {"id": name}

    def state(self, name: str) -> dict | None:
        """A job's state as it is on disk, where it outlives this process."""
        row = self.jobs.now().where(F.col("job_id") == name).first()
        if row is None:
            return None
        return {"status": row["status"], **({"result": row["detail"]} if row["status"] in ("done", "failed") else {})}


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is not running yet: call serve_forever, and shutdown to end it."""
    service = Service(engine)
    posts = {"/v1/search": service.search, "/v1/ask": service.ask, "/v1/summary": service.summary, "/v1/compare": service.compare, "/v1/agent": service.start}

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body) -> None:
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            if self.path == "/health":
                self.answer(200, {"status": "ok"})
            elif self.path == "/v1/documents":
                self.answer(200, service.documents())
            elif self.path.startswith("/v1/agent/") and (state := service.state(self.path.rsplit("/", 1)[1])):
                self.answer(200, state)
            else:
                self.answer(404, {"error": "not found"})

        def do_POST(self) -> None:
            if self.path not in posts:
                return self.answer(404, {"error": "not found"})
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                if not isinstance(body, dict):
                    raise Invalid("the body is a JSON object")
                return self.answer(202 if self.path == "/v1/agent" else 200, posts[self.path](body))
            except ValueError as error:  # Invalid, or no JSON
                return self.answer(422, {"error": str(error)[:200]})
            except Exception as error:  # a failed request must not end the server
                return self.answer(500, {"error": f"{type(error).__name__}: {error}"[:200]})

        def log_message(self, form: str, *values) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
