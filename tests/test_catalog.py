"""Every query of the catalogue against its SQL in DuckDB on the smallest tables."""

import re

import duckdb
import pytest

from docloom.plans.catalog import ORACLES, QUERIES
from docloom.plans.registry import TABLES
from docloom.streaming.runs import MOVES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return f"{v:.6g}"
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def check_states(docs, events, rows):
    state = {}
    for e in sorted(events, key=lambda e: (e["ts"], e["event_id"])):
        status, seen = state.get(e["user_id"], ("queued", 0))
        state[e["user_id"]] = MOVES.get((status, e["event_type"]), status), seen + 1
    assert {r["user_id"]: (r["status"], r["seen"]) for r in rows} == state


def check_joined(docs, events, rows):
    def join(text):
        out = ""
        for line in (text or "").split("\n"):
            line = line.strip(" ")
            if line and out.endswith("-"):
                letters = len(out) > 1 and out[-2].isalpha() and line[0].islower()
                out = (out[:-1] if letters else out) + line
            elif line:
                out = f"{out} {line}" if out else line
        return re.sub(r"[ \t\n\x0b\f\r]+", " ", out)

    assert {r["doc_id"]: r["text"] for r in rows} == {d["doc_id"]: join(d["text"]) for d in docs}


def check_chunks(docs, events, rows):
    """Packed passages: numbered without gaps, within their size, of the document's own lines in order, and all of them."""
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append(r)
    texts = {d["doc_id"]: d["text"] for d in docs}
    squeeze = lambda s: re.sub(r"\s+", "", s)
    for doc, some in of.items():
        some.sort(key=lambda r: int(r["passage_id"].rsplit(":", 1)[1]))
        assert [r["passage_id"] for r in some] == [f"{doc}:p{r['page']}:{k}" for k, r in enumerate(some)] and [r["page"] for r in some] == sorted(r["page"] for r in some)
        lines = {squeeze(x) for x in texts[doc].split("\n")}
        assert all(80 <= len(r["text"]) <= 1151 for r in some)
        assert all(r["section"] is None or squeeze(r["section"]) in lines for r in some)
        words, own = set(texts[doc].split()), [w for r in some for w in r["text"].split()]
        assert sum(w in words for w in own) >= 0.95 * len(own)  # a hard cut may part a word
    long_ = [d["doc_id"] for d in docs if d["text"] and len(d["text"]) > 400]
    assert len(set(long_) - set(of)) <= 0.1 * len(long_)


PLAIN = {"run_state": check_states, "joined_lines": check_joined, "overlap_chunks": check_chunks}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        PLAIN[name](spark.read.parquet(f"{SF}/documents.parquet").collect(), spark.read.parquet(f"{SF}/events.parquet").collect(), rows)
        return
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in sorted(df.columns)]
    assert sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in rows) == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
