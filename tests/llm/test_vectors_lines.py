"""Whitening, hard negatives and line dedup against exact versions, with nulls, ties, repeats, odd lengths and clashing columns."""

import hashlib
from collections import defaultdict
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import hard_negatives, lines, queries, whitening
from docloom.llm.eigen import eigen

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"


def clashing(df):
    for name in ("id", "x", "c", "n", "tile", "anchor", "scores", "chosen", "place", "component", "mark", "at", "h1", "h2", "docs", "largest", "keeper", "lines", "kept", "batch"):
        df = df.withColumn(name, F.lit("own"))
    return df


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((300, 6)).round(2)
    v[40:60] = v[40]  # a group of copies, and ties with every anchor
    v[60:70] = 0
    rows = [(k, [float(c) for c in x], int(rng.integers(0, 4))) for k, x in enumerate(v)]
    rows += [rows[0], rows[50], rows[50], (300, None, 1), (350, [1.0] * 5 + [None], 1), (400, [1.0] * 5 + [float("nan")], 2), (401, [float("inf")] + [0.0] * 5, 2), (450, rows[3][1], None), (None, rows[4][1], 1), (451, [1.0, 2.0], 1), (500, [], 1)]
    return clashing(spark.createDataFrame(rows, VECTORS))


def whole(rows):
    return [(r["vec_id"], r["label"], r["embedding"]) for r in rows if r["embedding"] is not None and len(r["embedding"]) == 6 and all(c is not None and np.isfinite(c) for c in r["embedding"])]


@pytest.mark.parametrize("n", [1, 2, 7, 64, 101])
def test_eigen(n):
    rng = np.random.default_rng(n)
    a = rng.standard_normal((n, n))
    turn, _ = np.linalg.qr(a)
    line = np.diag(np.full(n, 2.0)) - np.eye(n, k=1) - np.eye(n, k=-1)
    for m in (a @ a.T, np.eye(n), np.zeros((n, n)), np.outer(a[0], a[0]), (turn * np.repeat([1.0, 3.0], [n // 2, n - n // 2])) @ turn.T, line, np.diag(np.geomspace(1e-12, 1, n))):
        m = (m + m.T) / 2
        values, q = eigen(m)
        want = np.linalg.eigvalsh(m)[::-1]
        scale = max(np.abs(want).max(), 1e-300)
        assert np.abs(values - want).max() <= 1e-13 * n * scale
        assert np.abs(q.T @ q - np.eye(n)).max() < 1e-12 and np.abs(m @ q - q * values).max() <= 1e-12 * scale


def test_sums_without_loss():
    rng = np.random.default_rng(3)
    high = rng.standard_normal((2500, 3)) * np.array([1e9, 1.0, 1e-7])
    low = high * rng.uniform(-1e-17, 1e-17, high.shape)
    total = whitening.gram(high, low)
    exact = [[sum((Fraction(a) + Fraction(c)) * (Fraction(b) + Fraction(d)) for a, b, c, d in zip(high[:, i], high[:, j], low[:, i], low[:, j], strict=True)) for j in range(3)] for i in range(3)]
    size = [sum(abs(h) for h in (high[:, k] ** 2).tolist()) ** 0.5 for k in range(3)]
    for i in range(3):
        for j in range(3):
            got = Fraction(float(total[0][i, j])) + Fraction(float(total[1][i, j]))
            assert abs(got - exact[i][j]) <= Fraction(size[i] * size[j]) * Fraction(2) ** -58
    split = [whitening.gram(high[a : a + 500], low[a : a + 500]) for a in range(0, 2500, 500)]
    merged = split[0]
    for more in split[1:]:
        merged = whitening.add(merged, more)
    assert np.abs(merged[0] - total[0]).max() <= 1e-15 * np.abs(total[0]).max()


def check_whitening(out, kept):
    """Rows against exact integer moments and a plain eigen-solve of the exactly rounded covariance."""
    x = [[int(np.floor(1024.0 * c)) + 100000 for c in v] for _, _, v in kept]
    n, d = len(x), len(x[0])
    s = [sum(column) for column in zip(*x, strict=True)]
    cov = [[Fraction(n * sum(r[i] * r[j] for r in x) - s[i] * s[j], n * n) for j in range(d)] for i in range(d)]
    v = np.array([[float(c) for c in r] for r in cov])
    values, q = np.linalg.eigh(v)
    values, q = values[::-1], q[:, ::-1]
    k = min(8, d)
    centred = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(r, s, strict=True)] for r in x])
    want = centred @ q[:, :k] / np.sqrt(values[:k])
    of = defaultdict(list)
    for r in out:
        assert r["n"] == n and abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-9 and r["identity_error"] < 1e-9
        of[r["component"]].append((r["vec_id"], int(r["deviation"]), r["whitened"]))
    assert sorted(of) == list(range(1, k + 1))
    deviations = [sum((n * c - t) ** 2 for c, t in zip(r, s, strict=True)) for r in x]
    null = lambda i: -1 if i is None else i
    for c, rows in of.items():
        rows = sorted(rows, key=lambda r: (null(r[0]), r[1]))
        mine = sorted(((null(i), dev, w) for (i, _, _), dev, w in zip(kept, deviations, want[:, c - 1], strict=True)), key=lambda r: r[:2])
        assert [(null(a), b) for a, b, _ in rows] == [r[:2] for r in mine]
        a, b = np.array([r[2] for r in rows]), np.array([r[2] for r in mine])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8


def test_whitening(spark, vectors):
    out = whitening.whiten(vectors).collect()
    check_whitening(out, whole(vectors.select("vec_id", "label", "embedding").collect()))


def test_whitening_query(spark):
    kept = [(r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(queries.op11_whitening(spark, SF).collect(), kept)


def test_whitening_edges(spark, vectors):
    assert whitening.whiten(vectors.limit(0)).collect() == []
    same = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)], VECTORS)).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in same)
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k], 0) for k in range(5)], VECTORS)).collect()
    assert sorted({(r["component"], r["whitened"] is None) for r in line}) == [(1, False), (2, True)] and line[0]["identity_error"] < 1e-12
    wide = whitening.whiten(spark.createDataFrame([(1, [3e9], 0), (2, [-3e9], 0)], VECTORS)).collect()
    assert {r["deviation"] for r in wide} == {Decimal(int(np.float32(3e9)) * 1024 * 2) ** 2}


def mined(kept, positives=5, negatives=3):
    out, rows = [], sorted({(i, lab, tuple(int(np.floor(256.0 * c)) for c in v)) for i, lab, v in kept if i is not None and lab is not None})
    for i in sorted({r[0] for r in rows if r[0] % 50 == 0}):
        _, lab, q = min(r for r in rows if r[0] == i)
        score = defaultdict(lambda: -(2**63))
        for j, other, x in rows:
            if other != lab or j != i:
                score[other == lab, j] = max(score[other == lab, j], sum(a * b for a, b in zip(q, x, strict=True)))
        best = sorted((-s, j) for (same, j), s in score.items() if same)[:positives]
        for p, j in best:
            fit = sorted((-s, k) for (same, k), s in score.items() if not same and 50 * -p <= 100 * s <= 95 * -p)[:negatives]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(fit, 1)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives(spark, vectors):
    kept = whole(vectors.select("vec_id", "label", "embedding").collect())
    want = mined(kept)
    assert len(want) > 20
    for tile_rows in (hard_negatives.TILE_ROWS, 11):
        got = hard_negatives.mine(vectors, tile_rows=tile_rows)
        assert got.columns == COLUMNS and sorted(map(tuple, got.collect())) == want
    assert hard_negatives.mine(vectors.limit(0)).collect() == []
    assert hard_negatives.mine(vectors.where("label = 1")).collect() == []


def test_hard_negatives_of_long_vectors(spark):
    """Scores past 2^53 are summed in whole numbers."""
    rng = np.random.default_rng(2)
    rows = [(k, [float(np.float32(c)) for c in rng.uniform(1e5, 2e6, 3)], k % 2) for k in range(60)]
    got = sorted(map(tuple, hard_negatives.mine(spark.createDataFrame(rows, VECTORS)).collect()))
    assert got == mined([(i, lab, v) for i, v, lab in rows]) and got


def test_brackets_hold_and_prune():
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((6, 16)) * 900
    x = np.floor(centres[rng.integers(0, 6, 3000)] + rng.standard_normal((3000, 16)) * 20)
    most = float((x**2).sum(axis=1).max())
    aug = hard_negatives.augmented(x, most)
    pivots = hard_negatives.choose_pivots(aug[:500])
    tile = hard_negatives.Tile(np.arange(3000), np.zeros(3000, int), x, hard_negatives.distances(aug, pivots))
    q = x[:40]
    lower, upper = tile.bracket((q**2).sum(axis=1), hard_negatives.distances(np.concatenate([q, np.zeros((40, 1))], axis=1), pivots), most)
    scores = q @ tile.x.T
    for run, (a, b) in enumerate(zip(tile.starts, tile.ends, strict=True)):
        assert (scores[:, a:b] <= upper[:, run : run + 1]).all() and (scores[:, a:b] >= lower[:, run : run + 1]).all()
    fifth = np.sort(scores, axis=1)[:, -6]
    assert (upper < fifth[:, None]).mean() > 0.5  # clusters: most runs are never opened


WS = " \t\n\x0b\x0c\r"


def kept_lines(rows, least_chars=40, least_docs=5):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(WS).translate(low)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(-1 if i is None else i)
    out = []
    for i, text in rows:
        some = (text or "").split("\n")
        gone = lambda line: len(holders.get(key(line), ())) >= least_docs and max(holders[key(line)]) != (-1 if i is None else i)  # noqa: B023, E731
        kept = [line for line in some if not gone(line)]
        out.append((-1 if i is None else i, len(some), len(some) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(6)
    pool = [f"{'É' if k % 3 else 'e'} line {k} " + "shared words of it " * (k % 4 + 1) for k in range(30)]
    rows = [(k, "\n".join(f"{' ' * int(b)}{pool[int(j)].upper() if b else pool[int(j)]}\t" for j, b in zip(rng.integers(0, 30, 12), rng.integers(0, 2, 12), strict=True)) if k % 7 else "") for k in range(120)]
    rows += [(200, None), (201, "\n\n"), (202, pool[3] + "\r\n" + pool[3] + "\n" + pool[3]), (202, "another row of that id\n" + pool[7]), rows[5], (None, pool[3] + "\n" + pool[11]), (203, "\n".join([*(f"own line {k} with enough code points to count" for k in range(20000)), *pool])), (204, "x" * 400_000 + "\n" + pool[11] + " "), (205, "\x1c" + pool[3])]
    return clashing(spark.createDataFrame(rows, "doc_id long, text string"))


def test_lines(spark, texts):
    want = kept_lines([tuple(r) for r in texts.select("doc_id", "text").collect()])
    assert sum(r[2] for r in want) > 300
    for batches, fan_out in ((4, 2), (1, 2), (7, 3)):
        got = [(-1 if r["doc_id"] is None else r["doc_id"], *r[1:]) for r in lines.drop_lines(texts, batches=batches, fan_out=fan_out).collect()]
        assert sorted(got) == want
    assert lines.drop_lines(texts.limit(0)).collect() == []
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("run_", "batch_"))]


def test_runs_are_disjoint_and_levelled(spark):
    runs = lines.LineRuns(spark, fan_out=2)
    try:
        for k in range(5):
            runs.add(spark.range(k * 50, k * 50 + 100).select(F.col("id").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(3).cast("long").alias("docs"), (F.col("id") + k).alias("largest")))
        assert [len(level) for level in runs.levels] == [1, 0, 1]
        held = [r["h1"] for t in runs.runs for r in spark.table(t).collect()]
        assert sorted(held) == list(range(300))
        got = {r["h1"]: r["keeper"] for r in runs.totals(5).collect()}
        assert got == {k: k + k // 50 for k in range(50, 250)}
    finally:
        runs.close()


def test_lines_query(spark):
    want = [(i, n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, n, gone, t in kept_lines([tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()])]
    assert sorted(map(tuple, queries.op13_lines(spark, SF).collect())) == want
