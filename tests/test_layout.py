"""Page geometry against plain loops over points and boxes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom import schemas
from docloom.operators import layout as L

NAMES = ("x0", "y0", "x1", "y1")
BOXED = "doc_id string, page int, k int, box struct<x0:double,y0:double,x1:double,y1:double>"


def boxes_of(rng, n, width=200.0, tall=300.0):
    x, y = rng.uniform(0, width - 20, n), rng.uniform(0, tall - 20, n)
    return [(float(a), float(b), float(a + w), float(b + h)) for a, b, w, h in zip(x, y, rng.uniform(3, 60, n), rng.uniform(4, 14, n), strict=True)]


def shared(a, b):
    return max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)


def area(b):
    return (b[2] - b[0]) * (b[3] - b[1])


@pytest.fixture(scope="module")
def page(spark):
    rng = np.random.default_rng(11)
    some = boxes_of(rng, 60)
    df = spark.createDataFrame([("d", 0, k, b) for k, b in enumerate(some)], BOXED)
    return some, df


def test_meeting(page):
    some, df = page
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if shared(some[i], some[j]) > 0.3 * min(area(some[i]), area(some[j]))}
    assert want and {(r["one"], r["two"]) for r in L.overlapping_words(df, "k").collect()} == want


def test_room(spark, page):
    some, df = page
    pages = spark.createDataFrame([("d", 0, 200.0, 300.0)], "doc_id string, page int, width double, height double")
    panel = (0.0, 0.0, 150.0, 200.0)
    panels = spark.createDataFrame([("d", 0, panel)], "doc_id string, page int, box struct<x0:double,y0:double,x1:double,y1:double>")
    taken = np.zeros((301, 201), bool)
    for x0, y0, x1, y1 in some:
        taken[int(y0) : int(y1) + 1, int(x0) : int(x1) + 1] = True

    def plain(b, side, limit, gap):
        x0, y0, x1, y1 = b
        if all(panel[k] <= b[k] for k in (0, 1)) and all(panel[k] >= b[k] for k in (2, 3)):
            limit = min(limit, {"below": panel[3] - y1, "right": panel[2] - x1, "left": x0 - panel[0]}[side] - 2)
        if side == "below":
            for y in range(int(y1) + 2, min(math.floor(y1 + limit / (1 - gap)) + 3, 301)):
                if taken[y, max(int(x0) + 1, 0) : min(int(x1), 201)].any():
                    return max(min(limit, (y - y1) * (1 - gap) - 2), 0)
            return max(min(limit, 300 - y1 - 2), 0)
        rows = slice(max(int(y0) + 1, 0), min(int(y1), 301))
        if side == "right":
            for x in range(int(x1) + 2, min(math.floor(x1 + limit) + 1, 201)):
                if taken[rows, x].any():
                    return max(x - x1 - 2, 0)
            return max(min(limit, 200 - x1 - 2), 0)
        for x in range(int(x0) - 2, max(math.floor(x0 - limit) - 1, -1), -1):
            if taken[rows, x].any():
                return max(x0 - x - 2, 0)
        return max(min(limit, x0 - 2), 0)

    for side, gap in (("below", 0.0), ("below", 0.6), ("right", 0.0), ("left", 0.0)):
        got = {r["k"]: r["room"] for r in L.room(df, df.select("doc_id", "page", "box"), panels, pages, side, F.lit(40.0), gap).collect()}
        assert {k: round(v, 6) for k, v in got.items()} == {k: round(plain(b, side, 40.0, gap), 6) for k, b in enumerate(some)}, side


def block(pos, lines, boxes, **other):
    d = lambda b: dict(zip(NAMES, map(float, b), strict=True))
    around = (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes))
    base = {"doc_id": "d", "page": 0, "pos": pos, "box": d(around), "text": " ".join(lines), "lines": lines, "markup": " ".join(lines), "line_markups": lines, "styles": {}, "line_boxes": [d(b) for b in boxes], "bullet_boxes": [], "font": "F", "size": 10.0, "color": 0, "bold": False, "italic": False, "horizontal": True, "numeric": False}
    return base | other


@pytest.fixture(scope="module")
def blocks(spark):
    rows = [
        block(0, ["Rivers and lakes of the north", "fell again"], [(10, 10, 190, 20), (10, 22, 100, 32)], bullet_boxes=[dict(zip(NAMES, (2.0, 10.0, 8.0, 20.0), strict=True))]),
        block(1, ["Left", "12 %", "cell"], [(10, 50, 40, 60), (50, 50, 80, 60), (90, 50, 120, 60)]), block(2, ["1999"], [(10, 80, 30, 90)], numeric=True),
        block(3, ["x"], [(20, 24, 24, 30)]), block(4, ["rotated words"], [(150, 80, 160, 180)], horizontal=False), block(5, ["Heading here"], [(60, 100, 130, 112)]),
    ]
    return spark.createDataFrame(rows, schemas.BLOCK)


def test_targets(spark, blocks):
    targets = L.plan_targets(blocks).cache()
    got = {(r["pos"], r["line"]): r["source"] for r in targets.collect()}
    assert got == {(0, None): "Rivers and lakes of the north fell again", (1, 0): "Left", (1, 2): "cell", (5, None): "Heading here"}
    erased = L.inline_fragments(blocks, targets)
    assert [r["pos"] for r in erased.collect()] == [3]
    kept = L.protected_boxes(blocks, targets, erased)
    assert sorted(tuple(r["box"]) for r in kept.collect()) == [(2.0, 10.0, 8.0, 20.0), (10.0, 80.0, 30.0, 90.0), (50.0, 50.0, 80.0, 60.0), (150.0, 80.0, 160.0, 180.0)]
    cut = {(r["pos"], r["line"]): tuple(r["box"]) for r in L.redaction_boxes(targets, kept).collect()}
    assert cut[0, 0] == (10.5, 10.5, 189.5, 19.5) and cut[1, 0] == (10.5, 50.5, 39.5, 59.5)
    near = spark.createDataFrame([("d", 0, dict(zip(NAMES, (5.0, 9.0, 15.0, 19.0), strict=True))), ("d", 0, dict(zip(NAMES, (0.0, 31.0, 90.0, 45.0), strict=True)))], "doc_id string, page int, box struct<x0:double,y0:double,x1:double,y1:double>")
    cut = {(r["pos"], r["line"]): tuple(r["box"]) for r in L.redaction_boxes(targets, near).collect()}
    assert cut[0, 0] == (15.5, 10.5, 189.5, 19.5) and cut[0, 1] == (10.5, 22.5, 99.5, 30.5)


def test_insert_and_columns(spark, blocks):
    targets, pages = L.plan_targets(blocks), spark.createDataFrame([("d", 0, 200.0, 300.0)], "doc_id string, page int, width double, height double")
    around, panels = L.obstacles(blocks, spark.createDataFrame([("d", 0, dict(zip(NAMES, (0.0, 95.0, 199.0, 290.0), strict=True)))], "doc_id string, page int, box struct<x0:double,y0:double,x1:double,y1:double>"))
    assert panels.count() == 1
    spots = {(r["pos"], r["line"]): tuple(round(v, 3) for v in r["box"]) for r in L.insert_boxes(targets, around, panels, pages).collect()}
    assert spots[0, None] == (10.0, 10.0, 195.0, round(32 + (50 - 32) * 0.4 - 2, 3)) and spots[5, None][2] == 135.0
    bodies = L.body_boxes(blocks)
    assert sorted(tuple(r["box"]) for r in bodies.collect()) == [(10.0, 10.0, 190.0, 32.0), (10.0, 50.0, 120.0, 60.0)]
    lines = {r["pos"]: (tuple(r["box"]), r["align"]) for r in L.single_line_boxes(targets.where("pos = 5"), bodies, around, panels, pages).collect()}
    assert lines[5] == ((60.0, 100.0, 148.0, 112.0), "left")


def test_reports(spark, blocks):
    needs = spark.createDataFrame([("a", 0.9), ("a", 0.8), ("a", 1.0), ("a", 0.7), ("b", 1.0)], "style string, needed double")
    assert {r["style"]: r["scale"] for r in L.group_scales(needs).collect()} == {"a": 0.8, "b": 1.0}
    pages = spark.createDataFrame([("d", 3, 0.9, 0.7), ("d", 1, 0.5, 0.5), ("e", 0, None, None)], "doc_id string, targets int, mean_scale double, min_scale double")
    assert {r["doc_id"]: (r["zones"], r["mean_scale"], r["min_scale"]) for r in L.document_report(pages, ["doc_id"]).collect()} == {"d": (4, 0.8, 0.5), "e": (0, 1.0, None)}
    word = "doc_id string, page int, word int, text string, box struct<x0:double,y0:double,x1:double,y1:double>"
    words = spark.createDataFrame([("d", 0, 0, "19", (10.0, 80.0, 18.0, 90.0)), ("d", 0, 1, "99", (20.0, 80.0, 30.0, 90.0)), ("d", 0, 2, "Rivers", (12.0, 10.0, 40.0, 20.0)), ("d", 0, 3, "lakes", (50.0, 10.0, 60.0, 20.0))], word)
    zones = spark.createDataFrame([("d", 0, 0, (10.0, 10.0, 190.0, 32.0), "<s1>Rivers</s1> lakes NORTH", "FLÜSSE"), ("d", 0, 1, (10.0, 200.0, 60.0, 220.0), "tiny", "text")], "doc_id string, page int, zone int, box struct<x0:double,y0:double,x1:double,y1:double>, source string, translation string")
    checked, numbers = L.residual_words(zones, words), L.kept_numbers(blocks, words)
    assert {r["zone"]: (r["empty"], r["checked"], r["residual"]) for r in checked.collect()} == {0: (False, True, True), 1: (True, False, False)}
    assert [(r["pos"], r["line"], r["kept"]) for r in numbers.orderBy("pos").collect()] == [(1, 1, False), (2, 0, True)]
    side = spark.createDataFrame([("d", 0, 1, 4, 0, 0)], "doc_id string, page int, images int, drawings int, overlaps int, tags int")
    got = L.verify(side, side.withColumn("tags", F.lit(2)), checked, numbers).first()
    assert (got["pages"], got["pages_same_images"], got["markup_leaks"], got["zones_checked"], got["residual_source"], got["empty_zones"], got["numbers_kept"], got["numbers_total"], got["lost_numbers"], got["ok"]) == (1, 1, 2, 1, 1, 1, 1, 2, ["p1: 12 %"], False)
    with pytest.raises(Exception, match="different pages"):
        L.verify(side, side.withColumn("page", F.lit(1)), checked, numbers).collect()
    sizes = spark.createDataFrame([("d", 0, 200.0, 300.0), ("d", 1, 200.0, 300.0)], "doc_id string, page int, width double, height double")
    drawn = spark.createDataFrame([("d", 0, (0.0, 0.0, 5.0, 5.0)), ("d", 0, (-9.0, 0.0, -1.0, 5.0))], "doc_id string, page int, box struct<x0:double,y0:double,x1:double,y1:double>")
    assert {r["page"]: r["drawings"] for r in L.visible_drawings(drawn, sizes).collect()} == {0: 1, 1: 0}


def test_sweep_line():
    """The sweep against every pair of boxes and obstacles, empty stretches and far coordinates too."""
    import random

    from docloom.operators.sweep import FREE, few_ahead, first_ahead

    rng = random.Random(8)
    for n in (0, 1, 3, 40, 200):
        wide = rng.choice([30, 10**6])
        asked = [(a := rng.randrange(wide), a + rng.randrange(-1, 9), rng.randrange(60)) for _ in range(n)]
        taken = [(a := rng.randrange(wide), a + rng.randrange(20), b := rng.randrange(60), b + rng.randrange(9)) for _ in range(n)]
        taken += [(0, wide, 59, 61)] * (n > 3)
        want = [min((max(near, s) for a, b, near, far in taken if a <= high and b >= low and far >= s), default=None) for low, high, s in asked]
        assert first_ahead(asked, taken) == want
        if n:
            low, high, start = np.array(asked).T
            assert [None if c == FREE else c for c in few_ahead(low, high, start, np.array(taken).T).tolist()] == want
    assert first_ahead([(0, 5, 0)], []) == [None]


def test_pages_swept_together(monkeypatch):
    """Small pages of a batch are looked at in one go, pages without boxes or without obstacles among them."""
    from docloom.operators import sweep

    monkeypatch.setattr(sweep, "PAIRS", 50)
    rng = np.random.default_rng(5)
    page, of = np.sort(rng.integers(0, 40, 150)), np.sort(rng.integers(0, 40, 150) // 2 * 2)
    low, start = rng.integers(0, 60, 150), rng.integers(0, 60, 150)
    high, taken = low + rng.integers(-2, 9, 150), rng.integers(0, 60, (4, 150))
    taken[1] += 20
    want = [min((max(n, s) for a, b, n, f in taken[:, of == p].T.tolist() if a <= h and b >= lo and f >= s), default=sweep.FREE) for p, lo, h, s in zip(page, low.tolist(), high.tolist(), start.tolist(), strict=True)]
    assert sweep.pages_ahead(low, high, start, page, taken, of).tolist() == want


def test_text_columns_by_page(spark, monkeypatch):
    """A page's paragraphs meet its boxes as one list, not pair by pair; partitions grow with the rows."""
    from docloom import storage

    rows = [("d", p, k, (float(10 * k), 0.0, float(10 * k + 15), 9.0)) for p in range(30) for k in range(1 + p % 4)]
    b = spark.createDataFrame(rows, BOXED)
    bodies = b.where("k <> 1 and page <> 8")
    found = L.text_columns(b, bodies)
    assert "Generate" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and plan.count("Join") == 1
    bare = {(r["page"], r["k"]): (r["left"], r["right"]) for r in found.collect()}
    for _, p, k, (x0, _, x1, _) in rows:
        own = [(10.0 * j, 10.0 * j + 15) for j in range(1 + p % 4) if j != 1 and p != 8]
        over = [o for o in own if o[0] - 2 <= x0 < o[1]] or own or [(x0, x1)]
        assert bare[p, k] == (min(o[0] for o in over), max(o[1] for o in over))
    monkeypatch.setattr(storage, "ROWS", 4)
    assert storage.dealt(b, "page").rdd.getNumPartitions() == -(-len(rows) // 4)
