"""Block predicates and the assembly of glyphs."""

from pyspark.sql import functions as F

from docloom import schemas
from docloom.functions import blocks as B
from docloom.functions import text as X
from docloom.operators import extraction as E


def boxes(*rows):
    return F.array(*(B.box(*map(F.lit, r)) for r in rows))


def one(spark, *columns):
    return [*spark.range(1).select(*columns).first()]


def test_fonts(spark):
    names = {"ABCDEF+Lato-BoldItalic": (True, True), "Lato-CnI": (False, True), "Lato-Medium": (False, False), "Arial": (False, False), "X-DemiIt": (True, True)}
    got = spark.createDataFrame([(n,) for n in names], "f string").select("f", B.is_bold(F.col("f"), F.lit(0)), B.is_italic(F.col("f"), F.lit(0))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == names == {n: E.font_style(n, 0) for n in names}
    assert one(spark, B.is_bold(F.lit("a"), F.lit(16)), B.is_math_font(F.lit("AB+CMMI10")), B.is_math_font(F.lit("Mathias")), B.base_font(F.lit("AB+X-B")), B.font_family(F.lit("Times"))) == [True, True, True, "X-B", "serif"]


def test_lines(spark):
    aligned = boxes((10, 0, 90, 10), (10, 12, 90, 22), (10, 24, 50, 34))
    right, centred = boxes((30, 0, 90, 10), (50, 12, 90, 22)), boxes((30, 0, 70, 10), (40, 12, 60, 22))
    row, scattered = boxes((0, 0, 20, 10), (40, 2, 60, 12)), boxes((0, 0, 20, 10), (40, 12, 90, 22))
    size = F.lit(10.0)
    assert one(spark, *(B.alignment(b, size) for b in (aligned, right, centred, scattered, boxes((0, 0, 1, 1))))) == ["justify", "right", "center", None, "left"]
    assert one(spark, *(B.is_table_row(b) for b in (aligned, row))) == [False, True]
    words, figures = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("12 %"))
    assert one(spark, *(B.rewrite_by_line(b, w, size) for b, w in ((aligned, words), (row, words), (right, figures), (scattered, words)))) == [False, True, True, True]
    label = boxes((0, 0, 20, 10), (25, 1, 90, 11), (25, 13, 90, 23))
    assert one(spark, B.has_leading_label(label, F.array(F.lit("A.1"), F.lit("text"))), B.has_leading_label(aligned, words), B.has_leading_label(label, F.array(F.lit("a longer first line"), F.lit("x")))) == [True, False, False]
    assert one(spark, B.line_pitch(aligned, size, F.lit(False)), B.line_pitch(row, size, F.lit(True)), B.line_pitch(boxes((0, 0, 1, 1), (0, 90, 1, 91)), size, F.lit(False))) == [1.2, 1.15, 1.6]
    assert one(spark, B.script_position(F.lit(6.0), size, F.lit(95.0), F.lit(100.0)), B.script_position(F.lit(6.0), size, F.lit(102.0), F.lit(100.0)), B.script_position(F.lit(9.0), size, F.lit(90.0), F.lit(100.0))) == ["sup", "sub", None]
    assert one(spark, X.is_numeric(F.lit("+1,5 °C – 2")), X.is_numeric(F.lit("")), X.is_numeric(F.lit("5 kg")), X.without_symbols(F.lit("•\x07a b"))) == [True, False, False, "a b"]


def glyphs(text, line=0, block=0, x=0.0, gaps=(), **style):
    out = []
    for k, c in enumerate(text):
        x += dict(gaps).get(k, 0.0)
        base = {"page": 0, "block": block, "line": line, "pos": k, "char": c, "box": {"x0": x, "y0": line * 12.0, "x1": x + 5, "y1": line * 12.0 + 10}, "font": "Body", "size": 10.0, "color": 0, "flags": 0, "baseline": line * 12.0 + 8, "line_box": {"x0": 0.0, "y0": line * 12.0, "x1": 200.0, "y1": line * 12.0 + 10}, "dir_x": 1.0, "dir_y": 0.0}
        out.append(base | {n: f(k) for n, f in style.items()})
        x += 5
    return out


def test_assembly(spark):
    rows = glyphs("• River lev-", color=lambda k: 255 if 2 <= k <= 6 else 0) + [g | {"line": 1} for g in glyphs("els fell2 now", line=1, size=lambda k: 6.0 if k == 8 else 10.0, baseline=lambda k: 15.0 if k == 8 else 20.0)]
    rows += glyphs("10 Since then", block=1, gaps=[(3, 10.0)]) + glyphs("•  ", block=2) + [g | {"dir_x": 0.0, "dir_y": 1.0} for g in glyphs("1999", block=3)]
    df = spark.createDataFrame([{"doc_id": "d", **r} for r in rows], schemas.GLYPH)
    got = {r["pos"]: r for r in E.assemble(df).collect()}
    assert sorted(got) == [0, 1, 3]
    first = got[0]
    assert first["text"] == "River levels fell2 now" and first["lines"] == ["River lev-", "els fell2 now"] and len(first["bullet_boxes"]) == 1 and first["line_boxes"][0]["x0"] == 10.0
    assert first["markup"] == "<s1>River</s1> levels fell<s2>2</s2> now" and first["styles"]["s1"]["color"] == 255 and first["styles"]["s2"]["position"] == "sup"
    assert got[1]["text"] == "Since then" and [(b["x0"], b["x1"]) for b in got[1]["bullet_boxes"]] == [(0.0, 10.0)] and got[1]["markup"] == "Since then"
    assert got[3]["numeric"] and not got[3]["horizontal"] and got[0]["horizontal"]
    label = glyphs("A.1", block=0) + [g | {"line": 1, "line_box": {"x0": 30.0, "y0": 1.0, "x1": 99.0, "y1": 11.0}} for g in glyphs("Text", x=30.0)]
    parts = E.split_leading_labels(E.assemble(spark.createDataFrame([{"doc_id": "d", **r} for r in label], schemas.GLYPH))).orderBy("pos").collect()
    assert [(p["pos"], p["text"], p["box"]["x0"]) for p in parts] == [(0, "A.1", 0.0), (1, "Text", 30.0)]
