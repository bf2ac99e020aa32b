"""Zones for a renderer, fonts, block translation, and the routes of a translation."""

import json

from pyspark.sql import functions as F

from docloom import schemas
from docloom.operators import planning, rebuild, translate
from docloom.providers import pseudo
from docloom.functions import language

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_zones(spark):
    d = lambda *b: dict(zip(("x0", "y0", "x1", "y1"), map(float, b), strict=True))
    base = {"doc_id": "d", "page": 0, "styles": {"s1": ("F", 255, True, False, None)}, "bullet_boxes": [], "font": "Times", "size": 10.0, "color": 0, "bold": False, "italic": False, "horizontal": True, "numeric": False}
    rows = [
        base | {"pos": 0, "box": d(10, 10, 190, 32), "text": "River levels fell", "lines": ["River levels", "fell"], "markup": "River <s1>levels</s1> fell", "line_markups": ["River <s1>levels</s1>", "fell"], "line_boxes": [d(10, 10, 190, 20), d(10, 22, 60, 32)]},
        base | {"pos": 1, "box": d(60, 100, 130, 112), "text": "Heading here", "lines": ["Heading here"], "markup": "Heading here", "line_markups": ["Heading here"], "line_boxes": [d(60, 100, 130, 112)]},
        base | {"pos": 2, "box": d(20, 24, 24, 30), "text": "x", "lines": ["x"], "markup": "x", "line_markups": ["x"], "line_boxes": [d(20, 24, 24, 30)]},
    ]
    blocks = spark.createDataFrame(rows, schemas.BLOCK)
    pages = spark.createDataFrame([("d", 0, 200.0, 300.0)], "doc_id string, page int, width double, height double")
    none = spark.createDataFrame([], f"doc_id string, page int, box {BOX}")
    up = F.udf(pseudo, "string")
    zones, erased = rebuild.zones(blocks, none, pages, lambda t: t.withColumn("translation", up("source")))
    got = {r["pos"]: r for r in zones.collect()}
    assert sorted(got) == [0, 1] and got[0]["translation"].startswith("RIVER <s1>LEVELS</s1> FELL") and '<span style="color: #0000ff' in got[0]["html"]
    assert got[0]["align"] is None and got[1]["align"] == "left" and "font-size: 10.00pt" in got[0]["css"] and "serif" in got[0]["css"] and got[0]["at"]["y1"] > 32
    assert sorted((r["pos"], r["line"]) for r in erased.collect()) == [(0, 0), (0, 1), (1, 0), (2, None)]

    def renderer(key, left, right):
        if len(left) != 2 or len(right) != 4:
            raise ValueError((len(left), len(right)))
        return {"scales": [1.0, 0.8]}

    report = rebuild.render(zones, erased, renderer).first()
    assert (report["targets"], report["mean_scale"], report["min_scale"], report["error"]) == (2, 0.9, 0.8, None)
    failed = rebuild.render(zones, erased.limit(0), renderer).first()
    assert failed["error"].startswith("ValueError") and failed["targets"] == 0
    pictures = spark.createDataFrame([("d", 0, b"a"), ("d", 1, b"b")], "doc_id string, page int, image binary")
    assert rebuild.side_by_side(pictures, pictures.where("page = 0")).count() == 1


def test_fonts(spark):
    glyphs = [("d", 0, "AA+Lato", c, 1) for c in "ab"] + [("d", 1, "BB+Lato", c, 1) for c in "abc"] + [("d", 1, "BB+Lato", " ", 0), ("d", 1, "BB+Lato", "z", 0)]
    fonts = rebuild.drawable(spark.createDataFrame(glyphs, "doc_id string, font_no int, font string, char string, ink int"))
    runs = spark.createDataFrame([("d", 0, "CC+Lato", "abba"), ("d", 1, "Lato", "a c"), ("d", 2, "Lato", "az"), ("d", 3, "Other", "a")], "doc_id string, run int, font string, text string")
    assert {r["run"]: r["font_no"] for r in rebuild.find_fonts(runs, fonts).collect()} == {0: 0, 1: 1, 2: None, 3: None}


def test_translated_blocks(spark):
    blocks = spark.createDataFrame([(0, 0, "river"), (0, 1, "a <s1>dam</s1> b"), (0, 2, "plain words"), (1, 0, "SSP1-2.6"), (1, 1, "lost <s1>tags</s1>")], "page int, pos int, text string")
    glossary = spark.createDataFrame([("river", "fleuve"), ("words", "mots")], "source string, target string")
    asked = []

    def ask(prompts):
        out = []
        for r in prompts.collect():
            user = r["messages"][1]["content"]
            asked.append((r["batch_id"], "style tags" in user, "words -> mots" in r["messages"][0]["content"]))
            texts = [b["text"] for b in json.loads(user.split("\nThe style tags")[0])["blocks"]]
            say = {"a <s1>dam</s1> b": "un dam b", "lost <s1>tags</s1>": "des <s1>balises</s1>" if "style tags" in user else "rien"}
            out.append((r["batch_id"], json.dumps({"translations": [{"id": k, "text": say.get(t, t.upper())} for k, t in enumerate(texts)]})))
        return spark.createDataFrame(out, "batch_id string, reply string")

    found, usage = translate.translate_blocks(blocks, glossary, ask, "English", "French")
    assert {(r["page"], r["pos"]): r["translation"] for r in found.collect()} == {(0, 0): "fleuve", (0, 1): "un <s1>dam</s1> b", (0, 2): "PLAIN WORDS", (1, 0): "SSP1-2.6", (1, 1): "des <s1>balises</s1>"}
    assert usage.first().asDict() == {"tags_restored": 1, "tag_repairs": 1, "tag_fallbacks": 0, "kept_locally": 2} and ("0/0", False, True) in asked and ("1/0", True, False) in asked


def test_routes(spark):
    rows = [("bad file", False, None, "en", "fr", False, None), (None, False, None, None, "fr", False, None), (None, False, None, "fr", "fr", False, None), (None, True, None, "en", "fr", False, None), (None, True, False, "en", "fr", False, None), (None, True, True, "en", "fr", False, None), (None, False, None, "en", "fr", True, None), (None, False, None, "en", "fr", False, "boom")]
    files = spark.createDataFrame(rows, "refused string, needs_confirmation boolean, confirmed boolean, source string, target string, done boolean, failed string")
    assert [r["step"] for r in planning.translation_step(files).collect()] == ["refused", "refused", "refused", "needs_confirmation", "cancelled", "rebuild", "verify", "failed"]
    calls = spark.createDataFrame([("ask", "ask"), ("search", "ask"), (None, "ask")], "tool string, expected string")
    assert planning.tool_choices(calls).first().asDict() == {"right": 1, "total": 3, "wrong": ["none for ask", "search for ask"]}
    pages = spark.createDataFrame([("a", 0, "The water of the rivers is high and it is not safe"), ("b", 0, "x")], "doc_id string, page int, text string")
    stated = spark.createDataFrame([("a", None), ("b", "fr-CA")], "doc_id string, stated string")
    assert {r["doc_id"]: r["language"] for r in language.document_languages(pages, stated).collect()} == {"a": "en", "b": "fr"}


def test_damaged_files(spark):
    """Files that a parser cannot read are told, and have no glyphs; small predicates of extraction."""
    from docloom.operators import extraction

    def parse(content):
        for k, c in enumerate(content.decode()):
            yield {"page": 0, "block": 0, "line": 0, "pos": k, "char": c}

    files = spark.createDataFrame([("a", b"ab"), ("b", b"x\xff"), ("c", b"")], "doc_id string, content binary")
    glyphs, damaged = extraction.parse_with(parse, files)
    assert sorted((r["doc_id"], r["char"]) for r in glyphs.collect()) == [("a", "a"), ("a", "b")] and glyphs.columns[0] == "doc_id" and "error" not in glyphs.columns
    assert [(r["doc_id"], r["error"].split(":")[0]) for r in damaged.collect()] == [("b", "UnicodeDecodeError")]
    assert [extraction.is_symbol(c) for c in "•\x07\ue000a\t"] == [True, True, True, False, False]
