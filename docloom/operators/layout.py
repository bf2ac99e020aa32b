"""Geometry of pages: boxes that meet, what may be rewritten, free space around it, and the checks of a rebuilt page.

Tables of boxes have (doc_id, page) and a key of their own; blocks are schemas.BLOCK; `pages` has (doc_id, page, width,
height). Boxes meet only within a page: overlaps go through a grid of cells, all else is an equi-join on the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import blocks as B
from ..functions import text as X
from .sweep import with_cells

PAGE = ["doc_id", "page"]
CELL = 20
OVERLAP_SHARE, STACKED_SHARE, INSIDE_SHARE = 0.3, 0.4, 0.5
#: Points that a redaction keeps off its line, and the share of a gap that new text may not fill.
MARGIN, KEEP_GAP = 0.5, 0.6
PANEL_AREA = 400


# Boxes that meet --------------------------------------------------------------------------------------------------


def meeting(boxes: DataFrame, key: str, share: float, least_area: float = 0.0) -> DataFrame:
    """(PAGE, one, two): pairs whose shared area is over `share` of the smaller box, itself over least_area.

    Boxes are laid on cells of CELL points, so that only neighbours are paired.
    """
    cells = lambda a, b: F.sequence(F.floor(F.col(a) / CELL).cast("int"), F.floor(F.col(b) / CELL).cast("int"))
    laid = boxes.select(*PAGE, key, "box").withColumn("cx", F.explode(cells("box.x0", "box.x1"))).withColumn("cy", F.explode(cells("box.y0", "box.y1")))
    a = laid.select(*PAGE, "cx", "cy", F.col(key).alias("one"), F.col("box").alias("a"))
    b = laid.select(*PAGE, "cx", "cy", F.col(key).alias("two"), F.col("box").alias("b"))
    smaller = F.least(B.area(F.col("a")), B.area(F.col("b")))
    met = a.join(b, [*PAGE, "cx", "cy"]).where((F.col("one") < F.col("two")) & (smaller > least_area) & (B.shared_area(F.col("a"), F.col("b")) > share * smaller))
    return met.select(*PAGE, "one", "two").distinct()


def overlapping_words(words: DataFrame, key: str = "word") -> DataFrame:
    return meeting(words, key, OVERLAP_SHARE, 1.0)


def block_lines(blocks: DataFrame) -> DataFrame:
    """(PAGE, pos, line, box, text, markup) of every line of the blocks."""
    lines = F.arrays_zip(F.col("line_boxes").alias("box"), F.col("lines").alias("text"), F.col("line_markups").alias("markup"))
    return blocks.select(*PAGE, "pos", F.posexplode(lines).alias("line", "l")).select(*PAGE, "pos", "line", "l.box", "l.text", "l.markup")


def stacked_lines(blocks: DataFrame) -> DataFrame:
    """(PAGE, pos, line) of lines drawn upon another one, as a symbol with its scripts is."""
    lines = block_lines(blocks).withColumn("key", F.struct("pos", "line"))
    pairs = meeting(lines, "key", STACKED_SHARE)
    return pairs.select(*PAGE, F.explode(F.array("one", "two")).alias("k")).select(*PAGE, "k.pos", "k.line").distinct()


def zone_text(words: DataFrame, zones: DataFrame, key: str = "zone") -> DataFrame:
    """(PAGE, zone, text): the words whose centre lies in a zone, in order; zones without words have an empty text."""
    w = words.select(*PAGE, "word", F.col("box").alias("w"), "text")
    x, y = (F.col("w.x0") + F.col("w.x1")) / 2, (F.col("w.y0") + F.col("w.y1")) / 2
    inside = (x >= F.col("box.x0")) & (x < F.col("box.x1")) & (y >= F.col("box.y0")) & (y < F.col("box.y1"))
    held = zones.select(*PAGE, key, "box").join(w, PAGE).where(inside).groupBy(*PAGE, key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda t: t["text"]), " ").alias("text"))
    return zones.select(*PAGE, key).join(held, [*PAGE, key], "left").fillna("", ["text"])


# What is rewritten ------------------------------------------------------------------------------------------------


def with_by_line(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("by_line", B.rewrite_by_line(F.col("line_boxes"), F.col("lines"), F.col("size")))


def plan_targets(blocks: DataFrame) -> DataFrame:
    """(PAGE, pos, line, box, source, by_line, size, ...): whole paragraphs (line null), or single lines that need words.

    Only translatable blocks; neither stacked lines nor blocks of one stacked line.
    """
    rows = with_by_line(blocks).where(B.translatable())
    stacked = stacked_lines(blocks).withColumn("stacked", F.lit(True))
    style = ["by_line", "font", "size", "color", "bold", "italic", "styles", "line_boxes"]
    first = stacked.where("line = 0").select(*PAGE, "pos", "stacked")
    whole = rows.where("not by_line").join(first, [*PAGE, "pos"], "left").where((F.size("line_boxes") > 1) | F.col("stacked").isNull())
    whole = whole.select(*PAGE, "pos", F.lit(None).cast("int").alias("line"), "box", F.coalesce(F.nullif("markup", F.lit("")), F.col("text")).alias("source"), *style)
    lines = rows.where("by_line").withColumn("l", F.explode(F.transform(F.arrays_zip("line_boxes", "lines", "line_markups"), lambda x, i: F.struct(i.alias("line"), x["line_boxes"].alias("box"), x["lines"].alias("text"), x["line_markups"].alias("markup")))))
    single = lines.select(*PAGE, "pos", F.col("l.line").alias("line"), F.col("l.box").alias("box"), F.coalesce("l.markup", "l.text").alias("source"), *style, F.col("l.text").alias("plain"))
    single = single.where(X.has_words(F.col("plain")) & ~X.is_numeric(F.col("plain"))).drop("plain").join(stacked.drop("stacked"), [*PAGE, "pos", "line"], "left_anti")
    return whole.unionByName(single)


def inline_fragments(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """(PAGE, pos, box) of blocks without words that lie mostly inside a paragraph which is rewritten whole."""
    bare = blocks.where(~F.col("numeric") & (~X.has_words(F.col("text")) | B.is_math_font(F.col("font")))).select(*PAGE, "pos", "box")
    into = targets.where("not by_line").select(*PAGE, F.col("box").alias("paragraph"))
    share = B.shared_area(F.col("box"), F.col("paragraph")) > INSIDE_SHARE * B.area(F.col("box"))
    return bare.join(into, PAGE).where(share).select(*PAGE, "pos", "box").distinct()


def protected_boxes(blocks: DataFrame, targets: DataFrame, erased: DataFrame) -> DataFrame:
    """(PAGE, box) that have to survive: bullets, and the lines of blocks that are neither rewritten nor erased."""
    gone = targets.select(*PAGE, "box").unionByName(erased.select(*PAGE, "box")).distinct()
    bullets = blocks.select(*PAGE, F.explode("bullet_boxes").alias("box"))
    left = blocks.join(gone, [*PAGE, "box"], "left_anti").select(*PAGE, F.explode("line_boxes").alias("box"))
    return bullets.unionByName(left.join(gone, [*PAGE, "box"], "left_anti"))


def redaction_boxes(targets: DataFrame, protected: DataFrame) -> DataFrame:
    """(PAGE, pos, line, box): what is erased, a box per line, trimmed around protected boxes; empty ones drop out.

    A box is cut beside a protected one on the same line, else above or below it, one protected box after another.
    """
    lines = targets.withColumn("n", F.explode(F.when(F.col("by_line"), F.array(F.struct(F.lit(0).alias("k"), F.col("box").alias("b")))).otherwise(F.transform("line_boxes", lambda b, i: F.struct(i.alias("k"), b.alias("b"))))))
    lines = lines.select(*PAGE, "pos", F.coalesce("line", "n.k").alias("line"), F.col("n.b").alias("b"))
    kept = protected.groupBy(*PAGE).agg(F.array_sort(F.collect_list("box")).alias("kept"))

    def cut(r: Column, p: Column) -> Column:
        meets = (F.least(r["x1"], p["x1"]) > F.greatest(r["x0"], p["x0"])) & (F.least(r["y1"], p["y1"]) > F.greatest(r["y0"], p["y0"]))
        same = B.shared_height(r, p) > 0.5 * B.height(p)
        left, above = p["x0"] + p["x1"] < r["x0"] + r["x1"], p["y0"] + p["y1"] < r["y0"] + r["y1"]
        edge = lambda k, when, value: F.when(meets & when, value).otherwise(r[k])
        return B.box(
            edge("x0", same & left, F.greatest(r["x0"], p["x1"] + MARGIN)), edge("y0", ~same & above, F.greatest(r["y0"], p["y1"] + MARGIN)),
            edge("x1", same & ~left, F.least(r["x1"], p["x0"] - MARGIN)), edge("y1", ~same & ~above, F.least(r["y1"], p["y0"] - MARGIN)),
        )

    inner = B.box(F.col("b.x0") + MARGIN, F.col("b.y0") + MARGIN, F.col("b.x1") - MARGIN, F.col("b.y1") - MARGIN)
    none = F.array().cast(protected.select(F.array("box")).schema[0].dataType)
    rows = lines.join(kept, PAGE, "left").withColumn("box", F.aggregate(F.coalesce("kept", none), inner, cut))
    return rows.where("box.x1 > box.x0 and box.y1 > box.y0").select(*PAGE, "pos", "line", "box")


# Free space -------------------------------------------------------------------------------------------------------


def obstacles(blocks: DataFrame, drawings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(obstacles, panels), both (PAGE, box): lines, bullets and drawings are obstacles; a large drawing around a line
    is a panel, whose edge text must not pass. drawings: (PAGE, box) of images and vector drawings."""
    lines = blocks.select(*PAGE, F.explode("line_boxes").alias("box"))
    near = drawings.where(B.area(F.col("box")) > PANEL_AREA).distinct().join(lines.select(*PAGE, F.col("box").alias("t")), PAGE)
    around = (F.col("box.x0") <= F.col("t.x0")) & (F.col("box.y0") <= F.col("t.y0")) & (F.col("box.x1") >= F.col("t.x1")) & (F.col("box.y1") >= F.col("t.y1"))
    panels = near.where(around).select(*PAGE, "box").distinct()
    rest = drawings.join(panels, [*PAGE, "box"], "left_anti")
    return lines.unionByName(blocks.select(*PAGE, F.explode("bullet_boxes").alias("box"))).unionByName(rest.select(*PAGE, "box")), panels


def _whole(value: Column) -> Column:
    return F.floor(value).cast("int")


def room(boxes: DataFrame, obstacles: DataFrame, panels: DataFrame, pages: DataFrame, side: str, limit: Column, keep_gap: float = 0.0) -> DataFrame:
    """boxes (PAGE, key columns, box) with `room`: free points below, right or left of each, at most `limit`.

    Space is measured in cells of one point; text stays 2 points off what follows, and in its panel. keep_gap: the
    share of the gap to the next obstacle that has to stay empty. A page is one group, swept once (operators.sweep).
    """
    width, tall = _whole(F.col("width")) + 1, _whole(F.col("height")) + 1
    keys = [c for c in boxes.columns if c not in (*PAGE, "box")]
    b, p = F.col("box"), F.col("panel")
    inside = (p["x0"] <= b["x0"]) & (p["y0"] <= b["y0"]) & (p["x1"] >= b["x1"]) & (p["y1"] >= b["y1"])
    to_edge = {"below": p["y1"] - b["y1"] - 2, "right": p["x1"] - b["x1"] - 2, "left": b["x0"] - p["x0"] - 2}[side]
    rows = boxes.withColumn("limit", limit.cast("double")).join(pages.select(*PAGE, "width", "height"), PAGE)
    edges = rows.join(panels.select(*PAGE, F.col("box").alias("panel")), PAGE).where(inside).groupBy(*PAGE, *keys).agg(F.min(to_edge).alias("edge"))
    rows = rows.join(edges, [*PAGE, *keys], "left").withColumn("limit", F.least("limit", "edge"))  # least skips null
    cell, o = F.col("cell"), {k: _whole(F.col(f"box.{k}")) for k in ("x0", "y0", "x1", "y1")}
    across = ("x0", "x1", width) if side == "below" else ("y0", "y1", tall)
    rows = rows.withColumns({"low": F.greatest(_whole(b[across[0]]) + 1, F.lit(0)), "high": F.least(_whole(b[across[1]]), across[2]) - 1})
    # the sweep goes down, right, or, with signs turned, left
    if side == "below":
        start, stop, near, far = _whole(b["y1"]) + 2, F.least(_whole(b["y1"] + F.col("limit") / (1 - keep_gap)) + 3, tall), o["y0"], o["y1"]
        free, open_ = F.least(F.col("limit"), (cell - b["y1"]) * (1 - keep_gap) - 2), F.least(F.col("limit"), tall - 1 - b["y1"] - 2)
    elif side == "right":
        start, stop, near, far = _whole(b["x1"]) + 2, F.least(_whole(b["x1"] + F.col("limit")) + 1, width), o["x0"], o["x1"]
        free, open_ = cell - b["x1"] - 2, F.least(F.col("limit"), width - 1 - b["x1"] - 2)
    else:
        start, stop, near, far = 2 - _whole(b["x0"]), -F.greatest(_whole(b["x0"] - F.col("limit")) - 1, F.lit(-1)), -o["x1"], -o["x0"]
        free, open_ = b["x0"] + cell - 2, F.least(F.col("limit"), b["x0"] - 2)
    rows = rows.withColumns({"start": start, "stop": stop})
    taken = obstacles.select(*PAGE, o[across[0]].alias("low"), o[across[1]].alias("high"), near.alias("start"), far.alias("far"))
    both = rows.withColumns({"asked": F.lit(True), "far": F.lit(0)}).unionByName(taken.withColumn("asked", F.lit(False)), allowMissingColumns=True)
    kind = StructType([*both.drop("asked", "far").schema.fields, StructField("cell", IntegerType())])
    met = both.repartition(*PAGE).sortWithinPartitions(*PAGE).mapInArrow(with_cells(PAGE), kind)
    found = F.when(cell < F.col("stop"), free).otherwise(open_)  # no cell: null
    return met.select(*PAGE, *keys, "box", F.greatest(found, F.lit(0.0)).alias("room"))


def body_boxes(blocks: DataFrame) -> DataFrame:
    """(PAGE, box) of a page's paragraphs; of all upright blocks where a page has none."""
    flat = blocks.where("horizontal").withColumn("many", F.size("line_boxes") > 1)
    has = flat.groupBy(*PAGE).agg(F.bool_or("many").alias("has"))
    return flat.join(has, PAGE).where(F.col("many") | ~F.col("has")).select(*PAGE, "box")


def text_columns(boxes: DataFrame, bodies: DataFrame) -> DataFrame:
    """boxes with `left` and `right`: the column of paragraphs that span a box's left edge, else all of the page's.

    A page's distinct paragraph edges meet its boxes as one list, so that boxes are neither paired nor grouped.
    """
    keys = [c for c in boxes.columns if c not in (*PAGE, "box")]
    edges = bodies.select(*PAGE, F.struct("box.x0", "box.x1").alias("o")).groupBy(*PAGE).agg(F.collect_set("o").alias("o"))
    rows = boxes.join(edges, PAGE, "left")
    x0 = F.col("box.x0")
    over = F.filter("o", lambda o: (o["x0"] - 2 <= x0) & (x0 < o["x1"]))
    own = lambda f, k: F.coalesce(f(F.transform(over, lambda o: o[k])), f(F.transform("o", lambda o: o[k])), F.col(f"box.{k}"))
    return rows.select(*PAGE, *keys, "box", own(F.array_min, "x0").alias("left"), own(F.array_max, "x1").alias("right"))


def insert_boxes(targets: DataFrame, obstacles: DataFrame, panels: DataFrame, pages: DataFrame) -> DataFrame:
    """(PAGE, pos, line, box): where a target is written, its box grown down by at most its height and 1.2 lines, and
    right by at most half a font size."""
    size = F.col("at.size")
    rows = targets.select(*PAGE, F.struct("pos", F.coalesce("line", F.lit(-1)).alias("line"), "size").alias("at"), "box")
    low = room(rows, obstacles, panels, pages, "below", B.height(F.col("box")) + size * 1.2, KEEP_GAP)
    low = low.select(*PAGE, "at", B.box(F.col("box.x0"), F.col("box.y0"), F.col("box.x1"), F.col("box.y1") + F.col("room")).alias("box"))
    wide = room(low, obstacles, panels, pages, "right", 0.5 * size)
    return wide.select(*PAGE, "at.pos", F.nullif("at.line", F.lit(-1)).alias("line"), B.box(F.col("box.x0"), F.col("box.y0"), F.col("box.x1") + F.col("room"), F.col("box.y1")).alias("box"))


def single_line_boxes(targets: DataFrame, bodies: DataFrame, obstacles: DataFrame, panels: DataFrame, pages: DataFrame) -> DataFrame:
    """(PAGE, pos, line, box, align): one-line texts widened within their column, on the side they are anchored to."""
    rows = targets.select(*PAGE, F.struct("pos", F.coalesce("line", F.lit(-1)).alias("line")).alias("at"), "box")
    rows = text_columns(rows, bodies).join(pages.select(*PAGE, "width"), PAGE)
    x0, x1, left, right = (F.col(c) for c in ("box.x0", "box.x1", "left", "right"))
    at_right = (x1 > right - 2) & (x0 - left > 0.25 * (right - left))
    centred = (F.abs((x0 + x1) / 2 - F.col("width") / 2) < 2) & (x0 - left > 20)
    rows = rows.withColumn("align", F.when(at_right, "right").when(centred, "center").otherwise("left"))
    rows = rows.select(*PAGE, F.struct("at", "align", "left", "right").alias("k"), "box")
    to_left = room(rows, obstacles, panels, pages, "left", F.col("box.x0") - F.col("k.left")).select(*PAGE, "k", "box", F.col("room").alias("l"))
    to_right = room(rows, obstacles, panels, pages, "right", F.greatest(F.col("k.right") - F.col("box.x1"), F.lit(0.0))).select(*PAGE, "k", F.col("room").alias("r"))
    both = to_left.join(to_right, [*PAGE, "k"])
    side, align = F.least("l", "r"), F.col("k.align")
    x0 = F.col("box.x0") - F.when(align == "right", F.col("l")).when(align == "center", side).otherwise(0.0)
    x1 = F.col("box.x1") + F.when(align == "left", F.col("r")).when(align == "center", side).otherwise(0.0)
    return both.select(*PAGE, "k.at.pos", F.nullif("k.at.line", F.lit(-1)).alias("line"), B.box(x0, F.col("box.y0"), x1, F.col("box.y1")).alias("box"), align.alias("align"))


# Reports ----------------------------------------------------------------------------------------------------------


def group_scales(needs: DataFrame) -> DataFrame:
    """(style, scale): the lower median of the scales that the targets of a style need. needs: (style, needed)."""
    return needs.groupBy("style").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY needed)").alias("scale"))


def document_report(pages: DataFrame, by: list[str]) -> DataFrame:
    """pages (by, targets, mean_scale, min_scale) -> zones, the mean scale weighted by targets (1 without any), the least."""
    weighted = F.sum(F.col("mean_scale") * F.col("targets")) / F.nullif(F.sum("targets"), F.lit(0))
    return pages.groupBy(*by).agg(F.sum("targets").alias("zones"), F.coalesce(F.round(weighted, 3), F.lit(1.0)).alias("mean_scale"), F.min("min_scale").alias("min_scale"))


def visible_drawings(drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """(PAGE, drawings): those that reach into the page, none where nothing is drawn."""
    rows = pages.join(drawings.select(*PAGE, "box"), PAGE, "left")
    seen = (F.col("box.x0") < F.col("width")) & (F.col("box.x1") > 0) & (F.col("box.y0") < F.col("height")) & (F.col("box.y1") > 0)
    return rows.groupBy(*PAGE).agg(F.count_if(F.coalesce(seen, F.lit(False))).alias("drawings"))


def residual_words(zones: DataFrame, words_after: DataFrame) -> DataFrame:
    """zones (PAGE, zone, box, source, translation) with `empty`, `checked` and `residual`.

    empty: a translation of which nothing is in the zone, 2 points around. residual: of the source's long words that are
    neither capitals nor in the translation, most are still there.
    """
    wide = zones.select(*PAGE, "zone", B.box(F.col("box.x0") - 2, F.col("box.y0") - 2, F.col("box.x1") + 2, F.col("box.y1") + 2).alias("box"))
    around = zone_text(words_after, wide).withColumnRenamed("text", "around")
    exact = zone_text(words_after, zones.select(*PAGE, "zone", "box")).withColumnRenamed("text", "found")
    rows = zones.join(around, [*PAGE, "zone"]).join(exact, [*PAGE, "zone"])
    said = X.strip_tags(F.col("translation"))
    long_words = F.filter(F.split(F.trim(X.strip_tags(F.col("source"))), r"\s+"), lambda w: (F.length(w) > 4) & (w != F.upper(w)) & ~F.contains(said, w))
    n = F.size(long_words)
    left = F.size(F.filter(long_words, lambda w: F.contains("found", w)))
    return rows.select(*PAGE, "zone", ((F.trim(said) != "") & (F.col("around") == "")).alias("empty"), (n > 0).alias("checked"), ((n > 0) & (left > n / 2)).alias("residual"))


def kept_numbers(blocks: DataFrame, words_after: DataFrame) -> DataFrame:
    """(PAGE, pos, line, text, kept) of numeric lines of upright blocks: is the line still where it was?"""
    lines = block_lines(blocks.where("horizontal")).where(X.is_numeric(F.col("text"))).withColumn("zone", F.struct("pos", "line"))
    wide = lines.select(*PAGE, "zone", B.box(F.col("box.x0") - 2, F.col("box.y0") - 2, F.col("box.x1") + 2, F.col("box.y1") + 2).alias("box"))
    found = zone_text(words_after, wide).withColumnRenamed("text", "found")
    return lines.join(found, [*PAGE, "zone"]).select(*PAGE, "pos", "line", "text", F.contains(X.compact(F.col("found")), X.compact(F.col("text"))).alias("kept"))


def verify(before: DataFrame, after: DataFrame, zones: DataFrame, numbers: DataFrame) -> DataFrame:
    """One row per document. before, after: (PAGE, images, drawings, overlaps, tags) of every page; both must have the
    same pages, else this raises. zones: residual_words; numbers: kept_numbers."""
    names = ("images", "drawings", "overlaps", "tags")
    a = before.select(*PAGE, *(F.col(n).alias(f"{n}_before") for n in names), F.lit(True).alias("__a"))
    b = after.select(*PAGE, *(F.col(n).alias(f"{n}_after") for n in names), F.lit(True).alias("__b"))
    both = a.join(b, PAGE, "full").where(F.when(F.col("__a") & F.col("__b"), True).otherwise(F.raise_error(F.lit("the two documents have different pages"))))
    per = both.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.count_if(F.col("images_before") == F.col("images_after")).alias("pages_same_images"), F.sum("drawings_before").alias("drawings_before"), F.sum("drawings_after").alias("drawings_after"),
        F.sum("overlaps_before").alias("overlaps_before"), F.sum("overlaps_after").alias("overlaps_after"), F.sum(F.greatest(F.col("tags_after") - F.col("tags_before"), F.lit(0))).alias("markup_leaks"),
    )
    z = zones.groupBy("doc_id").agg(F.count_if("checked").alias("zones_checked"), F.count_if("residual").alias("residual_source"), F.count_if("empty").alias("empty_zones"))
    lost = F.struct("page", "pos", "line", F.format_string("p%d: %s", F.col("page") + 1, "text").alias("said"))
    k = numbers.groupBy("doc_id").agg(F.count_if("kept").alias("numbers_kept"), F.count("*").alias("numbers_total"), F.transform(F.array_sort(F.collect_list(F.when(~F.col("kept"), lost))), lambda x: x["said"]).alias("lost_numbers"))
    out = per.join(z, "doc_id", "left").join(k, "doc_id", "left").fillna(0)
    return out.withColumn("lost_numbers", F.coalesce("lost_numbers", F.array().cast("array<string>"))).withColumn("ok", verified())


def verified() -> Column:
    """Did a rebuilt document keep its pictures and numbers, lose its source text, and gain neither overlaps nor tags?"""
    same = (F.col("pages_same_images") == F.col("pages")) & (F.col("drawings_after") == F.col("drawings_before")) & (F.col("numbers_kept") == F.col("numbers_total"))
    return same & (F.col("residual_source") == 0) & (F.col("markup_leaks") == 0) & (F.col("empty_zones") == 0) & (F.col("overlaps_after") <= F.col("overlaps_before"))
