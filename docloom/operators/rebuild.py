"""What a renderer has to do to rewrite pages: fonts that can draw a text, zones with their boxes, styles and erasures.

Drawing itself is a renderer's work, behind a function; all decisions before it are tables here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import markup as M
from ..functions import text as X
from ..storage import written
from . import layout

PAGE = layout.PAGE


def drawable(glyphs: DataFrame) -> DataFrame:
    """Fonts (doc_id, font_no, font, chars) from glyphs (doc_id, font_no, font, char, ink): a glyph without ink counts
    as missing, but for white space."""
    seen = (F.col("ink") > 0) | F.col("char").rlike(r"^(?U)\s$")
    return glyphs.where(seen).groupBy("doc_id", "font_no", "font").agg(F.collect_set("char").alias("chars"))


def find_fonts(runs: DataFrame, fonts: DataFrame, key: str = "run") -> DataFrame:
    """(doc_id, key, font_no): the first embedded font of a run's base name that has all its characters; null if none."""
    need = F.array_distinct(F.filter(F.split("text", ""), lambda c: c != ""))
    asked = runs.select("doc_id", key, B.base_font(F.col("font")).alias("base"), need.alias("need"))
    have = fonts.select("doc_id", B.base_font(F.col("font")).alias("base"), "font_no", "chars")
    fits = asked.join(have, ["doc_id", "base"]).where(F.size(F.array_except("need", "chars")) == 0).groupBy("doc_id", key).agg(F.min("font_no").alias("font_no"))
    return runs.select("doc_id", key).join(fits, ["doc_id", key], "left")


def zones(blocks: DataFrame, drawings: DataFrame, pages: DataFrame, translate: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(zones, erasures) of the pages of blocks.

    zones: PAGE, pos, line, box (the source's), at (where to write), align, source, translation, html, css, style. erasures:
    PAGE, pos, line, box. translate adds `translation` to the column `source`. Single-line paragraphs are widened along
    their column, all others grow into the space below; zones of one style share a scale, which the renderer measures.
    """
    targets = layout.plan_targets(blocks)
    fragments = layout.inline_fragments(blocks, targets)
    protected = layout.protected_boxes(blocks, targets, fragments)
    erased = layout.redaction_boxes(targets, protected).unionByName(fragments.select(*PAGE, "pos", F.lit(None).cast("int").alias("line"), "box"))
    around, panels = layout.obstacles(blocks, drawings)
    single = targets.where((F.size("line_boxes") == 1) & ~F.col("by_line"))
    many = targets.join(single.select(*PAGE, "pos", F.lit(True).alias("one")), [*PAGE, "pos"], "left").where("one is null").drop("one")
    spots = layout.insert_boxes(many, around, panels, pages).withColumn("align", F.lit(None).cast("string"))
    spots = spots.unionByName(layout.single_line_boxes(single, layout.body_boxes(blocks), around, panels, pages))
    said = translate(targets)
    spots = spots.select(*(F.col(c).alias(f"spot_{c}") for c in (*PAGE, "pos", "line")), F.col("box").alias("at"), F.col("align").alias("own_align"))
    same = (F.col("doc_id") == F.col("spot_doc_id")) & (F.col("page") == F.col("spot_page")) & (F.col("pos") == F.col("spot_pos")) & F.col("line").eqNullSafe(F.col("spot_line"))
    rows = said.join(spots, same)
    style = B.style_key(F.col("font"), F.col("size"), F.col("bold"), F.col("italic"), F.col("by_line"))
    css = B.block_css(F.lit(1.0), F.col("by_line"), F.col("own_align"))
    return rows.select(*PAGE, "pos", "line", "box", "at", F.col("own_align").alias("align"), "source", "translation", M.html(F.col("translation"), F.col("styles")).alias("html"), css.alias("css"), style.alias("style")), erased


def plain_translation(translation: Column) -> Column:
    return X.strip_tags(translation)


def render(zones: DataFrame, erasures: DataFrame, renderer: Callable[[tuple, pd.DataFrame, pd.DataFrame], dict]) -> DataFrame:
    """Calls a renderer with all zones and erasures of a page; gives (PAGE, targets, mean_scale, min_scale, error).

    renderer((doc_id, page), zones, erasures) -> {"scales": [...]}; a page that raises is a row with its error.
    """

    def draw(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        try:
            scales, error = [float(s) for s in renderer(key, left, right)["scales"]], None
        except Exception as failure:  # one page must not stop a document
            scales, error = [], f"{type(failure).__name__}: {failure}"[:200]
        mean = sum(scales) / len(scales) if scales else None
        return pd.DataFrame({"doc_id": [key[0]], "page": [key[1]], "targets": [len(scales)], "mean_scale": [mean], "min_scale": [min(scales, default=None)], "error": [error]})

    kind = zones.schema["doc_id"].dataType.simpleString()
    # written first: both may come from one plan, and a renderer's work should not repeat that of the tables
    both = written(zones, "zones").groupBy(*PAGE).cogroup(written(erasures, "erasures").groupBy(*PAGE))
    return both.applyInPandas(draw, f"doc_id {kind}, page int, targets int, mean_scale double, min_scale double, error string")


def side_by_side(before: DataFrame, after: DataFrame) -> DataFrame:
    """(PAGE, left, right) of page pictures (PAGE, image): the pages both documents have."""
    return before.select(*PAGE, F.col("image").alias("left")).join(after.select(*PAGE, F.col("image").alias("right")), PAGE)


def each_page(rows: DataFrame, sink: Callable[[Iterator], None]) -> None:
    """Hands every partition's rows to a sink that writes them outside Spark."""
    rows.foreachPartition(sink)
