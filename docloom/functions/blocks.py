"""Predicates and values of text blocks (schemas.BLOCK), as column expressions.

Boxes are structs (x0, y0, x1, y1) in points from the page's top left corner.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

LABEL_CHARS, SCRIPT_SIZE, SCRIPT_SHIFT = 10, 0.8, 0.1
PITCH, LEAST_PITCH, MOST_PITCH = 1.15, 1.0, 1.6


# Fonts ------------------------------------------------------------------------------------------------------------


def base_font(font: Column) -> Column:
    """A font's name without the prefix of its subset."""
    return F.regexp_replace(font, r"^[^+]*\+", "")


def is_math_font(font: Column) -> Column:
    return base_font(font).rlike(f"(?i){X.MATH_FONT}")


def font_family(font: Column) -> Column:
    """The generic family closest to a font."""
    name = F.lower(font)
    serif = name.rlike("times|roman|nimbusrom|serif|georgia|garamond|cmr")
    return F.when(name.rlike("mono|courier|consolas"), "monospace").when(F.contains(name, F.lit("sans")), "sans-serif").when(serif, "serif").otherwise("sans-serif")


def _style_part(font: Column) -> Column:
    return F.when(F.contains(font, F.lit("-")), F.regexp_replace(base_font(font), "^[^-]*-", "")).otherwise("")


def is_bold(font: Column, flags: Column) -> Column:
    return (flags.bitwiseAND(16) != 0) | _style_part(font).rlike(f"(?i){X.BOLD_NAME}")


def is_italic(font: Column, flags: Column) -> Column:
    return (flags.bitwiseAND(2) != 0) | _style_part(font).rlike(X.ITALIC_NAME)


def script_position(size: Column, body: Column, baseline: Column, line: Column) -> Column:
    """sup or sub for small text raised above or lowered below its line's baseline (y grows downwards), else null."""
    shift = baseline - line
    return F.when(size < SCRIPT_SIZE * body, F.when(shift < -SCRIPT_SHIFT * body, "sup").when(shift > SCRIPT_SHIFT * body, "sub"))


# Boxes ------------------------------------------------------------------------------------------------------------


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def rounded(b: Column) -> Column:
    return box(*(F.round(b[k], 2) for k in ("x0", "y0", "x1", "y1")))


def union(boxes: Column) -> Column:
    edge = lambda k: F.transform(boxes, lambda b: b[k])
    return box(F.array_min(edge("x0")), F.array_min(edge("y0")), F.array_max(edge("x1")), F.array_max(edge("y1")))


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * height(b)


def shared_height(a: Column, b: Column) -> Column:
    return F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])


def shared_area(a: Column, b: Column) -> Column:
    """0 for boxes that do not meet."""
    return F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0)) * F.greatest(shared_height(a, b), F.lit(0.0))


# Blocks -----------------------------------------------------------------------------------------------------------


def translatable() -> Column:
    return F.col("horizontal") & ~F.col("numeric") & ~is_math_font(F.col("font")) & X.has_words(F.col("text"))


def is_table_row(boxes: Column) -> Column:
    """Do two lines of the block share more than half of the lower one's height?"""
    beside = lambda a, b: shared_height(a, b) > 0.5 * F.least(height(a), height(b))
    return F.exists(F.transform(boxes, lambda a, i: F.exists(F.slice(boxes, i + 2, F.size(boxes)), lambda b: beside(a, b))), lambda x: x)


def alignment(boxes: Column, size: Column) -> Column:
    """left, right, center or justify by the edges of a block's lines; null for scattered lines.

    A first line may be indented and a last line short, so they do not count where that matters; one line is left.
    """
    n, slack = F.size(boxes), F.greatest(size * 0.4, F.lit(1.5))
    lefts, rights = F.transform(boxes, lambda b: b["x0"]), F.transform(boxes, lambda b: b["x1"])
    middles = F.transform(boxes, lambda b: (b["x0"] + b["x1"]) / 2)
    same = lambda values: F.array_max(values) - F.array_min(values) < slack
    body = F.when(n > 2, F.slice(lefts, 2, F.greatest(n - 1, F.lit(1)))).otherwise(lefts)
    full = F.slice(rights, 1, F.greatest(n - 1, F.lit(1)))
    return F.when(n < 2, "left").when(same(body) & (n > 2) & same(full), "justify").when(same(body), "left").when(same(rights), "right").when(same(middles), "center")


def rewrite_by_line(boxes: Column, lines: Column, size: Column) -> Column:
    """Is each line rewritten in its own box: a table row, a line of figures only, or lines without alignment?"""
    return (F.size(boxes) >= 2) & (is_table_row(boxes) | F.exists(lines, X.is_numeric) | alignment(boxes, size).isNull())


def has_leading_label(boxes: Column, lines: Column) -> Column:
    """Is the first line a short label to the left of exactly one other line?"""
    first = F.get(boxes, F.lit(0))
    beside = F.filter(F.slice(boxes, 2, F.greatest(F.size(boxes), F.lit(1))), lambda b: shared_height(first, b) > 0.5 * height(first))
    return (F.size(boxes) >= 2) & (F.length(F.get(lines, F.lit(0))) <= LABEL_CHARS) & (F.size(beside) == 1) & (first["x1"] <= F.get(beside, F.lit(0))["x0"])


def line_pitch(boxes: Column, size: Column, by_line: Column) -> Column:
    """Line spacing in font sizes, within bounds; the default for single lines and blocks rewritten by line."""
    n = F.size(boxes)
    pitch = (F.element_at(boxes, -1)["y0"] - F.get(boxes, F.lit(0))["y0"]) / (n - 1) / size
    return F.when((n < 2) | by_line, PITCH).otherwise(F.least(F.greatest(pitch, F.lit(LEAST_PITCH)), F.lit(MOST_PITCH)))


def style_key(font: Column, size: Column, bold: Column, italic: Column, by_line: Column) -> Column:
    """Blocks of one key are scaled alike."""
    return F.struct(font.alias("font"), F.bround(size, 0).cast("int").alias("size"), bold.alias("bold"), italic.alias("italic"), by_line.alias("by_line"))


def hex_colour(colour: Column) -> Column:
    return F.lower(F.lpad(F.hex(colour), 6, "0"))


def run_css(style: Column, body_font: Column) -> Column:
    """CSS of a style run whose own font is not at hand."""
    weight = F.when(style["bold"], "bold").otherwise("normal")
    slant = F.when(style["italic"], "italic").otherwise("normal")
    family = F.when(style["font"] != body_font, F.concat(F.lit("font-family: "), font_family(style["font"])))
    place = F.when(style["position"] == "sup", "vertical-align: super").when(style["position"] == "sub", "vertical-align: sub")
    return F.concat_ws("; ", F.concat(F.lit("color: #"), hex_colour(style["color"])), F.concat(F.lit("font-weight: "), weight), F.concat(F.lit("font-style: "), slant), family, place, F.when(place.isNotNull(), "font-size: 70%"))


def block_css(scale: Column, by_line: Column, align: Column | None = None) -> Column:
    """CSS of a block's main style at a scale, from the block's columns."""
    boxes = F.col("line_boxes")
    aligned = F.coalesce(align if align is not None else F.lit(None).cast("string"), F.when(by_line, "left").otherwise(F.coalesce(alignment(boxes, F.col("size")), F.lit("left"))))
    indent = F.when(by_line, 0.0).otherwise(F.get(boxes, F.lit(0))["x0"] - F.col("box")["x0"])
    return F.format_string(
        "* { font-family: %s; font-size: %.2fpt; line-height: %.2f; color: #%s; font-weight: %s; font-style: %s; text-align: %s; text-indent: %.1fpt; margin: 0; padding: 0; }",
        font_family(F.col("font")), F.col("size") * scale, line_pitch(boxes, F.col("size"), by_line), hex_colour(F.col("color")), F.when(F.col("bold"), "bold").otherwise("normal"), F.when(F.col("italic"), "italic").otherwise("normal"),
        aligned, F.when(indent > 1, indent).otherwise(0.0),
    )
