"""Geometry over pages that are a deterministic function of lineitem: an order is a page, its items are boxes or lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import blocks as B
from ..operators import extraction, layout
from ..storage import dealt
from .registry import Tables, query

_BOX = """boxes AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k, CAST(l_partkey % 37 AS DOUBLE) * 3 AS x0, CAST(l_suppkey % 41 AS DOUBLE) * 3 AS y0, CAST(l_partkey % 37 AS DOUBLE) * 3 + 10 + CAST(l_quantity AS DOUBLE) AS x1, CAST(l_suppkey % 41 AS DOUBLE) * 3 + 12 AS y1,
  'item ' || l_linenumber AS text, l_returnflag AS flag, CAST(l_quantity AS DOUBLE) AS quantity FROM lineitem)"""
_SIDES = "least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h, least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS small"
_PAIRS = f"{_BOX}, pairs AS (SELECT a.page, a.k AS one, b.k AS two, {_SIDES} FROM boxes a JOIN boxes b ON a.page = b.page AND a.k < b.k)"


def boxes(t: Tables):
    x, y = (F.col("l_partkey") % 37).cast("double") * 3, (F.col("l_suppkey") % 41).cast("double") * 3
    q, order = F.col("l_quantity").cast("double"), Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return dealt(t.lineitem, "l_orderkey").select(F.lit("d").alias("doc_id"), F.col("l_orderkey").alias("page"), F.row_number().over(order).alias("k"), B.box(x, y, x + 10 + q, y + 12).alias("box"), F.format_string("item %d", "l_linenumber").alias("text"), F.col("l_returnflag").alias("flag"), q.alias("quantity"))


def page_blocks(t: Tables):
    """One block per page, its lines the page's boxes in order; three columns of text styles by the first line's flag."""
    lines = F.array_sort(F.collect_list(F.struct("k", "box", "text", "flag")))
    rows = boxes(t).groupBy("doc_id", "page").agg(lines.alias("l"))
    texts = F.transform("l", lambda x: F.when(x["flag"] == "R", F.concat(x["k"].cast("string"), F.lit(" %"))).otherwise(x["text"]))
    rows = rows.select("doc_id", "page", F.lit(0).alias("pos"), F.transform("l", lambda x: x["box"]).alias("line_boxes"), texts.alias("lines"), F.get("l", F.lit(0))["flag"].alias("flag"))
    return rows.select(
        "doc_id", "page", "pos", B.union(F.col("line_boxes")).alias("box"), F.array_join("lines", " ").alias("text"), "lines", F.array_join("lines", " ").alias("markup"), F.col("lines").alias("line_markups"), F.create_map().cast("map<string,struct<font:string,color:int,bold:boolean,italic:boolean,position:string>>").alias("styles"),
        "line_boxes", F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>").alias("bullet_boxes"), F.when(F.col("flag") == "A", "ABCDEF+Lato-Bold").otherwise("Times").alias("font"), F.lit(10.0).alias("size"), F.lit(0).alias("color"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit(True).alias("horizontal"), F.lit(False).alias("numeric"),
    )


@query(f"WITH {_PAIRS} SELECT page, one, two FROM pairs WHERE w > 0 AND h > 0 AND small > 1 AND w * h > 0.3 * small")
def box_overlaps(t: Tables):
    return layout.overlapping_words(boxes(t), "k").select("page", "one", "two")


@query(f"WITH {_PAIRS}, s AS (SELECT * FROM pairs WHERE w > 0 AND h > 0 AND w * h > 0.4 * small), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY page ORDER BY k) - 1 AS INT) AS line FROM boxes) SELECT DISTINCT n.page, n.line FROM n JOIN s ON s.page = n.page AND n.k IN (one, two)")
def stacked_lines(t: Tables):
    return layout.stacked_lines(page_blocks(t)).select("page", "line")


@query(f"""WITH {_BOX}, z AS (SELECT page, k AS zone, x0, y0, x0 + 60 AS x1, y0 + 40 AS y1 FROM boxes WHERE k = 1) SELECT z.page, coalesce(string_agg(text, ' ' ORDER BY k) FILTER (k IS NOT NULL), '') AS text FROM z LEFT JOIN boxes b ON b.page = z.page
  AND (b.x0 + b.x1) / 2 >= z.x0 AND (b.x0 + b.x1) / 2 < z.x1 AND (b.y0 + b.y1) / 2 >= z.y0 AND (b.y0 + b.y1) / 2 < z.y1 GROUP BY z.page""")
def zone_text(t: Tables):
    b = boxes(t)
    zones = b.where("k = 1").select("doc_id", "page", F.col("k").alias("zone"), B.box(F.col("box.x0"), F.col("box.y0"), F.col("box.x0") + 60, F.col("box.y0") + 40).alias("box"))
    return layout.zone_text(b.withColumnRenamed("k", "word"), zones).select("page", "text")


_ROOM = f"""{_BOX}, lim AS (SELECT *, 30.0 AS lim FROM boxes), c AS (SELECT a.page, a.k, min(greatest(floor(b.y0), floor(a.y1) + 2)) AS cell FROM lim a JOIN boxes b ON a.page = b.page
  AND floor(b.x0) < least(floor(a.x1), 201) AND floor(b.x1) >= greatest(floor(a.x0) + 1, 0) AND floor(b.y1) >= floor(a.y1) + 2 AND greatest(floor(b.y0), floor(a.y1) + 2) < least(floor(a.y1 + lim / 0.4) + 3, 181) GROUP BY a.page, a.k)"""


@query(f"WITH {_ROOM} SELECT a.page, a.k, greatest(CASE WHEN cell IS NULL THEN least(lim, 180 - y1 - 2) ELSE least(lim, (cell - y1) * 0.4 - 2) END, 0) AS room FROM lim a LEFT JOIN c USING (page, k)")
def free_space_below(t: Tables):
    b = boxes(t)
    pages = b.select("doc_id", "page").distinct().withColumn("width", F.lit(200.0)).withColumn("height", F.lit(180.0))
    none = b.select("doc_id", "page", "box").limit(0)
    return layout.room(b.select("doc_id", "page", "k", "box"), b.select("doc_id", "page", "box"), none, pages, "below", F.lit(30.0), layout.KEEP_GAP).select("page", "k", "room")


@query(f"""WITH {_BOX}, c AS (SELECT a.page, a.k, min(greatest(floor(b.x0), floor(a.x1) + 2)) AS cell FROM boxes a JOIN boxes b ON a.page = b.page AND floor(b.y0) < least(floor(a.y1), 181) AND floor(b.y1) >= floor(a.y0) + 1
  AND floor(b.x1) >= floor(a.x1) + 2 AND greatest(floor(b.x0), floor(a.x1) + 2) < least(floor(a.x1 + 25) + 1, 201) GROUP BY a.page, a.k)
SELECT a.page, a.k, greatest(CASE WHEN cell IS NULL THEN least(25, 200 - x1 - 2) ELSE cell - x1 - 2 END, 0) AS room FROM boxes a LEFT JOIN c USING (page, k)""")
def free_space_right(t: Tables):
    b = boxes(t)
    pages = b.select("doc_id", "page").distinct().withColumn("width", F.lit(200.0)).withColumn("height", F.lit(180.0))
    return layout.room(b.select("doc_id", "page", "k", "box"), b.select("doc_id", "page", "box"), b.select("doc_id", "page", "box").limit(0), pages, "right", F.lit(25.0)).select("page", "k", "room")


@query(f"""WITH {_BOX} SELECT DISTINCT a.page, a.k FROM boxes a JOIN boxes b ON a.page = b.page AND a.flag = 'R' AND b.flag <> 'R' AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)
  AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 0.5 * (a.x1 - a.x0) * (a.y1 - a.y0)""")
def inline_fragments(t: Tables):
    """Boxes of returned items, as fragments without words, inside those of other items."""
    b = boxes(t)
    bare = b.where("flag = 'R'").select("doc_id", "page", F.col("k").alias("pos"), "box", F.lit(False).alias("numeric"), F.lit("b").alias("text"), F.lit("Times").alias("font"))
    targets = b.where("flag <> 'R'").select("doc_id", "page", "box", F.lit(False).alias("by_line"))
    return layout.inline_fragments(bare, targets).select("page", F.col("pos").alias("k"))


_LINES = f"""{_BOX}, o AS (SELECT page, list(x0 ORDER BY k) AS x0, list(x1 ORDER BY k) AS x1, list((x0 + x1) / 2 ORDER BY k) AS xm, list(y0 ORDER BY k) AS y0, count(*) AS n, bool_or(flag = 'R') AS figures, first(flag ORDER BY k) AS flag FROM boxes GROUP BY page),
t AS (SELECT a.page, bool_or(least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0.5 * 12) AS is_row FROM boxes a JOIN boxes b ON a.page = b.page AND a.k < b.k GROUP BY a.page),
s AS (SELECT *, CASE WHEN n > 2 THEN x0[2:] ELSE x0 END AS body, x1[:n - 1] AS edge FROM o LEFT JOIN t USING (page)),
f AS (SELECT page, coalesce(is_row, false) AS table_row, n, figures, flag, y0, CASE WHEN n < 2 THEN 'left' WHEN list_max(body) - list_min(body) < 4 AND n > 2 AND list_max(edge) - list_min(edge) < 4 THEN 'justify' WHEN list_max(body) - list_min(body) < 4 THEN 'left' WHEN list_max(x1) - list_min(x1) < 4 THEN 'right' WHEN list_max(xm) - list_min(xm) < 4 THEN 'center' END AS align FROM s),
g AS (SELECT *, n >= 2 AND (table_row OR figures OR align IS NULL) AS by_line FROM f)"""


@query(f"WITH {_LINES} SELECT page, table_row, align, by_line FROM g")
def block_alignment(t: Tables):
    rows = layout.with_by_line(page_blocks(t))
    return rows.select("page", B.is_table_row(F.col("line_boxes")).alias("table_row"), B.alignment(F.col("line_boxes"), F.col("size")).alias("align"), "by_line")


@query(f"WITH {_LINES} SELECT page, CASE WHEN n < 2 OR by_line THEN 1.15 ELSE least(greatest(round((y0[n] - y0[1]) / (n - 1) / 10, 6), 1.0), 1.6) END AS pitch FROM g")
def line_pitch(t: Tables):
    rows = layout.with_by_line(page_blocks(t))
    return rows.select("page", F.round(B.line_pitch(F.col("line_boxes"), F.col("size"), F.col("by_line")), 6).alias("pitch"))


@query(f"""WITH {_BOX}, a AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY k) AS i, count(*) OVER (PARTITION BY page) AS n FROM boxes), f AS (SELECT * FROM a WHERE i = 1)
SELECT f.page, count(*) FILTER (least(a.y1, f.y1) - greatest(a.y0, f.y0) > 0.5 * 12) = 1 AND max(CASE WHEN least(a.y1, f.y1) - greatest(a.y0, f.y0) > 0.5 * 12 THEN a.x0 END) >= max(f.x1) AS labelled FROM f JOIN a ON a.page = f.page AND a.i > 1 GROUP BY f.page""")
def leading_labels(t: Tables):
    rows = page_blocks(t).where(F.size("lines") > 1)
    return rows.select("page", B.has_leading_label(F.col("line_boxes"), F.col("lines")).alias("labelled"))


@query(f"WITH {_LINES}, k AS (SELECT page, CASE WHEN flag = 'A' THEN 'ABCDEF+Lato-Bold' ELSE 'Times' END || '/' || by_line AS style, CAST(1 - n / 20.0 AS DOUBLE) AS needed FROM g) SELECT style, count(*) AS n, quantile_disc(needed, 0.5) AS scale FROM k GROUP BY style")
def group_scale(t: Tables):
    """The lower median of the scales that blocks of one style need; a block of n lines needs 1 - n / 20."""
    rows = layout.with_by_line(page_blocks(t))
    key = B.style_key(F.col("font"), F.col("size"), F.col("bold"), F.col("italic"), F.col("by_line"))
    needs = rows.select(key.alias("style"), (1 - F.size("lines") / 20.0).alias("needed"))
    found = layout.group_scales(needs).join(needs.groupBy("style").agg(F.count("*").alias("n")), "style")
    return found.select(F.concat("style.font", F.lit("/"), F.col("style.by_line").cast("string")).alias("style"), "n", "scale")


@query(f"WITH {_BOX}, p AS (SELECT page % 50 AS doc, page, count(*) AS n, round(1 - avg(quantity) / 100, 6) AS mean, round(1 - max(quantity) / 100, 6) AS least FROM boxes GROUP BY page) SELECT doc, CAST(sum(n) AS BIGINT) AS zones, round(sum(mean * n) / sum(n) + 1e-9, 3) AS mean_scale, min(least) AS min_scale FROM p GROUP BY doc")
def doc_report(t: Tables):
    pages = boxes(t).groupBy("page").agg(F.count("*").alias("targets"), (F.round(1 - F.avg("quantity") / 100, 6) + 1e-9).alias("mean_scale"), F.round(1 - F.max("quantity") / 100, 6).alias("min_scale"))
    return layout.document_report(pages.withColumn("doc", F.col("page") % 50), ["doc"])


@query(f"WITH {_BOX} SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes GROUP BY page")
def bbox_union(t: Tables):
    return page_blocks(t).select("page", "box.x0", "box.y0", "box.x1", "box.y1")


@query(f"""WITH {_BOX}, b AS (SELECT * FROM boxes WHERE flag <> 'R'), m AS (SELECT a.page, a.k, min(CASE WHEN b.x0 - 2 <= a.x0 AND a.x0 < b.x1 THEN b.x0 END) AS l, max(CASE WHEN b.x0 - 2 <= a.x0 AND a.x0 < b.x1 THEN b.x1 END) AS r, min(b.x0) AS all_l, max(b.x1) AS all_r FROM boxes a LEFT JOIN b ON a.page = b.page GROUP BY a.page, a.k)
SELECT m.page, m.k, coalesce(l, all_l, x0) AS left_edge, coalesce(r, all_r, x1) AS right_edge FROM m JOIN boxes USING (page, k)""")
def text_columns(t: Tables):
    b = boxes(t)
    found = layout.text_columns(b.select("doc_id", "page", "k", "box"), b.where("flag <> 'R'").select("doc_id", "page", "box"))
    return found.select("page", "k", F.col("left").alias("left_edge"), F.col("right").alias("right_edge"))


@query(f"WITH {_BOX}, kept AS (SELECT page, x0, y0, x1, y1 FROM boxes WHERE flag = 'N'), gone AS (SELECT page, x0, y0, x1, y1 FROM boxes WHERE flag <> 'N') SELECT page, count(*) AS n FROM (SELECT * FROM kept k WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.page = k.page AND g.x0 = k.x0 AND g.y0 = k.y0 AND g.x1 = k.x1 AND g.y1 = k.y1)) GROUP BY page")
def protected_lines(t: Tables):
    """Boxes of pages that are not rewritten: items of one flag are, all others are left."""
    b = boxes(t)
    single = b.select("doc_id", "page", F.col("k").alias("pos"), "box", F.array("box").alias("line_boxes"), F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>").alias("bullet_boxes"))
    gone = b.where("flag <> 'N'").select("doc_id", "page", "box")
    return layout.protected_boxes(single, gone, gone.limit(0)).groupBy("page").agg(F.count("*").alias("n"))


@query("SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, CAST((len(string_split_regex(trim(text), '\\s+')) + 1) // 3 AS INT) AS styled FROM benchmark WHERE NOT regexp_matches(text, '-| {2}|[•◦▪▫■□●○►▶▸‣⁃→✓✔➢➤]') AND NOT regexp_matches(text, '^\\d{1,3}\\s')")
def assembled_blocks(t: Tables):
    """Items set glyph by glyph in lines of words, every third word in red, and assembled again."""
    rows = t.benchmark.where(~F.col("text").rlike("-| {2}|[•◦▪▫■□●○►▶▸‣⁃→✓✔➢➤]") & ~F.col("text").rlike(r"^\d{1,3}\s"))
    words = rows.select("item_id", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("w", "word"))
    chars = words.select("item_id", "w", F.posexplode(F.split(F.concat("word", F.lit(" ")), "")).alias("c", "char")).where("char <> ''")
    line = F.floor(F.col("w") / 8).cast("int")
    at = F.row_number().over(Window.partitionBy("item_id", line).orderBy("w", "c"))
    x, y = (at * 5).cast("double"), (line * 12).cast("double")
    spot = B.box(x, y, x + 5, y + 10)
    values = {"doc_id": F.col("item_id").cast("string"), "page": F.lit(0), "block": F.lit(0), "line": line, "pos": at, "char": F.col("char"), "box": spot, "font": F.lit("Body"), "size": F.lit(10.0), "color": F.when((F.col("w") % 3 == 1) & (F.col("char") != " "), 0xFF0000).otherwise(0), "flags": F.lit(0)}
    values |= {"baseline": y + 8, "line_box": B.box(F.lit(0.0), y, F.lit(400.0), y + 10), "dir_x": F.lit(1.0), "dir_y": F.lit(0.0)}
    found = extraction.assemble(chars.select(*(values[n].alias(n) for n in schemas.GLYPH.names)))
    return found.select(F.col("doc_id").cast("long").alias("item_id"), "text", F.regexp_count("markup", F.lit(r"<s\d+>")).alias("styled"))
