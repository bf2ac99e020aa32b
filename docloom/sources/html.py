"""Web pages as blocks: tags play the part of layout, so that pages can be chunked like reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_numeric, normalise

BLOCK_TAG = r"(?is)<(h[1-6]|p|li|td|th|pre|nav|header|footer|title|blockquote)\b[^>]*>(.*?)</\1>"
#: Font sizes that tags stand for; all others are body text of 10 points.
SIZES = {"title": 20.0, "h1": 20.0, "h2": 16.0, "h3": 14.0, "h4": 12.0, "h5": 11.0, "h6": 11.0, "nav": 8.0, "header": 8.0, "footer": 8.0}
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def plain(markup: Column) -> Column:
    """Text of a piece of HTML: no tags, the common entities as characters, single spaces."""
    text = F.regexp_replace(markup, r"(?s)<[^>]*>", " ")
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return normalise(text)


def page_language(html: Column) -> Column:
    """The lang attribute of a page's root."""
    return F.nullif(F.regexp_extract(html, r"""(?is)<html\b[^>]*\blang=["']?([a-zA-Z_-]+)""", 1), F.lit(""))


def blocks(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """Blocks (doc_id, page, pos, text, size, bold, horizontal, numeric) of web pages; each is one page of its document."""
    found = F.regexp_extract_all(html_column, F.lit(BLOCK_TAG), F.lit(0))
    rows = pages.select(F.col(id_column).alias("doc_id"), F.posexplode(found).alias("pos", "raw"))
    tag, inner = F.lower(F.regexp_extract("raw", BLOCK_TAG, 1)), F.regexp_extract("raw", BLOCK_TAG, 2)
    rows = rows.select("doc_id", F.lit(0).alias("page"), "pos", tag.alias("tag"), plain(inner).alias("text"), inner.rlike(r"(?is)^\s*<(b|strong)>.*</\1>\s*$").alias("strong"))
    size = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SIZES.items() for x in kv)), F.col("tag")), F.lit(10.0))
    rows = rows.where("text <> ''").select("doc_id", "page", "pos", "text", size.alias("size"), (F.col("strong") | F.col("tag").rlike("^h[1-6]$")).alias("bold"))
    return rows.withColumn("horizontal", F.lit(True)).withColumn("numeric", is_numeric(F.col("text")))
