"""Column functions on text, all native expressions; Java patterns are in Unicode mode where letters matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of English and French, and elided letters.
STOP_WORDS = """
a an and are as at be been but by can for from has have in into is it its of on
or that the their there these this those to was were which will with within would
au aux avec ce ces cette dans de des du elle en est et il ils la le les leur
leurs mais ne ou par pas plus pour qu que qui sa se ses son sont sur un une vers
d l s n c j m y ont ete etre fait aussi comme entre dont
""".split()

# What counts as a search term, a number, a citation, a style tag, an HTML tag, a code, a dot leader, an
# ellipsis, a bullet and a mathematical font; words in names of bold and slanted fonts.
TOKEN = r"[a-z0-9]+(?:[.,\-/][a-z0-9]+)*"
STANDING_NUMBER = r"(?<![^\W\d])(?<![\d.])\d+(?:[.,]\d+)*"
GLUED_DIGITS = r"(?<=[^\W\d])\d+(?:[.,]\d+)*"
THOUSANDS_SPACE = "(?<=\\d)[ \u00a0\u202f](?=\\d{3}\\b)"
DECIMAL_COMMA = r"(?<=\d),(?=\d)"
DOUBLED = r"([a-z])\1"
CITATION = r"\[(\d{1,2})\]"
ELLIPSIS = r"\s*(?:\[\.\.\.\]|\[…\]|\.\.\.|…)\s*"
TAG = r"</?s\d+>"
HTML_TAG = r"</?(?:sub|sup|b|i|em|strong)>|<br\s*/?>"
CODE = r"[A-Z][A-Z0-9]{1,5}(?:[-.][A-Z0-9.]{1,5})?"
DOT_LEADER = r"(\.\s?){6,}"
TEMPERATURE_UNIT = r"[°º]\s?[CFK]\b"
FIGURES_ONLY = r"[\d\s.,;:%°+\-–—−()\[\]/×*≈<>~$€£]+"
BULLETS = "•◦▪▫■□●○►▶▸‣⁃→✓✔➢➤"
MATH_FONT = r"^(cmmi|cmsy|cmex|cmbsy|msam|msbm|eufm|rsfs|mw[ab]_|stix.*math)|math"
BOLD_NAME = r"bold|black|heavy|demi|ultra|medi(?!um)"
ITALIC_NAME = r"(?i:italic|oblique)|(?<=[a-z])(?:I|It)(?:MT)?$"

NUMBER = "(?U)" + STANDING_NUMBER


def fold(text: Column) -> Column:
    """Lower case without accents; compatibility characters decomposed."""
    return F.reflect(F.lit("org.apache.commons.lang3.StringUtils"), F.lit("stripAccents"), F.lower(F.coalesce(text, F.lit(""))))


def stem(token: Column) -> Column:
    """Plural folding: more than four letters, ending in s or x but not after s or u."""
    plural = (F.length(token) > 4) & F.right(token, F.lit(1)).isin("s", "x") & ~F.substring(token, -2, 1).isin("s", "u") & token.rlike("^[a-z]+$")
    return F.when(plural, F.substring(token, 1, F.length(token) - 1)).otherwise(token)


def tokens(text: Column) -> Column:
    """Array of search terms; stop words and single characters go before stemming."""
    found = F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))
    return F.transform(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS)), stem)


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def has_words(text: Column) -> Column:
    return text.rlike(r"\p{L}{2,}")


def normalise_numbers(text: Column) -> Column:
    """Thousands spaces removed, decimal commas as points."""
    return F.regexp_replace(F.regexp_replace(text, "(?U)" + THOUSANDS_SPACE, ""), DECIMAL_COMMA, ".")


def numbers(text: Column) -> Column:
    """Numbers that stand alone, not glued to a letter, digit or point."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?;])\s+")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, TAG, ""), "(?i)" + HTML_TAG, "")


def is_code(text: Column) -> Column:
    return text.rlike(f"^(?:{CODE})$")


def undouble(word: Column) -> Column:
    return F.regexp_replace(word, DOUBLED, "$1")


def same_word(quoted: Column, found: Column) -> Column:
    """Equal; one edit apart from five letters on; or the quoted word plus one or two glued letters."""
    near = (F.least(F.length(quoted), F.length(found)) >= 5) & (F.levenshtein(quoted, found) == 1)
    glued = (F.length(quoted) >= 3) & F.startswith(found, quoted) & (F.length(found) - F.length(quoted) <= 2)
    return (quoted == found) | near | glued


def dot_leader(text: Column) -> Column:
    return text.rlike(DOT_LEADER)


def join_lines(lines: Column) -> Column:
    """Visual lines as one text; a hyphen between a letter and a lower-case letter is undone."""

    def merge(text: Column, raw: Column) -> Column:
        line = F.trim(raw)
        dehyphen = text.rlike(r"\p{L}-$") & line.rlike(r"^\p{Ll}")
        return (
            F.when(line == "", text).when(text == "", line).when(dehyphen, F.concat(F.substring(text, F.lit(1), F.length(text) - 1), line))
            .when(F.endswith(text, F.lit("-")), F.concat(text, line)).otherwise(F.concat(text, F.lit(" "), line))
        )

    return F.regexp_replace(F.aggregate(lines, F.lit(""), merge), r"\s+", " ")


def pseudo_translate(text: Column, expansion: float = 0.2) -> Column:
    """Upper case outside style tags, lengthened by its own lower-cased start; expansion must not be negative."""
    if expansion < 0:
        raise ValueError("expansion must be >= 0")
    plain = F.trim(F.regexp_replace(text, TAG, ""))
    upper = F.regexp_replace(F.upper(text), r"<(/?)S(\d+)>", "<$1s$2>")
    extra = (F.ceil(F.length(plain) * F.lit(expansion)) - 1).cast("int")
    times = (F.ceil(extra / F.length(plain)) + 1).cast("int")
    padding = F.lower(F.rtrim(F.substring(F.repeat(F.concat(plain, F.lit(" ")), times), F.lit(1), extra)))
    return F.when((plain == "") | (extra < 1) | F.lit(expansion == 0), upper).otherwise(F.concat(F.rtrim(upper), F.lit(" "), padding))


def is_numeric(text: Column) -> Column:
    """Only figures, punctuation and units; a temperature unit counts as white space, an empty text as words."""
    return text.isNotNull() & F.regexp_replace(text, "(?U)" + TEMPERATURE_UNIT, " ").rlike(f"(?U)^(?:{FIGURES_ONLY})$")


def without_symbols(text: Column) -> Column:
    """Text without bullets, control characters (but tab and newline) and private-use glyphs."""
    return F.regexp_replace(text, f"[{BULLETS}\\x00-\\x08\\x0B-\\x1F\\uE000-\\uF8FF]", "")


def without_markers(text: Column) -> Column:
    """Text as a reader sees it, without [n] and without space before punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s*" + CITATION, ""), r"\s+([.,;:])", "$1"))


def compact(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def keep_markers(text: Column, valid: Column) -> Column:
    """Drops [n] markers whose n is not in valid, bold marks, and space before punctuation."""
    marks = F.array_distinct(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)))
    bad = F.filter(marks, lambda m: ~F.array_contains(valid, m.cast("int")))
    kept = F.aggregate(bad, text, lambda t, m: F.replace(t, F.concat(F.lit("["), m, F.lit("]")), F.lit("")))
    return F.trim(F.regexp_replace(F.replace(kept, F.lit("**"), F.lit("")), r"\s+([.,;])", "$1"))
