"""Lenient reading of JSON replies: what can be used is kept, what is malformed is dropped, nothing raises.

A reply is a string column. Each function gives a struct whose field `valid` says if the reply can be used at all; one
that cannot is a reason to ask again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("agreement", "difference", "only_in")
EVIDENCE = "array<struct<n:int,quote:string>>"
POINTS = f"array<struct<text:string,evidence:{EVIDENCE}>>"
SIDES = f"array<struct<report:string,says:string,evidence:{EVIDENCE}>>"
COMPARISON = f"array<struct<kind:string,aspect:string,sides:{SIDES}>>"
STEPS = "array<struct<route:string,question:string,doc_ids:array<string>,topic:string,path:string,target_lang:string,reply:string>>"
VERDICTS = "array<struct<n:int,faithful:boolean,problem:string>>"


def parsed(reply: Column) -> Column:
    """The reply as a variant, null if it is no JSON."""
    return F.try_parse_json(reply)


def at(value: Column, field: str) -> Column:
    return F.try_variant_get(value, f"$.{field}", "variant")


def kind(value: Column) -> Column:
    """STRING, BIGINT, ARRAY<...>, OBJECT<...>; VOID for null and for what is not there."""
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def is_list(value: Column) -> Column:
    return F.startswith(kind(value), F.lit("ARRAY"))


def is_object(value: Column) -> Column:
    return F.startswith(kind(value), F.lit("OBJECT"))


def string(value: Column) -> Column:
    """A string's content; null for any other kind."""
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def items(value: Column) -> Column:
    """A list's items; none for any other kind."""
    return F.coalesce(F.when(is_list(value), F.try_variant_get(value, "$", "array<variant>")), F.array().cast("array<variant>"))


def missing_or(value: Column, test: Column) -> Column:
    return (kind(value) == "VOID") | test


def _listed(reply: Column, field: str) -> Column:
    """The reply's list: a bare one, or that of a field of an object."""
    value = parsed(reply)
    return F.when(is_list(value), value).otherwise(at(value, field))


def _usable(reply: Column) -> Column:
    value = parsed(reply)
    return value.isNotNull() & (is_list(value) | is_object(value))


def _evidence(value: Column) -> Column:
    """Evidence items in full: a number and a quote each, none if the field is missing; null if any is malformed."""
    rows = F.transform(items(value), lambda e: F.struct(F.try_variant_get(e, "$.n", "int").alias("n"), string(at(e, "quote")).alias("quote")))
    whole = is_list(value) & F.forall(rows, lambda e: e["n"].isNotNull() & e["quote"].isNotNull())
    return F.when(whole, rows).when(value.isNull(), F.array().cast(EVIDENCE))


def answer(reply: Column) -> Column:
    """struct(valid, answerable, answer, evidence): a null answer is empty; evidence that is no list is none; items
    without an integer n or a quote are dropped. valid needs an object with a true or false `answerable`."""
    value = parsed(reply)
    answerable, text = F.try_variant_get(at(value, "answerable"), "$", "boolean"), at(value, "answer")
    valid = is_object(value) & answerable.isNotNull() & missing_or(text, kind(text) == "STRING")
    some = F.filter(items(at(value, "evidence")), lambda e: (kind(at(e, "n")) == "BIGINT") & (F.trim(F.coalesce(string(at(e, "quote")), F.lit(""))) != ""))
    rows = F.transform(some, lambda e: F.struct(F.try_variant_get(e, "$.n", "int").alias("n"), string(at(e, "quote")).alias("quote")))
    ok = F.coalesce(valid, F.lit(False))
    return F.struct(ok.alias("valid"), (ok & F.coalesce(answerable, F.lit(False))).alias("answerable"), F.when(ok, F.coalesce(string(text), F.lit(""))).otherwise("").alias("answer"), F.when(ok, rows).otherwise(F.array().cast(EVIDENCE)).alias("evidence"))


def points(reply: Column) -> Column:
    """struct(valid, points): a bare list counts as the points; points without a text or with malformed evidence go."""
    read = F.transform(items(_listed(reply, "points")), lambda p: F.struct(string(at(p, "text")).alias("text"), _evidence(at(p, "evidence")).alias("evidence")))
    kept = F.filter(read, lambda p: (F.trim(F.coalesce(p["text"], F.lit(""))) != "") & p["evidence"].isNotNull())
    ok = F.coalesce(_usable(reply), F.lit(False))
    return F.struct(ok.alias("valid"), F.when(ok, kept).otherwise(F.array().cast(POINTS)).alias("points"))


def comparison(reply: Column) -> Column:
    """struct(valid, points): points of an unknown kind, without sides or with a malformed side go."""

    def side(s: Column) -> Column:
        return F.struct(string(at(s, "report")).alias("report"), string(at(s, "says")).alias("says"), _evidence(at(s, "evidence")).alias("evidence"))

    def point(p: Column) -> Column:
        aspect = at(p, "aspect")
        return F.struct(string(at(p, "kind")).alias("kind"), F.when(kind(aspect) == "VOID", F.lit("")).otherwise(string(aspect)).alias("aspect"), F.transform(items(at(p, "sides")), side).alias("sides"))

    whole = lambda s: s["report"].isNotNull() & s["says"].isNotNull() & s["evidence"].isNotNull()
    kept = F.filter(F.transform(items(_listed(reply, "points")), point), lambda p: p["kind"].isin(*KINDS) & p["aspect"].isNotNull() & (F.size(p["sides"]) > 0) & F.forall(p["sides"], whole))
    ok = F.coalesce(_usable(reply), F.lit(False))
    return F.struct(ok.alias("valid"), F.when(ok, kept).otherwise(F.array().cast(COMPARISON)).alias("points"))


def steps(reply: Column) -> Column:
    """struct(valid, steps): one route object counts as one step; nulls are empty texts; one id counts as a list."""
    value = parsed(reply)
    listed = at(value, "steps")
    alone = is_object(value) & (kind(listed) == "VOID") & (kind(at(value, "route")) != "VOID")
    found = F.when(alone, F.array(value)).otherwise(items(listed))
    text = lambda s, f: F.when(kind(at(s, f)) == "VOID", F.lit("")).otherwise(string(at(s, f))).alias(f)

    def ids(s: Column) -> Column:
        v = at(s, "doc_ids")
        one = string(v)
        return F.when(one != "", F.array(one)).when(is_list(v), F.transform(items(v), lambda x: F.try_variant_get(x, "$", "string"))).otherwise(F.array().cast("array<string>")).alias("doc_ids")

    def step(s: Column) -> Column:
        route = F.when(kind(at(s, "route")) == "VOID", F.lit("clarify")).otherwise(string(at(s, "route")))
        return F.struct(route.alias("route"), text(s, "question"), ids(s), text(s, "topic"), text(s, "path"), text(s, "target_lang"), text(s, "reply"))

    read = F.transform(F.filter(found, is_object), step)
    fields = ("route", "question", "topic", "path", "target_lang", "reply")
    whole = F.forall(read, lambda s: F.concat(*(s[f] for f in fields)).isNotNull())
    ok = F.coalesce(is_object(value) & whole, F.lit(False))
    return F.struct(ok.alias("valid"), F.when(ok, read).otherwise(F.array().cast(STEPS)).alias("steps"))


def verdicts(reply: Column) -> Column:
    """struct(valid, verdicts): items need a number and a true or false `faithful`; the problem may be missing."""
    value = parsed(reply)
    row = lambda v: F.struct(F.try_variant_get(v, "$.n", "int").alias("n"), F.try_variant_get(v, "$.faithful", "boolean").alias("faithful"), F.when(kind(at(v, "problem")) == "VOID", F.lit("")).otherwise(string(at(v, "problem"))).alias("problem"))
    kept = F.filter(F.transform(F.filter(items(at(value, "items")), is_object), row), lambda v: v["n"].isNotNull() & v["faithful"].isNotNull() & v["problem"].isNotNull())
    ok = F.coalesce(is_object(value), F.lit(False))
    return F.struct(ok.alias("valid"), F.when(ok, kept).otherwise(F.array().cast(VERDICTS)).alias("verdicts"))


def translations(reply: Column, asked: Column) -> Column:
    """struct(valid, items): translations of ids 0 to asked - 1, trimmed; valid needs at least one of them."""
    rows = F.transform(items(at(parsed(reply), "translations")), lambda t: F.struct(F.try_variant_get(t, "$.id", "int").alias("id"), F.trim(string(at(t, "text"))).alias("text")))
    whole = F.forall(rows, lambda t: t["id"].isNotNull() & t["text"].isNotNull())
    kept = F.filter(rows, lambda t: (t["id"] >= 0) & (t["id"] < asked))
    ok = F.coalesce(is_list(at(parsed(reply), "translations")) & whole & (F.size(kept) > 0), F.lit(False))
    return F.struct(ok.alias("valid"), F.when(ok, kept).otherwise(F.array().cast("array<struct<id:int,text:string>>")).alias("items"))


def translated_query(reply: Column) -> Column:
    """The translation of a query, null if there is none."""
    return F.nullif(F.trim(string(at(parsed(reply), "translation"))), F.lit(""))


def error_reason(body: Column, most: int = 200) -> Column:
    """A provider's own words for a refusal, from its JSON body (or a list with it), or the body itself."""
    value = parsed(body)
    first = F.when(is_list(value), F.try_variant_get(value, "$[0]", "variant")).otherwise(value)
    said = lambda v: F.nullif(F.trim(F.coalesce(string(v), string(at(v, "message")))), F.lit(""))
    words = F.coalesce(said(at(first, "message")), said(at(first, "detail")), said(at(first, "error")), F.lit(""))
    return F.substring(F.when(value.isNull(), F.trim(body)).otherwise(words), 1, most)
