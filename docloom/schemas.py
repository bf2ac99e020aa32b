"""Schemas of the tables that sources read and sinks write."""

from __future__ import annotations

from pyspark.sql import types as T

_PLAIN = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "date": T.DateType()}


def of(spec) -> T.DataType:
    """A type from a name, [items], {field: type} or (key, value) of a map. Unlike DDL it needs no session."""
    if isinstance(spec, str):
        return _PLAIN[spec]
    if isinstance(spec, list):
        return T.ArrayType(of(spec[0]))
    if isinstance(spec, tuple):
        return T.MapType(of(spec[0]), of(spec[1]))
    return T.StructType([T.StructField(name, of(kind)) for name, kind in spec.items()])


_BOX = {"x0": "double", "y0": "double", "x1": "double", "y1": "double"}
_STYLE = {"font": "string", "color": "int", "bold": "boolean", "italic": "boolean", "position": "string"}
BOX, STYLE = of(_BOX), of(_STYLE)
CATALOGUE = of({"id": "string", "file": "string", "title": "string", "org": "string", "year": "int", "lang": "string", "url": "string", "summary_pages": ["int"]})
PASSAGE = of({"passage_id": "string", "doc_id": "string", "title": "string", "page": "int", "section": "string", "text": "string", "boxes": [_BOX], "lang": "string"})
QUESTION = of({"id": "string", "question": "string", "type": "string", "lang": "string", "expected": [{"doc_id": "string", "pages": ["int"]}]})
BLOCK = of(
    {"doc_id": "string", "page": "int", "pos": "int", "box": _BOX, "text": "string", "lines": ["string"], "markup": "string", "line_markups": ["string"], "styles": ("string", _STYLE), "line_boxes": [_BOX], "bullet_boxes": [_BOX]}
    | {"font": "string", "size": "double", "color": "int", "bold": "boolean", "italic": "boolean", "horizontal": "boolean", "numeric": "boolean"}
)
GLYPH = of(
    {"doc_id": "string", "page": "int", "block": "int", "line": "int", "pos": "int", "char": "string", "box": _BOX, "font": "string", "size": "double", "color": "int", "flags": "int", "baseline": "double", "line_box": _BOX, "dir_x": "double", "dir_y": "double"}
)
NODE = of(
    {"thread": "string", "seq": "int", "node": "string", "seconds": "double", "tool": "string", "items": "int", "passages": "int", "rejected": ["string"], "kept": "int", "removed": "int", "judged": "boolean", "ok": "boolean", "refusal": "string", "error": "string"}
    | {"timings": ("string", "double")}
)
TRAJECTORY = T.StructType([*NODE.fields, *of({"ts": "timestamp", "day": "date"}).fields])
JOB = of({"job_id": "string", "status": "string", "detail": "string", "done": "int", "total": "int", "ts": "timestamp", "seq": "long"})
VECTOR = of({"point_id": "string", "passage_id": "string", "doc_id": "string", "page": "int", "v": ["double"], "model": "string"})
CACHE = of({"key": "string", "value": "string", "model": "string", "prompt_version": "string"})
TRACE = of(
    {"thread": "string", "kind": "string", "name": "string", "input": "string", "output": "string", "tokens_in": "long", "tokens_out": "long", "cost_usd": "double", "score": "double", "level": "string", "ts": "timestamp"}
)
#: Statuses of a job, in the order it goes through them.
STATUSES = ("queued", "running", "needs_confirmation", "done", "failed")
