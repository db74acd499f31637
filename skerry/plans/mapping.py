"""Field types of an index, and the checks of requests against them."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import types as T

from . import ast
from .errors import InvalidRequest, MappingConflict

KEYWORD, TIMESTAMP, BOOLEAN, INTEGER, LONG, DOUBLE, OBJECT = "Keyword", "Timestamp", "Boolean", "Integer", "Long", "Double", "Object"
MAX_FIELDS = 1000
MAX_SIZE, MAX_FROM = 10_000, 1_000_000
STRICT, DYNAMIC = "strict", "controlled_dynamic"
Mapping = dict[str, str]

_RFC3339 = re.compile(r"\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})\Z")
SPARK_TYPES = {KEYWORD: "string", TIMESTAMP: "timestamp", BOOLEAN: "boolean", INTEGER: "int", LONG: "bigint", DOUBLE: "double", OBJECT: "string"}


def parse_rfc3339(value: Any) -> datetime | None:
    """The instant in UTC without zone, or None where the value isn't RFC 3339 (a date alone isn't)."""
    if not isinstance(value, str) or not _RFC3339.match(value):
        return None
    try:
        head, zone = (value[:-1], "+00:00") if value[-1] in "zZ" else (value[:-6], value[-6:])
        whole, _, part = head.partition(".")
        return datetime.fromisoformat(f"{whole}.{part[:6].ljust(6, '0')}{zone}".upper()).astimezone(timezone.utc).replace(tzinfo=None)
    except ValueError:
        return None


def infer_type(value: Any) -> str | None:
    """The type of one JSON value; None for null. Lists have none and are refused."""
    if value is None:
        return None
    if isinstance(value, bool):
        return BOOLEAN
    if isinstance(value, int):
        return INTEGER if -(2**31) <= value < 2**31 else LONG if -(2**63) <= value < 2**63 else DOUBLE
    if isinstance(value, float):
        return DOUBLE
    if isinstance(value, str):
        return TIMESTAMP if parse_rfc3339(value) else KEYWORD
    if isinstance(value, dict):
        return OBJECT
    raise MappingConflict("lists are not supported")


def extend(mapping: Mapping, source: Any, mode: str = DYNAMIC) -> Mapping:
    """The mapping with a document's new fields. Types must be equal: nothing widens. Strict refuses new fields."""
    if not isinstance(source, dict):
        raise MappingConflict("a document must be a JSON object")
    out = dict(mapping)
    for name, value in source.items():
        kind = infer_type(value)
        if kind is None:
            continue
        if name in out:
            if out[name] != kind:
                raise MappingConflict(f"field {name} is {out[name]}, not {kind}")
        elif mode == STRICT:
            raise MappingConflict(f"field {name} is not in the strict mapping")
        else:
            out[name] = kind
    if len(out) > MAX_FIELDS:
        raise MappingConflict(f"more than {MAX_FIELDS} fields")
    return out


def from_spark(schema: T.StructType) -> Mapping:
    """The mapping of a table's columns; types the engine doesn't know are left out."""
    kinds = {"string": KEYWORD, "boolean": BOOLEAN, "tinyint": INTEGER, "smallint": INTEGER, "int": INTEGER, "bigint": LONG, "float": DOUBLE, "double": DOUBLE, "timestamp": TIMESTAMP, "timestamp_ntz": TIMESTAMP}
    out = {}
    for f in schema:
        kind = kinds.get(f.dataType.simpleString(), DOUBLE if isinstance(f.dataType, T.DecimalType) else OBJECT if isinstance(f.dataType, (T.StructType, T.MapType)) else None)
        if kind and not f.name.startswith("_"):
            out[f.name] = kind
    return out


def _refuse(bad: bool, why: str) -> None:
    if bad:
        raise InvalidRequest(why)


def validate(request: ast.Request, mapping: Mapping) -> None:
    """Refuses what can't work on this mapping; fields it doesn't have pass and match nothing."""
    _refuse((request.size or 0) > MAX_SIZE and (request.start or 0) > MAX_FROM, "from and size are both beyond their limits")
    if request.sort:
        _refuse(mapping.get(request.sort.field) == OBJECT, "objects can't be sorted")
    if request.search_after is not None:
        _refuse(request.sort is None, "search_after needs a sort")
        _refuse(request.start is not None, "search_after and from exclude each other")
        _refuse(ast.has_fuzzy(request.query), "search_after can't be used with fuzzy terms")
    for name, agg in request.aggregations:
        kind = mapping.get(agg.field)
        if kind is None:
            continue
        _refuse(isinstance(agg, ast.TermsAgg) and kind == OBJECT, f"{name}: objects have no terms")
        _refuse(isinstance(agg, ast.StatsAgg) and kind not in (INTEGER, LONG, DOUBLE), f"{name}: stats need a numeric field")
        _refuse(isinstance(agg, ast.DateHistogramAgg) and kind != TIMESTAMP, f"{name}: date_histogram needs a timestamp field")
    validate_query(request.query, mapping)


def validate_query(q: ast.Query, mapping: Mapping) -> None:
    def text(name: str, what: str) -> None:
        _refuse(mapping.get(name, KEYWORD) != KEYWORD, f"{what} needs a text field, {name} is {mapping.get(name)}")

    if isinstance(q, (ast.Term, ast.Terms, ast.Prefix, ast.Wildcard)):
        _refuse(mapping.get(q.field) == OBJECT, f"{q.field} is an object")
    elif isinstance(q, ast.Range):
        _refuse(mapping.get(q.field, LONG) in (KEYWORD, BOOLEAN, OBJECT), f"range needs a number or timestamp, {q.field} is {mapping.get(q.field)}")
    elif isinstance(q, (ast.Match, ast.Phrase)):
        text(q.field, "match")
    elif isinstance(q, ast.MultiMatch):
        _refuse(not q.fields, "multi_match needs a field")
        for name, _ in q.fields:
            text(name, "multi_match")
    elif isinstance(q, ast.MoreLikeThis):
        _refuse((q.doc_id is None) == (q.like is None), "mlt needs either doc_id or like")
        for name in q.fields:
            text(name, "mlt")
    for c in ast.clauses(q):
        validate_query(c, mapping)


def canonical(value: Any) -> str:
    """One spelling of a JSON value."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
