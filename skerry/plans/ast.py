"""Syntax trees of search requests."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Union

BEST_FIELDS, MOST_FIELDS, PHRASE, PHRASE_PREFIX = "best_fields", "most_fields", "phrase", "phrase_prefix"


@dataclass(frozen=True)
class MatchAll:
    """Every document, with score 1."""


@dataclass(frozen=True)
class Term:
    """``field`` holds ``value``: a token of a text, or an equal number or boolean."""

    field: str
    value: Any
    fuzziness: int | str | None = None
    boost: float = 1.0


@dataclass(frozen=True)
class Terms:
    """``field`` holds any of ``values``."""

    field: str
    values: tuple = ()


@dataclass(frozen=True)
class Range:
    field: str
    gte: Any = None
    gt: Any = None
    lte: Any = None
    lt: Any = None


@dataclass(frozen=True)
class Prefix:
    field: str
    value: str


@dataclass(frozen=True)
class Wildcard:
    """``*`` any characters, ``?`` one."""

    field: str
    value: str


@dataclass(frozen=True)
class Match:
    """Any word of ``value``."""

    field: str
    value: str


@dataclass(frozen=True)
class Phrase:
    """The words of ``value`` in order; with ``slop`` 0 one directly after another."""

    field: str
    value: str
    slop: int | None = None


@dataclass(frozen=True)
class MultiMatch:
    query: str
    fields: tuple[tuple[str, float], ...]
    type: str = BEST_FIELDS
    tie_breaker: float = 0.0


@dataclass(frozen=True)
class MoreLikeThis:
    """Documents that share the significant terms of one document or of a given source."""

    doc_id: str | None = None
    like: dict | None = field(default=None, hash=False)
    fields: tuple[str, ...] = ()
    min_term_freq: int = 2
    min_doc_freq: int = 1
    max_query_terms: int = 25
    min_word_length: int = 0
    max_word_length: int = 2**31 - 1
    field_boost_factor: float = 1.0


@dataclass(frozen=True)
class Bool:
    must: tuple = ()
    should: tuple = ()
    filter: tuple = ()
    must_not: tuple = ()
    minimum_should_match: int | None = None


Query = Union[MatchAll, Term, Terms, Range, Prefix, Wildcard, Match, Phrase, MultiMatch, MoreLikeThis, Bool]


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class TermsAgg:
    field: str


@dataclass(frozen=True)
class StatsAgg:
    field: str


@dataclass(frozen=True)
class DateHistogramAgg:
    field: str
    interval: str  # minute, hour or day


@dataclass(frozen=True)
class Request:
    query: Query = MatchAll()
    start: int | None = None
    size: int | None = None
    sort: Sort | None = None
    search_after: tuple | None = None
    aggregations: tuple[tuple[str, Union[TermsAgg, StatsAgg, DateHistogramAgg]], ...] = ()


def clauses(q: Query) -> tuple:
    """The direct clauses of a Bool, none of any other node."""
    return q.must + q.should + q.filter + q.must_not if isinstance(q, Bool) else ()


def has_fuzzy(q: Query) -> bool:
    return isinstance(q, Term) and q.fuzziness is not None or any(map(has_fuzzy, clauses(q)))
