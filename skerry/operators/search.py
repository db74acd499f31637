"""Running a search: filter and score, aggregate over all matches, sort, page, highlight."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans import ast, compile as cp
from ..plans import mapping as mp
from ..plans.errors import InvalidRequest
from . import mlt
from .index import SearchIndex

SCORE_DIGITS = 6
HIGHLIGHT_BEFORE, HIGHLIGHT_AFTER, HIGHLIGHT_MOST = 50, 30, 3


@dataclass
class SearchResult:
    """``matches``: all matches with ``_score``; ``hits``: the page in order; ``aggregations``: name -> DataFrame."""

    matches: DataFrame
    hits: DataFrame
    aggregations: dict[str, DataFrame] = field(default_factory=dict)

    def total(self) -> int:
        return self.matches.count()


def matches(index: SearchIndex, query: ast.Query) -> DataFrame:
    """The index's rows that match, with ``_score`` rounded to 6 digits."""
    mp.validate_query(query, index.mapping)
    exclude = None
    if isinstance(query, ast.MoreLikeThis):
        exclude, query = query.doc_id, mlt.rewrite(index, query)
        if query is None:
            return index.df.where("false").withColumn("_score", F.lit(None).cast("double"))
    terms, fields = cp.query_terms(query), cp.token_fields(query, index.mapping)
    if fields:
        stats = index.statistics(terms, fields)
    else:
        from .index import Statistics

        stats = Statistics(0, {}, {})
    base = SearchIndex(index.df, index.mapping).with_tokens(sorted(fields))
    plain = cp.pushable(query, index.mapping)
    if plain is not None:
        base = base.where(plain)
    if exclude is not None:
        base = base.where(F.col("_id") != exclude)
    scored = cp.Compiler(index.mapping, stats).score(base, query)
    made = [c for c in scored.columns if c.startswith("_tok_") and c not in index.df.columns]
    return scored.where("_score is not null").withColumn("_score", F.round("_score", SCORE_DIGITS)).drop(*made)


def order_of(sort: ast.Sort | None, mapping: mp.Mapping) -> list[Column]:
    """Score falling and id by default; else the field with missing values last, then id."""
    if sort is None:
        return [F.desc("_score"), F.asc("_id")]
    if sort.field not in mapping:
        return [F.asc("_id")]
    c = F.col(f"`{sort.field}`")
    return [c.desc_nulls_last() if sort.descending else c.asc_nulls_last(), F.asc("_id")]


def page(found: DataFrame, request: ast.Request, mapping: mp.Mapping) -> DataFrame:
    """The request's page of the matches; only its rows leave the top-k operator."""
    if request.search_after is not None:
        found = found.where(after(request.sort, request.search_after, mapping))
    out = found.orderBy(*order_of(request.sort, mapping))
    if request.start:
        out = out.offset(min(request.start, mp.MAX_FROM))
    if request.size is not None:
        out = out.limit(min(request.size, mp.MAX_SIZE))
    return out


def after(sort: ast.Sort, cursor: tuple, mapping: mp.Mapping) -> Column:
    """Rows behind the cursor [sort value, score, id] in the order of ``order_of``."""
    value, _, last = cursor
    later = F.col("_id") > F.lit(last)
    kind = mapping.get(sort.field)
    if kind is None:
        return later
    c = F.col(f"`{sort.field}`")
    if value is None:
        return c.isNull() & later
    if kind == mp.TIMESTAMP:
        at = mp.parse_rfc3339(value) if isinstance(value, str) else value
        if at is None:
            raise InvalidRequest("search_after needs an RFC 3339 time for this sort")
        v = F.lit(at.isoformat(" ")).cast("timestamp_ntz")
    else:
        v = F.lit(value)
    return (c < v if sort.descending else c > v) | ((c == v) & later) | c.isNull()


def sort_values(request: ast.Request, mapping: mp.Mapping) -> Column:
    """[sort value or null, score, id] of a hit, as the next page's cursor takes it (JSON text)."""
    if request.sort is None or request.sort.field not in mapping:
        value = F.lit("null")
    else:
        c = F.col(f"`{request.sort.field}`")
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") if mapping[request.sort.field] == mp.TIMESTAMP else c
        value = F.coalesce(F.get(F.split(F.to_json(F.struct(text.alias("v"))), '"v":', 2), F.lit(1)), F.lit("null}"))
        value = F.regexp_replace(value, r"\}\z", "")
    return F.concat(F.lit("["), value, F.lit(","), F.col("_score").cast("string"), F.lit(","), F.concat(F.lit('"'), F.col("_id"), F.lit('"')), F.lit("]"))


def aggregate(found: DataFrame, agg: Any, mapping: mp.Mapping) -> DataFrame:
    """One aggregation over all matches."""
    known = agg.field in mapping
    c = F.col(f"`{agg.field}`") if known else F.lit(None)
    if isinstance(agg, ast.TermsAgg):
        counts = found.select(c.alias("key")).where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("doc_count"))
        text = F.concat(F.lit('"'), F.col("key"), F.lit('"')) if mapping.get(agg.field) == mp.KEYWORD else F.col("key").cast("string")
        return counts.orderBy(F.desc("doc_count"), text)
    if isinstance(agg, ast.StatsAgg):
        v = c.cast("double")
        return found.agg(F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("avg"), F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"))
    key = F.date_format(F.date_trunc(agg.interval.upper(), c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return found.where(c.isNotNull()).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("doc_count")).orderBy("key")


def search(index: SearchIndex, request: ast.Request, highlight: bool = False, share: bool = True) -> SearchResult:
    """Matches, page and aggregations of a request.

    With ``share`` and several aggregations the columns these need are persisted, so they all read one pass over the matches; ``matches``
    is that narrow table then, which the caller unpersists when done.
    """
    mp.validate(request, index.mapping)
    found = matches(index, request.query)
    narrow = found
    if share and len(request.aggregations) > 1:
        fields = sorted({a.field for _, a in request.aggregations if a.field in index.mapping})
        narrow = found.select("_id", "_score", *[F.col(f"`{f}`") for f in fields]).persist()
    hits = page(found, request, index.mapping).withColumn("_sort", sort_values(request, index.mapping))
    if highlight:
        hits = hits.withColumn("_highlight", highlights(index, request.query))
    return SearchResult(narrow, hits, {name: aggregate(narrow, a, index.mapping) for name, a in request.aggregations})


# -- highlighting -----------------------------------------------------------------------------


def highlight_terms(q: ast.Query) -> list[str]:
    if isinstance(q, ast.Bool):
        return sorted(set().union(*(highlight_terms(c) for c in q.must + q.should + q.filter)))
    if isinstance(q, ast.Term):
        return [q.value.lower()] if isinstance(q.value, str) else []
    if isinstance(q, ast.Terms):
        return sorted({v.lower() for v in q.values if isinstance(v, str)})
    if isinstance(q, ast.MultiMatch):
        return sorted(set(tx.tokenize(q.query)))
    return sorted(set(tx.tokenize(q.value))) if isinstance(q, (ast.Prefix, ast.Wildcard, ast.Match, ast.Phrase)) else []


def fragments(c: Column, terms: list[str]) -> Column:
    """The first three places of the terms as tokens, each with the text around it; null where there is none.

    A text is cut at a term's first places by a bounded split, which gives their offsets
    without walking over its characters.
    """
    low = F.concat(F.lit(" "), F.translate(c, tx.UPPER + tx.BLANKS, tx.LOWER + " " * len(tx.BLANKS)), F.lit(" "))
    places = []
    for t in terms:
        quoted = r" \Q" + t.replace(r"\E", r"\E\\E\Q") + r"\E(?= )"
        parts = F.split(low, quoted, HIGHLIGHT_MOST + 1)
        found = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), _place(parts, len(t)))
        places.append(F.when(F.size(parts) > 1, found).otherwise(F.array().cast("array<struct<at:int,size:int>>")))
    first = F.slice(F.array_sort(F.array_distinct(F.concat(*places))), 1, HIGHLIGHT_MOST)

    def fragment(p: Column) -> Column:
        begin = F.greatest(p["at"] - HIGHLIGHT_BEFORE, F.lit(0))
        return F.concat(
            F.substr(c, begin + 1, p["at"] - begin), F.lit("<em>"), F.substr(c, p["at"] + 1, p["size"]), F.lit("</em>"), F.substr(c, p["at"] + p["size"] + 1, F.lit(HIGHLIGHT_AFTER))
        )

    out = F.transform(first, fragment)
    return F.when(F.size(out) > 0, out)


def _place(parts: Column, size: int):
    """Offset of the i-th cut: what lies before it, with the words taken out by earlier cuts."""

    def place(i: Column) -> Column:
        before = F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda acc, p: acc + F.length(p))
        return F.struct((before + (i - 1) * (size + 1)).alias("at"), F.lit(size).alias("size"))

    return place


def highlights(index: SearchIndex, q: ast.Query) -> Column:
    """field -> fragments for every text field with any; null where no field has any."""
    terms = highlight_terms(q)
    kind = "map<string,array<string>>"
    if not terms or not index.text_fields:
        return F.lit(None).cast(kind)
    made = F.create_map(*[x for f in index.text_fields for x in (F.lit(f), fragments(F.col(f"`{f}`"), terms))])
    some = F.map_filter(made, lambda _, v: v.isNotNull())
    return F.when(F.size(some) > 0, some)
