"""Registered searches over the test tables, with SQL that computes the same by other means."""

from __future__ import annotations

import glob
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import mlt, suggest
from .operators.index import SearchIndex
from .operators.postings import Postings
from .operators.search import aggregate, fragments, matches, page, search, sort_values
from .plans import ast, dsl, qstring
from .plans import mapping as mp
from .session import scratch_path
from .sources.tables import table

Q = Callable[[SparkSession, str], DataFrame]
#: The fields of the indexes over the test tables.
DOC_FIELDS = ["text", "lang", "source", "kind", "title", "n_chars", "created_at"]
DOC_TEXTS = ["text", "lang", "source", "kind", "title"]


_KEPT: dict[tuple, object] = {}


def kept(kind: str, spark: SparkSession, folder: str, make: Callable):
    """What a flush leaves of a table (columns with words, posting lists), made once per session and state of the table's folder.

    Nothing that a search finds out is kept: each has an index of its own, which asks for its statistics.
    """
    files = sorted((f, os.path.getmtime(f)) for f in glob.glob(f"{folder.removeprefix('file://')}/*.parquet"))
    key = (kind, spark.sparkContext.applicationId, folder, tuple(files))
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def _stored_docs(spark: SparkSession, folder: str) -> SearchIndex:
    def make() -> SearchIndex:
        return SearchIndex.from_table(table(spark, folder, "documents"), "doc_id", DOC_FIELDS).materialized(scratch_path(spark, "documents"))

    return kept("documents", spark, folder, make)


def posting_lists(spark: SparkSession, folder: str) -> Postings:
    """The posting lists of the documents, as a flush leaves them."""
    return kept("postings", spark, folder, lambda: Postings.build(_stored_docs(spark, folder)))


def docs(spark: SparkSession, folder: str, profile: str = "flushed") -> SearchIndex:
    """The documents as a flushed index: columns and words stored together, statistics in posting lists."""
    index = _stored_docs(spark, folder)
    return SearchIndex(index.df, index.mapping, profile, stored=posting_lists(spark, folder).statistics())


def events(spark: SparkSession, folder: str) -> SearchIndex:
    return SearchIndex.from_table(table(spark, folder, "events"), "event_id", ["event_id", "ts", "user_id", "event_type", "value"])


def orders(spark: SparkSession, folder: str) -> SearchIndex:
    return SearchIndex.from_table(table(spark, folder, "orders"), "o_orderkey")


def parts(spark: SparkSession, folder: str) -> SearchIndex:
    return SearchIndex.from_table(table(spark, folder, "part"), "p_partkey")


def lines(spark: SparkSession, folder: str) -> SearchIndex:
    return SearchIndex.from_table(table(spark, folder, "lineitem"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


def regions(spark: SparkSession, folder: str) -> SearchIndex:
    return SearchIndex.from_table(table(spark, folder, "region"), "r_regionkey")


def scored(make: Callable, body: dict, *columns: str) -> Q:
    """All matches of a JSON query as (_id, _score, …)."""
    query = dsl.query(body)
    return lambda spark, folder: matches(make(spark, folder), query).select("_id", "_score", *columns)


def paged(make: Callable, body: dict, *columns: str) -> Q:
    """The hits of a JSON request."""
    request = dsl.request(body)

    def run(spark: SparkSession, folder: str) -> DataFrame:
        index = make(spark, folder)
        return page(matches(index, request.query), request, index.mapping).select("_id", "_score", *columns)

    return run


def aggregated(make: Callable, body: dict) -> Q:
    request = dsl.request(body)
    [(_, agg)] = request.aggregations

    def run(spark: SparkSession, folder: str) -> DataFrame:
        index = make(spark, folder)
        return aggregate(matches(index, request.query), agg, index.mapping)

    return run


# -- SQL --------------------------------------------------------------------------------------

_FROM = tx.UPPER + tx.BLANKS
_TO = tx.LOWER + " " * len(tx.BLANKS)


def _tok(c: str) -> str:
    return f"list_filter(string_split(translate({c}, '{_FROM}', '{_TO}'), ' '), lambda x: x <> '')"


def doc_sql(terms: list[str], body: str, texts: list[str] = DOC_TEXTS) -> str:
    """SQL with d (documents with tokens t_<field>) and st (n, mean lengths a_<field>, document frequencies f0, f1 …); ``terms`` fill {tf:i:field}-like calls made by ``bm``."""
    held = lambda t: " OR ".join(f"list_contains(coalesce(t_{f}, []), '{t}')" for f in texts)
    freq = "".join(f", count(*) FILTER ({held(t)}) AS f{i}" for i, t in enumerate(terms))
    mean = "".join(f", greatest(coalesce(avg(len(t_{f})), 1.0), 1.0) AS a_{f}" for f in texts)
    return f"""WITH d AS MATERIALIZED (SELECT *, CAST(doc_id AS VARCHAR) AS _id{"".join(f", {_tok(f)} AS t_{f}" for f in texts)} FROM documents),
st AS MATERIALIZED (SELECT count(*) AS n{mean}{freq} FROM d)
{body}"""


def idf(i: int) -> str:
    return f"(CASE WHEN f{i} = 0 THEN 1.0 ELSE greatest(ln((n - f{i} + 0.5) / (f{i} + 0.5)), 0.0) END)"


def tf(word: str, f: str = "text") -> str:
    return f"len(list_filter(t_{f}, lambda x: x = '{word}'))"


def bm(i: int, word: str, f: str = "text", weight: str | None = None) -> str:
    """BM25 of term number i, null where the field lacks it."""
    w = weight or idf(i)
    return f"(CASE WHEN {tf(word, f)} > 0 THEN {w} * {tf(word, f)} * 2.2 / ({tf(word, f)} + 1.2 * (0.25 + 0.75 * len(t_{f}) / a_{f})) END)"


def some(words: list[str], f: str = "text", flat: bool = False) -> str:
    """Sum over the words' BM25, null where none is there."""
    one = [bm(i, w, f, "1.0" if flat else None) for i, w in enumerate(words)]
    return f"(CASE WHEN {' OR '.join(f'{tf(w, f)} > 0' for w in words)} THEN {' + '.join(f'coalesce({x}, 0.0)' for x in one)} END)"


def hits_sql(score: str, where: str = "score IS NOT NULL") -> str:
    return f"SELECT _id, round(score, 6) AS _score FROM (SELECT d.*, {score} AS score FROM d, st) WHERE {where}"


_EVENT = "SELECT CAST(event_id AS VARCHAR) AS _id, 1.0 AS _score, * FROM events"
_TERM_EVENT = """(SELECT CAST(event_id AS VARCHAR) AS _id, event_id, ts, user_id, event_type, value, CASE WHEN lower(event_type) = '{w}' THEN i * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 1.0)) END AS score
FROM events, (SELECT CASE WHEN f = 0 THEN 1.0 ELSE greatest(ln((n - f + 0.5) / (f + 0.5)), 0.0) END AS i FROM (SELECT count(*) AS n, count(*) FILTER (event_type = '{w}') AS f FROM events)))"""


# -- queries that take more than one expression -----------------------------------------------


def _sort_missing(spark: SparkSession, folder: str) -> DataFrame:
    index = docs(spark, folder)
    request = dsl.request({"sort": {"source": {"order": "desc"}}, "from": 50, "size": 500})
    return page(matches(index, request.query), request, index.mapping).select("_id", "source")


def _search_after(spark: SparkSession, folder: str) -> DataFrame:
    """The third page of 50, each page found from the cursor of the last hit of the one before."""
    index = orders(spark, folder)
    cursor = None
    for _ in range(2):
        request = ast.Request(sort=ast.Sort("o_totalprice", True), size=50, search_after=cursor)
        last = page(matches(index, request.query), request, index.mapping).select("o_totalprice", "_score", "_id").collect()[-1]
        cursor = tuple(last)
    request = ast.Request(sort=ast.Sort("o_totalprice", True), size=50, search_after=cursor)
    return page(matches(index, request.query), request, index.mapping).select("_id", "o_totalprice")


def _multi_agg(spark: SparkSession, folder: str) -> DataFrame:
    body = {"query": {"range": {"value": {"gte": 50}}}, "aggs": {"types": {"terms": {"field": "event_type"}}, "hours": {"date_histogram": {"field": "ts", "interval": "day"}}}}
    result = search(events(spark, folder), dsl.request(body), share=False)
    rows = [a.select(F.lit(name).alias("agg"), F.col("key"), "doc_count") for name, a in result.aggregations.items()]
    return rows[0].unionByName(rows[1])


def _total(spark: SparkSession, folder: str) -> DataFrame:
    found = matches(events(spark, folder), dsl.query({"term": {"event_type": "error"}}))
    return found.agg(F.count(F.lit(1)).alias("total"))


def _mlt(query: ast.MoreLikeThis) -> Q:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        index = docs(spark, folder)
        return page(matches(index, query), ast.Request(size=100), index.mapping).select("_id", "_score")

    return run


def _mlt_doc(spark: SparkSession, folder: str) -> DataFrame:
    """Like the longest text."""
    longest = table(spark, folder, "documents").orderBy(F.desc("n_chars"), "doc_id").select("doc_id").first()
    return _mlt(ast.MoreLikeThis(doc_id=str(longest["doc_id"]), fields=("text",)))(spark, folder)


def _mlt_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The terms a document is rewritten to, with their boosts."""
    clauses = mlt.rewrite(docs(spark, folder), ast.MoreLikeThis(like=_LIKE, min_term_freq=1)).should
    return spark.createDataFrame([(c.field, c.value, round(c.boost, 6)) for c in clauses], "field string, term string, boost double")


_LIKE = {"text": "the merge planner drops the oldest generation during the weekly merge"}


def _suggest(spark: SparkSession, folder: str) -> DataFrame:
    words = suggest.vocabulary(docs(spark, folder))
    return suggest.suggest(words, "Me", {"text": 1.0, "title": 2.0, "kind": 0.0}, 20).select("text", "field", F.round("score", 6).alias("score"))


def _vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return suggest.vocabulary(docs(spark, folder)).select("field", "term", "doc_freq", F.round("score", 6).alias("score"))


def _highlight(spark: SparkSession, folder: str) -> DataFrame:
    index = docs(spark, folder)
    request = dsl.request({"query": {"match": {"text": "merge planner"}}, "size": 50})
    result = search(index, request, highlight=True)
    each = result.hits.select("_id", F.explode("_highlight").alias("field", "fragments"))
    return each.select("_id", "field", F.posexplode("fragments").alias("place", "fragment"))


def _typed_fields(spark: SparkSession, folder: str) -> SearchIndex:
    """Orders with a boolean and an object field."""
    o = table(spark, folder, "orders")
    info = F.to_json(F.struct(F.col("o_orderpriority").alias("priority"), (F.col("o_custkey") % 5).alias("group")))
    index = SearchIndex.from_table(o.select("o_orderkey", "o_orderstatus", (F.col("o_orderstatus") == "O").alias("open"), info.alias("info")), "o_orderkey")
    return SearchIndex(index.df, index.mapping | {"info": mp.OBJECT})


def _refused(spark: SparkSession, folder: str) -> DataFrame:
    """Requests that can't work on the mapping, or are no requests, with their status."""
    from .plans.response import multi_search

    agg = lambda kind, field, **more: {"aggs": {"a": {kind: {"field": field, **more}}}}
    bodies = [
        {"query": {"range": {"o_orderstatus": {"gte": "A"}}}}, {"query": {"range": {"open": {"gte": 1}}}}, agg("terms", "info"), agg("stats", "o_orderstatus"), agg("date_histogram", "o_orderkey", interval="day"), {"sort": {"info": {"order": "asc"}}},
        {"query": {"term": {"info": "x"}}}, {"query": {"match": {"o_orderkey": "x"}}}, {"query": {"nothing": {}}}, {"size": 10**9, "from": 10**9}, {"search_after": [1, 1.0, "1"]}, {"query": {"multi_match": {"query": "x", "fields": {}}}},
    ]
    return multi_search(spark, {"orders": _typed_fields(spark, folder)}, [("orders", b) for b in bodies] + [("nowhere", {})]).select("item", "status")


def _highlight_one(spark: SparkSession, folder: str) -> DataFrame:
    """The first fragment of one word in every text."""
    return table(spark, folder, "documents").select("doc_id", F.get(fragments(F.col("text"), ["merge"]), F.lit(0)).alias("fragment")).where("fragment is not null")


def _query_string(text: str, make: Callable = events) -> Q:
    query = qstring.parse(text)
    return lambda spark, folder: matches(make(spark, folder), query).select("_id", "_score")


def _msearch(spark: SparkSession, folder: str) -> DataFrame:
    from .plans.response import multi_search

    items = [("events", {"query": {"term": {"event_type": "click"}}, "sort": {"value": {"order": "desc"}}, "size": 20}), ("orders", {"query": {"range": {"o_totalprice": {"gte": 1000}}}, "sort": {"o_totalprice": {"order": "asc"}}, "size": 20}), ("nowhere", {}), ("orders", {"query": {"nothing": {}}})]
    made = {"events": events(spark, folder), "orders": orders(spark, folder)}
    return multi_search(spark, made, items)


def _sort_values(spark: SparkSession, folder: str) -> DataFrame:
    index = orders(spark, folder)
    request = dsl.request({"sort": {"o_custkey": {"order": "asc"}}, "size": 40})
    return page(matches(index, request.query), request, index.mapping).select("_id", sort_values(request, index.mapping).alias("cursor"))


def _unflushed(spark: SparkSession, folder: str) -> DataFrame:
    return matches(docs(spark, folder, "unflushed"), dsl.query({"match": {"text": "merge planner lease"}})).select("_id", "_score")


def by_postings(body: dict) -> Q:
    query = dsl.query(body)
    return lambda spark, folder: posting_lists(spark, folder).search(query)


def _dsl_flagship(size: int = 20) -> dict:
    return {"query": {"bool": {"must": [{"term": {"event_type": "error"}}], "filter": [{"range": {"value": {"gte": 50}}}]}}, "sort": {"ts": {"order": "desc"}}, "size": size}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return paged(events, _dsl_flagship(), "ts", "event_type", "value")(spark, folder)


_W = ["merge", "planner", "lease"]
_MIXED = {"bool": {"must": [{"match": {"text": "merge planner"}}], "should": [{"term": {"lang": "en"}}], "filter": [{"range": {"n_chars": {"gte": 500}}}], "must_not": [{"term": {"text": "lease"}}]}}
_MM = {"text": 1.0, "title": 2.0}


def _mm(kind: str, tie: float = 0.0, text: str = "merge planner") -> Q:
    return scored(docs, {"multi_match": {"query": text, "fields": _MM, "type": kind, "tie_breaker": tie}})


def queries() -> dict[str, Q]:
    return {
        "flagship": flagship,
        "match_all": paged(events, {"sort": {"event_id": {"order": "asc"}}, "size": 100}, "event_type", "value"),
        "term_keyword": scored(events, {"term": {"event_type": "Click"}}),
        "term_token": scored(docs, {"term": {"text": "the"}}),
        "term_numeric": scored(events, {"term": {"user_id": 8}}),
        "term_numeric_kind": scored(events, {"term": {"user_id": 8.0}}),
        "term_boost": scored(docs, {"term": {"field": "text", "value": "merge", "boost": 2.5}}),
        "term_missing_field": scored(docs, {"term": {"nothing": "x"}}),
        "terms_string": scored(docs, {"terms": {"lang": ["en", "fr"]}}),
        "terms_numeric": scored(orders, {"terms": {"o_custkey": [1, 7, 7, 100, 250]}}, "o_custkey"),
        "range_numeric": scored(lines, {"range": {"l_quantity": {"gte": 10, "lt": 12}}}, "l_quantity"),
        "range_timestamp": scored(events, {"range": {"ts": {"gte": "2024-01-05T00:00:00Z", "lt": "2024-01-06T02:00:00+02:00"}}}, "ts"),
        "range_open": scored(events, {"range": {"field": "value", "gt": None}}),
        "prefix": scored(parts, {"prefix": {"p_type": "ECO"}}, "p_type"),
        "prefix_documents": scored(docs, {"prefix": {"text": "The"}}),
        "wildcard": scored(parts, {"wildcard": {"p_name": "*r*g*"}}, "p_name"),
        "wildcard_one": scored(docs, {"wildcard": {"kind": "r?nb*k"}}, "kind"),
        "term_boolean": scored(_typed_fields, {"term": {"open": True}}),
        "refused_requests": _refused,
        "match": scored(docs, {"match": {"text": "merge Planner lease merge"}}),
        "bool_must_should": scored(docs, {"bool": {"must": [{"match": {"text": "merge planner"}}], "should": [{"term": {"lang": "en"}}, {"term": {"text": "lease"}}]}}),
        "bool_filter_must_not": scored(events, {"bool": {"filter": [{"term": {"event_type": "error"}}], "must_not": [{"range": {"value": {"lt": 50}}}]}}),
        "bool_min_should_match": scored(docs, {"bool": {"should": [{"term": {"text": w}} for w in _W], "minimum_should_match": 2}}),
        "bool_empty": scored(regions, {"bool": {}}),
        "bool_msm_zero": scored(events, {"bool": {"should": [{"term": {"user_id": 8}}], "minimum_should_match": 0}}),
        "bool_nested": scored(docs, {"bool": {"must": [{"bool": {"should": [{"term": {"text": "merge"}}, {"term": {"text": "lease"}}]}}], "must_not": [{"bool": {"must": [{"term": {"lang": "de"}}]}}]}}),
        "agg_terms": aggregated(events, {"aggs": {"a": {"terms": {"field": "event_type"}}}}),
        "agg_terms_numeric": aggregated(events, {"aggs": {"a": {"terms": {"field": "user_id"}}}}),
        "agg_stats": aggregated(events, {"query": {"term": {"event_type": "purchase"}}, "aggs": {"a": {"stats": {"field": "value"}}}}),
        "agg_stats_empty": aggregated(events, {"query": {"term": {"event_type": "none"}}, "aggs": {"a": {"stats": {"field": "value"}}}}),
        "agg_histogram_minute": aggregated(events, {"aggs": {"a": {"date_histogram": {"field": "ts", "interval": "minute"}}}}),
        "agg_histogram_hour": aggregated(events, {"aggs": {"a": {"date_histogram": {"field": "ts", "interval": "hour"}}}}),
        "agg_histogram_day": aggregated(events, {"aggs": {"a": {"date_histogram": {"field": "ts", "interval": "day"}}}}),
        "multi_agg_request": _multi_agg,
        "hit_total": _total,
        "sort_field_desc_missing_last": _sort_missing,
        "sort_timestamp": paged(events, {"sort": [{"ts": {"order": "desc"}}], "size": 30}, "ts"),
        "page_from_size": paged(orders, {"sort": {"o_totalprice": {"order": "asc"}}, "from": 100, "size": 50}, "o_totalprice"),
        "search_after": _search_after,
        "sort_values": _sort_values,
        "score_sort_topk": paged(docs, {"query": {"match": {"text": "merge planner lease"}}, "size": 25}),
        "fuzzy_exact": scored(regions, {"term": {"field": "r_name", "value": "ASIB", "fuzziness": 1}}, "r_name"),
        "fuzzy_auto": scored(parts, {"term": {"field": "p_type", "value": "PROMOO", "fuzziness": "auto"}}, "p_type"),
        "phrase_ordered": scored(docs, {"phrase": {"text": "merge planner"}}),
        "phrase_adjacent": scored(docs, {"phrase": {"field": "text", "value": "merge planner", "slop": 0}}),
        "multi_match_best_fields": _mm("best_fields"),
        "multi_match_tie_breaker": _mm("best_fields", 0.3, "merge merge"),
        "multi_match_most_fields": _mm("most_fields"),
        "multi_match_phrase": _mm("phrase", text="merge planner"),
        "multi_match_phrase_prefix": _mm("phrase_prefix", text="merge planner la"),
        "mlt_doc": _mlt_doc,
        "mlt_like": _mlt(ast.MoreLikeThis(like=_LIKE, min_term_freq=1)),
        "mlt_terms": _mlt_terms,
        "unflushed_profile": _unflushed,
        "suggest": _suggest,
        "suggest_vocabulary": _vocabulary,
        "highlight": _highlight,
        "highlight_fragment": _highlight_one,
        "query_string": _query_string("event_type:error AND value:>50"),
        "query_string_or_not": _query_string("(event_type:error OR event_type:view) NOT value:10..40"),
        "msearch": _msearch,
        "postings_match": by_postings({"match": {"text": "merge planner lease"}}),
        "postings_multi_match": by_postings({"multi_match": {"query": "merge planner", "fields": _MM, "tie_breaker": 0.3}}),
        "postings_bool": by_postings(_MIXED),
        "postings_phrase": by_postings({"phrase": {"text": "merge planner"}}),
        "postings_phrase_prefix": by_postings({"multi_match": {"query": "merge planner la", "fields": _MM, "type": "phrase_prefix"}}),
        "postings_topk": lambda spark, folder: posting_lists(spark, folder).page(dsl.query({"match": {"text": "merge planner lease"}}), 25).select("_id", "_score", "title"),
    }


def oracle_sql() -> dict[str, str]:
    one = "SELECT CAST({k} AS VARCHAR) AS _id, 1.0 AS _score{more} FROM {t}{where}"
    mm = lambda f: some(["merge", "planner"], f)
    a, b = mm("text"), f"({mm('title')} * 2.0)"
    adjacent = lambda f: f"contains(' ' || array_to_string(t_{f}, ' ') || ' ', ' merge planner ')"
    prefix_at = lambda f: f"instr(' ' || array_to_string(t_{f}, ' ') || ' ', ' merge planner ')"
    follows = lambda f: f"({prefix_at(f)} > 0 AND contains(substr(' ' || array_to_string(t_{f}, ' ') || ' ', {prefix_at(f)} + 14), ' la'))"
    phrase = f""", w AS (SELECT _id, unnest(t_text) AS word, generate_subscripts(t_text, 1) AS i FROM d),
o AS (SELECT *, sum(strlen(word) + 1) OVER (PARTITION BY _id ORDER BY i) - strlen(word) - 1 AS at FROM w),
g AS (SELECT a._id, a.i, min(b.at) - a.at AS gap FROM o a JOIN o b ON a._id = b._id AND b.i > a.i AND a.word = 'merge' AND b.word = 'planner' GROUP BY a._id, a.i, a.at),
best AS (SELECT _id, min(gap) AS gap FROM g GROUP BY _id)
SELECT _id, round(score / CASE WHEN gap > 10 THEN 1 + 0.1 * gap ELSE 1.0 END, 6) AS _score FROM (SELECT d._id, best.gap, {some(['merge', 'planner'])} AS score FROM d JOIN best USING (_id), st)"""
    mlt_doc = f""", r AS (SELECT _id, t_text FROM d ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 1),
k AS (SELECT term, count(*) AS tf FROM (SELECT unnest(t_text) AS term FROM r) GROUP BY term HAVING count(*) >= 2),
h AS (SELECT DISTINCT _id, term FROM ({" UNION ALL ".join(f"SELECT _id, unnest(t_{f}) AS term FROM d" for f in DOC_TEXTS)}) SEMI JOIN k USING (term)),
e AS (SELECT term, count(*) AS df FROM h GROUP BY term),
w AS (SELECT term, df, (CASE WHEN df = 0 THEN 1.0 ELSE greatest(ln((n - df + 0.5) / (df + 0.5)), 0.0) END) AS i, tf * i AS s FROM k JOIN e USING (term), st ORDER BY s DESC, term LIMIT 25),
b AS (SELECT term, i, 1 + s / (SELECT greatest(max(s), 1.0) FROM w) AS boost FROM w),
o AS (SELECT _id, unnest(t_text) AS term, len(t_text) AS dl FROM d WHERE _id NOT IN (SELECT _id FROM r)),
q AS (SELECT _id, term, dl, count(*) AS tf FROM o SEMI JOIN b USING (term) GROUP BY ALL)
SELECT _id, round(avg(boost * i * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a_text))), 6) AS _score FROM q JOIN b USING (term), st GROUP BY _id ORDER BY _score DESC, _id LIMIT 100"""
    distinct_words = sorted(set(tx.tokenize(_LIKE["text"])))
    counts = {w: tx.tokenize(_LIKE["text"]).count(w) for w in distinct_words}
    like_terms = "UNION ALL ".join(f"SELECT 'text' AS field, '{w}' AS term, {counts[w]} * {idf(i)} AS s, f{i} AS f FROM st " for i, w in enumerate(distinct_words))
    like = f""", c AS (SELECT * FROM ({like_terms}) WHERE f >= 1 ORDER BY s DESC, field, term LIMIT 25), m AS (SELECT greatest(max(s), 1.0) AS top FROM c)"""
    like_hits = f"""{like}, b AS (SELECT term, 1 + s / top AS boost FROM c, m),
p AS (SELECT d._id, b.term, b.boost, len(list_filter(t_text, lambda x: x = b.term)) AS tf, len(t_text) AS dl, a_text, n, (SELECT count(*) FROM d e WHERE {' OR '.join(f"list_contains(coalesce(e.t_{f}, []), b.term)" for f in DOC_TEXTS)}) AS df FROM d, b, st),
q AS (SELECT _id, boost * (CASE WHEN df = 0 THEN 1.0 ELSE greatest(ln((n - df + 0.5) / (df + 0.5)), 0.0) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a_text)) AS s FROM p WHERE tf > 0)
SELECT _id, round(avg(s), 6) AS _score FROM q GROUP BY _id ORDER BY _score DESC, _id LIMIT 100"""
    hist = lambda u: f"SELECT strftime(date_trunc('{u}', ts), '%Y-%m-%dT%H:%M:%SZ') AS key, count(*) AS doc_count FROM events GROUP BY ALL"
    low = f"(' ' || translate(text, '{_FROM}', '{_TO}') || ' ')"
    lang = f"SELECT _id, round(score, 6) AS _score FROM (SELECT d._id, greatest(coalesce({bm(0, 'en', 'lang')}, 0), coalesce({bm(1, 'fr', 'lang')}, 0)) AS score FROM d, st) WHERE score > 0"
    phrase_ordered = doc_sql(["merge", "planner"], phrase)
    phrase_begun = doc_sql(["merge", "planner", "la"], hits_sql(f"greatest(CASE WHEN {follows('text')} THEN {idf(0)} + {idf(1)} + {idf(2)} END, CASE WHEN {follows('title')} THEN 2 * ({idf(0)} + {idf(1)} + {idf(2)}) END)"))
    must = some(["merge", "planner"])
    s1, s2 = bm(3, "en", "lang"), bm(2, "lease")
    three = [bm(i, w) for i, w in enumerate(_W)]
    return {
        "flagship": f"SELECT _id, round(score, 6) AS _score, ts, event_type, value FROM {_TERM_EVENT.format(w='error')} WHERE score IS NOT NULL AND value >= 50 ORDER BY ts DESC, _id LIMIT 20",
        "match_all": "SELECT CAST(event_id AS VARCHAR) AS _id, 1.0 AS _score, event_type, value FROM events ORDER BY event_id, 1 LIMIT 100",
        "term_keyword": f"SELECT _id, round(score, 6) AS _score FROM {_TERM_EVENT.format(w='click')} WHERE score IS NOT NULL",
        "term_token": doc_sql(["the"], hits_sql(bm(0, "the"))),
        "term_numeric": one.format(k="event_id", more="", t="events", where=" WHERE user_id = 8"),
        "term_numeric_kind": one.format(k="event_id", more="", t="events", where=" WHERE false"),
        "term_boost": doc_sql(["merge"], hits_sql(f"2.5 * {bm(0, 'merge')}")),
        "term_missing_field": one.format(k="doc_id", more="", t="documents", where=" WHERE false"),
        "terms_string": doc_sql(["en", "fr"], lang),
        "terms_numeric": one.format(k="o_orderkey", more=", o_custkey", t="orders", where=" WHERE o_custkey IN (1, 7, 100, 250)"),
        "range_numeric": "SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS _id, 1.0 AS _score, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 12",
        "range_timestamp": one.format(k="event_id", more=", ts", t="events", where=" WHERE ts >= '2024-01-05' AND ts < '2024-01-06'"),
        "range_open": one.format(k="event_id", more="", t="events", where=" WHERE value IS NOT NULL"),
        "prefix": "SELECT CAST(p_partkey AS VARCHAR) AS _id, round(2.2 / (1 + 1.2 * (0.25 + 0.75 * len(string_split(p_type, ' ')) / a)), 6) AS _score, p_type FROM part, (SELECT greatest(avg(len(string_split(p_type, ' '))), 1.0) AS a FROM part) WHERE starts_with(p_type, 'ECO')",
        "prefix_documents": doc_sql(["the"], f""", w AS (SELECT _id, len(t_text) AS dl, unnest(t_text) AS word FROM d WHERE starts_with(text, 'The')),
o AS (SELECT _id, dl, word, count(*) AS k FROM w WHERE starts_with(word, 'the') GROUP BY ALL)
SELECT _id, round(sum(k * (CASE WHEN word = 'the' THEN {idf(0)} ELSE 1.0 END) * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * dl / a_text))), 6) AS _score FROM o, st GROUP BY _id"""),
        "wildcard": """WITH d AS (SELECT CAST(p_partkey AS VARCHAR) AS _id, p_name, string_split(lower(p_name), ' ') AS t FROM part), a AS (SELECT greatest(avg(len(t)), 1.0) AS a FROM d),
w AS (SELECT _id, p_name, len(t) AS dl, unnest(t) AS word FROM d WHERE regexp_full_match(p_name, '.*r.*g.*')),
o AS (SELECT _id, p_name, dl, word, count(*) AS k FROM w WHERE regexp_full_match(word, '.*r.*g.*') GROUP BY ALL)
SELECT _id, round(sum(k * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS _score, p_name FROM o, a GROUP BY _id, p_name""",
        "wildcard_one": "SELECT CAST(doc_id AS VARCHAR) AS _id, 1.0 AS _score, kind FROM documents WHERE regexp_full_match(kind, 'r.nb.*k')",
        "term_boolean": one.format(k="o_orderkey", more="", t="orders", where=" WHERE o_orderstatus = 'O'"),
        "refused_requests": "SELECT CAST(i AS INTEGER) AS item, CASE WHEN i = 12 THEN 404 ELSE 400 END AS status FROM range(13) AS r(i)",
        "highlight": doc_sql(["merge", "planner"], f""", h AS (SELECT d.*, {some(["merge", "planner"])} AS score FROM d, st), top AS (SELECT * FROM h WHERE score IS NOT NULL ORDER BY round(score, 6) DESC, _id LIMIT 50),
f AS ({" UNION ALL ".join(f"SELECT _id, '{f}' AS field, {f} AS v FROM top" for f in DOC_TEXTS)}),
p AS (SELECT _id, field, v, unnest(string_split(translate(v, '{_FROM}', '{_TO}'), ' ')) AS word, generate_subscripts(string_split(translate(v, '{_FROM}', '{_TO}'), ' '), 1) AS i FROM f),
o AS (SELECT *, CAST(sum(length(word) + 1) OVER (PARTITION BY _id, field ORDER BY i) - length(word) - 1 AS BIGINT) AS pos FROM p),
m AS (SELECT *, row_number() OVER (PARTITION BY _id, field ORDER BY pos) - 1 AS place FROM o WHERE word IN ('merge', 'planner'))
SELECT _id, field, CAST(place AS INTEGER) AS place, substr(v, greatest(pos - 50, 0) + 1, pos - greatest(pos - 50, 0)) || '<em>' || substr(v, pos + 1, length(word)) || '</em>' || substr(v, pos + length(word) + 1, 30) AS fragment FROM m WHERE place < 3"""),
        "match": doc_sql(_W, hits_sql(f"(CASE WHEN {tf('merge')} > 0 OR {tf('planner')} > 0 OR {tf('lease')} > 0 THEN 2 * coalesce({three[0]}, 0) + coalesce({three[1]}, 0) + coalesce({three[2]}, 0) END)")),
        "bool_must_should": doc_sql(["merge", "planner", "lease", "en"], f"SELECT _id, round((m + coalesce(a, 0) + coalesce(b, 0)) / (1 + (a IS NOT NULL)::INT + (b IS NOT NULL)::INT), 6) AS _score FROM (SELECT _id, {must} AS m, {s1} AS a, {s2} AS b FROM d, st) WHERE m IS NOT NULL"),
        "bool_filter_must_not": one.format(k="event_id", more="", t="events", where=" WHERE event_type = 'error' AND NOT coalesce(value < 50, false)"),
        "bool_min_should_match": doc_sql(_W, f"SELECT _id, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / k, 6) AS _score FROM (SELECT *, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS k FROM (SELECT _id, {three[0]} AS a, {three[1]} AS b, {three[2]} AS c FROM d, st)) WHERE k >= 2"),
        "bool_empty": one.format(k="r_regionkey", more="", t="region", where=""),
        "bool_msm_zero": one.format(k="event_id", more="", t="events", where=""),
        "bool_nested": doc_sql(["merge", "lease"], f"SELECT _id, round((coalesce(a, 0) + coalesce(b, 0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT), 6) AS _score FROM (SELECT _id, lang, {bm(0, 'merge')} AS a, {bm(1, 'lease')} AS b FROM d, st) WHERE (a IS NOT NULL OR b IS NOT NULL) AND NOT coalesce(lower(lang) = 'de', false)"),
        "agg_terms": "SELECT event_type AS key, count(*) AS doc_count FROM events WHERE event_type IS NOT NULL GROUP BY ALL",
        "agg_terms_numeric": "SELECT user_id AS key, count(*) AS doc_count FROM events WHERE user_id IS NOT NULL GROUP BY ALL",
        "agg_stats": "SELECT count(value) AS count, min(value) AS min, max(value) AS max, avg(value) AS avg, coalesce(sum(value), 0.0) AS sum FROM events WHERE event_type = 'purchase'",
        "agg_stats_empty": "SELECT 0 AS count, NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS avg, 0.0 AS sum",
        "agg_histogram_minute": hist("minute"),
        "agg_histogram_hour": hist("hour"),
        "agg_histogram_day": hist("day"),
        "multi_agg_request": "SELECT 'types' AS agg, event_type AS key, count(*) AS doc_count FROM events WHERE value >= 50 GROUP BY ALL UNION ALL SELECT 'hours', strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%SZ'), count(*) FROM events WHERE value >= 50 GROUP BY ALL",
        "hit_total": "SELECT count(*) AS total FROM events WHERE event_type = 'error'",
        "sort_field_desc_missing_last": "SELECT CAST(doc_id AS VARCHAR) AS _id, source FROM documents ORDER BY source DESC NULLS LAST, _id LIMIT 500 OFFSET 50",
        "sort_timestamp": "SELECT CAST(event_id AS VARCHAR) AS _id, 1.0 AS _score, ts FROM events ORDER BY ts DESC NULLS LAST, _id LIMIT 30",
        "page_from_size": "SELECT CAST(o_orderkey AS VARCHAR) AS _id, 1.0 AS _score, o_totalprice FROM orders ORDER BY o_totalprice NULLS LAST, _id LIMIT 50 OFFSET 100",
        "search_after": "SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, _id LIMIT 50 OFFSET 100",
        "sort_values": """SELECT _id, '[' || o_custkey || ',1.0,"' || _id || '"]' AS cursor FROM (SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_custkey FROM orders ORDER BY o_custkey NULLS LAST, _id LIMIT 40)""",
        "score_sort_topk": doc_sql(_W, hits_sql(some(_W)) + " ORDER BY _score DESC, _id LIMIT 25"),
        "fuzzy_exact": one.format(k="r_regionkey", more=", r_name", t="region", where=" WHERE levenshtein(r_name, 'ASIB') <= 1"),
        "fuzzy_auto": one.format(k="p_partkey", more=", p_type", t="part", where=" WHERE levenshtein(p_type, 'PROMOO') <= 2"),
        "phrase_ordered": phrase_ordered,
        "postings_phrase": phrase_ordered,
        "postings_phrase_prefix": phrase_begun,
        "phrase_adjacent": doc_sql(["merge", "planner"], hits_sql(f"CASE WHEN {adjacent('text')} THEN {some(['merge', 'planner'])} END")),
        "multi_match_best_fields": doc_sql(["merge", "planner"], hits_sql(f"greatest({a}, {b})")),
        "multi_match_tie_breaker": doc_sql(["merge"], f"SELECT _id, round(greatest(a, b) + 0.3 * (coalesce(a, 0) + coalesce(b, 0) - greatest(a, b)), 6) AS _score FROM (SELECT _id, 2 * {bm(0, 'merge')} AS a, 4 * {bm(0, 'merge', 'title')} AS b FROM d, st) WHERE a IS NOT NULL OR b IS NOT NULL"),
        "multi_match_most_fields": doc_sql(["merge", "planner"], f"SELECT _id, round(coalesce(a, 0) + coalesce(b, 0), 6) AS _score FROM (SELECT _id, {a} AS a, {b} AS b FROM d, st) WHERE a IS NOT NULL OR b IS NOT NULL"),
        "multi_match_phrase": doc_sql(["merge", "planner"], hits_sql(f"greatest(CASE WHEN {adjacent('text')} THEN {idf(0)} + {idf(1)} END, CASE WHEN {adjacent('title')} THEN 2 * ({idf(0)} + {idf(1)}) END)")),
        "multi_match_phrase_prefix": phrase_begun,
        "mlt_doc": doc_sql([], mlt_doc).replace("FROM d)\n, r AS", "FROM d), r AS"),
        "mlt_terms": doc_sql(distinct_words, f"{like} SELECT field, term, round(1 + s / top, 6) AS boost FROM c, m").replace("FROM d)\n, c AS", "FROM d), c AS"),
        "mlt_like": doc_sql(distinct_words, like_hits).replace("FROM d)\n, c AS", "FROM d), c AS"),
        "unflushed_profile": doc_sql(_W, hits_sql(some(_W, flat=True))),
        "suggest": doc_sql([], "SELECT text, field, round(score, 6) AS score FROM (SELECT term AS text, field, count(*) / n * w AS score FROM (SELECT 'text' AS field, 1.0 AS w, unnest(list_distinct(t_text)) AS term FROM d UNION ALL SELECT 'title', 2.0, unnest(list_distinct(t_title)) FROM d), st WHERE starts_with(term, 'me') GROUP BY term, field, n, w) ORDER BY score DESC, text, field LIMIT 20"),
        "suggest_vocabulary": doc_sql([], "SELECT field, term, count(*) AS doc_freq, round(count(*) / n, 6) AS score FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS field, unnest(list_distinct(t_{f})) AS term FROM d" for f in DOC_TEXTS) + "), st GROUP BY field, term, n"),
        "highlight_fragment": f"""SELECT doc_id, substr(text, greatest(p - 50, 1), p - greatest(p - 50, 1)) || '<em>' || substr(text, p, 5) || '</em>' || substr(text, p + 5, 30) AS fragment
FROM (SELECT doc_id, text, instr({low}, ' merge ') AS p FROM documents) WHERE p > 0""",
        "query_string": f"SELECT _id, round((score + 1.0) / 2, 6) AS _score FROM {_TERM_EVENT.format(w='error')} WHERE score IS NOT NULL AND value > 50",
        "query_string_or_not": f"""SELECT e._id, round(coalesce(e.score, v.score), 6) AS _score FROM {_TERM_EVENT.format(w='error')} e JOIN {_TERM_EVENT.format(w='view')} v USING (_id)
WHERE (e.score IS NOT NULL OR v.score IS NOT NULL) AND NOT coalesce(e.value BETWEEN 10 AND 40, false)""",
        "msearch": f"""SELECT * FROM (SELECT 0 AS item, 200 AS status, _id, round(score, 6) AS _score FROM {_TERM_EVENT.format(w='click')} WHERE score IS NOT NULL ORDER BY value DESC NULLS LAST, _id LIMIT 20)
UNION ALL SELECT * FROM (SELECT 1, 200, CAST(o_orderkey AS VARCHAR) AS _id, 1.0 FROM orders WHERE o_totalprice >= 1000 ORDER BY o_totalprice, _id LIMIT 20)
UNION ALL SELECT 2, 404, NULL, NULL UNION ALL SELECT 3, 400, NULL, NULL""",
        "postings_bool": doc_sql(["merge", "planner", "lease", "en"], f"SELECT _id, round((m + coalesce(a, 0)) / (1 + (a IS NOT NULL)::INT), 6) AS _score FROM (SELECT _id, n_chars, {must} AS m, {s1} AS a, {s2} AS b FROM d, st) WHERE m IS NOT NULL AND b IS NULL AND n_chars >= 500"),
        "postings_topk": doc_sql(_W, f"SELECT _id, round(score, 6) AS _score, title FROM (SELECT d.*, {some(_W)} AS score FROM d, st) WHERE score IS NOT NULL ORDER BY _score DESC, _id LIMIT 25"),
        "postings_match": doc_sql(_W, hits_sql(some(_W))),
        "postings_multi_match": doc_sql(["merge", "planner"], f"SELECT _id, round(greatest(a, b) + 0.3 * (coalesce(a, 0) + coalesce(b, 0) - greatest(a, b)), 6) AS _score FROM (SELECT _id, {a} AS a, {b} AS b FROM d, st) WHERE a IS NOT NULL OR b IS NOT NULL"),
    }
