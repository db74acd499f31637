import json
import random

import pytest

from skerry.operators import suggest
from skerry.operators.index import SearchIndex
from skerry.operators.postings import Postings
from skerry.operators.search import matches
from skerry.plans import dsl
from skerry.plans.errors import InvalidRequest
from skerry.plans.response import search_response
from skerry.sources.store import Store

LOGS = {
    "1": {"service": "auth", "level": "error", "latency": 30, "active": True, "timestamp": "2025-11-08T10:05:00Z"},
    "2": {"service": "auth", "level": "info", "latency": 10, "active": False, "timestamp": "2025-11-08T12:30:00+02:00"},
    "3": {"service": "billing", "level": "error", "timestamp": "2025-11-08T11:00:00Z"},
    "4": {"service": "auth-core", "message": "the green glass kiln"},
    "5": {"message": "The glass green kiln", "latency": 20},
}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return Store(spark, f"file://{tmp_path_factory.mktemp('store')}")


@pytest.fixture(scope="module")
def logs(store):
    store.create_index("logs")
    index = store.open("logs")
    index.bulk([{"index": {"id": k, "source": v}} for k, v in LOGS.items()])
    index.merge()
    return index


def ids(index, body):
    return [h["_id"] for h in index.search(body)["hits"]["hits"]]


def test_terms(logs):
    assert ids(logs, {"query": {"term": {"service": "AUTH"}}}) == ["1", "2"]
    assert ids(logs, {"query": {"term": {"message": "green"}}}) == ["4", "5"]
    assert ids(logs, {"query": {"term": {"latency": 20}}}) == ["5"]
    assert ids(logs, {"query": {"term": {"latency": 20.0}}}) == []
    assert ids(logs, {"query": {"term": {"active": True}}}) == ["1"]
    assert ids(logs, {"query": {"term": {"nothing": "x"}}}) == []
    assert ids(logs, {"query": {"terms": {"latency": [10, 10, 30]}}}) == ["1", "2"]
    assert ids(logs, {"query": {"terms": {"service": []}}}) == []


def test_range_and_time(logs):
    assert ids(logs, {"query": {"range": {"latency": {"gt": 10, "lte": 30}}}}) == ["1", "5"]
    assert ids(logs, {"query": {"range": {"timestamp": {"gte": "2025-11-08T10:30:00Z"}}}}) == ["2", "3"]
    assert ids(logs, {"query": {"range": {"latency": {"gte": "10"}}}}) == []
    assert ids(logs, {"query": {"range": {"field": "latency"}}}) == ["1", "2", "5"]


def test_patterns(logs):
    assert ids(logs, {"query": {"prefix": {"service": "auth-"}}}) == ["4"]
    assert ids(logs, {"query": {"prefix": {"service": "AUTH"}}}) == []
    assert ids(logs, {"query": {"wildcard": {"service": "a*h"}}}) == ["1", "2"]
    assert ids(logs, {"query": {"wildcard": {"service": "bill?ng"}}}) == ["3"]
    assert ids(logs, {"query": {"term": {"field": "service", "value": "auht", "fuzziness": 2}}}) == ["1", "2"]
    assert ids(logs, {"query": {"term": {"field": "service", "value": "Auth", "fuzziness": 0}}}) == []
    assert ids(logs, {"query": {"term": {"field": "service", "value": "biling", "fuzziness": "auto"}}}) == ["3"]


def test_phrases(logs):
    assert ids(logs, {"query": {"phrase": {"message": "green kiln"}}}) == ["5", "4"]  # 12 bytes apart in 4
    assert ids(logs, {"query": {"phrase": {"message": "green glass"}}}) == ["4"]
    assert ids(logs, {"query": {"phrase": {"message": "green"}}}) == []
    assert ids(logs, {"query": {"phrase": {"field": "message", "value": "green kiln", "slop": 0}}}) == ["5"]
    assert ids(logs, {"query": {"multi_match": {"query": "green kiln", "fields": {"message": 1, "service": 1}, "type": "phrase"}}}) == ["5"]
    assert ids(logs, {"query": {"multi_match": {"query": "the green k", "fields": {"message": 1}, "type": "phrase_prefix"}}}) == ["4"]


def test_bool(logs):
    error, auth = {"term": {"level": "error"}}, {"term": {"service": "auth"}}
    assert ids(logs, {"query": {"bool": {"must": [error], "must_not": [auth]}}}) == ["3"]
    assert sorted(ids(logs, {"query": {"bool": {"should": [error, auth]}}})) == ["1", "2", "3"]
    assert ids(logs, {"query": {"bool": {"should": [error, auth], "minimum_should_match": 2}}}) == ["1"]
    assert len(ids(logs, {"query": {"bool": {"should": [error], "minimum_should_match": 0}}})) == 5
    assert sorted(ids(logs, {"query": {"bool": {"filter": [auth], "should": [error]}}})) == ["1", "2"]
    hits = logs.search({"query": {"bool": {"filter": [auth, error]}}})["hits"]["hits"]
    assert [(h["_id"], h["_score"]) for h in hits] == [("1", 1.0)]
    assert len(ids(logs, {"query": {"bool": {}}})) == 5


def test_mean_of_clauses(logs):
    one = logs.search({"query": {"term": {"level": "error"}}})["hits"]["hits"][0]["_score"]
    both = logs.search({"query": {"bool": {"must": [{"term": {"level": "error"}}, {"range": {"latency": {"gte": 0}}}]}}})["hits"]["hits"][0]["_score"]
    assert both == pytest.approx((one + 1.0) / 2, abs=1e-6)


def test_sort_and_pages(logs):
    assert ids(logs, {"sort": {"latency": {"order": "asc"}}}) == ["2", "5", "1", "3", "4"]
    assert ids(logs, {"sort": {"latency": {"order": "desc"}}}) == ["1", "5", "2", "3", "4"]
    assert ids(logs, {"sort": {"timestamp": {"order": "asc"}}}) == ["1", "2", "3", "4", "5"]
    assert ids(logs, {"sort": {"active": {"order": "asc"}}})[:2] == ["2", "1"]
    assert ids(logs, {"sort": {"latency": {"order": "asc"}}, "from": 1, "size": 2}) == ["5", "1"]
    assert ids(logs, {"size": 0}) == [] and ids(logs, {"from": 5}) == []
    assert ids(logs, {"sort": {"nothing": {"order": "asc"}}}) == ["1", "2", "3", "4", "5"]


@pytest.mark.parametrize("field", ["latency", "service", "timestamp", "active", "nothing"])
@pytest.mark.parametrize("order", ["asc", "desc"])
def test_pages_by_cursor_give_everything(logs, field, order):
    whole = ids(logs, {"sort": {field: {"order": order}}})
    got, after = [], None
    while True:
        body = {"sort": {field: {"order": order}}, "size": 2} | ({"search_after": after} if after else {})
        hits = logs.search(body)["hits"]["hits"]
        if not hits:
            break
        got += [h["_id"] for h in hits]
        after = hits[-1]["sort"]
    assert got == whole


def test_aggregations_over_all_matches(logs):
    body = {"query": {"terms": {"level": ["error", "info"]}}, "size": 1, "aggs": {"s": {"terms": {"field": "service"}}, "l": {"stats": {"field": "latency"}}, "h": {"date_histogram": {"field": "timestamp", "interval": "hour"}}}}
    out = logs.search(body)
    # "error" is in more than a third and less than half of the documents
    assert out["hits"]["total"] == {"value": 3, "relation": "eq"} and len(out["hits"]["hits"]) == 1
    aggs = out["aggregations"]
    assert aggs["s"]["buckets"] == [{"key": "auth", "doc_count": 2}, {"key": "billing", "doc_count": 1}]
    assert aggs["l"] == {"count": 2, "min": 10.0, "max": 30.0, "avg": 20.0, "sum": 40.0}
    assert aggs["h"]["buckets"] == [{"key": "2025-11-08T10:00:00Z", "doc_count": 2}, {"key": "2025-11-08T11:00:00Z", "doc_count": 1}]
    none = logs.search({"query": {"term": {"level": "none"}}, "aggs": {"l": {"stats": {"field": "latency"}}, "s": {"terms": {"field": "service"}}}})["aggregations"]
    assert none == {"l": {"count": 0, "min": None, "max": None, "avg": None, "sum": 0.0}, "s": {"buckets": []}}


def test_response(logs):
    hit = logs.search({"query": {"term": {"latency": 20}}, "sort": {"latency": {"order": "asc"}}})["hits"]["hits"][0]
    assert hit == {"_id": "5", "_score": 1.0, "_source": LOGS["5"], "sort": [20, 1.0, "5"]}


def test_highlight(spark, store):
    store.create_index("notes")
    index = store.open("notes")
    index.bulk([{"index": {"id": "1", "source": {"content": "Harbour pilot, harbour PILOT and pilot\npilot again pilot", "other": "x"}}}, {"index": {"id": "2", "source": {"content": ""}}}])
    index.refresh()
    [hit] = index.search({"query": {"match": {"content": "pilot"}}})["hits"]["hits"]
    found = hit["highlight"]["content"]
    assert len(found) == 3 and found[0].startswith("Harbour pilot, harbour <em>PILOT</em> and pilot\npilot")
    assert "<em>pilot</em>\npilot again" in found[1]
    assert "highlight" not in index.search({})["hits"]["hits"][0]


def test_more_like_this(store):
    store.create_index("fruit")
    index = store.open("fruit")
    texts = {"1": "slate marble granite", "2": "slate marble", "3": "slate", "4": "plum", "5": "pear", "6": "fig", "7": "kiwi"}
    index.bulk([{"index": {"id": k, "source": {"content": v}}} for k, v in texts.items()])
    index.refresh()
    assert ids(index, {"query": {"mlt": {"doc_id": "1", "min_term_freq": 1}}}) == ["2", "3"]
    assert ids(index, {"query": {"mlt": {"like": {"content": "kiwi kiwi"}}}}) == ["7"]
    assert ids(index, {"query": {"mlt": {"doc_id": "1"}}}) == []
    assert ids(index, {"query": {"mlt": {"doc_id": "none", "min_term_freq": 1}}}) == []
    assert ids(index, {"query": {"bool": {"must": [{"mlt": {"doc_id": "1", "min_term_freq": 1}}]}}}) == []


def test_suggest(store):
    store.create_index("titles")
    index = store.open("titles")
    index.bulk([{"index": {"id": "1", "source": {"title": "kiln kiln kiln harbour", "body": "x"}}}, {"index": {"id": "2", "source": {"title": "kiln rope", "body": "harbour harbourmaster"}}}])
    index.refresh()
    words = {(r["field"], r["term"]): r["doc_freq"] for r in suggest.vocabulary(index.search_index()).collect()}
    assert words[("title", "kiln")] == 2 and words[("title", "rope")] == 1
    assert [(s["text"], s["field"], s["score"]) for s in index.suggest("HARB", {"title": 2.0, "body": 1.0})] == [("harbour", "title", 1.0), ("harbour", "body", 0.5), ("harbourmaster", "body", 0.5)]
    assert index.suggest("", {"title": 1.0}) == [] and index.suggest("kiln", {"title": 0.0}) == []
    fuzzy = suggest.suggest(suggest.vocabulary(index.search_index()), "kilm", {"title": 1.0}, edits=1).collect()
    assert [r["text"] for r in fuzzy] == ["kiln"]


def test_term_in_most_documents(spark):
    df = spark.createDataFrame([("1", "a b"), ("2", "a c"), ("3", "a"), ("4", None)], "_id string, t string")
    index = SearchIndex(df, {"t": "Keyword"})
    got = {r["_id"]: r["_score"] for r in matches(index, dsl.query({"term": {"t": "a"}})).collect()}
    assert got == {"1": 0.0, "2": 0.0, "3": 0.0}
    assert matches(index, dsl.query({"terms": {"t": ["a"]}})).collect() == []
    flat = SearchIndex(df, {"t": "Keyword"}, "unflushed")
    assert all(r["_score"] > 0 for r in matches(flat, dsl.query({"term": {"t": "a"}})).collect())


def test_postings_equal_the_scan(spark):
    texts = ["merge planner lease", "merge merge", None, "", "lease the planner", "other words", "Merge"]
    df = spark.createDataFrame([(str(i), t, t and t[::-1], i) for i, t in enumerate(texts)], "_id string, a string, b string, n int")
    index = SearchIndex(df, {"a": "Keyword", "b": "Keyword", "n": "Integer"})
    fast = Postings.build(index)
    for body in [
        {"match": {"a": "merge planner merge"}}, {"term": {"a": "LEASE"}}, {"terms": {"a": ["lease", "other"]}}, {"match": {"a": "nowhere"}}, {"match": {"nothing": "x"}},
        {"multi_match": {"query": "merge egrem", "fields": {"a": 1, "b": 2.5}, "tie_breaker": 0.3}}, {"multi_match": {"query": "merge egrem", "fields": {"a": 1, "b": 2}, "type": "most_fields"}},
        {"match_all": {}}, {"range": {"n": {"gte": 3}}}, {"bool": {"must_not": [{"term": {"a": "merge"}}]}}, {"bool": {"must": [{"range": {"n": {"lt": 5}}}], "should": [{"match": {"a": "merge lease"}}]}},
        {"bool": {"must": [{"match": {"a": "merge"}}], "filter": [{"range": {"n": {"lt": 5}}}], "must_not": [{"term": {"b": "esael"}}]}}, {"bool": {"should": [{"term": {"a": "lease"}}, {"term": {"n": 5}}]}}, {"mlt": {"doc_id": "0", "min_term_freq": 1}},
    ]:
        q = dsl.query(body)
        assert sorted((r["_id"], r["_score"]) for r in fast.search(q).collect()) == sorted((r["_id"], r["_score"]) for r in matches(index, q).collect()), body


def test_phrases_by_postings_equal_the_scan(spark):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(["merge", "planner", "lease", "plan", "überlänge", "x"]) + rnd.choice(["", "", "  ", "\n"]) for _ in range(rnd.randint(0, 14))) for _ in range(60)] + [None, "", "Merge Planner", "merge " + "x " * 40 + "planner"]
    df = spark.createDataFrame([(str(i), t, t and t.upper()) for i, t in enumerate(texts)], "_id string, a string, b string")
    for profile in ("flushed", "unflushed"):
        index = SearchIndex(df, {"a": "Keyword", "b": "Keyword"}, profile)
        fast = Postings.build(index)
        for body in [
            {"phrase": {"a": "merge planner"}}, {"phrase": {"a": "merge lease merge"}}, {"phrase": {"a": "merge merge"}}, {"phrase": {"a": "merge"}}, {"phrase": {"a": "merge nowhere"}}, {"phrase": {"field": "a", "value": "merge planner", "slop": 0}}, {"phrase": {"field": "a", "value": "x x x", "slop": 0}},
            {"multi_match": {"query": "merge planner", "fields": {"a": 1, "b": 2}, "type": "phrase"}}, {"multi_match": {"query": "merge planner pl", "fields": {"a": 1, "b": 2}, "type": "phrase_prefix"}}, {"multi_match": {"query": "merge über", "fields": {"a": 1}, "type": "phrase_prefix"}},
            {"bool": {"must": [{"phrase": {"a": "lease plan"}}], "should": [{"term": {"b": "x"}}], "must_not": [{"phrase": {"field": "b", "value": "merge merge", "slop": 0}}]}},
        ]:
            q = dsl.query(body)
            assert sorted((r["_id"], r["_score"]) for r in fast.search(q).collect()) == sorted((r["_id"], r["_score"]) for r in matches(index, q).collect()), body


def test_postings_refuse_what_they_lack(spark):
    index = SearchIndex(spark.createDataFrame([("1", "a b")], "_id string, a string"), {"a": "Keyword"})
    fast = Postings.build(index)
    for body in ({"prefix": {"a": "a"}}, {"wildcard": {"a": "*"}}, {"term": {"field": "a", "value": "a", "fuzziness": 1}}):
        with pytest.raises(InvalidRequest):
            fast.search(dsl.query(body))
    assert [r["a"] for r in fast.page(dsl.query({"match": {"a": "b"}}), 5).collect()] == ["a b"]


def test_phrase_takes_the_closest_start(spark):
    far = "alpha " + "x " * 30 + "alpha beta"
    df = spark.createDataFrame([("1", far), ("2", "alpha " + "y " * 30 + "beta"), ("3", "beta alpha"), ("4", "z"), ("5", "z"), ("6", "z"), ("7", "z")], "_id string, t string")
    index = SearchIndex(df, {"t": "Keyword"}, "unflushed")
    got = {r["_id"]: r["_score"] for r in matches(index, dsl.query({"phrase": {"t": "alpha beta"}})).collect()}
    assert set(got) == {"1", "2"} and got["1"] > 4 * got["2"]


def test_pushdown_reaches_the_scan(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(100).selectExpr("cast(id as string) as k", "cast(id as int) as n", "'a b' as t", "'unused' as u").write.parquet(path)
    index = SearchIndex.from_table(spark.read.parquet(path), "k")
    found = matches(index, dsl.query({"bool": {"must": [{"match": {"t": "a"}}], "filter": [{"range": {"n": {"gte": 7}}}]}})).select("_id", "_score")
    plan = found._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(n,7)" in plan.replace(" ", "")
    scan = [line for line in plan.splitlines() if "ReadSchema" in line][-1]
    assert "u:string" not in scan
    assert found.count() == 93


def test_multi_search(spark, logs):
    from skerry.plans.response import multi_search

    got = multi_search(spark, {"logs": logs.search_index()}, [("logs", {"query": {"term": {"latency": 10}}}), ("none", {}), ("logs", {"query": {"bad": 1}})]).collect()
    assert sorted((r["item"], r["status"], r["_id"]) for r in got) == [(0, 200, "2"), (1, 404, None), (2, 400, None)]
    assert multi_search(spark, {}, []).collect() == []


def test_query_string(logs):
    out = logs.search_string("level:error AND NOT service:auth")
    assert [h["_id"] for h in out["hits"]["hits"]] == ["3"]


def test_table_response(spark):
    index = SearchIndex.from_table(spark.createDataFrame([(1, "x y"), (2, None)], "k int, t string"), "k")
    out = search_response(index, dsl.request({"query": {"match": {"t": "x"}}}))
    assert out["hits"]["hits"][0]["_source"] == {"k": 1, "t": "x y"} and json.dumps(out)
