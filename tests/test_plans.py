import pytest

from skerry.functions import text as tx
from skerry.plans import ast, dsl, mapping as mp, qstring
from skerry.plans.errors import InvalidRequest, MappingConflict

ACCEPTED = [
    ({"match_all": {}}, ast.MatchAll()),
    ("match_all", ast.MatchAll()),
    ({"term": {"field": "a", "value": "b"}}, ast.Term("a", "b")),
    ({"term": {"a": "b"}}, ast.Term("a", "b")),
    ({"term": {"a": 3}}, ast.Term("a", 3)),
    ({"term": {"field": "a", "value": "b", "fuzziness": "AUTO"}}, ast.Term("a", "b", "auto")),
    ({"term": {"field": "a", "value": "b", "fuzziness": 2}}, ast.Term("a", "b", 2)),
    ({"term": {"value": "x"}}, ast.Term("value", "x")),
    ({"terms": {"a": ["b", 1, True]}}, ast.Terms("a", ("b", 1, True))),
    ({"terms": {"field": "a", "values": []}}, ast.Terms("a", ())),
    ({"range": {"a": {"gte": 1, "lt": None}}}, ast.Range("a", gte=1)),
    ({"range": {"field": "a", "gt": 1.5}}, ast.Range("a", gt=1.5)),
    ({"prefix": {"a": "b"}}, ast.Prefix("a", "b")),
    ({"wildcard": {"field": "a", "value": "b*"}}, ast.Wildcard("a", "b*")),
    ({"match": {"a": "b c"}}, ast.Match("a", "b c")),
    ({"phrase": {"a": "b c"}}, ast.Phrase("a", "b c")),
    ({"multi_match": {"query": "x", "fields": {"a": 1, "b": 2.5}}}, ast.MultiMatch("x", (("a", 1.0), ("b", 2.5)))),
    ({"bool": {"must": [{"match_all": {}}, None], "minimum_should_match": "2"}}, ast.Bool(must=(ast.MatchAll(),))),
    ({"bool": {"should": [{"term": {"a": 1}}], "minimum_should_match": 1}}, ast.Bool(should=(ast.Term("a", 1),), minimum_should_match=1)),
    ({"mlt": {"doc_id": "1", "fields": ["a"]}}, ast.MoreLikeThis(doc_id="1", fields=("a",))),
]
REFUSED = [
    {}, [], "x", {"nothing": {}}, {"match_all": {}, "term": {"a": 1}}, {"term": {}}, {"term": {"a": 1, "b": 2}}, {"term": {"a": None}}, {"term": {"a": [1]}}, {"term": []}, {"terms": {"a": "b"}},
    {"range": {"a": 1}}, {"range": {"a": {"from": 1}}}, {"prefix": {"a": 1}}, {"match": {"a": ["b"]}}, {"bool": {"must": {"match_all": {}}}}, {"bool": {"what": []}},
    {"multi_match": {"query": "x", "fields": ["a"]}}, {"multi_match": {"query": "x", "fields": {"a": "1"}}}, {"multi_match": {"query": "x", "fields": {"a": 1}, "type": "cross"}}, {"mlt": {"what": 1}},
]


@pytest.mark.parametrize("body,want", ACCEPTED)
def test_accepts(body, want):
    assert dsl.query(body) == want


@pytest.mark.parametrize("body", REFUSED)
def test_refuses(body):
    with pytest.raises(InvalidRequest):
        dsl.query(body)


def test_request():
    r = dsl.request({"query": {"match_all": {}}, "from": 5, "size": 10, "sort": [{"a": {"order": "desc"}}], "aggs": {"x": {"terms": {"field": "b"}}, "h": {"date_histogram": {"field": "t", "interval": "day"}}}})
    assert r == ast.Request(ast.MatchAll(), 5, 10, ast.Sort("a", True), None, (("x", ast.TermsAgg("b")), ("h", ast.DateHistogramAgg("t", "day"))))
    assert dsl.request({}) == ast.Request()
    assert dsl.request({"sort": {"field": "a", "order": "asc"}, "search_after": [1, 1.0, "x"]}).search_after == (1, 1.0, "x")


@pytest.mark.parametrize(
    "body",
    [
        {"what": 1}, {"from": -1}, {"size": "3"}, {"size": True}, {"sort": [{"a": {}}, {"b": {}}]}, {"sort": {"a": "desc"}}, {"sort": {"a": {"order": "up"}}}, {"search_after": 3},
        {"aggs": {"x": {"terms": {"field": "b", "size": 3}}}}, {"aggs": {"x": {"cube": {"field": "b"}}}}, {"aggs": {"x": {"date_histogram": {"field": "t", "interval": "week"}}}}, {"aggs": {}, "aggregations": {}},
    ],
)
def test_refused_requests(body):
    with pytest.raises(InvalidRequest):
        dsl.request(body)


T = ast.Term
STRINGS = {
    "status:active": T("status", "active"),
    "count:42": T("count", 42),
    "deleted:true": T("deleted", True),
    "word": T("tag", "word"),
    "status:active type:post": ast.Bool(must=(T("status", "active"), T("type", "post"))),
    "status:active AND type:post": ast.Bool(must=(T("status", "active"), T("type", "post"))),
    "tag:kiln OR tag:rope": ast.Bool(should=(T("tag", "kiln"), T("tag", "rope"))),
    "status:active NOT deleted:true": ast.Bool(must=(T("status", "active"),), must_not=(T("deleted", True),)),
    "a:1 AND NOT b:2 NOT c:3": ast.Bool(must=(T("a", 1),), must_not=(T("b", 2), T("c", 3))),
    "NOT a:1": ast.Bool(must_not=(T("a", 1),)),
    "(tag:kiln OR tag:rope) AND status:active": ast.Bool(must=(ast.Bool(should=(T("tag", "kiln"), T("tag", "rope"))), T("status", "active"))),
    "(a:1 AND b:2) OR c:3": ast.Bool(should=(ast.Bool(must=(T("a", 1), T("b", 2))), T("c", 3))),
    'message:"slow drain"': T("message", "slow drain"),
    'message:"say \\"AND\\""': T("message", 'say "AND"'),
    "service:auth-*": ast.Wildcard("service", "auth-*"),
    "service:a?c": ast.Wildcard("service", "a?c"),
    "price:>10": ast.Range("price", gt=10),
    "price:>=10": ast.Range("price", gte=10),
    "price:<1.5": ast.Range("price", lt=1.5),
    "price:<=100": ast.Range("price", lte=100),
    "price:10..100": ast.Range("price", gte=10, lte=100),
    "name:pilot~auto": T("name", "pilot", "auto"),
    "name:pilot~1": T("name", "pilot", 1),
    "name:pilot~2~": T("name", "pilot", 2),
    "band:ORION": T("band", "ORION"),
    "code:007": T("code", "007"),
    "status:active AND (tag:pinned OR tag:boosted) NOT deleted:true": ast.Bool(must=(T("status", "active"), ast.Bool(should=(T("tag", "pinned"), T("tag", "boosted")))), must_not=(T("deleted", True),)),
}


@pytest.mark.parametrize("text", STRINGS)
def test_query_string(text):
    assert qstring.parse(text) == STRINGS[text]


@pytest.mark.parametrize("text", ["", "  ", "(a:1", "a:1)", "a:1 AND", "OR a:1", "a:1 OR", "NOT", "price:>x", "()"])
def test_bad_query_string(text):
    with pytest.raises(InvalidRequest):
        qstring.parse(text)


@pytest.mark.parametrize(
    "value,kind",
    [("x", "Keyword"), ("2025-11-08", "Keyword"), ("2025-11-08T01:02:03Z", "Timestamp"), ("2025-11-08t01:02:03.5+02:00", "Timestamp"), ("2026-02-30T01:02:03Z", "Keyword"), (True, "Boolean"), (1, "Integer"), (2**31, "Long"), (-(2**31), "Integer"), (2**63, "Double"), (1.0, "Double"), ({}, "Object"), (None, None)],
)
def test_types(value, kind):
    assert mp.infer_type(value) == kind


def test_mapping_never_widens():
    m = mp.extend({}, {"a": 1, "b": None, "c": "x"})
    assert m == {"a": "Integer", "c": "Keyword"}
    for bad in ({"a": 2**40}, {"a": 1.5}, {"c": "2025-11-08T01:02:03Z"}, {"n": [1]}, [1], "x"):
        with pytest.raises(MappingConflict):
            mp.extend(m, bad)
    with pytest.raises(MappingConflict):
        mp.extend(m, {"new": 1}, mp.STRICT)
    with pytest.raises(MappingConflict):
        mp.extend({}, {f"f{i}": 1 for i in range(1001)})


@pytest.mark.parametrize(
    "body",
    [
        {"query": {"range": {"s": {"gte": 1}}}}, {"query": {"match": {"n": "x"}}}, {"query": {"term": {"o": "x"}}}, {"sort": {"o": {"order": "asc"}}}, {"aggs": {"a": {"terms": {"field": "o"}}}}, {"aggs": {"a": {"stats": {"field": "s"}}}},
        {"aggs": {"a": {"date_histogram": {"field": "n", "interval": "day"}}}}, {"search_after": [1, 1.0, "x"]}, {"sort": {"n": {"order": "asc"}}, "from": 1, "search_after": [1, 1.0, "x"]}, {"query": {"bool": {"must": [{"match": {"n": "x"}}]}}},
        {"sort": {"n": {"order": "asc"}}, "search_after": [1, 1.0, "x"], "query": {"bool": {"must": [{"term": {"field": "s", "value": "x", "fuzziness": 1}}]}}}, {"query": {"multi_match": {"query": "x", "fields": {}}}}, {"query": {"mlt": {}}}, {"from": 2_000_000, "size": 20_000},
    ],
)
def test_validation(body):
    with pytest.raises(InvalidRequest):
        mp.validate(dsl.request(body), {"s": "Keyword", "n": "Integer", "o": "Object", "t": "Timestamp"})


def test_tokenize():
    assert tx.tokenize("  Hello\tÉa, WORLD x ") == ["hello", "Éa,", "world", "x"]
    assert tx.tokenize("") == []


def test_idf():
    assert tx.idf(0, 10) == 1.0 and tx.idf(10, 10) == 0.0 and tx.idf(1, 10) > 1.8 and tx.idf(5, 0) == 0.0
