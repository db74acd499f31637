import pytest

from skerry.api import Api
from skerry.sources.store import Store


@pytest.fixture(scope="module")
def api(spark, tmp_path_factory):
    return Api(Store(spark, f"file://{tmp_path_factory.mktemp('api')}"))


def test_whole_life_of_an_index(api):
    call = api.request
    assert call("GET", "/_health") == (200, {"status": "ok"})
    assert call("PUT", "/logs", {"settings": {"merge_threshold_docs": 4}})[0] == 201
    assert call("PUT", "/logs")[0] == 409 and call("PUT", "/Bad")[0] == 400 and call("GET", "/none")[0] == 404
    assert call("PUT", "/logs/_doc", {"id": "1", "source": {"service": "auth", "latency": 3}})[0] == 201
    assert call("POST", "/logs/_doc", {"id": "1", "source": {"service": "auth core", "latency": 4}}) == (200, {"_id": "1", "result": "updated", "_seq": 2})
    assert call("POST", "/logs/_doc", {"id": "2", "source": {"latency": "x"}})[0] == 400
    assert call("POST", "/logs/_doc", {"source": {}})[0] == 400
    assert call("GET", "/logs/_doc/1")[1]["_source"]["latency"] == 4 and call("GET", "/logs/_doc/9")[0] == 404
    status, bulk = call("POST", "/logs/_bulk", {"operations": [{"index": {"id": "2", "source": {"service": "billing"}}}, {"delete": {"id": "7"}}]})
    assert status == 200 and not bulk["errors"]
    assert call("POST", "/logs/_refresh") == (200, {"refreshed_operations": 4})
    status, found = call("POST", "/logs/_search", {"query": {"term": {"service": "core"}}})
    assert status == 200 and [h["_id"] for h in found["hits"]["hits"]] == ["1"]
    assert [h["_id"] for h in call("GET", "/logs/_search?q=service:billing")[1]["hits"]["hits"]] == ["2"]
    assert call("GET", "/logs/_search")[0] == 400 and call("POST", "/logs/_search", {"query": {"x": 1}})[0] == 400
    assert call("POST", "/logs/_suggest", {"prefix": "bi", "fields": {"service": 1}})[1]["suggestions"][0]["text"] == "billing"
    assert call("POST", "/logs/_flush")[1]["flushed_documents"] == 2
    assert call("POST", "/logs/_snapshot/a")[0] == 201 and call("POST", "/logs/_snapshot/a")[0] == 409
    assert [s["name"] for s in call("GET", "/logs/_snapshot")[1]["snapshots"]] == ["a"] and call("GET", "/logs/_snapshot/b")[0] == 404
    call("POST", "/logs/_bulk", {"operations": [{"delete": {"id": "1"}}]})
    assert call("POST", "/logs/_merge")[1] == {"merged_documents": 1}
    assert call("POST", "/logs/_snapshot/a/_restore")[0] == 200 and call("DELETE", "/logs/_snapshot/a")[0] == 200
    many = call("POST", "/_msearch", {"requests": [{"index": "logs", "request": {"query": "match_all"}}, {"index": "none"}, {"index": "logs", "request": {"query": {"x": 1}}}, 3]})[1]["responses"]
    assert [r["status"] for r in many] == [200, 404, 400, 400] and many[0]["hits"]["total"] == 2
    assert call("PUT", "/logs/_settings", {"retention_secs": 60})[1]["settings"]["retention_secs"] == 60
    text = call("GET", "/metrics")[1]
    assert "skerry_indexes 1" in text and 'skerry_segments{index="logs"} 1' in text
    assert call("PATCH", "/logs")[0] == 404 and call("POST", "/logs/_what")[0] == 404
    assert call("DELETE", "/logs")[0] == 200 and call("GET", "/logs")[0] == 404
