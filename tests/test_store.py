from datetime import datetime, timedelta, timezone

import pytest

from skerry.plans.errors import AlreadyExists, InvalidRequest, LimitExceeded, MappingConflict, NotFound
from skerry.sources.store import Settings, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


@pytest.fixture
def index(store):
    store.create_index("logs", Settings(merge_threshold_docs=3))
    return store.open("logs")


def found(index, body=None):
    return [h["_id"] for h in index.search(body or {})["hits"]["hits"]]


def test_catalog(store):
    meta = store.create_index("a-1_b", Settings(namespace="core"), {"x": "Integer"})
    assert meta["mappings"] == {"x": "Integer"} and store.indexes() == ["a-1_b"]
    for bad in ("", "A", "a/b", "x" * 256):
        with pytest.raises(InvalidRequest):
            store.create_index(bad)
    with pytest.raises(AlreadyExists):
        store.create_index("a-1_b")
    for settings in (Settings(namespace="no space"), Settings(mapping_mode="x"), Settings(retention_secs=0)):
        with pytest.raises(InvalidRequest):
            store.create_index("c", settings)
    with pytest.raises(InvalidRequest):
        store.create_index("c", mappings={"x": "text"})
    assert store.update_settings("a-1_b", 60)["settings"]["retention_secs"] == 60
    store.delete_index("a-1_b")
    for call in (store.get_index, store.delete_index, store.open):
        with pytest.raises(NotFound):
            call("a-1_b")
    with pytest.raises(LimitExceeded):
        Store(store.spark, store.root, max_indexes=0).create_index("z")


def test_visibility(store, index):
    assert index.index_document("1", {"service": "auth"})["result"] == "created"
    assert index.get_document("1") == {"service": "auth"} and found(index) == []
    assert index.refresh() == 1 and found(index) == ["1"]
    assert index.index_document("1", {"service": "billing"})["result"] == "updated"
    index.delete_document("none")
    index.index_document("2", {"service": "x"})
    index.delete_document("2")
    assert index.get_document("2") is None and found(index) == ["1"]
    assert index.search({"query": {"term": {"service": "auth"}}})["hits"]["total"]["value"] == 1
    index.refresh()
    assert index.search({"query": {"term": {"service": "auth"}}})["hits"]["total"]["value"] == 0
    # opening shows what was logged
    index.index_document("3", {"service": "late"})
    assert found(store.open("logs")) == ["1", "3"]


def test_bulk_in_order_and_item_by_item(index):
    out = index.bulk([
        {"index": {"id": "1", "source": {"n": 1}}}, {"index": {"id": "2", "source": {"n": "x"}}}, {"index": {"id": "3", "source": [1]}}, {"index": {"id": "1", "source": {"n": 2, "m": "y"}}}, {"delete": {"id": "9"}}, {"index": {"id": "4", "source": {"n": 2**40}}},
    ])
    assert out["errors"] and [i["status"] for i in out["items"]] == [201, 400, 400, 201, 200, 400]
    assert all(i.get("result") in ("created", "deleted") for i in out["items"] if i["status"] < 400)
    index.refresh()
    assert index.get_document("1") == {"n": 2, "m": "y"} and found(index) == ["1"]
    assert index.mapping == {"n": "Integer", "m": "Keyword"}
    with pytest.raises(MappingConflict):
        index.index_document("5", {"n": 1.5})
    with pytest.raises(InvalidRequest):
        index.bulk([{"update": {"id": "1"}}])


def test_strict_mode(store):
    store.create_index("s", Settings(mapping_mode="strict"), {"a": "Keyword"})
    index = store.open("s")
    assert [i["status"] for i in index.bulk([{"index": {"id": "1", "source": {"a": "x"}}}, {"index": {"id": "2", "source": {"b": "x"}}}])["items"]] == [201, 400]
    ops = store.spark.createDataFrame([(0, "index", "3", '{"a":"y"}'), (1, "index", "4", '{"c":1}')], "position bigint, op string, id string, source string")
    assert [r["id"] for r in index.bulk_frame(ops).collect()] == ["4"]
    index.refresh()
    assert found(index) == ["1", "3"]


def test_bulk_frame(spark, index):
    rows = [(0, "index", "1", '{"n":1,"t":"2026-01-01T00:00:00Z"}'), (1, "index", "2", '{"n":"x"}'), (2, "delete", "1", None), (3, "index", "3", '{"n":3}'), (4, "index", "3", '{"n":4,"o":{"p":1}}'), (5, "index", "5", "[1]"), (6, "index", "6", None), (7, "index", "7", '{"n":[1]}'), (8, "index", "8", '{"n":null}'), (9, "index", None, "{}")]
    refused = index.bulk_frame(spark.createDataFrame(rows, "position bigint, op string, id string, source string"))
    assert sorted(r["id"] for r in refused.collect()) == ["2", "5", "6", "7"]
    index.refresh()
    assert found(index) == ["3", "8"] and index.get_document("3") == {"n": 4, "o": {"p": 1}}
    assert index.mapping == {"n": "Integer", "t": "Timestamp", "o": "Object"}
    assert index.bulk_frame(spark.createDataFrame([], "position bigint, op string, id string, source string")).collect() == []


def test_flush_merge_and_reopen(store, index):
    for k in range(3):
        index.bulk([{"index": {"id": f"{k}-{j}", "source": {"n": j}}} for j in range(4)])
        index.refresh()
        assert index.flush()["flushed_documents"] == 4
    assert len(index.manifest["segments"]) == 3 and index.manifest["log"] == []
    index.bulk([{"delete": {"id": "0-0"}}, {"index": {"id": "1-1", "source": {"n": 100}}}])
    # not refreshed: a flush doesn't contain it and must not lose it
    assert index.flush()["flushed_documents"] == 0
    again = store.open("logs")
    assert len(found(again)) == 11 and again.search({"query": {"term": {"n": 100}}})["hits"]["hits"][0]["_id"] == "1-1"
    again.flush()
    assert again.merge()["merged_documents"] == 11
    assert len(again.manifest["segments"]) == 1 and "0-0" not in found(again)
    assert again.metrics()["segments"] == 1 and again.flush()["flushed_documents"] == 0


def test_small_segments_are_folded(index):
    for k in range(4):
        index.bulk([{"index": {"id": str(k), "source": {"n": k}}}])
        index.refresh()
        index.flush()
    assert [s["documents"] for s in index.manifest["segments"]] in ([3, 1], [4])
    assert found(index) == ["0", "1", "2", "3"]


def test_deleted_stays_deleted_through_segments(index):
    index.bulk([{"index": {"id": str(k), "source": {"n": k}}} for k in range(5)])
    index.refresh(), index.flush()
    index.delete_document("2")
    index.refresh(), index.flush()
    assert found(index) == ["0", "1", "3", "4"] and index.get_document("2") is None
    index.merge()
    assert found(index) == ["0", "1", "3", "4"]


def test_snapshots(index):
    index.bulk([{"index": {"id": "1", "source": {"n": 1}}}])
    index.refresh()
    index.bulk([{"index": {"id": "2", "source": {"n": 2}}}])
    meta = index.create_snapshot("one")
    assert meta["documents"] == 2 and [s["name"] for s in index.snapshots()] == ["one"]
    with pytest.raises(AlreadyExists):
        index.create_snapshot("one")
    for bad in ("", "a/b", ".."):
        with pytest.raises(InvalidRequest):
            index.create_snapshot(bad)
    index.bulk([{"delete": {"id": "1"}}, {"index": {"id": "3", "source": {"m": "x"}}}])
    index.merge()
    assert found(index) == ["2", "3"]
    index.bulk([{"index": {"id": "4", "source": {"n": 4}}}])
    index.restore_snapshot("one")
    assert found(index) == ["1", "2"] and index.mapping == {"n": "Integer"}
    index.bulk([{"index": {"id": "5", "source": {"n": 5}}}])
    index.refresh()
    assert found(index) == ["1", "2", "5"]
    index.delete_snapshot("one"), index.delete_snapshot("one")
    with pytest.raises(NotFound):
        index.restore_snapshot("one")


def test_retention(store):
    store.create_index("r", Settings(primary_time_field="ts", retention_secs=3600))
    index, now = store.open("r"), datetime(2026, 1, 1, 12, tzinfo=timezone.utc)
    times = {"old": now - timedelta(hours=2), "edge": now - timedelta(hours=1), "new": now - timedelta(minutes=5)}
    index.bulk([{"index": {"id": k, "source": {"ts": v.isoformat().replace("+00:00", "Z"), "w": "x"}}} for k, v in times.items()] + [{"index": {"id": "none", "source": {"w": "x"}}}])
    index.refresh()
    body = {"query": {"term": {"w": "x"}}}
    assert [h["_id"] for h in index.search(body, now)["hits"]["hits"]] == ["new", "none"]
    assert index.evict(now) == 2 and index.get_document("old") is None
    store.update_settings("r", None)
    assert found(index, body) == ["new", "none"]


def test_retention_in_seconds(store):
    store.create_index("r", Settings(primary_time_field="ts", retention_secs=100))
    index = store.open("r")
    index.bulk([{"index": {"id": str(s), "source": {"ts": s}}} for s in (1_000, 1_950)])
    index.refresh()
    assert [h["_id"] for h in index.search({}, datetime.fromtimestamp(2_000, timezone.utc))["hits"]["hits"]] == ["1950"]


def test_odd_field_names(index):
    index.bulk([{"index": {"id": "1", "source": {"a.b": 1, "Name": "x", "name": "y", "_id": "z", "it's": 1, "sp ace": "q w", "": 3}}}])
    index.refresh()
    assert index.search({"query": {"term": {"a.b": 1}}})["hits"]["total"]["value"] == 1
    assert index.search({"query": {"term": {"sp ace": "W"}}})["hits"]["total"]["value"] == 1
    index.merge()
    assert index.search({})["hits"]["hits"][0]["_source"]["_id"] == "z"


def test_stream(spark, index, tmp_path):
    from skerry.streaming.ingest import ingest

    schema = "position bigint, op string, id string, source string"
    path = f"file://{tmp_path}/in"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    write([(2, "index", "1", '{"n":2}'), (1, "index", "1", '{"n":1}'), (3, "index", "2", '{"n":3}')])
    run = lambda: ingest(spark.readStream.schema(schema).parquet(path), index, f"file://{tmp_path}/cp", "s").awaitTermination()
    run()
    assert index.get_document("1") == {"n": 2} and found(index) == ["1", "2"]
    write([(1, "delete", "1", None)])
    run()
    assert found(index) == ["2"]
    # a batch that comes again is known
    before = index.manifest["next_seq"]
    index.bulk_frame(spark.createDataFrame([(1, "delete", "2", None)], schema), batch=("s", 0))
    assert index.manifest["next_seq"] == before and found(index) == ["2"]


def test_stream_histogram(spark, tmp_path):
    from skerry.streaming.ingest import histogram

    times = [datetime(2026, 1, 1, h, 30) for h in (0, 0, 1, 5)]
    spark.createDataFrame([(t,) for t in times], "ts timestamp").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp").parquet(f"file://{tmp_path}/in")
    q = histogram(stream, "ts", "1 hour", "1 hour").writeStream.format("memory").queryName("hist").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("hist").collect())) == [("2026-01-01T00:00:00Z", 2), ("2026-01-01T01:00:00Z", 1)]


class Conf:
    """A session with only the settings of a dict."""

    def __init__(self, master, **values):
        self.values, self.conf, self.sparkContext, self.master = values, self, self, master

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


def test_shared_folder_setting():
    from skerry.session import SHARED_DIR_KEY, scratch_path, shared_root

    assert scratch_path(Conf("spark://x", **{SHARED_DIR_KEY: "hdfs://h/d/"}), "x").startswith("hdfs://h/d/skerry/x-")
    alone = Conf("local[4]")
    assert shared_root(alone) == shared_root(alone) and shared_root(alone).startswith("file:///")
    with pytest.raises(RuntimeError):
        shared_root(Conf("spark://x"))


def one(k, n):
    return {"index": {"id": str(k), "source": {"n": n}}}


def test_segments_are_read_beside_their_deletions(store):
    store.create_index("d", Settings(merge_threshold_docs=1))
    index = store.open("d")
    for part in ([one(k, k) for k in range(6)], [one(1, 10), {"delete": {"id": "2"}}], [one(2, 20), one(1, 11), {"delete": {"id": "5"}}]):
        index.bulk(part)
        index.refresh(), index.flush()
    segments = index.manifest["segments"]
    assert [(s["documents"], s["rows"], len(s.get("deletions", []))) for s in segments] == [(3, 3, 2), (0, 0, 1), (2, 3, 0)]
    want = {"0": 0, "1": 11, "2": 20, "3": 3, "4": 4}
    assert {r["_id"]: r["n"] for r in index.searchable().collect()} == want
    index.bulk([one(0, 1), {"delete": {"id": "3"}}])
    index.refresh()
    want = {"0": 1, "1": 11, "2": 20, "4": 4}
    assert {r["_id"]: r["n"] for r in index.searchable().collect()} == want
    assert index.merge()["merged_documents"] == 4 and {r["_id"]: r["n"] for r in index.searchable().collect()} == want


def test_a_lone_large_segment_is_merged_if_it_holds_deleted_documents(store):
    store.create_index("l", Settings(merge_threshold_docs=3))
    index = store.open("l")
    index.bulk([one(k, k) for k in range(5)] + [{"delete": {"id": "0"}}])
    index.refresh(), index.flush()
    # the flush has planned and made the merge
    assert [(s["documents"], s["rows"]) for s in index.manifest["segments"]] == [(4, 4)] and index.plan_merge() == []


class Killed(BaseException):
    pass


@pytest.mark.parametrize("after", [False, True])
def test_a_writer_that_dies_in_a_flush(store, index, monkeypatch, after):
    from skerry import files

    index.bulk([one(k, k) for k in range(4)])
    index.refresh()
    real = files.create_exclusive

    def create(*a):
        if after:
            real(*a)
        raise Killed

    monkeypatch.setattr(files, "create_exclusive", create)
    with pytest.raises(Killed):
        index.flush()
    monkeypatch.undo()
    again = store.open("logs")
    assert found(again) == ["0", "1", "2", "3"]
    again.bulk([one(9, 9)])
    again.refresh(), again.flush()
    assert found(again) == ["0", "1", "2", "3", "9"]


def test_an_overtaken_writer_is_refused(store, index):
    from skerry.files import ConcurrentWrite

    old = index.manifest
    store.open("logs").bulk([one(1, 1)])
    with pytest.raises(ConcurrentWrite):
        index._save(old | {"next_seq": 99})
    index.bulk([one(2, 2)])
    index.refresh()
    assert found(index) == ["1", "2"]


def test_writers_of_one_process_take_turns(store, index):
    import threading

    threads = [threading.Thread(target=lambda k=k: store.open("logs").bulk([one(k, k)])) for k in range(4)]
    [t.start() for t in threads], [t.join() for t in threads]
    index.refresh()
    assert found(index) == ["0", "1", "2", "3"]


def test_a_damaged_log_is_noticed(spark, index):
    index.bulk([one(1, 1), one(2, 2)])
    index.verify_log()
    part = f"{index.path}/log/{index.manifest['log'][0]['number']:08d}"
    spark.read.parquet(part).where("_id = '1'").coalesce(1).write.mode("append").parquet(part)
    with pytest.raises(InvalidRequest):
        index.verify_log()
    index.refresh()
    with pytest.raises(InvalidRequest):
        index.flush()


def test_statistics_from_segments_equal_those_of_a_scan(store):
    """After flushes, overtaken documents and a merge, scores and suggestions without reading texts are those of reading them."""
    from skerry.operators import suggest
    from skerry.operators.index import SearchIndex
    from skerry.operators.search import matches
    from skerry.plans import dsl

    store.create_index("t", Settings(merge_threshold_docs=1))
    index = store.open("t")
    doc = lambda k, t, **more: {"index": {"id": str(k), "source": {"t": t} | more}}
    parts = [[doc(1, "merge planner"), doc(2, "merge lease lease"), doc(3, "other")], [doc(2, "planner only", b="merge"), {"delete": {"id": "3"}}, doc(4, "")], [doc(5, "Merge words", b="lease"), doc(1, "merge merge merge")]]

    def compare():
        found = index.search_index()
        assert found.stored is not None
        scan = SearchIndex(index.searchable(), found.mapping)
        for body in ({"match": {"t": "merge planner lease"}}, {"term": {"b": "lease"}}, {"mlt": {"like": {"t": "merge lease words"}, "min_term_freq": 1}}, {"multi_match": {"query": "merge lease", "fields": {"t": 1, "b": 2}}}):
            got, want = (sorted((r["_id"], r["_score"]) for r in matches(x, dsl.query(body)).collect()) for x in (found, scan))
            assert got == want, body
        words = lambda df: sorted(tuple(r) for r in df.collect())
        assert words(found.stored.vocabulary()) == words(suggest.vocabulary(scan))

    for part in parts:
        index.bulk(part)
        index.refresh()
        assert index.search_index().stored is None  # the log holds words that no list has yet
        index.flush()
        compare()
    index.merge()
    compare()
    assert [s["text"] for s in index.suggest("me", {"t": 1.0})] == ["merge"]
