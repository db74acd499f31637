from skerry.sources.store import Settings, Store
from skerry.streaming.maintenance import Intervals, Maintenance


def test_due_tasks(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.create_index("a", Settings(merge_threshold_docs=5, primary_time_field="ts", retention_secs=60))
    index, now = store.open("a"), [0.0]
    keeper = Maintenance(store, Intervals(refresh=1, flush=10, merge=20, retention=30), clock=lambda: now[0])
    index.bulk([{"index": {"id": "old", "source": {"ts": "2020-01-01T00:00:00Z"}}}, {"index": {"id": "new", "source": {"ts": "2999-01-01T00:00:00Z"}}}])
    assert keeper.tick() == ["refresh", "flush", "merge", "retention"] and keeper.errors == []
    assert [r["_id"] for r in index.searchable().collect()] == ["new"] and index.get_document("old") is None
    assert keeper.tick() == []
    now[0] = 1.5
    assert keeper.tick() == ["refresh"]
    now[0] = 11
    assert keeper.tick() == ["refresh", "flush"]
    # an index that is damaged doesn't stop the others
    store.create_index("b")
    store.files.delete(f"{store.root}/b/manifest.json")
    index.bulk([{"delete": {"id": "new"}}])
    now[0] = 13
    keeper.tick()
    assert [e[1] for e in keeper.errors] == ["b"] and index.searchable().collect() == []


def test_intervals(monkeypatch):
    assert Intervals(refresh=0, flush=5) == Intervals(1.0, 5, 60.0, 60.0)
    monkeypatch.setenv("SKERRY_FLUSH_SECS", "7")
    assert Intervals.from_environment().flush == 7.0 and Intervals.from_environment().merge == 60.0
