import random
from datetime import datetime, timedelta

import pytest

from skerry.operators import consolidate as co

DOCS = "index_name string, segment_number bigint, mapping_version int, document_id string, sequence_number bigint, written_at timestamp, source string"
SETTINGS = "index_name string, merge_threshold_docs bigint"
T = datetime(2026, 1, 1)


def made(spark, rows, settings):
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(settings, SETTINGS)


def some_rows(seed, n=600):
    rnd, rows = random.Random(seed), []
    for s in range(n):
        index = rnd.choice(["big", "big", "big", "small", "tiny"])
        segment = rnd.randint(1, 60) if index != "tiny" else 1
        doc = f"{rnd.randint(1, 200):03d}"
        row = (index, segment, 1, doc, s, T + timedelta(seconds=s), '{"v":%d}' % s)
        rows += [row] * rnd.choice([1, 1, 2])
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_every_document_once_in_few_segments(spark, seed):
    rows = some_rows(seed)
    docs, settings = made(spark, rows, [("big", 10), ("small", None)])
    done = co.consolidate(docs, settings)
    want = {}
    for r in rows:
        want[(r[0], r[3])] = max(want.get((r[0], r[3]), (-1,)), (r[4], r[6]))
    got = {(r["index_name"], r["document_id"]): (r["sequence_number"], r["source"]) for r in done.documents.collect()}
    assert got == want and done.documents.count() == len(want)
    segments = done.segments.collect()
    assert sum(s["document_count"] for s in segments) == len(want)
    for s in segments:
        limit = {"big": 10}.get(s["index_name"], 8)
        alone = sum(x["index_name"] == s["index_name"] for x in segments) == 1
        assert s["document_count"] >= limit or alone
        inside = [r for r in done.documents.where(f"index_name = '{s['index_name']}' and segment_number = {s['segment_number']}").collect()]
        assert len(inside) == s["document_count"]
        assert min(r["document_id"] for r in inside) == s["first_document"] and max(r["document_id"] for r in inside) == s["last_document"]
    size = {}
    for r in rows:
        size.setdefault((r[0], r[1]), set()).add(r[3])
    small = {k for k, v in size.items() if len(v) < {"big": 10}.get(k[0], 8)}
    small = {k for k in small if sum(x[0] == k[0] for x in small) >= 2}
    assert {(r["index_name"], r["segment_number"]) for r in co.replaced(done).collect()} == small


def test_segments_are_closed_by_bytes(spark):
    rows = [("i", k, 1, f"{k:04d}", k, T, "x" * 100) for k in range(500)]
    docs, settings = made(spark, rows, [("i", 5)])
    done = co.consolidate(docs.coalesce(1), settings, segment_bytes=2_000)
    sizes = [s["document_count"] for s in done.segments.collect()]
    assert sum(sizes) == 500 and 20 <= len(sizes) <= 30 and max(sizes) <= 25


def test_hot_document_and_ties(spark):
    rows = [("i", k % 50, 1, "hot", 7, T, "same") for k in range(3000)] + [("i", 1, 1, "a", 1, T, None), ("i", 2, 1, "a", 1, T, "x")]
    done = co.consolidate(*made(spark, rows, [("i", 100)]))
    assert sorted((r["document_id"], r["source"]) for r in done.documents.collect()) == [("a", "x"), ("hot", "same")]


def test_nulls_and_extra_columns(spark):
    rows = [(None, 1, 1, "a", 1, T, "p"), ("i", None, None, "b", None, None, None), ("i", 1, 1, None, 1, T, "q"), ("i", 1, 1, None, 1, T, "q"), ("i", 1, 1, None, 2, T, "r"), ("i", 2, 1, "c", 1, T, "s" * 400_000)]
    docs, settings = made(spark, rows, [(None, 4), ("i", 4), ("i", 4)])
    done = co.consolidate(docs.selectExpr("*", "1 as part", "2 as piece", "3 as old_segment", "4 as _v", "5 as threshold"), settings)
    got = done.documents
    assert got.count() == 5 and {"part", "piece", "old_segment", "_v", "threshold", "mapping_version"} <= set(got.columns)
    assert got.where("document_id is null").count() == 2
    assert {(r["index_name"], r["segment_number"]) for r in co.replaced(done).collect()} == {("i", 2), ("i", None)}


def test_empty(spark):
    done = co.consolidate(*made(spark, [], []))
    assert done.documents.collect() == [] and done.segments.collect() == [] and co.replaced(done).collect() == []


def test_many_runs_are_merged_in_levels(spark):
    rows = some_rows(3)
    docs, settings = made(spark, rows, [("big", 10), ("small", None)])
    done = co.consolidate(docs.repartition(9), settings, fan_in=2, file_bytes=4_000, segment_bytes=300)
    want = {}
    for r in rows:
        want[(r[0], r[3])] = max(want.get((r[0], r[3]), (-1,)), (r[4], r[6]))
    got = done.documents.collect()
    assert {(r["index_name"], r["document_id"]): (r["sequence_number"], r["source"]) for r in got} == want and len(got) == len(want)
    sizes = {}
    for r in rows:
        sizes.setdefault((r[0], r[1]), set()).add(r[3])
    assert {(r["index_name"], r["segment_number"]): r["size"] for r in done.plan.collect()} == {k: len(v) for k, v in sizes.items()}
    assert all(s["document_count"] >= {"big": 10}.get(s["index_name"], 8) for s in done.segments.collect() if s["index_name"] != "tiny")


def test_good_segments_without_copies_stay(spark):
    row = lambda s, d, n: ("i", s, 1, d, n, T, f"{d} {n}")
    rows = [row(1, f"a{k:02d}", k) for k in range(20)]  # good, its documents nowhere else
    rows += [row(2, f"b{k:02d}", k) for k in range(20)] + [row(3, f"b{k:02d}", 90 + k) for k in range(15)]  # good, with copies
    rows += [row(4, f"c{k:02d}", k) for k in range(12)] + [row(4, "c00", 0)]  # good, one row repeated
    rows += [row(s, f"d{s}", s) for s in range(5, 25)]  # small
    rows += [("j", 1, 1, "only", 1, T, None), (None, 1, 1, "p", 1, T, "x"), (None, 2, 1, "p", 2, T, "y")]
    done = co.consolidate(*made(spark, rows, [("i", 10)]))
    plan = {(r["index_name"], r["segment_number"]): (r["merge"], r["rewrite"]) for r in done.plan.collect()}
    assert plan.pop(("i", 1)) == (False, False) == plan.pop(("j", 1))
    assert plan.pop((None, 1)) == plan.pop((None, 2)) == (True, True)
    assert all(v == (k[1] >= 5, True) for k, v in plan.items())
    got = {(r["index_name"], r["document_id"]): (r["segment_number"], r["sequence_number"]) for r in done.documents.collect()}
    assert done.documents.count() == len(got) == 20 + 20 + 12 + 20 + 1 + 1
    assert all(got[("i", f"a{k:02d}")] == (1, k) for k in range(20)) and got[(None, "p")][1] == 2 and got[("j", "only")] == (1, 1)
    assert {got[("i", f"b{k:02d}")][1] for k in range(15)} == {90 + k for k in range(15)} and min(v[0] for k, v in got.items() if k[0] == "i" and k[1][0] != "a") > 24
    segments = {(s["index_name"], s["segment_number"]): s["document_count"] for s in done.segments.collect()}
    assert segments[("i", 1)] == 20 and sum(segments.values()) == len(got)


def test_a_document_in_very_many_segments_is_spread_over_blocks(spark):
    """Its rows stream by: they are more than a row group, in several runs, and each segment counts it once."""
    rows = [("i", k, 1, "hot", k % 777, T, "x" * 3000) for k in range(3000)] + [("i", 5000, 1, f"z{k}", 1, T, "z") for k in range(9)]
    done = co.consolidate(*made(spark, rows, [("i", 2)]), fan_in=3)
    assert {(r["size"], r["shared"]) for r in done.plan.where("segment_number < 5000").collect()} == {(1, 1)}
    assert done.documents.where("document_id = 'hot'").first()["sequence_number"] == 776 and done.documents.count() == 10
