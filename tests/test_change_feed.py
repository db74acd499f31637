import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skerry.functions.change_records import parsed
from skerry.functions.kway import last_of_each, merge_blocks
from skerry.operators.change_feed import LogStructuredTable, apply_feed, source_of

WAL = "entry_id bigint, index_name string, generation bigint, sequence_number bigint, document_id string, record string"
W = '{"type":"index_document","document":{"id":"%s","source":{"v":%d}}}'
D = '{"delete":{"id":"%s"}}'

RECORDS = {
    W % ("a", 1): ("index", "a"),
    '{"document": {"source": {"id": "no", "type": "x"}, "id": "a"}, "type": "index_document"}': ("index", "a"),
    '{"index":{"id":"a","source":{}}}': ("index", "a"),
    '{"IndexDocument":{"document":{"id":"a","source":{}}}}': ("index", "a"),
    '{"type":"delete_document","document_id":"a"}': ("delete", "a"),
    D % "a": ("delete", "a"),
    '{"DeleteDocument":{"document_id":"a"}}': ("delete", "a"),
    '{"type":"mapping_update","mapping_version":2,"reason":"x"}': ("mapping", None),
    ' {"index":{"id":7}} \n': ("index", "7"),
    '{"other":1}': ("other", None),
    '{"a":1,"a":2}': ("other", None),
}
UNREADABLE = [None, "", " ", "x", "[1]", '"x"', "7", "null", '{"index":{"id":"a"}', '{"index":{"id":"a', '{"index":{"id":"a"}}x', '{"index":{"id":"a"}}}', '{"index":{"id":"a"}}{"b":1}', '{"index":{"id":"a"}},{"b":1}', "{'index':{'id':'a'}}", '{"index":{"id":"a"}}]', '{"a":NaN}', '{"a":1,}', '{"index":{"id":"a"}}��']


def test_records(spark):
    df = spark.createDataFrame([(r,) for r in [*RECORDS, *UNREADABLE]], "r string")
    got = {x["r"]: x["p"] for x in parsed(df, "r", "p").collect()}
    for r, want in RECORDS.items():
        assert got[r] is not None and tuple(got[r]) == want, r
    for r in UNREADABLE:
        assert got[r] is None, r


def state(table):
    return {(r["index_name"], r["document_id"]): r["seq"] for r in table.read().collect()}


def replay(rows):
    last = {}
    for _, i, _, s, d, rec in rows:
        if i is None or s is None or rec is None or '"mapping' in rec:
            continue
        doc = d
        last.setdefault((i, doc), {})[s] = "delete" not in rec
    return {k: max(v) for k, v in last.items() if v[max(v)]}


def feed(n, seed):
    rnd, rows = random.Random(seed), []
    for s in range(1, n + 1):
        doc = rnd.choice(["a", "A", "0a", "b", "c", "hot", "hot", "hot"])
        rec = (W % (doc, s)) if rnd.random() < 0.7 else D % doc
        rows += [(0, rnd.choice("ij"), 1, s, doc, rec)] * rnd.choice([1, 1, 2, 3])
    rnd.shuffle(rows)
    return [(k, *r[1:]) for k, r in enumerate(rows)]


@pytest.mark.parametrize("runs,compact_at", [(1, 9), (4, 9), (6, 2)])
def test_any_arrival_gives_the_last_state(spark, runs, compact_at):
    rows = feed(300, runs)
    df = spark.createDataFrame(rows, WAL)
    assert state(apply_feed(df, runs=runs, compact_at=compact_at)) == replay(rows)


def test_late_changes_after_compaction(spark, tmp_path):
    path = f"file://{tmp_path}/lsm"
    table = LogStructuredTable(spark, path, ["k"], buckets=3)
    rows = lambda *x: spark.createDataFrame(x, "k string, seq bigint, tie bigint, deleted boolean, payload string, extra int")
    table.append(rows(("a", 5, 1, True, None, 0), ("b", 1, 2, False, "b1", 0), ("c", 1, 1, False, "c1", 0)))
    table.append(rows(("b", 4, 3, False, "b4", 0), (None, 9, 9, False, "x", 0), ("d", None, 9, False, "x", 0)))
    table.compact()
    assert len(table.runs) == 1
    # an older write of a deleted key, and a repeated change, change nothing
    again = LogStructuredTable(spark, path, ["k"])
    again.append(rows(("a", 3, 7, False, "a3", 0), ("b", 4, 3, False, "b4", 0), ("c", 2, 1, True, None, 0)))
    assert sorted(tuple(r) for r in again.read(["k", "payload"]).collect()) == [("b", "b4")]
    assert sorted((r["k"], r["deleted"]) for r in again.read(tombstones=True).collect()) == [("a", True), ("b", False), ("c", True)]


def test_null_ids_and_empty_feeds(spark):
    rows = [(1, "i", 1, 1, None, W % ("a", 1)), (2, "i", 1, 2, "z", '{"index":{"source":{}}}'), (3, None, 1, 3, "q", W % ("q", 1)), (4, "i", 1, None, "r", W % ("r", 1)), (None, "i", 1, 9, "s", W % ("s", 1)), (5, "i", None, 10, None, '{"index":{}}')]
    assert state(apply_feed(spark.createDataFrame(rows, WAL))) == {("i", "a"): 1, ("i", "z"): 2, ("i", "s"): 9}
    assert apply_feed(spark.createDataFrame([], WAL)).read().collect() == []


def test_extra_columns_do_not_clash(spark):
    df = spark.createDataFrame(feed(40, 9), WAL).selectExpr("*", "1 as bucket", "2 as seq", "3 as tie", "'x' as payload", "4 as r")
    assert state(apply_feed(df)) == replay(feed(40, 9))


def test_source(spark):
    long = "x" * 300_000
    rows = ['{"index":{"id":"a","source":{"v":1}}}', W % ("a", 2), '{"IndexDocument":{"document":{"id":"a","source":{"t":"%s"}}}}' % long]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "r string").select(source_of(F.col("r"))).collect()]
    assert got == ['{"v":1}', '{"v":2}', '{"t":"%s"}' % long]


def test_merge_of_sorted_streams():
    rnd = random.Random(1)
    streams = []
    for _ in range(4):
        rows = sorted((rnd.randint(0, 30), rnd.choice("xy"), rnd.randint(0, 99)) for _ in range(rnd.randint(0, 60)))
        blocks = [pa.table(dict(zip("abv", map(list, zip(*rows[i:i + 7]))))) for i in range(0, len(rows), 7)]
        streams.append((rows, blocks))
    out, last = [], None
    for t in merge_blocks([iter(b) for _, b in streams], ["a", "b"]):
        t = t.sort_by([("a", "ascending"), ("b", "ascending"), ("v", "ascending")])
        part = list(zip(*(t[c].to_pylist() for c in "abv")))
        assert last is None or part[0][:2] > last
        last = part[-1][:2]
        keep = last_of_each(t.combine_chunks(), ["a", "b"])
        assert [part[i] for i in keep] == [max(p for p in part if p[:2] == k) for k in sorted({p[:2] for p in part})]
        out += part
    assert out == sorted(r for rows, _ in streams for r in rows)
    assert list(merge_blocks([iter([])], ["a"])) == []
