import json

import pytest

from skerry import files
from skerry.files import ConcurrentWrite, Versions, create_exclusive, names, read_bytes
from skerry.functions.change_records import parsed
from skerry.operators.change_feed import LogStructuredTable

ROWS = "k string, seq bigint, tie bigint, deleted boolean, payload string"


def test_a_file_is_created_once(spark, tmp_path):
    path = f"file://{tmp_path}/a/b.json"
    assert create_exclusive(spark, path, b"1") and not create_exclusive(spark, path, b"2")
    assert read_bytes(spark, path) == b"1" and names(spark, f"file://{tmp_path}/a") == ["b.json"] and names(spark, f"file://{tmp_path}/none") == []


def test_the_way_of_other_file_systems(spark, tmp_path):
    """A hidden name, then a rename that doesn't overwrite: never a half file under the name."""
    path, part = f"file://{tmp_path}/e/1.json", f"file://{tmp_path}/e/.1.json.x.part"
    assert files._create_by_rename(spark, path, part, b"whole") and not files._create_by_rename(spark, path, part, b"other")
    assert read_bytes(spark, path) == b"whole" and [n for n in names(spark, f"file://{tmp_path}/e") if not n.startswith(".")] == ["1.json"]


def test_versions(spark, tmp_path):
    v, other = (Versions(spark, f"file://{tmp_path}/m") for _ in "ab")
    assert v.latest() == (0, None)
    v.put(0, {"n": 1})
    with pytest.raises(ConcurrentWrite):
        other.put(0, {"n": 9})
    for k in range(1, 9):
        v.put(k, {"n": k + 1})
    assert other.latest() == (9, {"n": 9}) and len(v.numbers()) == files.OLD_VERSIONS + 1
    assert v.change(lambda s: {"n": s["n"] + 1}) == {"n": 10} and v.change(lambda s: None) == {"n": 10}


class Killed(BaseException):
    pass


@pytest.mark.parametrize("at", range(6))
def test_a_writer_that_dies_leaves_a_whole_state(spark, tmp_path, monkeypatch, at):
    """Killed before or after each step that makes a manifest visible, the runs are those before or after the change."""
    path = f"file://{tmp_path}/lsm"
    frame = lambda *x: spark.createDataFrame(x, ROWS)
    table = LogStructuredTable(spark, path, ["k"], buckets=2, compact_at=3)
    table.append(frame(("a", 1, 1, False, "a1"), ("b", 1, 1, False, "b1")))
    table.append(frame(("a", 2, 1, True, None)))
    before, after = {("b", "b1")}, {("b", "b1"), ("c", "c3")}
    calls, real = [], files.create_exclusive

    def create(*a):
        calls.append(1)
        if len(calls) - 1 == at // 2 and at % 2 == 0:
            raise Killed
        made = real(*a)
        if len(calls) - 1 == at // 2:
            raise Killed
        return made

    monkeypatch.setattr(files, "create_exclusive", create)
    try:
        table.append(frame(("c", 3, 1, False, "c3")))  # the third run is also compacted
    except Killed:
        pass
    monkeypatch.undo()
    again = LogStructuredTable(spark, path, ["k"])
    got = {tuple(r) for r in again.read(["k", "payload"]).collect()}
    assert got == (before if at == 0 else after)
    again.append(frame(("c", 3, 1, False, "c3")))
    again.compact()
    assert {tuple(r) for r in again.read(["k", "payload"]).collect()} == after


def test_two_writers_lose_no_run(spark, tmp_path):
    frame = lambda *x: spark.createDataFrame(x, ROWS)
    a, b = (LogStructuredTable(spark, f"file://{tmp_path}/lsm", ["k"], buckets=2) for _ in "ab")
    a.append(frame(("x", 1, 1, False, "1")))
    b.append(frame(("y", 1, 1, False, "1")))
    a.append(frame(("z", 1, 1, False, "1")))
    assert {r["k"] for r in b.reload().read().collect()} == {"x", "y", "z"}
    a.compact()
    b.compact()  # what it would merge has been merged
    assert len(b.runs) == 1 and {r["k"] for r in b.read().collect()} == {"x", "y", "z"}


def test_records_may_say_anything(spark):
    whole = [
        json.dumps({"index": {"id": "a", "source": {"text": 'x _end_of_record_ {"_end_of_record_":true}]'}}}), '{"_end_of_record_":1,"index":{"id":"a"}}', '{"index":{"id":"a"},"_end_of_record_":{"x":[1]}}',
    ]
    cut = ['{"index":{"id":"a"}},{"_end_of_record_":true}]', '{"index":{"id":"a"}},{"_end_of_record_":"1"}],{"x":[{}', '{"index":{"id":"a"}},{"_end_of_record_":null}']
    got = {r["r"]: r["p"] for r in parsed(spark.createDataFrame([(x,) for x in whole + cut], "r string"), "r", "p").collect()}
    assert all(got[x] is not None and tuple(got[x]) == ("index", "a") for x in whole) and all(got[x] is None for x in cut)
