import itertools
import json
import random
from datetime import datetime

import numpy as np
import pytest

from skerry.operators import schema_drift as sd

DOCS = "index_name string, segment_number bigint, mapping_version int, document_id string, sequence_number bigint, written_at timestamp, source string"
T = datetime(2026, 1, 1)


def docs(spark, rows):
    """rows: (index, segment, version, id, seq, source)."""
    return spark.createDataFrame([(*r[:5], T, r[5] if r[5] is None or isinstance(r[5], str) else json.dumps(r[5])) for r in rows], DOCS)


def changed(df):
    return sorted((r["index_name"], r["version"], r["change_kind"], r["field_name"], r["old_name"]) for r in sd.changes(df).where("depth = 1").collect())


def test_kinds_of_change(spark):
    rows = [("i", 1, 1, str(k), k, {"a": 1, "b": f"x{k}", "gone": 5, "t": "2026-01-01T00:00:00Z", "n": 1}) for k in range(6)]
    rows += [("i", 2, 2, str(k), 10 + k, {"a": 2**40, "bee": f"x{k}" if k else "other", "t": "plain", "n": None if k else 2, "new": True}) for k in range(6)]
    want = [("i", 2, "added", "new", ""), ("i", 2, "removed", "gone", ""), ("i", 2, "renamed", "bee", "b"), ("i", 2, "type_changed", "a", ""), ("i", 2, "type_changed", "t", "")]
    assert changed(docs(spark, rows)) == want
    # repeated rows and another order change nothing
    assert changed(docs(spark, (rows + rows)[::-1])) == want


def test_rename_needs_half(spark):
    old = [("i", 1, 1, str(k), k, {"a": f"v{k}"}) for k in range(4)]
    for same, kind in ((2, "renamed"), (1, "added")):
        new = [("i", 2, 2, str(k), 10 + k, {"b": f"v{k}" if k < same else "q"}) for k in range(4)]
        assert kind in {x[2] for x in changed(docs(spark, old + new))}
    # documents of one version alone have no say
    new = [("i", 2, 2, str(k), 10 + k, {"b": f"v{k}"}) for k in range(1)]
    assert [x[2] for x in changed(docs(spark, old + new))] == ["renamed"]


def test_version_of_a_segment(spark):
    rows = [("i", 1, None, "a", 1, {"x": 1}), ("i", 1, 1, "b", 2, {"x": 1}), ("i", 2, 2, "a", 3, {"y": "q"}), ("i", 9, None, "c", 4, {"lost": 1})]
    assert changed(docs(spark, rows)) == [("i", 2, "added", "y", ""), ("i", 2, "removed", "x", "")]


def test_nested_fields(spark):
    rows = [("i", 1, 1, "a", 1, {"s": {"name": "x", "rev": 1}, "o": {}}), ("i", 2, 2, "a", 2, {"s": {"name": "x"}, "o": {"rev": 1}})]
    got = [(r["change_kind"], r["field_name"], r["old_name"], r["depth"]) for r in sd.changes(docs(spark, rows)).collect()]
    assert got == [("moved", "o.rev", "s.rev", 2)]


def test_dirty_sources(spark):
    rows = [
        (None, 1, 1, "a", 1, {"x": 1}), ("i", 1, 1, None, 1, {"x": 1}), ("i", 1, 1, "a", None, None), ("i", 1, 1, "a", 1, "not json"), ("i", 1, 1, "a", 1, "[1]"), ("i", 1, 1, "b", 2, {"x": [1], "a.b": 1}),
        ("i", 2, 2, "a", 1, {"x": None, "a.b": 1.0}), ("i", None, 2, "a", 1, {"z": "y" * 200_000}), ("j", 1, 1, "a", 1, {"only": 1}),
    ]
    df = docs(spark, rows).selectExpr("*", "1 as version", "2 as _v", "3 as roles", "4 as field")
    got = changed(df)
    assert got == [("i", 2, "added", "z", ""), ("i", 2, "removed", "x", ""), ("i", 2, "type_changed", "a.b", "")]
    assert sd.changes(df.where("false")).collect() == []


def test_types(spark):
    values = ["x", "2026-01-01T00:00:00+02:00", "2026-13-01T00:00:00Z", "2026-01-01", True, 1, -(2**31) - 1, 2**64, 1.5, 1e3, {}, [1], None]
    rows = [("i", 1, 1, "a", 1, {f"f{k}": v for k, v in enumerate(values)})]
    got = {r["field"]: r["type"] for r in sd.field_types(sd.versioned(docs(spark, rows))).collect()}
    kinds = ["Keyword", "Timestamp", "Keyword", "Keyword", "Boolean", "Integer", "Long", "Double", "Double", "Double", "Object", "Array"]
    assert got == {f"f{k}": t for k, t in enumerate(kinds)}


def test_broadcast_and_join_agree(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [("i", v, v, str(rnd.randint(0, 20)), v * 100 + k, {rnd.choice(["a", "b"]) + str(v // 2): rnd.randint(0, 3), "c": k}) for v in (1, 2, 3) for k in range(30)]
    df = docs(spark, rows)
    want = changed(df)
    monkeypatch.setattr(sd, "BROADCAST_ROWS", -1)
    assert changed(df) == want and want


def test_cheapest_assignment():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = rng.integers(1, 5), rng.integers(5, 7)
        cost = rng.integers(0, 9, (n, m)).astype(float)
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), int(n)))
        pairs = sd.assign(cost)
        assert sorted(i for i, _ in pairs) == list(range(n)) and sum(cost[i, j] for i, j in pairs) == best


def test_script_picks_the_best_pairing():
    node = lambda *names: sd.Node("", "Object", {n: sd.Node(n, "Keyword") for n in names})
    cost, script = sd.edit_script(node("a", "b", "k"), node("x", "y", "k"), {("a", "x"): 0.6, ("a", "y"): 0.9, ("b", "y"): 1.0})
    assert sorted(s[:3] for s in script) == [("renamed", "x", "a"), ("renamed", "y", "b")] and cost == pytest.approx(0.9 + 0.5)


def test_one_table(spark):
    rows = [("i", 1, 1, str(k), k, {"a": k, "b": f"x{k}", "s": {"q": 1}}) for k in range(4)]
    rows += [("i", 2, 2, str(k), 10 + k, {"a": k + 0.5, "bee": f"x{k}"}) for k in range(4)]
    rows += [("i", 3, 3, str(k), 20 + k, {"a": "stray" if k == 0 else 1, "bean": f"x{k}"}) for k in range(4)]
    rows += [("j", 1, None, "z", 1, None)]
    df = docs(spark, rows)
    found = sd.drift(df)
    got = sd.unify(found)
    assert got.count() == len(rows) and {"f_a", "f_bean", "f_s"} <= set(got.columns) and "f_b" not in got.columns
    assert {r["f_bean"] for r in got.where("index_name = 'i'").collect()} == {"x0", "x1", "x2", "x3"}
    # types of a: Integer, Double, Integer: all are numbers, the stray text is kept beside them
    assert dict(got.dtypes)["f_a"] == "double"
    assert [r["strays"] for r in got.where("f_a is null and index_name = 'i'").collect()] == [{"a": '"stray"'}]
    narrow = sd.unify(found, max_columns=1)
    assert narrow.where("version = 1").first()["rest"].keys() >= {"s"}
    assert sd.unify(sd.drift(df.where("false"))).collect() == []


def test_two_fields_that_end_under_one_name(spark):
    rows = [("i", 1, 1, str(k), k, {"a": f"x{k}", "b": f"y{k}"}) for k in range(3)]
    rows += [("i", 2, 2, str(k), 10 + k, {"p": f"x{k}", "b": f"y{k}"}) for k in range(3)]
    rows += [("i", 3, 3, str(k), 20 + k, {"b": f"y{k}"}) for k in range(3)]
    rows += [("i", 4, 4, str(k), 30 + k, {"p": f"y{k}"}) for k in range(3)]
    got = sd.unify(sd.drift(docs(spark, rows)))
    first = got.where("version = 1 and document_id = '1'").first()
    assert first["f_p"] is None and first["rest"] == {"a": '"x1"', "b": '"y1"'}
    assert got.where("version = 3 and document_id = '1'").first()["f_p"] == "y1"


WAL = "index_name string, document_id string, sequence_number bigint, record string"
META = "index_name string, mapping_version int, updated_at timestamp, mappings string"


def test_log_and_mappings_take_part(spark):
    seg = docs(spark, [("i", v, v, str(k), 10 * v + k, {"a" if v == 1 else "b": f"x{k}"}) for v in (1, 2) for k in range(4)])
    write = lambda k, source: json.dumps({"index": {"id": k, "source": source}})
    wal = [
        ("i", "new", 40, write("new", {"b": "q"})), ("i", None, 40, json.dumps({"index": {"source": {"b": "q"}, "id": "new"}})), ("i", None, 41, '{"type":"mapping_update","mapping_version":3}'),
        ("i", None, 43, '{"type":"mapping_update","mapping_version":2}'), ("i", "late", 44, write("late", {"b": "q", "extra": 1})), ("i", None, 50, '{"type":"mapping_update","mapping_version":9}'),
        ("i", "gone", 51, '{"delete":{"id":"gone"}}'), ("i", "cut", 52, write("cut", {})[:-1]), ("j", "only", None, write("only", {"z": True})),
    ]
    maps = [(1, {"a": "keyword", "due": "timestamp", "odd": 7}), (2, {"b": {"field_type": "Keyword"}, "due": {"type": "long"}, "odd": 7}), (4, {"b": {"type": "keyword"}, "odd": 7}), (4, None)]
    meta = spark.createDataFrame([("i", v, T, m and json.dumps(m)) for v, m in maps], META)
    wal = spark.createDataFrame(wal, WAL)
    got = {(r["version"], r["change_kind"], r["field_name"], r["old_name"], r["shown_by"]) for r in sd.all_changes(seg, wal, meta).collect()}
    assert got == {
        (2, "renamed", "b", "a", "documents"), (2, "type_changed", "due", "", "mapping"), (4, "removed", "due", "", "mapping"), (3, "added", "extra", "", "log"), (3, "announced", "", "", "log"), (9, "announced", "", "", "log"),
    }
    table = sd.unify(sd.all_drift(seg, wal, meta))
    rows = {r["document_id"]: r for r in table.where("document_id in ('new', 'late', 'only', 'gone', 'cut')").collect()}
    assert table.count() == 8 + 3 and set(rows) == {"new", "late", "only"}
    assert (rows["new"]["version"], rows["late"]["version"], rows["only"]["version"]) == (2, 3, None)
    assert rows["late"]["f_b"] == "q" and rows["late"]["f_extra"] == 1 and rows["only"]["rest"] == {"z": "true"}
    assert dict(table.dtypes)["f_odd"] == "string" and "f_due" in table.columns and "f_a" not in table.columns


def test_values_of_another_type_are_not_changed(spark):
    sound = [("i", 1, 1, f"s{k}", k, {"n": k, "b": True, "d": 0.5}) for k in range(5)]
    odd = [{"n": 1.5}, {"n": True}, {"n": "7"}, {"b": 7}, {"b": "yes"}, {"d": "0.5"}, {"d": True}, {"d": 2}]
    rows = sound + [("i", 1, 1, f"o{k}", 10 + k, v) for k, v in enumerate(odd)] + [("i", 1, 1, "x", 30, "[1]"), ("i", 1, 1, "y", 31, "not json")]
    got = {r["document_id"]: r for r in sd.unify(sd.drift(docs(spark, rows))).collect()}
    for k, v in enumerate(odd[:-1]):
        r = got[f"o{k}"]
        assert r["strays"] == {name: json.dumps(x) for name, x in v.items()} and [r["f_n"], r["f_b"], r["f_d"]] == [None] * 3
    assert got["o7"]["f_d"] == 2.0 and (got["s3"]["f_n"], got["s3"]["f_b"], got["s3"]["f_d"]) == (3, True, 0.5)
    assert got["x"]["rest"] == {"": "[1]"} and got["y"]["rest"] == {"": "not json"}


def all_changes(spark, old, new, docs_each=3):
    rows = [("i", 1, 1, str(k), k, old(k)) for k in range(docs_each)] + [("i", 2, 2, str(k), 10 + k, new(k)) for k in range(docs_each)]
    found = sd.changes(docs(spark, rows))
    return sorted((r["change_kind"], r["field_name"], r["old_name"]) for r in found.collect()), found


def test_changes_at_any_depth(spark):
    got, _ = all_changes(spark, lambda k: {"a": {"b": {"c": 1, "old": f"v{k}"}}}, lambda k: {"a": {"b": {"c": "s", "new": f"v{k}"}}})
    assert got == [("renamed", "a.b.new", "a.b.old"), ("type_changed", "a.b.c", "")]
    got, _ = all_changes(spark, lambda k: {"o": {"x": k}}, lambda k: {"o": {"y": k}})
    assert got == [("renamed", "o.y", "o.x")]
    deep = lambda leaf: {"l1": {"l2": {"l3": {"l4": {"l5": {"l6": leaf}}}}}}
    got, _ = all_changes(spark, lambda k: deep({"p": k, "q": 1}), lambda k: deep({"r": k, "q": 1.5}))
    path = "l1.l2.l3.l4.l5.l6."
    assert got == [("renamed", path + "r", path + "p"), ("type_changed", path + "q", "")]


def test_renamed_parents_keep_their_fields_changes(spark):
    got, _ = all_changes(spark, lambda k: {"o": {"x": f"x{k}", "y": 1, "z": {"w": k}}, "e": {}}, lambda k: {"e": {}, "o": {"x": f"x{k}", "y": 1, "zz": {"w": k}}})
    assert got == [("renamed", "o.zz", "o.z")]
    # the whole object is equal under another name, and so are the fields in it
    got, _ = all_changes(spark, lambda k: {"o": {"x": f"x{k}", "y": 1}}, lambda k: {"p": {"x": f"x{k}", "y": 1}})
    assert got == [("renamed", "p", "o")]


def test_moves_and_top_level_changes(spark):
    old, new = (lambda k: {"zone": f"z{k}", "meta": {"host": f"h{k}"}, "n": 1}), (lambda k: {"meta": {"area": f"z{k}"}, "host": f"h{k}", "n": 1})
    got, found = all_changes(spark, old, new)
    assert got == [("moved", "host", "meta.host"), ("moved", "meta.area", "zone")]
    top = sorted((r["change_kind"], r["field_name"], r["old_name"]) for r in sd.top_changes(found).collect())
    assert top == [("added", "host", ""), ("removed", "zone", "")]
    # what moves along with its parent is part of its move
    got, _ = all_changes(spark, lambda k: {"o": {"x": k, "y": f"{k}"}, "k": {"a": 1}}, lambda k: {"k": {"a": 1, "o": {"x": k, "y": f"{k}"}}})
    assert got == [("moved", "k.o", "o")]


def test_renames_are_never_displaced_by_moves():
    leaf = lambda n: sd.Node(n, "Keyword")
    old = sd.Node("", "Object", {"a": leaf("a"), "s": sd.Node("s", "Object", {"x": leaf("x")})})
    new = sd.Node("", "Object", {"b": leaf("b"), "s": sd.Node("s", "Object", {"y": leaf("y")})})
    shares = {("a", "b"): 0.5, ("a", ("s", "y")): 1.0, (("s", "x"), "b"): 1.0}
    cost, script = sd.edit_script(old, new, shares)
    assert sorted(x[:3] for x in script) == [("added", "s.y", ""), ("removed", "s.x", ""), ("renamed", "b", "a")] and cost == pytest.approx(1.0 + 2.0)
    cost, script = sd.edit_script(old, new, {("a", ("s", "y")): 1.0, (("s", "x"), "b"): 0.8})
    assert sorted(x[:3] for x in script) == [("moved", "b", "s.x"), ("moved", "s.y", "a")] and cost == pytest.approx(4 - sd.MOVE_SAVES * 1.8)


def test_narrow_join_finds_nested_agreements_too(spark, monkeypatch):
    monkeypatch.setattr(sd, "BROADCAST_ROWS", -1)
    test_changes_at_any_depth(spark)
    test_moves_and_top_level_changes(spark)


def table_of(spark, *versions, docs_each=3):
    """Rows of the unified table of documents that each version writes anew, by (version, id)."""
    rows = [("i", v, v, str(k), 10 * v + k, doc(k)) for v, doc in enumerate(versions, 1) for k in range(docs_each)]
    return {(r["version"], r["document_id"]): r.asDict() for r in sd.unify(sd.drift(docs(spark, rows))).collect()}


def objects(row, *names):
    return [json.loads(row[f"f_{n}"]) if row[f"f_{n}"] is not None else None for n in names]


def test_renames_within_objects_are_projected(spark):
    inner = lambda k, x, p: {x: f"x{k}", "d": {p: k, "q": [{"x": 1}]}}
    got = table_of(spark, lambda k: {"o": inner(k, "x", "p"), "n": 1}, lambda k: {"o": inner(k, "y", "p"), "n": 1}, lambda k: {"oo": inner(k, "y", "p"), "n": 1}, lambda k: {"oo": inner(k, "y", "r"), "n": 1})
    for (_, k), row in got.items():
        assert row["f_n"] == 1 and row["rest"] == {} and row["strays"] == {} and "f_o" not in row
        assert objects(row, "oo") == [inner(int(k), "y", "r")]


def test_moves_are_projected(spark):
    old, new = (lambda k: {"zone": f"z{k}", "meta": {"host": k, "id": 1}, "s": {"rev": k + 5}, "o": {}}), (lambda k: {"meta": {"area": f"z{k}", "id": 1}, "host": k, "s": {}, "o": {"rev": k + 5}})
    got = table_of(spark, old, new)
    for (_, k), row in got.items():
        # what moves to the top gives its column its type, what moves into an object has no column
        assert row["f_host"] == int(k) and "f_zone" not in row and row["rest"] == {}
        assert objects(row, "meta", "s", "o") == [{"area": f"z{k}", "id": 1}, {}, {"rev": int(k) + 5}]
    # moved, then renamed with its new parent, then back out
    steps = (lambda k: {"a": f"v{k}", "p": {"c": 1}}), (lambda k: {"p": {"a": f"v{k}", "c": 1}}), (lambda k: {"q": {"a": f"v{k}", "c": 1}}), (lambda k: {"q": {"c": 1}, "b": f"v{k}"})
    assert {(r["f_b"], r["f_q"], tuple(r["rest"])) for r in table_of(spark, *steps).values()} == {(f"v{k}", '{"c":1}', ()) for k in range(3)}


def test_a_null_under_the_last_name_gives_way(spark):
    got = table_of(spark, lambda k: {"a": f"x{k}", "b": None}, lambda k: {"b": f"x{k}"})
    assert {(r["f_b"], tuple(r["rest"])) for r in got.values()} == {(f"x{k}", ()) for k in range(3)}


def test_a_name_that_passes_on_is_projected(spark):
    got = table_of(spark, lambda k: {"a": f"x{k}", "z": k}, lambda k: {"b": f"x{k}", "z": k}, lambda k: {"b": f"x{k}", "a": k})
    assert {(r["f_b"], r["f_a"]) for r in got.values()} == {(f"x{k}", k) for k in range(3)}


def test_composed_rules_do_both_steps():
    rnd = random.Random(1)
    path = lambda: tuple(rnd.choice("abc") for _ in range(rnd.randint(1, 3)))
    for _ in range(3000):
        step, later = ({path(): new for new in {path() for _ in range(rnd.randint(0, 3))}} for _ in range(2))
        both = sd.compose(step, later)
        for p in itertools.chain(*(itertools.product("abc", repeat=n) for n in range(5))):
            assert sd.place(both, p) == sd.place(later, sd.place(step, p)), (step, later, p)


def projected(spark, rules, *sources):
    """What ``_projected`` makes of the heads of documents, with what it left out of each."""
    names, heads, *more = sd.projection(rules)
    df = spark.createDataFrame([(s if isinstance(s, str) else json.dumps(s), names, heads, *more) for s in sources], f"source string, {sd._PROJECTION}")
    df = df.selectExpr("*", "cast(parse_json(source) as map<string, variant>) as _m")
    return [json.loads(r[0]) for r in df.selectExpr(f"to_json({sd._projected('_m')})").collect()]


def test_fields_that_end_at_one_place_keep_theirs(spark):
    rules = {("o", "x"): ("o", "y"), ("s", "v"): ("o", "v"), ("s",): ("t",)}
    cases = [
        ({"o": {"x": 1, "y": 2}, "s": {"v": 3}}, {"o": {"x": 1, "y": 2, "v": 3}, "t": {}}),
        ({"o": 5, "s": {"v": 3, "w": 4}}, {"o": 5, "s": {"v": 3}, "t": {"w": 4}}),
        ({"o": {"v": {"q": 1}}, "s": {"v": 3}}, {"o": {"v": {"q": 1}}, "s": {"v": 3}, "t": {}}),
        ({"s": {"v": 3, "w": {"k": {}}}, "t": {"w": 1}}, {"s": {"w": {"k": {}}}, "t": {"w": 1}, "o": {"v": 3}}),
        ({"o": {"x": 1, "y": None}, "s": {"v": None}}, {"o": {"y": 1, "v": None}, "t": {}}),
        ({"o": None, "s": {"v": 3}}, {"o": {"v": 3}, "t": {}}), ({"s": []}, {"t": []}), ({"s": "v"}, {"t": "v"}), ({"other": 1}, {}),
    ]
    assert projected(spark, rules, *(c[0] for c in cases)) == [c[1] for c in cases]
    # the name a blocked field keeps blocks the one that would have taken it
    assert projected(spark, {("a",): ("b",), ("z",): ("a",), ("y", "q"): ("a", "q")}, {"a": 1, "b": 2, "z": 3, "y": {"q": 4}}, {"a": 1, "z": 3}) == [{"a": 1, "b": 2, "z": 3, "y": {"q": 4}}, {"b": 1, "a": 3}]
    # names and numbers are kept as they are
    odd = '{"o": {"x\\"{\\u0001": 1.50, "x": 12345678901234567890123456789012, "a.b": {"é": [1e3, {"x": null}]}}}'
    assert projected(spark, {("o", "x"): ("o", "a.b", "x")}, odd) == [{"o": {'x"{\x01': 1.5, "a.b": {"é": [1e3, {"x": None}], "x": 12345678901234567890123456789012}}}]


def test_no_value_is_lost_by_a_projection(spark):
    rnd = random.Random(2)

    def leaves(v):
        return [x for w in v.values() for x in leaves(w)] if isinstance(v, dict) else [v]

    def doc(depth=0):
        return {n: doc(depth + 1) if depth < 3 and rnd.random() < 0.6 else rnd.randint(0, 10**9) for n in rnd.sample("abcd", rnd.randint(1 - (depth > 0), 3))}

    path = lambda: tuple(rnd.choice("abcd") for _ in range(rnd.randint(1, 3)))
    for _ in range(12):
        rules = {}
        while sd.projection(rules)[1] != list("abcd"):
            rules = sd.compose({path(): path() for _ in range(3)}, {path(): path()})
        some = [doc() for _ in range(60)]
        for before, after in zip(some, projected(spark, rules, *some)):
            assert sorted(leaves(before)) == sorted(leaves(after)), (rules, before, after)
