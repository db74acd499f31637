import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skerry.operators.incremental import DONE, LEASED, PENDING, Ledger, StaleToken, next_run, run_states, unprocessed

WAL = "index_name string, generation bigint, sequence_number bigint, received_at timestamp, record string"
RUN = "run_id bigint, index_name string, generation bigint, started_at timestamp, status string, last_sequence_number bigint"
T0 = datetime(2026, 3, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


def brute(wal, runs):
    by_run = {}
    for r in runs:
        by_run.setdefault(r[0], []).append(r)
    done = []
    for rs in by_run.values():
        status = [(x[4] or "").lower() for x in rs]
        numbers = [x[5] for x in rs if (x[4] or "").lower() == "committed" and x[5] is not None]
        if "committed" in status and "rolled_back" not in status and numbers:
            done.append((rs[0][1], rs[0][2], rs[0][3], max(numbers)))
    seen = {}
    for i, g, s, t, rec in wal:
        if rec == "{}" and i is not None and s is not None:
            hit = any(i == a and g == b and t is not None and start >= t and n >= s for a, b, start, n in done)
            seen[(i, s)] = seen.get((i, s), False) or hit
    return {k for k, v in seen.items() if not v}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("slice_seconds", [3600, 10**9])
def test_equals_brute_force(spark, seed, slice_seconds):
    rnd = random.Random(seed)
    wal = [(rnd.choice("ij"), rnd.choice([1, 2]), rnd.randint(1, 60), at(rnd.randint(0, 20) / 2), rnd.choice(["{}", "{}", "{}", "{", None])) for _ in range(250)]
    runs = []
    for k in range(14):
        head = (k, rnd.choice("ij"), rnd.choice([1, 2]), at(rnd.randint(0, 20) / 2))
        for _ in range(rnd.choice([1, 1, 2, 3])):
            runs.append((*head, rnd.choice(["committed", "COMMITTED", "running", "failed", "rolled_back", "Rolled_Back", None]), rnd.choice([None, rnd.randint(1, 60)])))
    got = unprocessed(spark.createDataFrame(wal, WAL), run_states(spark.createDataFrame(runs, RUN)), slice_seconds)
    assert {(r["index_name"], r["sequence_number"]) for r in got.collect()} == brute(wal, runs)


@pytest.mark.parametrize("slice_rows", [1, 7])
def test_large_slices_and_untimed_rows_are_spread(spark, slice_rows):
    """A third of the rows at one time, a third without a time: parts of a slice have all its runs."""
    rnd = random.Random(11)
    wal = [("i", 1, k, rnd.choice([at(5), None, at(rnd.randint(0, 20) / 2)]), "{}") for k in range(1, 121)] + [("i", None, 200, at(5), "{}")]
    runs = [(k, "i", 1, at(h), "committed", n) for k, (h, n) in enumerate([(4, 110), (5, 60), (7, 30), (9.5, 10)])]
    got = unprocessed(spark.createDataFrame(wal, WAL), run_states(spark.createDataFrame(runs, RUN)), slice_rows=slice_rows)
    assert {(r["index_name"], r["sequence_number"]) for r in got.collect()} == brute(wal, runs)


def test_nulls_ties_and_clashing_columns(spark):
    wal = [("i", 1, 5, at(1), "{}"), ("i", 1, 5, at(9), "{}"), ("i", 1, 6, None, "{}"), (None, 1, 7, at(1), "{}"), ("i", None, 8, at(1), "{}"), ("i", 1, None, at(1), "{}"), ("i", 1, 9, at(2), "{}")]
    runs = [(1, "i", 1, at(1), "committed", 5), (2, "i", 1, at(2), "Committed", 9), (None, "i", 1, at(3), "committed", 99), (3, "i", 1, at(3), "committed", None), (4, "i", None, at(5), "committed", 99)]
    frame = spark.createDataFrame(wal, WAL).selectExpr("*", "1 as slice", "2 as reach", "3 as kind", "4 as seq", "5 as at")
    journal = spark.createDataFrame(runs, RUN).selectExpr("*", "1 as state", "2 as committed")
    got = unprocessed(frame, run_states(journal))
    assert {r["sequence_number"] for r in got.collect()} == {6, 8}
    assert unprocessed(frame.where("false"), run_states(journal)).collect() == []
    assert {r["sequence_number"] for r in unprocessed(frame, run_states(journal.where("false"))).collect()} == {5, 6, 8, 9}


def test_states_and_leases(spark):
    runs = [(1, "i", 1, at(0), "running", None), (1, "i", 1, at(0), "committed", 4), (2, "i", 1, at(1), "committed", 9), (2, "i", 1, at(1), "rolled_back", 9), (3, "i", 1, at(2), "running", None), (4, "i", 1, at(2), "failed", 7), (5, "i", 1, at(2), None, 7)]
    df = spark.createDataFrame(runs, RUN)
    state = lambda now: {r["run_id"]: r["state"] for r in run_states(df, now).collect()}
    assert state(None) == {1: DONE, 2: PENDING, 3: LEASED, 4: PENDING, 5: PENDING}
    assert state(F.lit(at(4)).cast("timestamp"))[3] == PENDING
    assert state(F.lit(at(2.5)).cast("timestamp"))[3] == LEASED


def test_items_are_named_by_their_entries(spark):
    wal = [("i", 1, s, at(1), "{}") for s in (1, 9_999, 10_000, 25_000)]
    frame, none = spark.createDataFrame(wal, WAL), spark.createDataFrame([], RUN)
    first = {(r["sequence_number"], r["item"]) for r in next_run(frame, none).collect()}
    assert first == {(r["sequence_number"], r["item"]) for r in next_run(frame, none).collect()}
    assert len({i for _, i in first}) == 3


def test_ledger(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", lease_seconds=10)
    assert ledger.add(["x", "y"]) == 2 and ledger.add(["x"]) == 0
    a = ledger.lease("x", "a", now=0)
    assert a.token == 1 and ledger.lease("x", "b", now=5) is None and ledger.state("x", 5)[0] == LEASED
    # the lease runs out, another worker takes the item, and the first one is refused
    b = ledger.lease("x", "b", now=11)
    assert b.token > a.token
    with pytest.raises(StaleToken):
        ledger.complete(a)
    ledger.complete(b)
    ledger.complete(b)
    assert ledger.state("x", 99) [0] == DONE and ledger.lease("x", "c", now=99) is None
    with pytest.raises(StaleToken):
        ledger.complete(a)
    with pytest.raises(KeyError):
        ledger.state("never", 0)


def test_run_survives_failures(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", lease_seconds=10)
    done, fail = [], {"b"}

    def work(item, path):
        if item in fail:
            fail.clear()
            raise OSError("lost")
        spark.createDataFrame([(item,)], "item string").write.mode("overwrite").parquet(path)
        done.append(item)

    with pytest.raises(OSError):
        ledger.run(["a", "b", "c"], work, "w", lambda: 0)
    assert ledger.run(["a", "b", "c"], work, "w", lambda: 1) == ["b", "c"]
    assert done == ["a", "b", "c"] and ledger.run(["a", "b", "c"], work, "w", lambda: 2) == []
    assert [r["item"] for r in spark.read.parquet(ledger.output_path("b")).collect()] == ["b"]


def test_late_entries_of_a_done_stretch_are_taken_once(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", lease_seconds=10)
    none, taken = spark.createDataFrame([], RUN), []

    def round_of(wal, now, fail=()):
        entries = next_run(spark.createDataFrame(wal, WAL), none, ledger=ledger).collect()
        held = {}
        for r in entries:
            held.setdefault(r["item"], []).append(r["sequence_number"])

        def work(item, path):
            if fail and set(fail) & set(held[item]):
                raise OSError("lost")
            taken.extend(held[item])

        ledger.run(sorted(held), work, "w", lambda: now)
        return held

    wal = [("i/j", 1, s, at(1), "{}") for s in (1, 2, 5, 20_000)]
    assert len(round_of(wal, 0)) == 2 and sorted(taken) == [1, 2, 5, 20_000]
    # new and late entries of a stretch that is done, and a late copy of a done entry in another generation
    wal += [("i/j", 1, 6, at(2), "{}"), ("i/j", 1, 3, at(2), "{}"), ("i/j", 2, 5, at(3), "{}")]
    with pytest.raises(OSError):
        round_of(wal, 1, fail=[3])
    # the failed item keeps its entries; what came since is an item of its own
    wal += [("i/j", 2, 4, at(4), "{}"), ("i/j", 2, 3, at(4), "{}")]
    assert sorted(map(sorted, round_of(wal, 2).values())) == [[3, 6], [4]]
    assert sorted(taken) == [1, 2, 3, 4, 5, 6, 20_000]
    assert round_of(wal, 3) == {} and ledger.planned().count() == 7


def test_of_two_plans_at_a_time_one_is_made_again(spark, tmp_path, monkeypatch):
    ledger, other = (Ledger(spark, f"file://{tmp_path}/ledger") for _ in "ab")
    frame = spark.createDataFrame([("i", 1), ("i", 2)], "index_name string, sequence_number bigint")
    create, first = ledger._create, []

    def slow(*a):
        if not first:
            first.append(other.plan(frame).collect())
        return create(*a)

    monkeypatch.setattr(ledger, "_create", slow)
    assert sorted(ledger.plan(frame).collect()) == sorted(first[0]) and ledger.planned().count() == 2


def held(df):
    return sorted(r["sequence_number"] for r in df.collect())


def test_leases_hold_entries_until_they_expire(spark, tmp_path):
    """A run that is still going holds what had arrived; once its lease is over the entries are open again."""
    wal = spark.createDataFrame([("i", 1, s, at(h), "{}") for s, h in ((1, 0), (2, 1), (3, 9), (4, 1))] + [("j", 1, 7, at(0), "{}")], WAL)
    runs = spark.createDataFrame([(1, "i", 1, at(0.5), "committed", 1), (2, "i", 1, at(2), "running", None), (3, "j", 1, at(2), "running", None), (3, "j", 1, at(2), "failed", None)], RUN)
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    ledger.adopt(runs)
    live, over = (F.lit(at(h)).cast("timestamp") for h in (2.5, 3.5))
    assert held(ledger.open(wal, live)) == [3, 7]
    assert held(ledger.open(wal, over)) == [2, 3, 4, 7] == held(ledger.open(wal))
    # the run ends well after all: the journal is taken over again and its entries are done
    ledger.adopt(runs.unionByName(spark.createDataFrame([(2, "i", 1, at(2), "committed", 2)], RUN)))
    assert held(ledger.open(wal, over)) == [3, 4, 7]


def test_leases_of_planned_items(spark, tmp_path):
    ledger, now = Ledger(spark, f"file://{tmp_path}/ledger", lease_seconds=10), lambda s: F.lit(s).cast("timestamp")
    wal = spark.createDataFrame([("i", 1, s, at(1), "{}") for s in (1, 2, 20_000)], WAL)
    items = sorted({r["item"] for r in ledger.open(wal).collect()})
    ledger.add(items)
    lease = ledger.lease(items[0], "a", now=100)
    assert held(ledger.open(wal, now(105))) == [20_000] and held(ledger.open(wal, now(111))) == [1, 2, 20_000]
    assert {r["item"]: (r["state"], r["token"]) for r in ledger.states(105.0).collect()} == {items[0]: (LEASED, 1), items[1]: (PENDING, 0)}
    ledger.complete(lease)
    assert held(ledger.open(wal, now(105))) == [20_000] == held(ledger.open(wal))


def test_crash_between_output_and_completion(spark, tmp_path):
    """The output is there but the item isn't done: it is done again over the same path, and the dead worker can't complete it."""
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", lease_seconds=10)
    write = lambda path: spark.createDataFrame([(1,)], "n int").write.mode("overwrite").parquet(path)
    ledger.add(["x"])
    dead = ledger.lease("x", "dead", now=0)
    write(ledger.output_path("x"))
    assert ledger.run(["x"], lambda item, path: write(path), "w", lambda: 5) == []
    assert ledger.run(["x"], lambda item, path: write(path), "w", lambda: 11) == ["x"]
    with pytest.raises(StaleToken):
        ledger.complete(dead)
    assert spark.read.parquet(ledger.output_path("x")).count() == 1
