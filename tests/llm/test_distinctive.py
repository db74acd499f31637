import random

import numpy as np
import pytest

from skerry.llm import distinctive, term_counts


def plain_em(tf, background, share, rounds):
    p = [x / sum(tf) for x in tf]
    for _ in range(rounds):
        e = [t * share * q / ((1 - share) * b + share * q) for t, q, b in zip(tf, p, background)]
        p = [x / sum(e) for x in e]
    return p


def postings(seed=1, records=12):
    rnd = random.Random(seed)
    rows = []
    for r in range(records):
        for t in ["the", "of", "merge", "lease", f"own{r}", f"rare{r % 3}"]:
            n = rnd.randint(1, 6) if t.startswith("own") else rnd.randint(0, 4)
            if n:
                rows.append(("i", "f", t, r, list(range(n))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "index_name string, field string, term string, doc_id bigint, positions array<int>")


def fixed_point(tf, rest):
    """Where EM ends, by sorting: the terms with a probability are those of the highest tf / rest."""
    order = sorted(range(len(tf)), key=lambda i: -tf[i] / rest[i])
    for k in range(len(tf), 0, -1):
        m = sum(tf[i] for i in order[:k]) / (1 + sum(rest[i] for i in order[:k]))
        if tf[order[k - 1]] > rest[order[k - 1]] * m:
            return [max(0.0, t / m - x) if i in order[:k] else 0.0 for i, (t, x) in enumerate(zip(tf, rest))]


def test_plain_rounds():
    tf, b, n, start = np.array([3, 1, 2, 5, 1]), np.array([0.2, 0.5, 0.1, 0.01, 0.4]), np.array([1, 1, 1, 1, 1]), np.array([0, 3])
    got = distinctive.expectation_maximisation(tf, b, n, start, rounds=50)
    assert got == pytest.approx(plain_em([3, 1, 2], [0.2, 0.5, 0.1], 0.3, 50) + plain_em([5, 1], [0.01, 0.4], 0.3, 50), abs=1e-9)


@pytest.mark.parametrize("seed", range(5))
def test_em_ends_at_its_fixed_point(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 40, 30)
    start = np.cumsum(sizes) - sizes
    tf, n = rng.integers(1, 30, sizes.sum()), rng.integers(1, 4, sizes.sum())
    background, share = rng.random(sizes.sum()) ** 3 / 10 + 1e-9, rng.uniform(0.05, 0.95, 30)
    got = distinctive.expectation_maximisation(tf, background, n, start, share)
    for k, (lo, size) in enumerate(zip(start, sizes)):
        part = slice(lo, lo + size)
        each = np.repeat(np.arange(size), n[part])
        c = (1 - share[k]) / share[k]
        want = fixed_point(tf[part][each].tolist(), (c * background[part][each]).tolist())
        assert np.allclose(got[part][each], want, atol=1e-10)
        # a record's result doesn't depend on which others share its block
        alone = distinctive.expectation_maximisation(tf[part], background[part], n[part], np.array([0]), share[k])
        assert (alone == got[part]).all()
    # many plain rounds come near it
    slow = distinctive.expectation_maximisation(tf, background, n, start, share, rounds=20_000)
    assert np.abs(slow - got).max() < 1e-3


def test_scores_equal_the_fixed_point_by_record(spark):
    rows = postings()
    stats = distinctive.term_statistics(term_counts.posting_occurrences(frame(spark, rows)))
    got = {(r["r"], r["t"]): r for r in distinctive.scores(stats).collect()}
    df = {}
    for r in rows:
        df[r[2]] = df.get(r[2], 0) + 1
    assert len(got) == len(rows)
    for record in {r[3] for r in rows}:
        own = [r for r in rows if r[3] == record]
        c = min((1 - distinctive.OWN_SHARE) / distinctive.OWN_SHARE, distinctive.KEPT * len(rows) / sum(len(r[4]) for r in own))
        want = fixed_point([len(r[4]) for r in own], [c * df[r[2]] / len(rows) for r in own])
        for r, w in zip(own, want):
            x = got[(record, r[2])]
            assert x["score"] == pytest.approx(w, abs=1e-7) and x["tf"] == len(r[4]) and x["df"] == df[r[2]]


def test_partitions_do_not_matter(spark):
    stats = distinctive.term_statistics(term_counts.posting_occurrences(frame(spark, postings(3, 60)))).persist()
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(tuple(r) for r in distinctive.scores(stats).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def test_terms_above_the_bound_keep_a_probability(spark):
    """In groups so small that a record is much of the group's model too."""
    rnd, rows = random.Random(8), []
    for g in range(12):
        for r in range(rnd.randint(1, 13)):
            rows += [(f"g{g}", "f", t, r, list(range(rnd.choice([1, 4, 5, 90])))) for t in ("a", "b", "c", f"o{r % 5}") if rnd.random() < 0.8]
    got = distinctive.scores(distinctive.term_statistics(term_counts.posting_occurrences(frame(spark, rows)))).toPandas()
    assert (got[got["tf"] > distinctive.KEPT * got["df"]]["score"] > 0).all() and (got["score"] == 0).any()


def test_converged_model_prefers_own_terms(spark):
    stats = distinctive.term_statistics(term_counts.posting_occurrences(frame(spark, postings(4))))
    got = distinctive.scores(stats).toPandas()
    sums = got.groupby("r")["score"].sum()
    assert np.allclose(sums, 1)
    own = got[got["t"].str.startswith("own")]["score"].mean()
    assert own > 2 * got[got["t"].isin(["the", "of"])]["score"].mean()


def test_blocks_do_not_matter(spark, monkeypatch):
    """Records split over blocks are held together."""
    stats = distinctive.term_statistics(term_counts.posting_occurrences(frame(spark, postings(2, 40)))).coalesce(1)
    want = sorted(tuple(r) for r in distinctive.scores(stats).collect())
    monkeypatch.setattr(distinctive, "BLOCK", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = sorted(tuple(r) for r in distinctive.scores(stats).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [x[:-1] for x in got] == [x[:-1] for x in want]
    assert np.allclose([x[-1] for x in got], [x[-1] for x in want])


def test_dirty_rows(spark):
    rows = [("i", "f", "a", 1, None), ("i", None, "a", 1, [1, None]), (None, "f", "b", 2, [1]), ("i", "f", None, 1, [1]), ("i", "f", "c", None, [1]), ("i", "f", "a", 1, [1, 1])]
    df = frame(spark, rows + rows).selectExpr("*", "0 as tf", "0 as df", "'x' as g")
    stats = distinctive.term_statistics(term_counts.posting_occurrences(df))
    got = {(r["g"], r["r"], r["t"]): (r["tf"], r["df"], r["score"]) for r in distinctive.scores(stats).collect()}
    assert {k: v[:2] for k, v in got.items()} == {("i", 1, "a"): (2, 1), (None, 2, "b"): (1, 1)}
    assert distinctive.scores(stats.where("false")).collect() == []
