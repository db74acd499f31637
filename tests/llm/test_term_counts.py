import random
from collections import Counter

import pyarrow as pa
import pytest

from skerry.llm import term_counts as tc


def brute(occurrences, max_n):
    """n-gram -> (occurrences, records) per group, from distinct (record, section, place, term)."""
    seqs = {}
    for g, r, s, p, t in sorted(set(occurrences), key=repr):
        seqs.setdefault((g, r, s), []).append((p, t))
    count, records = Counter(), {}
    for (g, r, s), xs in seqs.items():
        ts = [t for _, t in sorted(xs)]
        for i in range(len(ts)):
            for n in range(1, max_n + 1):
                if i + n <= len(ts):
                    gram = (g, *ts[i:i + n])
                    count[gram] += 1
                    records.setdefault(gram, set()).add(r)
    return {k: (count[k], len(records[k])) for k in count}


@pytest.mark.parametrize("max_n", [1, 2, 3])
def test_counts_equal_brute_force(spark, max_n):
    rnd = random.Random(max_n)
    occ = [(rnd.choice(["i", "j"]), rnd.randint(1, 9), rnd.choice("fg"), rnd.randint(0, 40), rnd.choice(["a", "b", "c", "é", "b c"])) for _ in range(1500)]
    occ = list({(g, r, s, p): (g, r, s, p, t) for g, r, s, p, t in occ}.values())
    df = spark.createDataFrame(occ + occ[:200], "g string, r bigint, s string, p int, t string").select("g", "r", "s", "p", "t")
    got = {(x["g"], *[x[f"t{j}"] for j in range(1, x["n"] + 1)]): (x["occurrences"], x["records"]) for x in tc.ngram_counts(df, max_n).collect()}
    assert got == brute(occ, max_n)


def test_hot_terms_are_salted_and_added_up(spark):
    occ = [("i", r % 97, "f", r, "hot" if r % 3 else f"w{r}") for r in range(3000)]
    df = spark.createDataFrame(occ, "g string, r bigint, s string, p int, t string")
    assert len(tc.hot_starts(tc.suffixes(df, 1))) == 1
    got = {(x["g"], *[x[f"t{j}"] for j in range(1, x["n"] + 1)]): (x["occurrences"], x["records"]) for x in tc.ngram_counts(df, 2).collect()}
    assert got == brute(occ, 2)


def test_stack_over_small_batches():
    """Runs that go on over many batches give the same as one batch."""
    rnd = random.Random(3)
    rows = sorted({(rnd.choice("gh"), rnd.choice("abc"), rnd.choice("xy"), rnd.randint(1, 5), "s", rnd.randint(0, 9)) for _ in range(400)})
    rows.sort(key=lambda x: (x[0], [-ord(c) for c in x[1] + x[2]], x[3], x[4], x[5]))
    names = ["g", "t1", "t2", "r", "s", "p"]
    schema = pa.schema([("g", pa.string()), ("t1", pa.string()), ("t2", pa.string()), ("n", pa.int32()), ("occurrences", pa.int64()), ("records", pa.int64())])

    def run(size):
        stack, out = tc.PrefixStack(2), []
        for i in range(0, len(rows), size):
            stack.feed(pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i:i + size])], names))
            out += [x for b in stack.take(schema) for x in b.to_pylist()]
        stack.close()
        return sorted(map(repr, out + [x for b in stack.take(schema) for x in b.to_pylist()]))

    assert run(1) == run(7) == run(10_000)


def test_dirty_postings(spark):
    data = [
        ("i", "f", " Merge ", 1, [3, 3, 9]), ("i", "f", "merge", 1, [9]), ("i", "h", "MERGE", 1, [9]), ("i", "f", "ÉA", 2, [1]),
        ("i", "f", None, 2, [1]), ("i", "f", "x", None, [1]), ("i", "f", "lone", 3, []), ("i", "f", "lone", 4, None), (None, "f", "merge", 7, [1]), ("i", None, "merge", 5, [None, 2]),
    ]
    df = spark.createDataFrame(data, "index_name string, field string, term string, doc_id bigint, positions array<int>").selectExpr("*", "1 as g", "'q' as t1")
    occ = tc.posting_occurrences(df)
    got = {(r["g"], r["t1"]): (r["occurrences"], r["records"]) for r in tc.ngram_counts(occ).collect()}
    assert got == {("i", "merge"): (4, 2), ("i", "Éa"): (1, 1), ("i", "lone"): (0, 2), (None, "merge"): (1, 1)}
    assert {(r["g"], r["total"]) for r in tc.group_sizes(occ).collect()} == {("i", 5), (None, 1)}
    assert tc.ngram_counts(occ.where("false")).collect() == []


def test_bands(spark):
    counts = spark.createDataFrame([("i", "a", 2), ("i", "b", 3), ("i", "c", 6), ("i", "d", 7), (None, "e", 4)], "g string, t1 string, records bigint")
    sizes = spark.createDataFrame([("i", 10), (None, 4)], "g string, total bigint")
    got = {r["t1"]: r["band"] for r in tc.with_bands(counts, sizes).collect()}
    assert got == {"a": "rare", "b": "useful", "c": "useful", "d": "common", "e": "common"}


def test_texts(spark):
    df = spark.createDataFrame([(1, "The  merge\nThe"), (2, None), (3, ""), (None, "x")], "doc_id bigint, text string")
    got = {(r["t1"], r["t2"]): (r["occurrences"], r["records"]) for r in tc.count_suffixes(tc.text_suffixes(df, "doc_id", "text", 2), 2).collect()}
    assert got == {("the", None): (2, 1), ("merge", None): (1, 1), ("the", "merge"): (1, 1), ("merge", "the"): (1, 1)}
