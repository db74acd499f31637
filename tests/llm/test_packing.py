import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skerry.llm.packing import first_fit_decreasing, pack


def plain_ffd(sizes, capacity):
    bins, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        for b, used in enumerate(bins):
            if used + sizes[i] <= capacity:
                bins[b] += sizes[i]
                out[i] = b
                break
        else:
            bins.append(sizes[i])
            out[i] = len(bins) - 1
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 20), min_size=1, max_size=60))
def test_tree_is_first_fit_decreasing(sizes):
    assert first_fit_decreasing(np.array(sizes, np.int64), 20).tolist() == plain_ffd(sizes, 20)


def test_frame(spark, vocabulary, public):
    texts = [f"text number {i} " * (i % 40) for i in range(300)] + [None, "", "word " * 700, "word " * 700]
    data = [(i // 2, t, 1, 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, g int, container int")
    got = pack(df, capacity=256, group_rows=64).collect()
    assert {r["doc_id"] for r in got} == {d[0] for d in data}
    load = {}
    for r in got:
        load[r["container"]] = load.get(r["container"], 0) + r["n_tokens"]
    assert max(load.values()) <= 256
    sizes = [len(public(t)) if t else 0 for t in texts]
    assert sum(load.values()) == sum(sizes)
    # each row is there with all its tokens, and only those above the capacity are divided
    assert len(got) == sum(max(1, -(-s // 256)) for s in sizes)
    assert all(r["token_start"] == 256 * r["piece"] for r in got)
    filled = sum(load.values()) / (256 * sum(v > 0 for v in load.values()))
    assert filled > 0.93


def test_edges(spark, vocabulary):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert pack(empty).collect() == []
    one = spark.createDataFrame([(None, "hello"), (None, "hello")], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["piece"], r["n_tokens"]) for r in pack(one).collect()) == [(None, 0, 1), (None, 0, 1)]
    with pytest.raises(ValueError):
        pack(one, capacity=0)


def test_same_result_again(spark, vocabulary):
    df = spark.createDataFrame([(i, "a b c " * (i % 30)) for i in range(200)], "doc_id bigint, text string").repartition(3, "doc_id")
    assert sorted(map(tuple, pack(df, capacity=64, group_rows=50).collect())) == sorted(map(tuple, pack(df, capacity=64, group_rows=50).collect()))
