import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skerry.llm.bpe import ByteBpe, PairTable, worker_cache
from skerry.llm.tokenize import BYTE_LEVEL_PATTERN, encode, text_slices

HARD = ["", " ", "a" * 5000, "ab" * 700, "   " * 99, "é" * 300, "漢字" * 100, "\x00\x01", "<|endoftext|>", "it's  I'LL don't\r\n\r\n x", "😀" * 200, " " * 70 + "a", "x" * 65]


def ids_of(vocabulary, texts):
    cache = worker_cache(vocabulary, BYTE_LEVEL_PATTERN)
    return [cache.token_ids(c).tolist() for c in cache.codes(texts)]


def test_equals_the_public_library(vocabulary, public):
    rnd = random.Random(5)
    texts = HARD + ["".join(chr(rnd.randint(1, 0x2FFF)) for _ in range(rnd.randint(1, 200))) for _ in range(50)] + ["".join(rnd.choice("abcdefghij") for _ in range(3000))]
    assert ids_of(vocabulary, texts) == [public(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    import os

    from skerry.llm.tokenize import vocabulary_path

    path = vocabulary_path()
    if not os.path.exists(path):
        return
    ids = ids_of(path, [text])[0]
    cache = worker_cache(path, BYTE_LEVEL_PATTERN)
    token = {i: t for t, i in cache.bpe.ranks.items()}
    assert b"".join(token[i] for i in ids) == text.encode("utf-8", "surrogatepass")


def test_pair_table_keeps_colliding_keys():
    rnd = np.random.default_rng(2)
    left, right = rnd.integers(0, 300, 4000), rnd.integers(0, 300, 4000)
    keep = np.unique(left * 1000 + right, return_index=True)[1]
    left, right = left[keep], right[keep]
    table = PairTable(left, right, np.arange(len(left), dtype=np.int32))
    assert (table.find(left.astype(np.int32), right.astype(np.int32)) == np.arange(len(left))).all()
    assert (table.find(np.array([-1, 5000]), np.array([3, 3])) == 2**31 - 1).all()


def test_cache_is_emptied_but_results_stay(vocabulary, public):
    from skerry.llm.bpe import WordCache

    cache = WordCache(ByteBpe.load(vocabulary, BYTE_LEVEL_PATTERN), max_words=5)
    for text in ["one two three four five six seven", "seven eight nine", "one"]:
        assert cache.token_ids(cache.codes([text])[0]).tolist() == public(text)
        cache.release()
    assert len(cache.code) <= 12


def test_slices_cover_everything():
    texts = ["a" * 10, None, "", "b" * 100, "c"]
    got = list(text_slices(texts, 20))
    assert [i for lo, hi in got for i in range(lo, hi)] == list(range(5))


def test_frame(spark, vocabulary, public):
    data = [(1, "hello world", "x"), (1, "hello world", "y"), (2, None, "z"), (3, "", None), (None, " hi", "q"), (4, "long " * 30_000, "r")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, k string")
    got = sorted(((r["doc_id"], r["ids"]) for r in encode(df).collect()), key=repr)
    assert got == sorted([(d, public(t) if t else []) for d, t, _ in data], key=repr)
    assert encode(df).columns == ["doc_id", "ids"]
    assert encode(df.where("false")).collect() == []


def test_long_rows_of_a_vocabulary_whose_tokens_do_not_encode_to_themselves(vocabulary):
    """"abcd" can't be made of its parts, so the shortcut for long rows isn't taken; single merges give the right ids."""
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"bc": 299, b"abcd": 301, b"aa": 302, b"aaa": 298}
    bpe, word = ByteBpe(ranks, r"\S+"), "aaabcaab" * 20 + "abcd" * 10
    assert not bpe.closed and ByteBpe.load(vocabulary, BYTE_LEVEL_PATTERN).closed
    parts = [bytes([b]) for b in word.encode()]
    while True:
        best = min((ranks.get(a + b, 10**9), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best[0] == 10**9:
            break
        parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    assert bpe.encode_words([word]) == [tuple(ranks[p] for p in parts)]
