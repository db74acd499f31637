import numpy as np
import pytest

from skerry.llm.bpe import worker_cache
from skerry.llm.splitting import Breaks, cut_all, cut_by_count, split, split_texts
from skerry.llm.tokenize import BYTE_LEVEL_PATTERN

LIMIT, OVERLAP = 64, 16
PROSE = "\n\n".join(" ".join(f"Sentence {i} of part {p} ends here." for i in range(p % 7 + 1)) for p in range(60))
TEXTS = [PROSE, "a" * 3000, "漢字" * 400, "x\n\n" * 900, "😀" * 400, " ".join("word" for _ in range(900)), "=" * 500 + " tail", '{"k":[' + ",".join(map(str, range(900))) + "]}", "\r\n".join(f"line {i} is here" for i in range(200))]


def cut_one(cache, text, limit=LIMIT, overlap=OVERLAP):
    return split_texts(cache, [text], cache.codes([text]), limit, overlap)[0]


def test_pieces_cover_the_text_within_the_limit(vocabulary, public):
    cache = worker_cache(vocabulary, BYTE_LEVEL_PATTERN)
    for text in TEXTS:
        a, z, start, n = cut_one(cache, text)
        assert a[0] == 0 and z[-1] == len(text)
        assert (np.diff(z) > 0).all() and (a[1:] <= z[:-1]).all()
        for x, y in zip(a, z):
            assert len(public(text[x:y])) <= LIMIT, text[:20]
        shared = (start[:-1] + n[:-1] - start[1:])[: len(start) - 1]
        if text is PROSE:
            assert shared.min() >= OVERLAP


def test_natural_breaks_win(vocabulary):
    cache = worker_cache(vocabulary, BYTE_LEVEL_PATTERN)
    a, z, *_ = cut_one(cache, PROSE)
    ends = [PROSE[:e] for e in z[:-1]]
    assert all(e.endswith(("\n\n", ".", "\n")) for e in ends)
    words = " ".join("word" for _ in range(900))
    _, z, *_ = cut_one(cache, words)
    assert all(words[e:e + 1] == " " for e in z[:-1])


def greedy(b, limit, overlap):
    """One cut after another, by the successor table of a single step."""
    step, start = [], []
    [(s, e)] = cut_all([b], limit, overlap)
    return list(zip(s.tolist(), e.tolist())), step, start


def test_doubling_equals_walking(vocabulary):
    cache = worker_cache(vocabulary, BYTE_LEVEL_PATTERN)
    codes = cache.codes(TEXTS)
    breaks = [Breaks(cache, t, c, LIMIT // 8) for t, c in zip(TEXTS, codes)]
    together = cut_all(breaks, LIMIT, OVERLAP)
    for b, (s, e) in zip(breaks, together):
        # every piece starts where the one before it says, and one text alone gives the same cuts
        alone = cut_all([b], LIMIT, OVERLAP)[0]
        assert s.tolist() == alone[0].tolist() and e.tolist() == alone[1].tolist()
        t = b.token
        for i in range(1, len(s)):
            assert s[i] == np.searchsorted(t, t[e[i - 1]] - OVERLAP, "right") - 1 or s[i] == 0
        assert e[-1] == len(t) - 1


def test_frame(spark, vocabulary, public):
    data = [(1, PROSE, 7, "p"), (1, PROSE, 8, "p"), (2, None, 0, "q"), (3, "", 0, "q"), (None, "short", 0, None), (4, " \n ", 1, "r")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, piece int, n_tokens string")
    got = split(df, limit=LIMIT, overlap=OVERLAP).collect()
    short = sorted(((r["doc_id"], r["piece_text"], r["n_pieces"]) for r in got if r["n_pieces"] == 1), key=repr)
    assert short == sorted([(2, None, 1), (3, "", 1), (None, "short", 1), (4, " \n ", 1)], key=repr)
    long = [r for r in got if r["doc_id"] == 1]
    assert len(long) == 2 * long[0]["n_pieces"]
    for r in long:
        assert r["piece_text"] == PROSE[r["char_start"]:r["char_end"]]
        assert len(public(r["piece_text"])) <= LIMIT
    assert split(df.where("false")).collect() == []
    with pytest.raises(ValueError):
        split(df, limit=64, overlap=40)


def test_very_long_text(spark, vocabulary):
    df = spark.createDataFrame([(1, "Some words here. " * 40_000)], "doc_id bigint, text string")
    got = split(df).collect()
    assert max(r["n_tokens"] for r in got) <= 512 and got[0]["n_pieces"] == len(got)


def test_pieces_that_no_table_brings_below_the_limit_are_cut_on(vocabulary, public):
    cache = worker_cache(vocabulary, BYTE_LEVEL_PATTERN)
    for text in TEXTS:
        text = text[:1500]
        got = cut_by_count(cache, text, 0, len(text), 24, 6)
        assert got[0][0] == 0 and got[-1][1] == len(text)
        assert all(k == len(public(text[s:e])) <= 24 for s, e, k in got)
        for (s, e, _), (t, f, _) in zip(got, got[1:]):
            assert s <= t <= e < f and (len(public(text[t:e])) >= 6 or t == e)
