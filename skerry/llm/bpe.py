"""Byte-level BPE over numpy matrices, for a public vocabulary given as ranks.

A text is cut into words by the vocabulary's pattern. Each distinct word is
encoded once per worker: the words of a batch are grouped by length into padded
matrices of symbol ids, and in each round every row merges its leftmost pair of
minimum rank; pairs are looked up in an open-addressing table, rows shrink by
compaction, and finished rows leave the matrix.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

NONE = np.int32(2**31 - 1)
#: Rows of more symbols than this merge, in a round, every occurrence of their minimum pair that the leftmost-first
#: order would reach before any other pair. A merged symbol has a higher rank than its parts, so no pair that such a
#: merge creates can come before the remaining occurrences, and the result is the same. That holds
#: where every token encodes to itself, which is checked; with another kind of vocabulary all rows merge one pair a round.
LONG_ROW = 64


class PairTable:
    """(left, right) -> merged id, by open addressing with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(len(left), 1) * 2.5))))
        self.shift = np.uint64(64 - bits)
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 1
        while len(todo):
            at = slot[todo]
            free = self.keys[at] == -1
            # of the keys that want one free slot, the first takes it
            _, first = np.unique(at[free], return_index=True)
            won = todo[free][first]
            self.keys[slot[won]] = keys[won]
            self.values[slot[won]] = merged[won]
            rest = np.ones(len(todo), bool)
            rest[np.flatnonzero(free)[first]] = False
            todo = todo[rest]
            if len(todo):
                slot[todo] = (slot[todo] + 1) & self.mask
                self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where no merge exists (or a side is negative)."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(keys.shape, NONE, np.int32)
        flat, res = keys.ravel(), out.ravel()
        live = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(flat[live])
        while len(live):
            seen = self.keys[slot]
            hit = seen == flat[live]
            res[live[hit]] = self.values[slot[hit]]
            go = ~hit & (seen != -1)
            live, slot = live[go], (slot[go] + 1) & self.mask
        return res.reshape(keys.shape)


class ByteBpe:
    """A vocabulary and its encoder; ``encode_words`` is exact for any bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.find_words = regex.compile(pattern).findall
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.ranks = ranks
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int32))
        self._closed: bool | None = None
        self.token_bytes_len = np.zeros(max(ranks.values()) + 1, np.int32)
        for token, rank in ranks.items():
            self.token_bytes_len[rank] = len(token)

    @staticmethod
    def load(path: str, pattern: str) -> "ByteBpe":
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return ByteBpe(ranks, pattern)

    @property
    def closed(self) -> bool:
        """Whether every token encodes to itself. Found out, by single merges, when the first row above ``LONG_ROW`` comes."""
        if self._closed is None:
            self._closed = False  # so that these rows merge one pair a round
            raw, alone = list(self.ranks), list(self.ranks.values())
            self._closed = self._encode_raw(raw) == [(i,) for i in alone]
        return self._closed

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word, which must be one match of the pattern."""
        return self._encode_raw([w.encode("utf-8", "surrogatepass") for w in words])

    def _encode_raw(self, raw: list[bytes]) -> list[tuple[int, ...]]:
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list[tuple[int, ...]] = [()] * len(raw)
        # buckets of lengths that differ by at most a quarter bound the padding
        bucket = np.where(lengths <= 16, lengths, np.ceil(np.log(np.maximum(lengths, 1)) / np.log(1.25)).astype(np.int64) + 100)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for group in np.split(order, cuts):
            width = int(lengths[group].max()) if len(group) else 0
            rows = max(1, 4_000_000 // max(width, 1))
            for at in range(0, len(group), rows):
                part = group[at:at + rows]
                for i, ids in zip(part, self._encode_matrix([raw[i] for i in part], width)):
                    out[i] = ids
        return out

    def _encode_matrix(self, raw: list[bytes], width: int) -> list[tuple[int, ...]]:
        if width == 0:
            return [()] * len(raw)
        buffer = np.frombuffer(b"".join(raw), np.uint8)
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        m = np.full((len(raw), width), -1, np.int32)
        m[np.arange(width) < n[:, None]] = self.byte_id[buffer]
        out: list = [None] * len(raw)
        row_of = np.arange(len(raw))
        rank = self.pairs.find(m[:, :-1], m[:, 1:]) if width > 1 else np.zeros((len(raw), 0), np.int32)
        while True:
            best = rank.min(axis=1) if rank.shape[1] else np.full(len(m), NONE)
            done = best == NONE
            if done.any():
                for r, ids, k in zip(row_of[done], m[done].tolist(), n[done].tolist()):
                    out[r] = tuple(ids[:k])
                keep = ~done
                m, rank, n, row_of, best = m[keep], rank[keep], n[keep], row_of[keep], best[keep]
            if not len(m):
                return out
            if m.shape[1] > LONG_ROW and self.closed:
                m, n = self._merge_all(m, n, rank, best)
                rank = self.pairs.find(m[:, :-1], m[:, 1:])
            else:
                m, rank, n = self._merge_one(m, n, rank, best)

    def _merge_one(self, m, n, rank, best):
        """Each row merges its leftmost pair of minimum rank; columns after it move left by one."""
        rows, last = np.arange(len(m)), m.shape[1] - 1
        at = rank.argmin(axis=1)
        cols = np.arange(last)
        shifted = cols > at[:, None]
        m2 = np.where(shifted, m[:, 1:], m[:, :-1])
        m2[rows, at] = best
        if last == 1:
            return m2, np.zeros((len(m2), 0), np.int32), n - 1
        rank2 = np.where(cols[:-1] > at[:, None], rank[:, 1:], rank[:, :-1])
        # only the pairs beside the merged symbol are new
        before, after = at > 0, at < last - 1
        b, a = rows[before], rows[after]
        rank2[b, at[b] - 1] = self.pairs.find(m2[b, at[b] - 1], m2[b, at[b]])
        rank2[a, at[a]] = self.pairs.find(m2[a, at[a]], m2[a, at[a] + 1])
        return m2, rank2, n - 1

    def _merge_all(self, m, n, rank, best):
        """Each row merges, left to right, the occurrences of the pair that is its leftmost of minimum rank."""
        rows = np.arange(len(m))
        at = rank.argmin(axis=1)
        a, b = m[rows, at], m[rows, at + 1]
        hit = (m[:, :-1] == a[:, None]) & (m[:, 1:] == b[:, None])
        if (same := a == b).any():  # in a run x x x ... only every other place can merge
            sub = hit[same]
            idx = np.arange(sub.shape[1])
            start = np.where(sub & ~np.pad(sub, ((0, 0), (1, 0)))[:, :-1], idx, 0)
            hit[same] = sub & ((idx - np.maximum.accumulate(start, axis=1)) % 2 == 0)
        m = m.copy()
        m[:, :-1][hit] = np.repeat(best, hit.sum(axis=1))
        gone = np.zeros(m.shape, bool)
        gone[:, 1:] = hit
        gone |= m < 0
        n = m.shape[1] - gone.sum(axis=1)
        out = np.full((len(m), int(n.max())), -1, np.int32)
        out[np.arange(out.shape[1]) < n[:, None]] = m[~gone]
        return out, n


#: Flags of a word, for finding breaks: it has a line end, two or more, ends a sentence, starts with a blank.
LINE, LINES, SENTENCE, BLANK = 1, 2, 4, 8
_SENTENCE_ENDS = tuple(".!?:;\u3002\uff01\uff1f\u2026")


def word_flags(word: str) -> int:
    lines = word.count("\n") + (word.count("\r") if "\n" not in word else 0)
    return LINE * (lines > 0) | LINES * (lines > 1) | SENTENCE * word.rstrip("\"')]*_`").endswith(_SENTENCE_ENDS) | BLANK * word[0].isspace()


class WordCache:
    """Codes of the words this worker has met, with their ids, token counts, lengths and flags as arrays.

    It is emptied (by ``release``) once it holds ``max_words`` words or ``max_chars`` characters, so its memory is bounded.
    """

    def __init__(self, bpe: ByteBpe, max_words: int = 400_000, max_chars: int = 8_000_000):
        self.bpe, self.max_words, self.max_chars = bpe, max_words, max_chars
        self._clear()

    def _clear(self) -> None:
        self.code: dict[str, int] = {}
        self.count = self.chars = np.zeros(0, np.int64)
        self.flags = np.zeros(0, np.int8)
        self.ids, self.start, self.held = np.zeros(0, np.int32), np.zeros(0, np.int64), 0

    def codes(self, texts: list[str | None]) -> list[np.ndarray]:
        """The codes of each text's words; they hold until the next call of ``release``."""
        find = self.bpe.find_words
        words = [find(t) if t else [] for t in texts]
        new = set().union(*words).difference(self.code) if words else set()
        if new:
            self._learn(list(new))
        get = self.code.__getitem__
        return [np.fromiter(map(get, ws), np.int64, len(ws)) for ws in words]

    def _learn(self, new: list[str]) -> None:
        ids = self.bpe.encode_words(new)
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        chars = np.fromiter(map(len, new), np.int64, len(new))
        self.code.update(zip(new, range(len(self.code), len(self.code) + len(new))))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in ids for i in x), np.int32, int(count.sum()))])
        self.count, self.chars = np.concatenate([self.count, count]), np.concatenate([self.chars, chars])
        self.flags = np.concatenate([self.flags, np.fromiter(map(word_flags, new), np.int8, len(new))])
        self.held += int(chars.sum())

    def token_ids(self, codes: np.ndarray) -> np.ndarray:
        """The ids of the words, one after another."""
        count = self.count[codes]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.start[codes] - (ends - count), count) + np.arange(total)]

    def release(self) -> None:
        if len(self.code) > self.max_words or self.held > self.max_chars:
            self._clear()


@lru_cache(maxsize=4)
def worker_cache(path: str, pattern: str) -> WordCache:
    """One encoder per Python worker and vocabulary."""
    return WordCache(ByteBpe.load(path, pattern))
