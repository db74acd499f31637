"""Problem 9: cutting long texts at their own breaks into overlapping pieces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship
from .bpe import BLANK, LINE, LINES, SENTENCE, WordCache, worker_cache
from .tokenize import BYTE_LEVEL_PATTERN, text_slices, vocabulary_path

LIMIT, OVERLAP = 512, 64
#: Kinds of break, weakest first: inside a word, between words without a blank, before a blank, after a sentence, a line, a paragraph.
INSIDE, BESIDE, WORD, AFTER_SENTENCE, AFTER_LINE, PARAGRAPH = range(6)


class Breaks:
    """The places where a text may be cut: token and character offsets (0 and the end among them), and the kind of break."""

    def __init__(self, cache: WordCache, text: str, codes: np.ndarray, longest: int):
        count, flags = cache.count[codes], cache.flags[codes].astype(np.int64)
        token = np.concatenate([[0], np.cumsum(count)])
        char = np.concatenate([[0], np.cumsum(cache.chars[codes])])
        line, blank = flags & LINE > 0, flags & BLANK > 0
        kind = np.full(len(token), BESIDE)
        kind[1:-1][blank[1:]] = WORD
        kind[1:-1][(flags[:-1] & SENTENCE > 0) & blank[1:]] = AFTER_SENTENCE
        kind[1:][line] = AFTER_LINE
        kind[1:][flags & LINES > 0] = PARAGRAPH
        kind[2:][line[1:] & line[:-1]] = PARAGRAPH
        extra = [self._inside(cache, text, codes[i], token[i], char[i]) for i in np.flatnonzero(count > longest)]
        if extra:
            t, c = (np.concatenate([x[j] for x in extra]) for j in (0, 1))
            token, char, kind = np.concatenate([token, t]), np.concatenate([char, c]), np.concatenate([kind, np.full(len(t), INSIDE)])
            order = np.argsort(token, kind="stable")
            token, char, kind = token[order], char[order], kind[order]
        self.token, self.char, self.kind = token, char, kind

    @staticmethod
    def _inside(cache: WordCache, text: str, code: int, token: int, char: int) -> tuple[np.ndarray, np.ndarray]:
        """Token boundaries within a long word that lie between characters."""
        word = text[char:char + int(cache.chars[code])].encode("utf-8", "surrogatepass")
        at = np.cumsum(cache.bpe.token_bytes_len[cache.token_ids(np.array([code]))])[:-1]
        lead = (np.frombuffer(word, np.uint8) & 0xC0) != 0x80
        safe = lead[at]
        return token + 1 + np.flatnonzero(safe), char + np.cumsum(lead)[at - 1][safe]


def cut_all(breaks: list[Breaks], limit: int, overlap: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the indexes of the breaks where its pieces start and end.

    Every break is joined to its farthest legal successor: the end if that is in reach, else
    the last break of the strongest kind that leaves the piece at least half full (a quarter
    for the end of a word), else the last break in reach. The next piece starts at the last break at least ``overlap`` tokens
    back. The successor table is then squared again and again; with each square the reached
    breaks double, so all cuts of all texts come out in as many steps as the logarithm of the
    most pieces.
    """
    size = np.array([len(b.token) for b in breaks])
    base = np.cumsum(size) - size
    nexts, starts = [], []
    for b, at in zip(breaks, base):
        t, end = b.token, len(b.token) - 1
        back = np.searchsorted(t, t - overlap, "right") - 1
        back[0] = 0
        back = np.maximum(back, 0)
        reach = t[back] + limit
        far = np.searchsorted(t, reach, "right") - 1
        nxt = np.where(far > np.arange(len(t)), far, np.minimum(np.arange(len(t)) + 1, end))
        settled = far >= end
        half, quarter = np.maximum(t[back] + limit // 2, t), np.maximum(t[back] + limit // 4, t)
        for kind in (PARAGRAPH, AFTER_LINE, AFTER_SENTENCE, WORD, BESIDE):
            own = np.flatnonzero(b.kind >= kind)
            if not len(own):
                continue
            cand = np.searchsorted(t[own], reach, "right") - 1
            ok = ~settled & (cand >= 0)
            pick = own[np.maximum(cand, 0)]
            ok &= t[pick] > (half if kind > WORD else quarter)
            nxt[ok] = pick[ok]
            settled |= ok
        nxt[end] = end
        nexts.append(nxt + at), starts.append(back + at)
    step, start = np.concatenate(nexts), np.concatenate(starts)
    reached = base.copy()
    while True:
        ahead = step[reached]
        grown = np.unique(np.concatenate([reached, ahead]))
        if len(grown) == len(reached):
            break
        reached, step = grown, step[step]
    out = []
    of = np.searchsorted(base, reached, "right") - 1
    for i, (at, n) in enumerate(zip(base, size)):
        path = reached[of == i] if len(breaks) < 2 else reached[np.searchsorted(of, i):np.searchsorted(of, i, "right")]
        out.append((start[path[:-1]] - at, path[1:] - at))
    return out


def _cut_on(cache: WordCache, text: str, b: Breaks, a: np.ndarray, z: np.ndarray, n: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, ...]:
    """The pieces with those above the limit, which no tightened table could bring below it, cut on by counting."""
    rows: list[tuple[int, int, int, int]] = []
    for x, y, token, m in zip(b.char[a].tolist(), b.char[z].tolist(), b.token[a].tolist(), n.tolist()):
        if m <= limit:
            rows.append((x, y, token, m))
        else:
            rows += [(s, e, int(b.token[np.searchsorted(b.char, s, "right") - 1]), k) for s, e, k in cut_by_count(cache, text, x, y, limit, overlap)]
    return tuple(np.array(c, np.int64) for c in zip(*rows))


def cut_by_count(cache: WordCache, text: str, start: int, end: int, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces (start, end, tokens) of ``text[start:end]``, each ending at the last character that bisection finds within the limit
    and beginning at the last one that leaves ``overlap`` tokens of the piece before."""
    def count(x: int, y: int) -> int:
        codes = cache.codes([text[x:y]])[0]  # may add to the counts
        return int(cache.count[codes].sum())

    out, done = [], start
    while True:
        lo, hi = done + 1, end  # one more character than before always fits: it is at most 4 tokens
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if count(start, mid) <= limit else (lo, mid - 1)
        if count(start, lo) > limit:
            start, lo = done, done + 1
        out.append((start, lo, count(start, lo)))
        if lo >= end:
            return out
        low, high = start, lo
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if count(mid, lo) >= overlap else (low, mid - 1)
        start, done = low, lo


def split_texts(cache: WordCache, texts: list[str], codes: list[np.ndarray], limit: int, overlap: int) -> list[tuple[list, list, list, list]]:
    """For each text the lists of piece starts and ends (characters), token starts and token counts."""
    longest = max(1, limit // 8)
    breaks = [Breaks(cache, t, c, longest) for t, c in zip(texts, codes)]
    tight = np.full(len(texts), limit)
    out: list = [None] * len(texts)
    todo = list(range(len(texts)))
    while todo:
        again = []
        by_limit: dict[int, list[int]] = {}
        for i in todo:
            by_limit.setdefault(int(tight[i]), []).append(i)
        for lim, some in by_limit.items():
            for i, (a, z) in zip(some, cut_all([breaks[i] for i in some], lim, overlap)):
                b = breaks[i]
                n = b.token[z] - b.token[a]
                # a cut inside a word can change how its ends are encoded: count those pieces again
                hard = np.flatnonzero((b.kind[a] == INSIDE) | (b.kind[z] == INSIDE))
                if len(hard):
                    n[hard] = [int(cache.count[c].sum()) for c in cache.codes([texts[i][b.char[a[j]]:b.char[z[j]]] for j in hard])]
                    if n.max() > limit and lim > 2 * overlap + 8:
                        tight[i] = max(2 * overlap + 8, lim - max(int(n.max()) - limit, lim // 16))
                        again.append(i)
                        continue
                out[i] = (b.char[a], b.char[z], b.token[a], n) if n.max() <= limit else _cut_on(cache, texts[i], b, a, z, n, limit, overlap)
        todo = again
    return out


def split(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str | None = None, pattern: str = BYTE_LEVEL_PATTERN) -> DataFrame:
    """(key, piece, n_pieces, char_start, char_end, token_start, n_tokens, piece_text).

    Texts of more than ``limit`` tokens are cut; the others come out as their one piece 0. A
    piece ends at a paragraph, line, sentence or word end where there is one in reach, and
    inside a word (between characters) only where a word is longer than that. It begins at
    least ``overlap`` tokens before the end of the one before it, at a word boundary where
    one is near. Null and empty texts give one piece of 0 tokens with their own text. Character offsets
    count code points. Rows with equal keys are cut each by itself.
    """
    if not 0 <= overlap <= limit // 2 or limit < 16:
        raise ValueError("limit must be at least 16 tokens, and overlap at most half of it")
    ship(df.sparkSession)
    path = vocabulary or vocabulary_path()
    kind = df.schema[key].dataType.simpleString()
    names = ["k", "piece", "n_pieces", "char_start", "char_end", "token_start", "n_tokens", "piece_text"]

    def run(batches):
        cache = worker_cache(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in text_slices(texts):
                part = texts[lo:hi]
                codes = cache.codes(part)
                total = np.fromiter((cache.count[c].sum() for c in codes), np.int64, len(codes))
                long = np.flatnonzero(total > limit)
                cuts = dict(zip(long.tolist(), split_texts(cache, [part[i] for i in long], [codes[i] for i in long], limit, overlap))) if len(long) else {}
                n = np.ones(len(part), np.int64)
                cols: list[list] = [[], [], [], []]
                pieces: list[str | None] = []
                for i, t in enumerate(part):
                    if i in cuts:
                        a, z, s, m = cuts[i]
                        n[i] = len(a)
                        for col, x in zip(cols, (a, z, s, m)):
                            col.append(x)
                        pieces.extend(t[x:y] for x, y in zip(a.tolist(), z.tolist()))
                    else:
                        for col, x in zip(cols, (0, len(t or ""), 0, total[i])):
                            col.append(np.array([x], np.int64))
                        pieces.append(t)
                cache.release()
                row = np.repeat(np.arange(lo, hi), n)
                number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(number, pa.int32()), pa.array(np.repeat(n, n), pa.int32())]
                    + [pa.array(np.concatenate(c), pa.int64()) for c in cols]
                    + [pa.array(pieces, pa.string())],
                    names,
                )

    out = df.select(df[key].alias("k"), df[text].cast("string").alias("t")).mapInArrow(
        run, f"k {kind}, piece int, n_pieces int, char_start bigint, char_end bigint, token_start bigint, n_tokens bigint, piece_text string"
    )
    return out.withColumnRenamed("k", key)
