"""Words of texts and their BM25 scores as built-in column expressions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Unicode white space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
K1, B = 1.2, 0.75
#: A distance in bytes between the words of a phrase that costs nothing, and what each byte of a larger one costs.
FREE_GAP, GAP_COST = 10, 0.1


def tokens(c: Column) -> Column:
    """Words between white space, ASCII letters in lower case, punctuation kept; null for null.

    Blanks become spaces in the same pass that lowers letters, so the split is by a plain
    character and no lambda runs.
    """
    return F.array_remove(F.split(F.translate(c, UPPER + BLANKS, LOWER + " " * len(BLANKS)), " "), "")


def tokenize(text: str) -> list[str]:
    """The same words of a query's text."""
    return [w for w in re.split(f"[{BLANKS}]+", text.translate(str.maketrans(UPPER, LOWER))) if w]


def frequency(tok: Column, term: str) -> Column:
    """How often the term is among the tokens; compiled code without a lambda."""
    return F.size(tok) - F.size(F.array_remove(tok, term))


def bm25(tf: Column, idf: float | Column, length: Column, average: float) -> Column:
    idf = F.lit(float(idf)) if not isinstance(idf, Column) else idf
    return idf * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / F.lit(max(average, 1.0))))


def idf(df: int, n: int) -> float:
    """1 for a term no document holds, 0 for one that more than half of them hold."""
    n = max(n, 1)
    return 1.0 if df == 0 else max(math.log((n - df + 0.5) / (df + 0.5)), 0.0) if n - df + 0.5 > 0 else 0.0


def joined(tok: Column) -> Column:
    """The tokens with one space around each."""
    return F.concat(F.lit(" "), F.array_join(tok, " "), F.lit(" "))


def glob_pattern(glob: str) -> str:
    """The anchored regular expression of a pattern with ``*`` and ``?``."""
    parts = {"*": ".*", "?": "."}
    return r"\A(?:" + "".join(parts.get(ch) or re.sub(r"([\\.^$|()\[\]{}+\-&~#])", r"\\\1", ch) for ch in glob) + r")\z"
