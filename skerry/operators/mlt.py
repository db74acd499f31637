"""More-like-this: a document's significant terms as a query."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans import ast
from .index import SearchIndex


def rewrite(index: SearchIndex, q: ast.MoreLikeThis) -> ast.Bool | None:
    """A Bool of boosted terms, at least one to match; None where there is nothing to go by.

    The terms are those of one document, so what is collected is bounded by it. Equal
    significance is ordered by field and term.
    """
    names = [f for f in (q.fields or index.text_fields) if f in index.text_fields]
    if q.doc_id is not None:
        row = index.df.where(F.col("_id") == q.doc_id).select(*[F.col(f"`{f}`") for f in names]).first() if names else None
        source = row.asDict() if row else None
    else:
        source = q.like
    if not source:
        return None
    counts: Counter = Counter()
    for f in names:
        if isinstance(source.get(f), str):
            counts.update((f, w) for w in tx.tokenize(source[f]) if q.min_word_length <= len(w.encode()) <= q.max_word_length)
    kept = {k: n for k, n in counts.items() if n >= q.min_term_freq}
    if not kept:
        return None
    n, df = _frequencies(index, sorted({w for _, w in kept}))
    weighed = [(tf * tx.idf(df.get(w, 0), n), f, w) for (f, w), tf in kept.items() if df.get(w, 0) >= q.min_doc_freq]
    best = sorted(weighed, key=lambda x: (-x[0], x[1], x[2]))[: q.max_query_terms]
    if not best:
        return None
    top = max(best[0][0], 1.0)
    clauses = tuple(ast.Term(f, w, boost=(1.0 + s / top) * q.field_boost_factor) for s, f, w in best)
    return ast.Bool(should=clauses, minimum_should_match=1)


def _frequencies(index: SearchIndex, words: list[str]) -> tuple[int, dict[str, int]]:
    """Documents, and how many hold each word in any text field: from stored counts, or in one pass, whatever the number of words."""
    if index.stored is not None:
        return index.stored.documents(), index.stored.frequencies(words)
    fields = index.text_fields
    every = F.array_distinct(F.concat(*[F.coalesce(F.col(f"`_tok_{f}`"), F.array().cast("array<string>")) for f in fields]))
    wanted = F.array_intersect(every, F.array(*[F.lit(w) for w in words]))
    rows = index.with_tokens(fields).select(F.explode(wanted).alias("w")).groupBy("w").count().collect()
    return index.statistics(set(), set()).n, {r["w"]: r["count"] for r in rows}
