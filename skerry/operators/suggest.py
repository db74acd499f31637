"""Autocompletion from the vocabulary of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .index import SearchIndex


def vocabulary(index: SearchIndex) -> DataFrame:
    """(field, term, doc_freq, score): documents that hold a term in a field, and their share of all."""
    source = index.with_tokens(index.text_fields)
    held = F.array(*[F.struct(F.lit(f).alias("field"), F.array_distinct(F.col(f"`_tok_{f}`")).alias("terms")) for f in index.text_fields])
    rows = source.select(F.explode(held).alias("x")).select("x.field", F.explode("x.terms").alias("term"))
    n = index.statistics(set(), set()).n
    return rows.groupBy("field", "term").agg(F.count(F.lit(1)).alias("doc_freq")).withColumn("score", F.col("doc_freq") / F.lit(max(n, 1)))


def suggest(words: DataFrame, prefix: str, weights: dict[str, float], size: int = 10, edits: int = 0) -> DataFrame:
    """(text, field, score) of the best completions: score by weight falling, then text, then field.

    The prefix is compared in ASCII lower case; an empty one, or a weight of 0, gives nothing.
    ``words`` sorted by term lets a Parquet scan skip what doesn't begin with the prefix.
    ``edits`` above 0 also takes terms whose beginning is within so many edits of it.
    """
    low = prefix.translate(str.maketrans(tx.UPPER, tx.LOWER))
    weights = {f: w for f, w in weights.items() if w != 0}
    empty = words.where("false").select(F.col("term").alias("text"), "field", "score")
    if not low or not weights:
        return empty
    begins = F.col("term").startswith(low)
    if edits:
        begins = begins | (F.levenshtein(F.substring("term", 1, len(low)), F.lit(low), edits) >= 0)
    weight = F.create_map(*[x for f, w in weights.items() for x in (F.lit(f), F.lit(float(w)))])
    found = words.where(begins & F.col("field").isin(list(weights)))
    best = found.groupBy(F.col("term").alias("text"), "field").agg(F.max("score").alias("score"))
    scored = best.select("text", "field", (F.col("score") * weight[F.col("field")]).alias("score"))
    return scored.orderBy(F.desc("score"), "text", "field").limit(size)
