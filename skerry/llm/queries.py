"""Queries of the training-data problems tagged llm, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from . import distinctive, packing, splitting, term_counts, tokenize


def _arrow_bytes(spark: SparkSession) -> None:
    """Long texts make batches of many rows large: batches for Python are bounded by bytes too."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def _banded(spark: SparkSession, folder: str) -> DataFrame:
    postings = table(spark, folder, "postings")
    rows = term_counts.posting_rows(postings)
    # records and hot terms are told by the postings before they are unfolded to positions
    counts = term_counts.ngram_counts(term_counts.posting_occurrences(postings), hot=term_counts.hot_starts(rows, "t"))
    return term_counts.with_bands(counts, term_counts.group_sizes(rows))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """(index_name, term, band) of the terms that too few or too many records hold."""
    return _banded(spark, folder).filter("band <> 'useful'").select(F.col("g").alias("index_name"), F.col("t1").alias("term"), "band")


def p1_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every term of the postings and suggest entries with its true counts beside the suggested ones; 0 where no posting has it."""
    suggested = table(spark, folder, "suggest_entries").filter("term is not null")
    suggested = suggested.groupBy("index_name", term_counts.normal_term(F.col("term")).alias("term")).agg(F.max("doc_freq").alias("suggested_doc_freq"))
    counted = _banded(spark, folder).select(F.col("g").alias("index_name"), F.col("t1").alias("term"), "occurrences", "records", "total", "band")
    both = counted.join(suggested, ["index_name", "term"], "full")
    return both.select("index_name", "term", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), F.coalesce("records", F.lit(0)).alias("doc_freq"), F.coalesce("band", F.lit("rare")).alias("band"), "suggested_doc_freq")


def p1_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The postings' n-grams of up to three terms by position within a record's field, with their counts per index and bands."""
    postings = table(spark, folder, "postings")
    placed = term_counts.posting_occurrences(postings).filter("p is not null")
    counts = term_counts.with_bands(term_counts.ngram_counts(placed, 3), term_counts.group_sizes(placed))
    return counts.select(F.col("g").alias("index_name"), "t1", "t2", "t3", "n", "occurrences", "records", "band")


def _ngram_counts(spark: SparkSession, folder: str) -> DataFrame:
    return term_counts.count_suffixes(term_counts.text_suffixes(table(spark, folder, "documents"), "doc_id", "text", 3), 3)


def p1_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """N-grams of up to three words over all texts with their counts."""
    return _ngram_counts(spark, folder).select(F.concat_ws(" ", "t1", "t2", "t3").alias("ngram"), "n", "occurrences", "records")


def p1_ngram_bands(spark: SparkSession, folder: str) -> DataFrame:
    """Every n-gram of up to three words over all texts with its counts and band; the total is that of the documents with a word."""
    words = term_counts.text_suffixes(table(spark, folder, "documents"), "doc_id", "text", 1)
    # all texts are one group, so the sizes are one row
    counts = term_counts.with_bands(_ngram_counts(spark, folder), F.broadcast(term_counts.group_sizes(words)))
    return counts.select(F.concat_ws(" ", "t1", "t2", "t3").alias("ngram"), "n", "occurrences", "records", "total", "band")


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return distinctive.scores(distinctive.term_statistics(term_counts.posting_occurrences(table(spark, folder, "postings"))))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """(index_name, doc_id, term) of the terms that the record's own model keeps, checked for 4 or more occurrences and 2 to 12 records.

    Of such terms EM loses none: 4 occurrences for 12 records are above ``KEPT``.
    """
    return _scored(spark, folder).filter("score > 0").filter("tf >= 4 and df between 2 and 12").select(F.col("g").alias("index_name"), F.col("r").alias("doc_id"), F.col("t").alias("term"))


def p2_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score of each term of each record, to 6 digits; what is within 1e-9 of a half goes up."""
    return _scored(spark, folder).select(F.col("g").alias("index_name"), F.col("r").alias("doc_id"), F.col("t").alias("term"), "tf", "df", F.round(F.col("score") + 1e-9, 6).alias("score"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, ids) by byte_bpe_50k."""
    _arrow_bytes(spark)
    return tokenize.encode(table(spark, folder, "documents"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Containers of 2,048 tokens filled with the texts."""
    _arrow_bytes(spark)
    return packing.pack(table(spark, folder, "documents"))


def p8_checks(spark: SparkSession, folder: str) -> DataFrame:
    """One row on ``p8_containers``: the texts and keys placed, containers above the capacity, texts divided though they fit, and
    texts whose stretches aren't one whole."""
    placed = p8_containers(spark, folder)
    texts = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("stretches"), F.sum("n_tokens").alias("tokens"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"), F.min("token_start").alias("start"))
    full = placed.groupBy("container").agg(F.sum("n_tokens").alias("tokens")).agg(F.count_if(F.col("tokens") > packing.CAPACITY).alias("overfull"))
    divided = F.count_if((F.col("stretches") > 1) & (F.col("tokens") <= packing.CAPACITY)).alias("divided")
    broken = F.count_if((F.col("start") != 0) | (F.col("end") != F.col("tokens"))).alias("broken")
    one = texts.agg(F.count(F.lit(1)).alias("texts"), divided, broken).unionByName(full, allowMissingColumns=True)
    return one.agg(*[F.sum(c).alias(c) for c in ("texts", "divided", "broken", "overfull")])


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of at most 512 tokens that share at least 64 with the one before."""
    _arrow_bytes(spark)
    return splitting.split(table(spark, folder, "documents"))


def p9_checks(spark: SparkSession, folder: str) -> DataFrame:
    """One row on ``p9_pieces``: texts and pieces that begin them, pieces above the limit, pieces that don't say what the text says there, gaps
    between neighbours, and pieces that end no further than the one before."""
    texts = table(spark, folder, "documents").select("doc_id", "text")
    pieces = p9_pieces(spark, folder).join(texts, "doc_id")
    own = F.substr("text", F.col("char_start").cast("int") + 1, (F.col("char_end") - F.col("char_start")).cast("int"))
    before = Window.partitionBy("doc_id").orderBy("piece")
    each = pieces.select("piece", "n_pieces", "n_tokens", "char_start", "char_end", (F.col("piece_text").eqNullSafe(own)).alias("same"), F.lag("char_end").over(before).alias("last"), F.length("text").alias("size"))
    return each.agg(
        F.count_if(F.col("piece") == 0).alias("texts"), F.count_if(F.col("n_tokens") > splitting.LIMIT).alias("too_long"), F.count_if(~F.col("same")).alias("changed"), F.count_if(F.col("char_start") > F.col("last")).alias("gaps"),
        F.count_if(F.col("char_end") <= F.col("last")).alias("no_progress"), F.count_if((F.col("piece") == F.col("n_pieces") - 1) & (F.col("char_end") != F.coalesce("size", F.lit(0)))).alias("unfinished"),
    )


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_terms, p1_phrases, p1_ngrams, p1_ngram_bands, p2_found, p2_scores, p7_ids, p8_containers, p8_checks, p9_pieces, p9_checks)}


_TERM = "translate(trim(term, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OCCURRENCES = f"""occ AS (SELECT DISTINCT index_name, doc_id, field, {_TERM} AS term, p FROM (
  SELECT index_name, doc_id, field, term, unnest(CASE WHEN len(positions) > 0 THEN positions ELSE [NULL] END) AS p FROM postings
  WHERE term IS NOT NULL AND doc_id IS NOT NULL))"""
_BANDS = f"""WITH {_OCCURRENCES},
counts AS (SELECT index_name, term, count(p) AS occurrences, count(DISTINCT doc_id) AS doc_freq FROM occ GROUP BY ALL),
sizes AS (SELECT index_name, count(DISTINCT doc_id) AS total FROM occ GROUP BY ALL),
banded AS (SELECT c.*, CASE WHEN doc_freq <= 2 THEN 'rare' WHEN doc_freq * 10 > total * 6 THEN 'common' ELSE 'useful' END AS band
  FROM counts c JOIN sizes s USING (index_name))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"{_BANDS} SELECT index_name, term, band FROM banded WHERE band <> 'useful'",
        "p1_terms": f"""{_BANDS}, sug AS (SELECT index_name, {_TERM} AS term, max(doc_freq) AS suggested_doc_freq FROM suggest_entries WHERE term IS NOT NULL GROUP BY ALL)
SELECT index_name, term, coalesce(occurrences, 0) AS occurrences, coalesce(doc_freq, 0) AS doc_freq, coalesce(band, 'rare') AS band, suggested_doc_freq
FROM banded FULL JOIN sug USING (index_name, term)""",
        "p1_phrases": f"""WITH {_OCCURRENCES},
x AS (SELECT index_name, doc_id, term AS t1, lead(term, 1) OVER w AS t2, lead(term, 2) OVER w AS t3 FROM occ WHERE p IS NOT NULL WINDOW w AS (PARTITION BY index_name, doc_id, field ORDER BY p, term)),
g AS (SELECT index_name, doc_id, t1, NULL::VARCHAR AS t2, NULL::VARCHAR AS t3, 1 AS n FROM x UNION ALL SELECT index_name, doc_id, t1, t2, NULL, 2 FROM x WHERE t2 IS NOT NULL UNION ALL SELECT index_name, doc_id, t1, t2, t3, 3 FROM x WHERE t3 IS NOT NULL),
c AS (SELECT index_name, t1, t2, t3, n, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM g GROUP BY ALL),
z AS (SELECT index_name, count(DISTINCT doc_id) AS total FROM occ WHERE p IS NOT NULL GROUP BY ALL)
SELECT c.*, CASE WHEN records <= 2 THEN 'rare' WHEN records * 10 > total * 6 THEN 'common' ELSE 'useful' END AS band FROM c JOIN z USING (index_name)""",
        "p1_ngrams": f"""WITH w AS (SELECT doc_id, list_filter(string_split(translate(text, '{term_counts._UPPER + term_counts._BLANKS}', '{term_counts._LOWER + " " * len(term_counts._BLANKS)}'), ' '), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS ngram FROM w, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n)
SELECT ngram, n, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM g GROUP BY ALL""",
        "p1_ngram_bands": f"""WITH w AS (SELECT doc_id, list_filter(string_split(translate(text, '{term_counts._UPPER + term_counts._BLANKS}', '{term_counts._LOWER + " " * len(term_counts._BLANKS)}'), ' '), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS ngram FROM w, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n),
c AS (SELECT ngram, n, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM g GROUP BY ALL),
z AS (SELECT count(DISTINCT doc_id) AS total FROM w WHERE len(w) > 0)
SELECT c.*, total, CASE WHEN records <= 2 THEN 'rare' WHEN records * 10 > total * 6 THEN 'common' ELSE 'useful' END AS band FROM c, z""",
        "p2_found": f"""WITH {_OCCURRENCES},
tf AS (SELECT index_name, doc_id, term, count(p) AS tf FROM occ GROUP BY ALL),
df AS (SELECT index_name, term, count(*) AS df FROM tf GROUP BY ALL)
SELECT index_name, doc_id, term FROM tf JOIN df USING (index_name, term) WHERE tf >= 4 AND df BETWEEN 2 AND 12""",
        "p8_checks": "SELECT count(*) AS texts, 0 AS divided, 0 AS broken, 0 AS overfull FROM documents",
        "p9_checks": "SELECT count(*) AS texts, 0 AS too_long, 0 AS changed, 0 AS gaps, 0 AS no_progress, 0 AS unfinished FROM documents",
        # the fixed point of EM: of the terms by falling tf/df the longest stretch whose last still has a probability keeps one
        "p2_scores": f"""WITH {_OCCURRENCES},
tf AS (SELECT index_name, doc_id, term, greatest(count(p), 1) AS tf FROM occ GROUP BY ALL),
df AS (SELECT index_name, term, count(*) AS df FROM tf GROUP BY ALL),
size AS (SELECT index_name, sum(df) AS size FROM df GROUP BY ALL),
len AS (SELECT index_name, doc_id, sum(tf) AS len FROM tf GROUP BY ALL),
x AS (SELECT index_name, doc_id, term, tf, df, df / size * least({1 / distinctive.OWN_SHARE - 1!r}, {distinctive.KEPT!r} * size / len) AS cb
  FROM tf JOIN df USING (index_name, term) JOIN size USING (index_name) JOIN len USING (index_name, doc_id)),
m AS (SELECT *, sum(tf) OVER w / (1 + sum(cb) OVER w) AS m FROM x WINDOW w AS (PARTITION BY index_name, doc_id ORDER BY tf / df DESC)),
last AS (SELECT index_name, doc_id, arg_min(m, tf / df) AS m FROM m WHERE tf > cb * m GROUP BY ALL)
SELECT index_name, doc_id, term, tf, df, round(greatest(tf / last.m - cb, 0) + 1e-9, 6) AS score FROM x JOIN last USING (index_name, doc_id)""",
    }
