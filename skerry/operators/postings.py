"""Searching by posting lists instead of texts: the fast path for word queries and phrases on a stored index."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import ast, compile as cp
from ..plans import mapping as mp
from ..plans.errors import InvalidRequest
from ..session import partitions, scratch_path, ship
from . import mlt
from .index import SearchIndex, Statistics


@dataclass
class Postings:
    """Three tables: postings (term, field, _id, tf, dl, places) range-partitioned and sorted by term, so a query's
    few terms skip all other row groups; frequencies (term, df) likewise; lengths, one row of mean lengths per field."""

    index: SearchIndex
    postings: DataFrame
    frequencies: DataFrame
    lengths: DataFrame
    n: int

    @staticmethod
    def build(index: SearchIndex, path: str | None = None) -> "Postings":
        spark = index.df.sparkSession
        path = path or scratch_path(spark, "postings")
        source = index.with_tokens(index.text_fields).select("_id", *[F.col(f"`_tok_{f}`") for f in index.text_fields])
        counted = term_places(source, index.text_fields)
        n = partitions(spark)
        # (term, _id) and not the term alone: a term that every document holds spreads over several ranges
        counted.repartitionByRange(n, "term", "_id").sortWithinPartitions("term", "_id").write.mode("overwrite").parquet(f"{path}/postings")
        stored = spark.read.parquet(f"{path}/postings")
        df = stored.select("term", "_id").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        df.repartitionByRange(n, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/frequencies")
        lengths = source.select(*[F.avg(F.when(F.col(f"`_tok_{f}`").isNotNull(), F.size(f"`_tok_{f}`")).cast("double")).alias(f) for f in index.text_fields], F.count(F.lit(1)).alias("_n"))
        lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        return Postings.read(index, path)

    @staticmethod
    def read(index: SearchIndex, path: str) -> "Postings":
        spark = index.df.sparkSession
        lengths = spark.read.parquet(f"{path}/lengths")
        return Postings(index, spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/frequencies"), lengths, lengths.first()["_n"])

    def documents(self) -> int:
        return self.n

    def frequencies_of(self, terms: list[str]) -> dict[str, int]:
        """Documents that hold each term in any field; row groups without them are skipped."""
        return {r["term"]: r["df"] for r in self.frequencies.where(F.col("term").isin(list(terms))).collect()} if terms else {}

    def statistics(self) -> "StoredCounts":
        """The lists' counts, for searches that read texts."""
        return StoredCounts(self)

    def search(self, query: ast.Query) -> DataFrame:
        """(_id, _score) of the matches of a query made of words (term, terms, match, phrase, multi_match, bool over them) and typed clauses.

        Row groups without a word of the query are skipped and texts aren't read. Documents are joined
        only where typed clauses need their values, or where a match needs no word. Phrases go by the places of their words. Queries that need more of a
        text (patterns, beginnings, fuzzy terms) are refused.
        """
        index, mapping = self.index, self.index.mapping
        exclude = None
        if isinstance(query, ast.MoreLikeThis):
            exclude, query = query.doc_id, mlt.rewrite(index, query)
            if query is None:
                return index.df.where("false").select("_id", F.lit(0.0).alias("_score"))
        wanted = cp.words_by_field(query, mapping)
        if wanted is None:
            raise InvalidRequest("posting lists answer queries of words, phrases and typed clauses only")
        mp.validate_query(query, mapping)
        terms = sorted({w for _, w in wanted} | cp.query_terms(query))
        df = self.frequencies_of(terms)
        average = {k: v or 1.0 for k, v in self.lengths.first().asDict().items() if k != "_n"}
        stats = Statistics(self.n, {t: df.get(t, 0) for t in terms}, average, index.profile == "unflushed")
        given, columns = {}, []
        for i, (f, w) in enumerate(sorted(wanted)):
            given[("tf", f, w)] = f"_tf{i}"
            columns.append(F.max(F.when((F.col("field") == f) & (F.col("term") == w), F.col("tf"))).alias(f"_tf{i}"))
        for i, f in enumerate(sorted({f for f, _ in wanted})):
            given[("length", f)] = f"_dl{i}"
            columns.append(F.max(F.when(F.col("field") == f, F.col("dl"))).alias(f"_dl{i}"))
        placed, begun = cp.placed_words(query, mapping)
        for i, (f, w) in enumerate(sorted(placed)):
            given[("places", f, w)] = f"_at{i}"
            columns.append(F.max(F.when((F.col("field") == f) & (F.col("term") == w), F.col("places"))).alias(f"_at{i}"))
        begins = F.lit(False)
        for i, (f, w) in enumerate(sorted(begun)):
            given[("last", f, w)] = f"_last{i}"
            fits = (F.col("field") == f) & F.col("term").startswith(w)
            begins = begins | fits
            columns.append(F.max(F.when(fits, F.element_at("places", -1)["at"])).alias(f"_last{i}"))
        typed, must = cp.plain_fields(query, mapping), cp.needs_word(query, mapping)
        rows = None
        if columns:
            inside = F.col("term").isin(terms) & F.col("field").isin(sorted({f for f, _ in wanted}))
            inside = inside | begins if begun else inside
            rows = self.postings.where(inside).groupBy("_id").agg(*columns)
        if rows is None or typed or not must:
            docs = index.df.select("_id", *[F.col(f"`{f}`") for f in sorted(typed)])
            if (plain := cp.pushable(query, {k: v for k, v in mapping.items() if k in typed})) is not None:
                docs = docs.where(plain)
            rows = docs if rows is None else docs.join(rows, "_id", "inner" if must else "left")
        if exclude is not None:
            rows = rows.where(F.col("_id") != exclude)
        scored = cp.Compiler(mapping, stats, given).score(rows, query)
        return scored.where("_score is not null").select("_id", F.round("_score", 6).alias("_score"))

    def page(self, query: ast.Query, size: int, start: int = 0) -> DataFrame:
        """The best hits with all columns; only their rows of the documents are kept, by a broadcast of at most ``MAX_SIZE`` ids."""
        best = self.search(query).orderBy(F.desc("_score"), "_id").offset(start).limit(min(size, mp.MAX_SIZE))
        return self.index.df.join(F.broadcast(best), "_id").orderBy(F.desc("_score"), "_id")


@dataclass
class StoredCounts:
    """What a search needs to know of the whole collection, by posting lists."""

    lists: Postings

    def documents(self) -> int:
        return self.lists.n

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        return self.lists.frequencies_of(terms)

    def averages(self, fields: list[str]) -> dict[str, float]:
        row = self.lists.lengths.first().asDict()
        return {f: row[f] for f in fields if f in row}


def term_places(source: DataFrame, fields: list[str]) -> DataFrame:
    """(term, field, _id, dl, tf, places): each word of each field's tokens (``_tok_<field>``) with its places in rising order.

    A place is the token's number from 1 and the byte where it starts if single spaces part the tokens.
    """
    ship(source.sparkSession)

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for k, name in enumerate(fields, 1):
                tokens = batch.column(k)
                words = tokens.flatten()
                if not len(words):
                    continue
                size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(size)), size)
                first = (np.cumsum(size) - size)[row]
                after = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
                before = np.concatenate([[0], after[:-1]])
                at, byte = np.arange(len(row)) - first + 1, before - before[first]
                cols = [ids.take(pa.array(row)), pa.array([name] * len(row)), pa.array(size[row], pa.int32()), words, pa.array(at, pa.int32()), pa.array(byte, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["_id", "field", "dl", "term", "at", "byte"])

    rows = source.select("_id", *[F.col(f"`_tok_{f}`") for f in fields]).mapInArrow(run, "_id string, field string, dl int, term string, at int, byte int")
    held = F.sort_array(F.collect_list(F.struct("at", "byte"))).alias("places")
    return rows.groupBy("term", "field", "_id", "dl").agg(F.count(F.lit(1)).cast("int").alias("tf"), held)
