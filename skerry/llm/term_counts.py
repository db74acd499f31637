"""Problem 1: occurrences and records of every term (or n-gram), with marks for the too rare and too common."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import partitions, ship

#: Unicode white space.
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Records of a hot term are routed to at least so many tasks, so that a term that every record holds is not one task's work.
SALTS = 8


def normal_term(c: Column) -> Column:
    """Without surrounding spaces, ASCII letters in lower case; other characters stay."""
    return F.translate(F.trim(c), _UPPER, _LOWER)


def posting_rows(postings: DataFrame, group: str = "index_name", record: str = "doc_id", section: str = "field", term: str = "term", positions: str = "positions") -> DataFrame:
    """(g, r, s, t, ps): the postings with their terms in one spelling and their distinct positions.

    Rows without a term or record are left out: they say nothing about either.
    """
    rows = postings.select(
        postings[group].alias("g"), postings[record].alias("r"), postings[section].alias("s"), normal_term(postings[term]).alias("t"), F.array_distinct(postings[positions]).alias("ps")
    )
    return rows.filter("t is not null and r is not null")


def posting_occurrences(postings: DataFrame, **columns: str) -> DataFrame:
    """(g, r, s, t, p): a row per position of a posting, or one of null position where a posting has none; ``columns`` as for ``posting_rows``."""
    return posting_rows(postings, **columns).select("g", "r", "s", "t", F.explode_outer("ps").alias("p"))


def text_suffixes(df: DataFrame, key: str, text: str, max_n: int, group: Column | None = None) -> DataFrame:
    """(g, r, s, p, t1..tn): each blank-separated word of each text with the ``max_n`` - 1 that follow it.

    The words are ASCII-lowered. Null and empty texts have none; rows of null key are left out.
    """
    words = F.array_remove(F.split(F.translate(df[text].cast("string"), _UPPER + _BLANKS, _LOWER + " " * len(_BLANKS)), " "), "")
    rows = df.select((F.lit("") if group is None else group).alias("g"), df[key].alias("r"), F.lit("").alias("s"), words.alias("w")).filter("r is not null")
    shifted = [F.slice("w", j, F.greatest(F.size("w"), F.lit(1))).alias(f"t{j}") for j in range(1, max_n + 1)]
    zipped = rows.select("g", "r", "s", F.posexplode(F.arrays_zip(*shifted)).alias("p", "x"))
    return zipped.select("g", "r", "s", "p", *[F.col(f"x.t{j}") for j in range(1, max_n + 1)])


def suffixes(occurrences: DataFrame, max_n: int) -> DataFrame:
    """(g, r, s, p, t1..tn): the term at each occurrence and the ``max_n`` - 1 that follow it in its section.

    Of several terms at one place the order is that of the terms. A term listed twice at one
    place counts once.
    """
    if max_n == 1:
        return occurrences.select("g", "r", "s", "p", F.col("t").alias("t1"))
    place = Window.partitionBy("g", "r", "s").orderBy("p", "t")
    once = occurrences.distinct()
    return once.select("g", "r", "s", "p", F.col("t").alias("t1"), *[F.lead("t", j).over(place).alias(f"t{j + 1}") for j in range(1, max_n)])


class PrefixStack:
    """Counts and record sets of the open prefixes, one level per term.

    Rows come sorted with longer suffixes before their own prefixes, so when a prefix changes
    at some depth nothing can extend the open prefixes from there on: they are popped and
    given out. Runs that open and close inside one batch are counted by numpy; only the runs
    open at a batch's end are kept on the stack for the next batch.
    """

    def __init__(self, max_n: int):
        self.max_n = max_n
        self.open: list[tuple | None] = [None] * max_n  # per depth: prefix, count, record arrays
        self.last: tuple | None = None  # the last row's whole key, to tell a repeated occurrence
        self.out: list[tuple[list, list[int], list[int]]] = []

    def feed(self, batch: pa.RecordBatch) -> None:
        """batch: g, t1..tn, r, s, p in sorted order."""
        rows = batch.num_rows
        codes = [_codes(c) for c in batch.columns]
        differ = [np.concatenate([[True], c[1:] != c[:-1]]) for c in codes]
        first = tuple(c[0].as_py() for c in batch.columns)
        new_row = np.logical_or.reduce(differ)
        if self.last is not None:
            new_row[0] = first != self.last
        self.last = tuple(c[rows - 1].as_py() for c in batch.columns)
        placed = ~_nulls(batch.column(self.max_n + 3))
        change = differ[0]
        for d in range(1, self.max_n + 1):
            change = change | differ[d]
            there = ~_nulls(batch.column(d))
            starts = np.flatnonzero(change)
            run = np.cumsum(change) - 1
            weight = (new_row & there & placed).astype(np.int64)
            counts = np.add.reduceat(weight, starts)
            valid = there[starts]
            pairs = pa.table({"run": run[there], "r": batch.column(self.max_n + 1).filter(pa.array(there))})
            pairs = pairs.group_by(["run", "r"]).aggregate([])
            distinct = np.bincount(pairs["run"].to_numpy(), minlength=len(starts)) if len(pairs) else np.zeros(len(starts), np.int64)
            prefixes = pa.table({str(j): batch.column(j).take(pa.array(starts)) for j in range(d + 1)})
            held = self.open[d - 1]
            if held is not None:
                prefix, count, records = held
                if prefix == first[: d + 1]:
                    counts[0] += count
                    add_records(records, _records(pairs, 0))
                    if len(starts) > 1:  # it ends in this batch
                        distinct[0] = len(records_union(records))
                else:
                    self._pop(d, prefix, count, records)
            end = len(starts) - 1
            if valid[end]:
                mine = held[2] if end == 0 and held is not None and held[0] == first[: d + 1] else [_records(pairs, end)]
                self.open[d - 1] = (tuple(prefixes[str(j)][end].as_py() for j in range(d + 1)), int(counts[end]), mine)
            else:
                self.open[d - 1] = None
            closed = np.flatnonzero(valid[:end])
            if len(closed):
                self.out.append((prefixes.take(pa.array(closed)), counts[closed], distinct[closed]))

    def _pop(self, d: int, prefix: tuple, count: int, records: list) -> None:
        self.out.append((pa.table({str(j): [v] for j, v in enumerate(prefix)}), [count], [len(records_union(records))]))

    def close(self) -> None:
        for d, held in enumerate(self.open, 1):
            if held is not None:
                self._pop(d, *held)
        self.open = [None] * self.max_n

    def take(self, schema: pa.Schema):
        out, self.out = self.out, []
        for prefixes, counts, distinct in out:
            n = len(counts)
            cols = [prefixes[str(j)].combine_chunks().cast(schema.field(j).type) if str(j) in prefixes.column_names else pa.nulls(n, schema.field(j).type) for j in range(self.max_n + 1)]
            depth = pa.array(np.full(n, prefixes.num_columns - 1), pa.int32())
            cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols]
            yield pa.RecordBatch.from_arrays([*cols, depth, pa.array(counts, pa.int64()), pa.array(distinct, pa.int64())], schema=schema)


def records_union(records: list) -> pa.Array:
    """The distinct records of the chunks, which are replaced by them."""
    if len(records) > 1:
        records[:] = [pc.unique(pa.concat_arrays(records))]
    return records[0]


def add_records(records: list, more: pa.Array) -> None:
    """Adds a chunk; they are made distinct once the new ones outgrow the old, so each is looked at a few times in all."""
    records.append(more)
    if sum(map(len, records[1:])) > len(records[0]):
        records_union(records)


def _records(pairs: pa.Table, run: int) -> pa.Array:
    got = pairs["r"].filter(pc.equal(pairs["run"], run)).combine_chunks()
    return got.chunk(0) if isinstance(got, pa.ChunkedArray) else got


def _codes(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _nulls(column: pa.Array) -> np.ndarray:
    return column.is_null().to_numpy(zero_copy_only=False)


def ngram_counts(occurrences: DataFrame, max_n: int = 1, salts: int = SALTS, hot: list[int] | None = None) -> DataFrame:
    """(g, t1..tn, n, occurrences, records) of every n-gram of 1 to ``max_n`` terms of each group; see ``count_suffixes``."""
    return count_suffixes(suffixes(occurrences, max_n), max_n, salts, hot)


def hot_starts(rows: DataFrame, first: str = "t1") -> list[int]:
    """Hashes of the (group, first term) pairs that hold more than a quarter of a partition's fair share of the rows.

    One pass with a bounded sketch; there are at most four times as many as partitions. It decides only how the work is spread.
    """
    parts = partitions(rows.sparkSession)
    most = min(4 * parts, 2000)
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(xxhash64(g, {first}), {most}, {10 * most})").alias("top")).first()
    return [x["item"] for x in got["top"] or [] if x["count"] * 4 * parts > got["n"]]


def count_suffixes(rows: DataFrame, max_n: int, salts: int = SALTS, hot: list[int] | None = None) -> DataFrame:
    """(g, t1..tn, n, occurrences, records) from suffixes (g, r, s, p, t1..tn).

    Suffix-sorted counting: each occurrence gives one suffix of at most ``max_n`` terms; the
    suffixes are routed by group and first term, sorted in reverse lexicographic order, and a
    stack gives the count and record set of every prefix in one pass. Suffixes of a first term that very many
    begin with are routed by record too; record sets of different such salts are disjoint, so their
    counts are added up exactly. A repeated occurrence (same record, section, place) counts once;
    one of null place proves the record but counts as no occurrence of known place. Groups may
    be null and are then their own group. ``hot`` are the ``hot_starts``, where they are known.
    """
    ship(rows.sparkSession)
    kinds, terms = dict(rows.dtypes), [f"t{j}" for j in range(1, max_n + 1)]
    columns = ["g", *terms, "r", "s", "p"]
    schema = f"g {kinds['g']}, " + "".join(f"{t} string, " for t in terms) + "n int, occurrences bigint, records bigint"

    def run(batches):
        stack, out = PrefixStack(max_n), None
        for batch in batches:
            out = out or pa.schema([pa.field("g", batch.schema.field("g").type), *[pa.field(t, pa.string()) for t in terms], pa.field("n", pa.int32()), pa.field("occurrences", pa.int64()), pa.field("records", pa.int64())])
            if batch.num_rows:
                stack.feed(batch)
                yield from stack.take(out)
        stack.close()
        if out is not None:
            yield from stack.take(out)

    order = [F.desc_nulls_last(t) for t in terms]
    begins = F.xxhash64("g", "t1")
    hot = hot_starts(rows) if hot is None else hot
    cold = rows.where(~begins.isin(hot)) if hot else rows
    counts = cold.repartition("g", "t1").sortWithinPartitions("g", *order, "r", "s", "p").select(*columns).mapInArrow(run, schema)
    if not hot:
        return counts
    salted = rows.where(begins.isin(hot)).withColumn("salt", F.pmod(F.hash("r"), F.lit(max(salts, partitions(rows.sparkSession)))))
    parts = salted.repartition("g", "t1", "salt").sortWithinPartitions("g", *order, "salt", "r", "s", "p").select(*columns).mapInArrow(run, schema)
    return counts.unionByName(parts.groupBy("g", *terms, "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")))


def group_sizes(rows: DataFrame) -> DataFrame:
    """(g, total): distinct records of each group."""
    return rows.select("g", "r").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("total"))


def with_bands(counts: DataFrame, sizes: DataFrame, rare: int = 2, common_tenths: int = 6) -> DataFrame:
    """Adds total and band: rare up to ``rare`` records, else common above so many tenths of the group's records, else useful."""
    joined = counts.alias("c").join(sizes.alias("z"), F.expr("c.g <=> z.g")).select("c.*", "z.total")
    band = F.when(F.col("records") <= rare, "rare").when(F.col("records") * 10 > F.col("total") * common_tenths, "common").otherwise("useful")
    return joined.withColumn("band", band)
