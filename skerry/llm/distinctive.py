"""Problem 2: how characteristic each term is of its record, by a parsimonious language model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, ship

#: Least share of a record's own model in the mixture with its group's. EM ends for a record when no probability of it moves by more.
OWN_SHARE, TOLERANCE = 0.3, 1e-9
#: A term with more than so many occurrences in the record for each record of the group that holds it is never put down to the group altogether.
KEPT = 0.25
#: Classes that are worked on at once.
BLOCK = 200_000


def expectation_maximisation(tf: np.ndarray, background: np.ndarray, n: np.ndarray, start: np.ndarray, share: float | np.ndarray = OWN_SHARE, tolerance: float = TOLERANCE, rounds: int | None = None) -> np.ndarray:
    """Converged probability of each class's terms in their record.

    A class is ``n`` terms of one record with equal frequency and background; records are
    stretches beginning at ``start``, with one ``share`` for all or one each. A round takes the expected own occurrences of every
    term under the present model and makes of them the next model. Plain rounds end slowly
    where a term's probability falls to 0, so after each round the model jumps to the limit
    that all further rounds have while the same terms keep a probability: ``tf / m - c * background`` with c = (1 - share) / share and
    m such that they sum to 1; terms for which that isn't positive have 0 from then on. As m only grows when terms
    leave, none of them comes back, and a record ends after at most as many rounds as it has classes. It leaves
    the block when a round moves none of its probabilities by more than ``tolerance``; so no record's result depends on others.
    With ``rounds`` exactly so many plain rounds are made.
    """
    lengths = np.diff(np.append(start, len(tf)))
    seg = np.repeat(np.arange(len(start)), lengths)
    tf = tf.astype(np.float64)
    share = np.broadcast_to(np.asarray(share, np.float64), len(start))
    rest = ((1 - share) / share)[seg] * background
    p = tf / np.add.reduceat(tf * n, start)[seg]
    if rounds is not None:
        for _ in range(rounds):
            expected = tf * p / (rest + p)
            p = expected / np.add.reduceat(expected * n, start)[seg]
        return np.where(p < 1e-12, 0.0, p)
    out, where = np.empty(len(tf)), np.arange(len(tf))
    weight, at, most = n.astype(np.float64), start, int(lengths.max()) + 2
    for _ in range(most):
        expected = tf * p / (rest + p)
        q = expected / np.add.reduceat(expected * weight, at)[seg]
        going = np.maximum.reduceat(np.abs(q - p), at) > tolerance
        ended = ~going[seg]
        out[where[ended]] = p[ended]
        if not going.any():
            return out
        live = going[seg]
        tf, rest, weight, where, q, seg = tf[live], rest[live], weight[live], where[live], q[live], seg[live]
        at = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        seg = np.cumsum(np.append(False, seg[1:] != seg[:-1]))
        held = weight * (q > 0)
        m = np.add.reduceat(held * tf, at) / (1 + np.add.reduceat(held * rest, at))
        p = np.where(q > 0, np.maximum(tf / m[seg] - rest, 0.0), 0.0)
    raise ArithmeticError(f"no end of EM after {most} rounds")


def term_statistics(occurrences: DataFrame) -> DataFrame:
    """(g, r, t, tf, df, size): a row per record and term, with the term's records in the group, and the group's rows.

    Frequencies are distinct (section, place) pairs; a term without a known place counts as once.
    """
    # the place must not be null, or the pair would not count
    place = F.struct(F.col("s"), F.col("p"))
    tf = occurrences.groupBy("g", "r", "t").agg(F.greatest(F.count_distinct(F.when(F.col("p").isNotNull(), place)), F.lit(1)).alias("tf"))
    # written, as the counts below and the join read it
    path = scratch_path(tf.sparkSession, "term-frequencies")
    tf.write.parquet(path)
    tf = tf.sparkSession.read.parquet(path)
    term = tf.groupBy("g", "t").agg(F.count(F.lit(1)).alias("df"))
    size = term.groupBy("g").agg(F.sum("df").alias("size"))
    return (
        tf.alias("a")
        .join(term.alias("b"), F.expr("a.g <=> b.g and a.t = b.t"))
        .select("a.*", "b.df")
        .alias("a")
        .join(size.alias("z"), F.expr("a.g <=> z.g"))
        .select("a.*", "z.size")
    )


def own_share(record_size: np.ndarray, size: np.ndarray, share: float = OWN_SHARE, kept: float = KEPT) -> np.ndarray:
    """The share of each record's own model: ``share``, and more where the record is so large a part of its group that the
    group's model could take a term with tf > ``kept`` * df.

    With c = (1 - share) / share such a term keeps a probability if tf / background = size * tf / df is above c times the record's
    occurrences, and size * kept is at least that where c <= kept * size / occurrences.
    """
    c = np.minimum((1 - share) / share, kept * size / np.maximum(record_size, 1))
    return 1 / (1 + c)


def scores(statistics: DataFrame, share: float = OWN_SHARE, tolerance: float = TOLERANCE, kept: float = KEPT) -> DataFrame:
    """``statistics`` with ``score``: the probability of the term in the record's own model.

    The group's model is each term's share of the group's (record, term) pairs, so what many records say
    counts little, however often one of them says it. EM treats terms of one record with equal tf and df alike, so they are merged into one
    weighted class before they are gathered by record: a record's classes grow far slower
    than its terms. Records are then worked on in blocks of many at once. A score of 0 says
    that the group's model explains the term; a term with tf > ``kept`` * df never has 0 (see ``own_share``).
    """
    spark = statistics.sparkSession
    ship(spark)
    kinds = dict(statistics.dtypes)
    # read for the classes and for the terms
    path = scratch_path(spark, "term-statistics")
    statistics.write.parquet(path)
    statistics = spark.read.parquet(path)
    classes = statistics.groupBy("g", "r", "tf", "df", "size").agg(F.count(F.lit(1)).alias("n"))
    schema = f"g {kinds['g']}, r {kinds['r']}, tf bigint, df bigint, score double"

    def solve(table: pa.Table):
        same = np.ones(table.num_rows, bool)
        for name in ("g", "r"):
            c = table[name].combine_chunks().dictionary_encode(null_encoding="encode")
            c = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c).indices.to_numpy(zero_copy_only=False)
            same[1:] &= c[1:] == c[:-1]
        same[0] = False
        tf, df, size, n = (table[x].to_numpy() for x in ("tf", "df", "size", "n"))
        start = np.flatnonzero(~same)
        own = own_share(np.add.reduceat(tf * n, start), size[start], share, kept)
        p = expectation_maximisation(tf, df / size, n, start, own, tolerance)
        yield from table.select(["g", "r", "tf", "df"]).append_column("score", pa.array(p)).combine_chunks().to_batches()

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < BLOCK:
                continue
            table = pa.Table.from_batches(held)
            last = tuple(table[x][rows - 1].as_py() for x in ("g", "r"))
            # the last record may go on in the next batch
            cut = rows
            lo, hi = 0, rows - 1
            key = lambda i: tuple(table[x][i].as_py() for x in ("g", "r"))
            while lo < hi:  # rows of equal keys are together, the last record's at the end
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if key(mid) == last else (mid + 1, hi)
            cut = lo
            if cut:
                yield from solve(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            rows -= cut
        if rows:
            yield from solve(pa.Table.from_batches(held))

    solved = classes.repartition("g", "r").sortWithinPartitions("g", "r", "tf", "df").select("g", "r", "tf", "df", "size", "n").mapInArrow(run, schema)
    return (
        statistics.alias("a")
        .join(solved.alias("b"), F.expr("a.g <=> b.g and a.r = b.r and a.tf = b.tf and a.df = b.df"))
        .select("a.*", "b.score")
    )
