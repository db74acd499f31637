"""Problem 8: filling containers of a fixed number of tokens with texts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .bpe import worker_cache
from .tokenize import BYTE_LEVEL_PATTERN, text_slices, vocabulary_path

CAPACITY = 2048
#: Rows per group on average. A group is packed in one task; its size doesn't grow with the data.
GROUP_ROWS = 4096


class Tournament:
    """Remaining room of bins at the leaves, the larger of two children at each inner node."""

    def __init__(self, capacity: int, bins: int):
        self.leaves = 1 << max(0, math.ceil(math.log2(max(bins, 1))))
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for ``size``; it loses that room."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        room[node] -= size
        leaf = node - self.leaves
        while node > 1:
            node //= 2
            larger = max(room[2 * node], room[2 * node + 1])
            if room[node] == larger:
                break
            room[node] = larger
        return leaf


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, by falling size and then by position; no item exceeds the capacity."""
    order = np.argsort(-sizes, kind="stable")
    # bins in use never exceed the items, nor twice the total size over the capacity plus one
    tree = Tournament(capacity, min(len(sizes), int(2 * sizes.sum() // max(capacity, 1)) + 1))
    out = np.empty(len(sizes), np.int64)
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        out[i] = tree.place(size)
    return out


def pieces_by_tokens(df: DataFrame, key: str, text: str, capacity: int, path: str, pattern: str) -> DataFrame:
    """(key, row, piece, token_start, n_tokens): a row per text, or per capacity-sized stretch of a text above it."""
    kind = df.schema[key].dataType

    def run(batches):
        cache = worker_cache(path, pattern)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in text_slices(texts):
                total = np.fromiter((cache.count[c].sum() for c in cache.codes(texts[lo:hi])), np.int64, hi - lo)
                cache.release()
                n = np.maximum(1, -(-total // capacity))
                row = np.repeat(np.arange(lo, hi), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                size = np.minimum(np.repeat(total, n) - start, capacity)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int32())],
                    ["k", "row", "piece", "token_start", "n_tokens"],
                )

    # the row number tells repeated keys apart, so that no key can make one group large
    source = df.select(df[key].alias("k"), F.monotonically_increasing_id().alias("row"), df[text].cast("string").alias("t"))
    return source.mapInArrow(run, f"k {kind.simpleString()}, row bigint, piece int, token_start bigint, n_tokens int")


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, seed: int = 17, vocabulary: str | None = None, pattern: str = BYTE_LEVEL_PATTERN) -> DataFrame:
    """(container, key, piece, token_start, n_tokens): where each text goes.

    First-fit decreasing with a tournament tree of the bins' room, run in random groups of
    about ``group_rows`` texts, so a task's work doesn't grow with the data and each group
    leaves at most its last bins unfilled. A text above ``capacity`` tokens is divided into
    full stretches and a rest; no other text is divided. Null and empty texts have 0 tokens
    and go to a container like any other, so each row is assigned. Repeated rows are separate
    items. An empty table gives no rows. ``container`` is group * 2^32 + bin.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least one token")
    ship(df.sparkSession)
    groups = max(1, math.ceil(df.count() / group_rows))
    kind = df.schema[key].dataType.simpleString()
    items = pieces_by_tokens(df, key, text, capacity, vocabulary or vocabulary_path(), pattern)
    items = items.withColumn("g", F.pmod(F.xxhash64("k", "row", "piece", F.lit(seed)), F.lit(groups)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_tokens", "k", "row", "piece"], ascending=[False, True, True, True], kind="stable")
        part["container"] = part["g"].astype("int64") * 2**32 + first_fit_decreasing(part["n_tokens"].to_numpy(np.int64), capacity)
        return part[["container", "k", "piece", "token_start", "n_tokens"]]

    out = items.groupBy("g").applyInPandas(run, f"container bigint, k {kind}, piece int, token_start bigint, n_tokens int")
    return out.withColumnRenamed("k", key)
