"""Problem 7: token ids of every text by a public tokenizer."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship
from .bpe import worker_cache

#: Where the public vocabularies lie, by default, and the word pattern that belongs to the byte-level ones.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k"
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are encoded in slices of about this many characters, which bounds a worker's memory.
SLICE_CHARS = 2_000_000


def vocabulary_path(name: str = BYTE_BPE_50K, folder: str | None = None) -> str:
    return os.path.join(folder or os.environ.get("SKERRY_TOKENIZERS", TOKENIZERS), f"{name}.tiktoken")


def text_slices(texts: list[str | None], limit: int = SLICE_CHARS):
    """(start, stop) ranges of the list with about ``limit`` characters each, at least one text."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str = BYTE_LEVEL_PATTERN) -> DataFrame:
    """(key, ids): the ids of each row's text, without special tokens.

    Null and empty texts have the empty list; a text of blanks is encoded like any
    other. Every row comes out once, repeated keys and null keys included. Strings that
    spell a special token are ordinary text. Other columns are ignored.
    """
    ship(df.sparkSession)
    path = vocabulary or vocabulary_path()
    kind = df.schema[key].dataType

    def run(batches):
        cache = worker_cache(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in text_slices(texts):
                codes = cache.codes(texts[lo:hi])
                sizes = np.fromiter((cache.count[c].sum() for c in codes), np.int64, len(codes))
                flat = cache.token_ids(np.concatenate(codes))
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids], ["k", "ids"])
                cache.release()

    source = df.select(df[key].alias("k"), df[text].cast("string").alias("t"))
    out = source.mapInArrow(run, f"k {kind.simpleString()}, ids array<int>")
    return out.withColumnRenamed("k", key)
