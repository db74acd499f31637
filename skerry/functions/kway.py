"""K-way merge of sorted Arrow streams, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Cursor:
    """One sorted stream with its current block."""

    def __init__(self, blocks: Iterator[pa.Table], keys: list[str]):
        self.blocks, self.keys, self.block, self.at = blocks, keys, None, 0
        self.fill()

    def fill(self) -> bool:
        while self.block is None or self.at >= self.block.num_rows:
            self.block, self.at = next(self.blocks, None), 0
            if self.block is None:
                return False
        return True

    def key(self, row: int) -> tuple:
        return tuple(self.block[k][row].as_py() for k in self.keys)

    def take_to(self, frontier: tuple) -> pa.Table:
        """The rows of this block whose key is at most ``frontier``."""
        lo, hi = self.at, self.block.num_rows
        while lo < hi:
            mid = (lo + hi) // 2
            if self.key(mid) <= frontier:
                lo = mid + 1
            else:
                hi = mid
        out = self.block.slice(self.at, lo - self.at)
        self.at = lo
        return out


def merge_blocks(streams: list[Iterator[pa.Table]], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of all rows of the streams, each sorted by ``keys`` (not null); every key of a table is above those of the one before.

    All rows of a key come out in one table (which the caller sorts, by whatever it orders them further), so only a block of each stream, and the rows of
    the keys they share, are held. The frontier is the least of the blocks' last keys: all rows up to it are
    there, but rows of the frontier key itself may go on in later blocks, so those are
    gathered before it is given out.
    """
    cursors = [c for c in (Cursor(s, keys) for s in streams) if c.block is not None]
    while cursors:
        frontier = min(c.key(c.block.num_rows - 1) for c in cursors)
        parts = []
        live = []
        for c in cursors:
            more = True
            while more:
                parts.append(c.take_to(frontier))
                more = False
                if c.at >= c.block.num_rows:
                    if not c.fill():
                        break
                    more = c.key(0) <= frontier
            else:
                live.append(c)
        cursors = live
        yield pa.concat_tables([p for p in parts if p.num_rows])


def last_of_each(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Positions of the last row of each run of equal keys."""
    differ = np.zeros(table.num_rows, bool)
    differ[-1:] = True
    for k in keys:
        column = table[k].combine_chunks() if table[k].num_chunks != 1 else table[k].chunk(0)
        differ[:-1] |= pc.not_equal(column[:-1], column[1:]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(differ)
