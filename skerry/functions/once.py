"""Keeping an expensive expression from being copied."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def computed_once(c: Column) -> Column:
    """The same value, as a column that counts as nondeterministic.

    A filter on a computed column is pushed below its projection with the expression copied
    into it, and computed again there and wherever it is used above. That isn't done to nondeterministic columns.
    """
    return F.when(F.spark_partition_id() >= 0, c)
