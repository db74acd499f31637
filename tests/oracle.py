"""Comparing a query with its SQL on the same tables."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
from collections import Counter

import duckdb
import numpy as np
import pandas as pd


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return repr(round(float(v), 6))
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, (datetime.datetime, pd.Timestamp)):
        return pd.Timestamp(v).isoformat()
    return str(v)


def agrees(spark, folder, query, sql):
    """The query runs, and where there is SQL both give the same rows under the same names."""
    df = query(spark, folder)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if sql is None:
        return
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    found = con.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
