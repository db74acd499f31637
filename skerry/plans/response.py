"""Responses in the shape search clients know."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ast, dsl
from .errors import NotFound, SearchError


def value(v: Any) -> Any:
    return v.isoformat() + "Z" if hasattr(v, "isoformat") else v


def search_response(index: Any, request: ast.Request, source: str | None = None, highlight: bool = False) -> dict:
    """Runs the request and gives the response as a dict; ``source`` names a column of JSON text to take ``_source`` from."""
    from ..operators.search import search

    result = search(index, request, highlight)
    fields = list(index.mapping)
    hits = []
    # at most MAX_SIZE hits unless size is left open; then as many as the response is asked to hold, a partition at a time
    for r in result.hits.toLocalIterator() if request.size is None else result.hits.collect():
        row = r.asDict(recursive=True)
        body = json.loads(row[source]) if source else {f: value(row[f]) for f in fields if row.get(f) is not None}
        hit = {"_id": row["_id"], "_score": row["_score"], "_source": body}
        if request.sort is not None:
            hit["sort"] = json.loads(row["_sort"])
        if row.get("_highlight"):
            hit["highlight"] = row["_highlight"]
        hits.append(hit)
    aggs = {}
    for (name, agg), df in zip(request.aggregations, result.aggregations.values()):
        # the buckets are the response's own size; they come a partition at a time
        rows = [r.asDict() for r in df.toLocalIterator()]
        aggs[name] = rows[0] if isinstance(agg, ast.StatsAgg) else {"buckets": rows}
    total = result.total()
    result.matches.unpersist()
    out = {"hits": {"total": {"value": total, "relation": "eq"}, "hits": hits}}
    return out | ({"aggregations": aggs} if aggs else {})


def multi_search(spark: SparkSession, indexes: dict[str, Any], items: list[tuple[str, dict]]) -> DataFrame:
    """(item, status, _id, _score) of the pages of several requests; a failed one has its status and no hit."""
    from ..operators.search import search

    schema = "item int, status int, _id string, _score double"
    out = None
    for i, (name, body) in enumerate(items):
        try:
            if name not in indexes:
                raise NotFound(name)
            hits = search(indexes[name], dsl.request(body)).hits
            one = hits.select(F.lit(i).alias("item"), F.lit(200).alias("status"), "_id", "_score")
        except SearchError as e:
            one = spark.createDataFrame([(i, e.status, None, None)], schema)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], schema)
