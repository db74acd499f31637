"""Registered queries of the index store and of streams."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Api
from .operators.search import matches
from .plans import dsl
from .session import scratch_path
from .sources.store import Index, Settings, Store
from .sources.tables import table
from .streaming.ingest import histogram, ingest


def _new(spark: SparkSession, name: str, settings: Settings | None = None) -> Index:
    store = Store(spark, scratch_path(spark, "store"))
    store.create_index(name, settings)
    return store.open(name)


def _order_ops(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in order of their key as writes of their customer, finished ones as deletes."""
    source = F.to_json(F.struct(F.col("o_orderkey").alias("order"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority")))
    o = table(spark, folder, "orders")
    return o.select(F.col("o_orderkey").alias("position"), F.when(F.col("o_orderstatus") == "F", "delete").otherwise("index").alias("op"), F.col("o_custkey").cast("string").alias("id"), source.alias("source"))


def bulk_last_write_wins(spark: SparkSession, folder: str) -> DataFrame:
    index = _new(spark, "customers")
    index.bulk_frame(_order_ops(spark, folder))
    index.refresh()
    return index.searchable().select("_id", "order", "price", "priority")


def flush_and_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The same in two flushed halves and an unflushed rest, merged."""
    index = _new(spark, "customers")
    ops = _order_ops(spark, folder)
    for part in range(3):
        index.bulk_frame(ops.where(F.col("position") % 3 == part).withColumn("position", F.col("position")))
        index.refresh()
        if part < 2:
            index.flush()
    index.merge()
    return index.searchable().select("_id", "order", "price", "priority")


def snapshot_restore(spark: SparkSession, folder: str) -> DataFrame:
    """A snapshot restored after everything has been deleted."""
    index = _new(spark, "customers")
    ops = _order_ops(spark, folder)
    index.bulk_frame(ops)
    index.create_snapshot("before")
    index.bulk_frame(ops.groupBy("id").agg(F.max("position").alias("position")).select("position", F.lit("delete").alias("op"), "id", F.lit(None).cast("string").alias("source")))
    index.merge()
    index.restore_snapshot("before")
    return index.searchable().select("_id", "order", "price", "priority")


def retention(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the last seven days before a fixed time."""
    index = _new(spark, "events", Settings(primary_time_field="ts", retention_secs=7 * 86400))
    source = F.to_json(F.struct("event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), "user_id"))
    index.bulk_frame(table(spark, folder, "events").select(F.col("event_id").alias("position"), F.lit("index").alias("op"), F.col("event_id").cast("string").alias("id"), source.alias("source")))
    index.refresh()
    now = datetime(2024, 1, 20, tzinfo=timezone.utc)
    return matches(index.search_index(now), dsl.query({"term": {"event_type": "error"}})).select("_id", "user_id")


def mapping_inference(spark: SparkSession, folder: str) -> DataFrame:
    """The mapping the writes of the log leave; types are those of each field's first document."""
    index = _new(spark, "log")
    from .operators.change_feed import log_changes, source_of

    writes = log_changes(table(spark, folder, "wal_entries")).where("not deleted")
    index.bulk_frame(writes.select(F.col("tie").alias("position"), F.lit("index").alias("op"), F.col("document_id").alias("id"), source_of(F.col("payload")).alias("source")))
    return spark.createDataFrame(sorted(index.mapping.items()), "field string, type string")


def get_document(spark: SparkSession, folder: str) -> DataFrame:
    """One document straight after it was written, not refreshed."""
    index = _new(spark, "customers")
    c = table(spark, folder, "customer")
    source = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")))
    index.bulk_frame(c.select(F.col("c_custkey").alias("position"), F.lit("index").alias("op"), F.col("c_custkey").cast("string").alias("id"), source.alias("source")))
    doc = index.get_document("42")
    return spark.createDataFrame([("42", doc["name"], doc["segment"])], "_id string, name string, segment string")


def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """The orders' operations as a stream of files into an index."""
    index, path = _new(spark, "customers"), scratch_path(spark, "stream")
    ops = _order_ops(spark, folder)
    # two files, the later orders in the second
    middle = ops.agg(F.percentile_approx("position", 0.5)).first()[0]
    ops.where(F.col("position") <= middle).coalesce(1).write.mode("append").parquet(f"{path}/in")
    ops.where(F.col("position") > middle).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    ingest(stream, index, f"{path}/checkpoint", f"s{abs(hash(path))}").awaitTermination()
    return index.searchable().select("_id", "order", "price", "priority")


def stream_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counts of the events as a stream, without the days still open at its end."""
    path = scratch_path(spark, "histogram")
    e = table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    e.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{path}/in")
    out = histogram(stream, "ts", "1 day", "1 hour").writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("key string, doc_count bigint").parquet(f"{path}/out")


def service_life(spark: SparkSession, folder: str) -> DataFrame:
    """An index's life by the service's calls, each with its status and what its response says."""
    api = Api(Store(spark, scratch_path(spark, "store")))
    nations = table(spark, folder, "nation").orderBy("n_nationkey").collect()  # a fixed small table
    docs = [{"index": {"id": str(r["n_nationkey"]), "source": {"name": r["n_name"], "region": r["n_regionkey"], "ts": r["n_nationkey"] * 1000}}} for r in nations]
    calls = [
        ("PUT", "/nations", {"settings": {"primary_time_field": "ts"}}, lambda b: b["name"]), ("PUT", "/nations", None, None), ("PUT", "/Bad", None, None), ("GET", "/nations", None, lambda b: b["settings"]["primary_time_field"]), ("GET", "/none", None, None),
        ("POST", "/nations/_bulk", {"operations": docs}, lambda b: len(b["items"])), ("POST", "/nations/_refresh", None, lambda b: b["refreshed_operations"]), ("GET", "/nations/_doc/3", None, lambda b: b["_source"]["name"]), ("GET", "/nations/_doc/x", None, lambda b: b["found"]),
        ("POST", "/nations/_doc", {"id": "1"}, None), ("POST", "/nations/_flush", None, lambda b: b["flushed_documents"]), ("GET", "/nations/_search?q=region:1", None, lambda b: b["hits"]["total"]["value"]), ("GET", "/nations/_search", None, None),
        ("POST", "/nations/_search", {"sort": {"name": {"order": "desc"}}, "size": 2}, lambda b: ",".join(h["_id"] for h in b["hits"]["hits"])), ("POST", "/nations/_search", {"query": {"x": 1}}, None),
        ("POST", "/nations/_suggest", {"prefix": "NATION_1", "fields": {"name": 1}, "size": 50}, lambda b: len(b["suggestions"])), ("POST", "/nations/_snapshot/b", None, lambda b: b["documents"]), ("POST", "/nations/_snapshot/a", None, lambda b: b["documents"]), ("POST", "/nations/_snapshot/a", None, None),
        ("GET", "/nations/_snapshot", None, lambda b: ",".join(x["name"] for x in b["snapshots"])), ("GET", "/nations/_snapshot/b", None, lambda b: b["documents"]), ("DELETE", "/nations/_snapshot/b", None, None), ("GET", "/nations/_snapshot/b", None, None),
        ("PUT", "/nations/_settings", {"retention_secs": 3600}, lambda b: b["settings"]["retention_secs"]), ("evict", None, None, None), ("POST", "/nations/_snapshot/a/_restore", None, lambda b: b["documents"]), ("POST", "/_msearch", {"requests": [{"index": "nations"}, {"index": "none"}]}, lambda b: ",".join(str(r["status"]) for r in b["responses"])),
        ("GET", "/_health", None, lambda b: b["status"]), ("DELETE", "/nations", None, None), ("GET", "/nations", None, None),
    ]
    rows = []
    for step, (method, path, body, says) in enumerate(calls):
        if method == "evict":
            rows.append((step, 200, str(api.store.open("nations").evict(datetime.fromtimestamp(13_600, timezone.utc)))))
            continue
        status, answer = api.request(method, path, body)
        rows.append((step, status, str(says(answer)) if says else None))
    return spark.createDataFrame(rows, "step int, status int, says string")


def queries() -> dict:
    return {f.__name__: f for f in (bulk_last_write_wins, flush_and_merge, snapshot_restore, retention, mapping_inference, get_document, stream_ingest, stream_histogram, service_life)}


def oracle_sql() -> dict[str, str]:
    last = """SELECT _id, "order", price, priority FROM (SELECT CAST(o_custkey AS VARCHAR) AS _id, max({'k': KEY, 's': o_orderstatus, 'o': o_orderkey, 'p': o_totalprice, 'r': o_orderpriority}) AS m FROM orders GROUP BY ALL)
, LATERAL (SELECT m.o AS "order", m.p AS price, m.r AS priority) WHERE m.s <> 'F'"""
    by_order = last.replace("KEY", "o_orderkey")
    from .operators.queries import CHANGES_SQL

    types = f"""{CHANGES_SQL}, w AS (SELECT entry_id, coalesce(j->'$.document.source', j->'$.index.source', j->'$.IndexDocument.document.source') AS s FROM changes WHERE op = 'index' AND document_id IS NOT NULL),
k AS (SELECT entry_id, s, unnest(json_keys(s)) AS field FROM w), v AS (SELECT entry_id, field, json_extract(s, '$."' || field || '"') AS value FROM k),
t AS (SELECT entry_id, field, CASE json_type(value)
    WHEN 'VARCHAR' THEN CASE WHEN (value->>'$') LIKE '____-__-__T__:__:__%' AND try_cast(value->>'$' AS TIMESTAMPTZ) IS NOT NULL THEN 'Timestamp' ELSE 'Keyword' END
    WHEN 'BOOLEAN' THEN 'Boolean' WHEN 'OBJECT' THEN 'Object' WHEN 'DOUBLE' THEN 'Double'
    ELSE CASE WHEN try_cast(value AS INTEGER) IS NOT NULL THEN 'Integer' WHEN try_cast(value AS BIGINT) IS NOT NULL THEN 'Long' ELSE 'Double' END END AS type
  FROM v WHERE json_type(value) NOT IN ('NULL', 'ARRAY'))
SELECT field, arg_min(type, entry_id) AS type FROM t GROUP BY field"""
    return {
        "mapping_inference": types,
        "service_life": """SELECT CAST(step AS INTEGER) AS step, CAST(status AS INTEGER) AS status, says FROM (SELECT unnest([
  {'step': 0, 'status': 201, 'says': 'nations'}, {'step': 1, 'status': 409, 'says': NULL}, {'step': 2, 'status': 400, 'says': NULL}, {'step': 3, 'status': 200, 'says': 'ts'}, {'step': 4, 'status': 404, 'says': NULL},
  {'step': 5, 'status': 200, 'says': n}, {'step': 6, 'status': 200, 'says': n}, {'step': 7, 'status': 200, 'says': third}, {'step': 8, 'status': 404, 'says': 'False'}, {'step': 9, 'status': 400, 'says': NULL},
  {'step': 10, 'status': 200, 'says': n}, {'step': 11, 'status': 200, 'says': ones}, {'step': 12, 'status': 400, 'says': NULL}, {'step': 13, 'status': 200, 'says': last}, {'step': 14, 'status': 400, 'says': NULL},
  {'step': 15, 'status': 200, 'says': begins}, {'step': 16, 'status': 201, 'says': n}, {'step': 17, 'status': 201, 'says': n}, {'step': 18, 'status': 409, 'says': NULL}, {'step': 19, 'status': 200, 'says': 'b,a'},
  {'step': 20, 'status': 200, 'says': n}, {'step': 21, 'status': 200, 'says': NULL}, {'step': 22, 'status': 404, 'says': NULL}, {'step': 23, 'status': 200, 'says': '3600'}, {'step': 24, 'status': 200, 'says': old},
  {'step': 25, 'status': 200, 'says': n}, {'step': 26, 'status': 200, 'says': '200,404'}, {'step': 27, 'status': 200, 'says': 'ok'}, {'step': 28, 'status': 200, 'says': NULL}, {'step': 29, 'status': 404, 'says': NULL}], recursive := true)
FROM (SELECT CAST(count(*) AS VARCHAR) AS n, max(CASE WHEN n_nationkey = 3 THEN n_name END) AS third, CAST(count(*) FILTER (n_regionkey = 1) AS VARCHAR) AS ones,
  array_to_string(list(CAST(n_nationkey AS VARCHAR) ORDER BY n_name DESC)[1:2], ',') AS last, CAST(count(*) FILTER (starts_with(n_name, 'NATION_1')) AS VARCHAR) AS begins, CAST(count(*) FILTER (n_nationkey * 1000 + 3600 <= 13600) AS VARCHAR) AS old FROM nation))""",
        "bulk_last_write_wins": by_order,
        "flush_and_merge": last.replace("KEY", "(o_orderkey % 3) * 1000000000 + o_orderkey"),
        "snapshot_restore": by_order,
        "stream_ingest": by_order,
        "retention": "SELECT CAST(event_id AS VARCHAR) AS _id, user_id FROM events WHERE event_type = 'error' AND ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-20'",
        "get_document": "SELECT CAST(c_custkey AS VARCHAR) AS _id, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey = 42",
        "stream_histogram": """SELECT strftime(d, '%Y-%m-%dT%H:%M:%SZ') AS key, count(*) AS doc_count FROM (SELECT date_trunc('day', ts) AS d FROM events)
WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""",
    }
