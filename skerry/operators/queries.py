"""Queries of the training-data problems tagged general, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import change_feed, consolidate, incremental, schema_drift


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """(index_name, document_id, sequence_number) of the documents that exist after the last change."""
    state = change_feed.apply_feed(table(spark, folder, "wal_entries"))
    return state.read(["index_name", "document_id", "seq"]).withColumnRenamed("seq", "sequence_number")


def p3_state(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that exist at the end, each in its last form."""
    state = change_feed.apply_feed(table(spark, folder, "wal_entries")).read(["index_name", "document_id", "seq", "payload"])
    return state.select("index_name", "document_id", F.col("seq").alias("sequence_number"), change_feed.source_of(F.col("payload")).alias("source"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """(index_name, mapping_version, change_kind, field_name, old_name): the top-level changes of each version against the one before."""
    found = schema_drift.top_changes(schema_drift.changes(table(spark, folder, "segment_documents")))
    return found.select("index_name", F.col("version").alias("mapping_version"), "change_kind", "field_name", "old_name")


def p4_changes(spark: SparkSession, folder: str) -> DataFrame:
    """All changes that documents, log or mappings show, those within objects included, with the types before and after."""
    return schema_drift.all_changes(*(table(spark, folder, t) for t in ("segment_documents", "wal_entries", "index_metadata"))).drop("path", "old_path")


def p4_unified(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, of segments and log, in one table of one set of columns."""
    return schema_drift.unify(schema_drift.all_drift(*(table(spark, folder, t) for t in ("segment_documents", "wal_entries", "index_metadata"))))


def _consolidated(spark: SparkSession, folder: str) -> consolidate.Consolidated:
    return consolidate.consolidate(table(spark, folder, "segment_documents"), table(spark, folder, "index_metadata"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """(index_name, segment_number) of the segments that were too small and have been merged."""
    return consolidate.replaced(_consolidated(spark, folder))


def p5_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The new segments with their key ranges and sizes."""
    return _consolidated(spark, folder).segments


def p5_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Each index's documents and key range by the metadata of its segments after the merge."""
    return _consolidated(spark, folder).segments.groupBy("index_name").agg(F.sum("document_count").alias("documents"), F.min("first_document").alias("first_document"), F.max("last_document").alias("last_document"))


def p5_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document once, as the new segments hold it."""
    return _consolidated(spark, folder).documents.select("index_name", "document_id", "sequence_number", "source")


def _open_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of the pending items of a ledger that has taken over the journal of past runs; all of the journal's leases have run out."""
    return incremental.next_run(table(spark, folder, "wal_entries"), table(spark, folder, "flush_runs"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """(index_name, sequence_number) of the entries no run has processed."""
    return _open_entries(spark, folder).select("index_name", "sequence_number")


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """The open entries counted by log, newest generation and stretch of numbers. The ledger's items are those of ``p6_work``."""
    entries = _open_entries(spark, folder).drop("item").withColumnRenamed("stretch", "item")
    return entries.groupBy("item", "index_name").agg(F.count(F.lit(1)).alias("entries"), F.min("sequence_number").alias("first_number"), F.max("sequence_number").alias("last_number"))


def p6_work(spark: SparkSession, folder: str) -> DataFrame:
    """The next run's work items as a new ledger plans them, with their entries counted."""
    entries = _open_entries(spark, folder)
    return entries.groupBy("item", "index_name").agg(F.count(F.lit(1)).alias("entries"), F.min("sequence_number").alias("first_number"), F.max("sequence_number").alias("last_number"))


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p3_state, p4_found, p4_changes, p4_unified, p5_found, p5_segments, p5_sizes, p5_documents, p6_found, p6_items, p6_work)}


#: Rows whose record is a complete JSON object, with what it does and to which document.
CHANGES_SQL = """WITH good AS (SELECT *, CASE WHEN json_valid(record) AND json_type(record) = 'OBJECT' THEN CAST(record AS JSON) END AS j FROM wal_entries),
changes AS (SELECT index_name, sequence_number, entry_id, j,
  coalesce((j->>'$.document.id'), (j->>'$.document_id'), (j->>'$.index.id'), (j->>'$.delete.id'), (j->>'$.IndexDocument.document.id'), (j->>'$.DeleteDocument.document_id'), document_id) AS document_id,
  CASE WHEN (j->>'$.type') = 'index_document' OR (j->'$.index') IS NOT NULL OR (j->'$.IndexDocument') IS NOT NULL THEN 'index'
       WHEN (j->>'$.type') = 'delete_document' OR (j->'$.delete') IS NOT NULL OR (j->'$.DeleteDocument') IS NOT NULL THEN 'delete' END AS op
  FROM good WHERE j IS NOT NULL)"""
_DRIFT = r"""WITH seg AS (SELECT index_name, segment_number, max(mapping_version) AS v FROM segment_documents GROUP BY ALL),
d AS (SELECT DISTINCT s.index_name, coalesce(s.mapping_version, g.v) AS version, s.document_id, CASE WHEN json_valid(s.source) THEN CAST(s.source AS JSON) END AS j
  FROM segment_documents s LEFT JOIN seg g ON s.index_name = g.index_name AND s.segment_number = g.segment_number),
k AS (SELECT index_name, version, document_id, j, unnest(json_keys(j)) AS field FROM d WHERE version IS NOT NULL AND json_type(j) = 'OBJECT'),
v AS (SELECT index_name, version, document_id, field, json_extract(j, '$."' || field || '"') AS value FROM k),
t AS (SELECT *, CASE json_type(value)
    WHEN 'VARCHAR' THEN CASE WHEN regexp_full_match(value->>'$', '\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})') AND try_cast(value->>'$' AS TIMESTAMPTZ) IS NOT NULL THEN 'Timestamp' ELSE 'Keyword' END
    WHEN 'BIGINT' THEN CASE WHEN try_cast(value AS INTEGER) IS NULL THEN 'Long' ELSE 'Integer' END
    WHEN 'UBIGINT' THEN CASE WHEN try_cast(value AS INTEGER) IS NOT NULL THEN 'Integer' WHEN try_cast(value AS BIGINT) IS NOT NULL THEN 'Long' ELSE 'Double' END
    WHEN 'BOOLEAN' THEN 'Boolean' WHEN 'OBJECT' THEN 'Object' WHEN 'ARRAY' THEN 'Array' ELSE 'Double' END AS type
  FROM v WHERE json_type(value) <> 'NULL'),
n AS (SELECT index_name, version, field, type, count(*) AS c FROM t GROUP BY ALL),
f AS (SELECT index_name, version, field, arg_max(type, (c, type)) AS type FROM n GROUP BY ALL),
ver AS (SELECT DISTINCT index_name, version FROM d WHERE version IS NOT NULL),
step AS (SELECT * FROM (SELECT index_name, version, lag(version) OVER (PARTITION BY index_name ORDER BY version) AS previous FROM ver) WHERE previous IS NOT NULL),
cur AS (SELECT s.index_name, s.version, f.field, f.type FROM step s JOIN f ON f.index_name = s.index_name AND f.version = s.version),
old AS (SELECT s.index_name, s.version, f.field, f.type FROM step s JOIN f ON f.index_name = s.index_name AND f.version = s.previous),
gone AS (SELECT o.* FROM old o ANTI JOIN cur c ON o.index_name = c.index_name AND o.version = c.version AND o.field = c.field),
come AS (SELECT c.* FROM cur c ANTI JOIN old o ON o.index_name = c.index_name AND o.version = c.version AND o.field = c.field),
held AS (SELECT g.index_name, g.version, g.field, t.document_id, t.value FROM gone g JOIN step s ON g.index_name = s.index_name AND g.version = s.version
  JOIN t ON t.index_name = s.index_name AND t.version = s.previous AND t.field = g.field
  SEMI JOIN d ON d.index_name = s.index_name AND d.version = s.version AND d.document_id = t.document_id),
total AS (SELECT index_name, version, field, count(DISTINCT document_id) AS docs FROM held GROUP BY ALL),
same AS (SELECT h.index_name, h.version, h.field AS old_name, c.field AS field_name, count(DISTINCT h.document_id) AS docs
  FROM held h JOIN t ON t.index_name = h.index_name AND t.version = h.version AND t.document_id = h.document_id AND CAST(t.value AS VARCHAR) = CAST(h.value AS VARCHAR)
  JOIN come c ON c.index_name = t.index_name AND c.version = t.version AND c.field = t.field GROUP BY ALL),
renamed AS (SELECT s.index_name, s.version, s.field_name, s.old_name FROM same s JOIN total t ON t.index_name = s.index_name AND t.version = s.version AND t.field = s.old_name WHERE 2 * s.docs >= t.docs)
SELECT index_name, version AS mapping_version, 'renamed' AS change_kind, field_name, old_name FROM renamed
UNION ALL SELECT g.index_name, g.version, 'removed', g.field, '' FROM gone g ANTI JOIN renamed r ON r.index_name = g.index_name AND r.version = g.version AND r.old_name = g.field
UNION ALL SELECT c.index_name, c.version, 'added', c.field, '' FROM come c ANTI JOIN renamed r ON r.index_name = c.index_name AND r.version = c.version AND r.field_name = c.field
UNION ALL SELECT c.index_name, c.version, 'type_changed', c.field, '' FROM cur c JOIN old o ON o.index_name = c.index_name AND o.version = c.version AND o.field = c.field WHERE o.type <> c.type"""
_UNPROCESSED = """WITH good AS (SELECT index_name, generation, sequence_number, received_at FROM wal_entries WHERE json_valid(record) AND json_type(record) = 'OBJECT'),
runs AS (SELECT run_id, any_value(index_name) AS index_name, any_value(generation) AS generation, min(started_at) AS started_at,
  max(CASE WHEN lower(status) = 'committed' THEN last_sequence_number END) AS reach
  FROM flush_runs GROUP BY run_id
  HAVING bool_or(lower(status) = 'committed') AND NOT coalesce(bool_or(lower(status) = 'rolled_back'), false)),
later AS (SELECT index_name, generation, started_at, max(reach) OVER (PARTITION BY index_name, generation ORDER BY started_at DESC) AS reach FROM runs WHERE reach IS NOT NULL),
latest AS (SELECT DISTINCT * FROM later),
rows AS (SELECT g.index_name, g.generation, g.sequence_number, coalesce(l.reach >= g.sequence_number, false) AS processed
  FROM good g ASOF LEFT JOIN latest l ON g.index_name = l.index_name AND g.generation = l.generation AND g.received_at <= l.started_at),
open AS (SELECT index_name, sequence_number, max(generation) AS generation FROM rows GROUP BY ALL HAVING NOT bool_or(processed))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"""{CHANGES_SQL} SELECT index_name, document_id, max(sequence_number) AS sequence_number FROM changes
WHERE op IS NOT NULL AND document_id IS NOT NULL GROUP BY index_name, document_id HAVING arg_max(op, sequence_number) = 'index'""",
        "p3_state": f"""{CHANGES_SQL}, last AS (SELECT index_name, document_id, arg_max({{'op': op, 'seq': sequence_number, 'j': j}}, (sequence_number, entry_id)) AS c
  FROM changes WHERE op IS NOT NULL AND document_id IS NOT NULL GROUP BY ALL)
SELECT index_name, document_id, c.seq AS sequence_number, CAST(coalesce(c.j->'$.document.source', c.j->'$.index.source', c.j->'$.IndexDocument.document.source') AS VARCHAR) AS source
FROM last WHERE c.op = 'index'""",
        "p4_found": _DRIFT,
        "p5_found": """WITH sizes AS (SELECT index_name, segment_number, count(DISTINCT document_id) AS size FROM segment_documents GROUP BY ALL),
limits AS (SELECT index_name, max(merge_threshold_docs) AS threshold FROM index_metadata GROUP BY ALL),
small AS (SELECT index_name, segment_number FROM sizes LEFT JOIN limits USING (index_name) WHERE size >= 1 AND size < coalesce(threshold, 8))
SELECT index_name, segment_number FROM small WHERE index_name IN (SELECT index_name FROM small GROUP BY ALL HAVING count(*) >= 2)""",
        "p5_sizes": """SELECT index_name, count(DISTINCT document_id) AS documents, min(document_id) AS first_document, max(document_id) AS last_document
FROM segment_documents GROUP BY index_name""",
        "p5_documents": """SELECT index_name, document_id, v.sequence_number AS sequence_number, v.source AS source FROM (
SELECT index_name, document_id, max({'sequence_number': sequence_number, 'written_at': written_at, 'segment_number': segment_number, 'mapping_version': coalesce(mapping_version, -1), 'source': source}) AS v
FROM segment_documents GROUP BY ALL)""",
        "p6_found": f"{_UNPROCESSED} SELECT index_name, sequence_number FROM open",
        "p6_items": f"""{_UNPROCESSED}, named AS (SELECT *, index_name || '_' || coalesce(generation::VARCHAR, 'none') || '_' || printf('%012d', CAST(floor(sequence_number / 10000) AS BIGINT)) AS item FROM open)
SELECT item, index_name, count(*) AS entries, min(sequence_number) AS first_number, max(sequence_number) AS last_number FROM named GROUP BY ALL""",
        "p6_work": f"""{_UNPROCESSED}, items AS (SELECT index_name, count(*) AS entries, min(sequence_number) AS first_number, max(sequence_number) AS last_number,
  sha256(string_agg(CAST(sequence_number AS VARCHAR), ',' ORDER BY sequence_number)) AS digest FROM open GROUP BY index_name, floor(sequence_number / 10000))
SELECT url_encode(index_name) || '_' || printf('%012d', first_number) || '_' || printf('%012d', last_number) || '_' || substr(digest, 1, 32) AS item, index_name, entries, first_number, last_number FROM items""",
    }
