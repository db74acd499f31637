"""Problem 3: a table's state from a feed of inserts, updates and deletes, by a log-structured merge.

A feed is appended as sorted runs: within a run only the last change of a key is kept, rows
lie in buckets of the key's hash, and each bucket is one file sorted by key. A read merges a
bucket's files of all runs, newest change of a key first, and leaves out tombstones; no
shuffle is needed, whatever the number of runs. Compaction merges all runs into one.

The list of runs is a numbered manifest, of which a new version is created exclusively: a
writer that dies at any point leaves the runs before or after its change, and two writers
don't lose each other's runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..files import Versions
from ..functions import change_records as cr
from ..functions.kway import last_of_each, merge_blocks
from ..session import hadoop_path, partitions, scratch_path, ship

BLOCK_ROWS = 16_384


class LogStructuredTable:
    """Runs of changes under ``path``; rows are ``key`` columns, ``seq``, ``tie``, ``deleted`` and ``payload``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int | None = None, compact_at: int = 8):
        self.spark, self.path, self.keys, self.compact_at = spark, path.rstrip("/"), keys, compact_at
        self.versions = Versions(spark, f"{self.path}/manifest")
        # the number of buckets is settled before the first run, so all writers agree on it
        self._take(self.versions.change(lambda state: None if state else {"buckets": buckets or partitions(spark), "runs": [], "retired": [], "schema": None}))

    def _take(self, state: dict) -> None:
        self.buckets, self.runs = state["buckets"], state["runs"]
        self.schema = T.StructType.fromJson(state["schema"]) if state["schema"] else None

    def reload(self) -> "LogStructuredTable":
        """Takes in what other writers have done since."""
        self._take(self.versions.latest()[1])
        return self

    @staticmethod
    def _new_run() -> str:
        # a name of its own: what a writer that died has left under another is never read
        return f"run-{uuid.uuid4().hex}"

    def _write(self, rows: DataFrame) -> str:
        run = self._new_run()
        # Spark's own hash of the keys: with as many buckets as shuffle partitions (or a multiple) a bucket lies in one task
        bucket = F.pmod(F.hash(*self.keys), F.lit(self.buckets))
        rows.withColumn("bucket", bucket).sortWithinPartitions("bucket", *self.keys).write.partitionBy("bucket").parquet(f"{self.path}/{run}")
        return run

    # -- writing ----------------------------------------------------------------------------

    def append(self, changes: DataFrame) -> None:
        """Adds ``changes`` as a run.

        A run keeps, per key, the change of the highest (seq, tie): copies and overtaken changes
        end on the map side, before the shuffle, so a key with a large share of the feed sends
        at most one row per map task. Rows of null key or seq name no change and are left out.
        """
        value = F.struct("seq", "tie", "deleted", "payload")
        known = changes.where(" and ".join(f"`{k}` is not null" for k in [*self.keys, "seq"]))
        last = known.groupBy(*self.keys).agg(F.max(value).alias("v")).select(*self.keys, "v.*")
        run = self._write(last)
        self._take(self.versions.change(lambda state: state | {"runs": [*state["runs"], run], "schema": last.schema.jsonValue()}))
        if len(self.runs) >= self.compact_at:
            self.compact()

    def compact(self) -> None:
        """Merges all runs into one. Tombstones stay: an older change of their key may still arrive.

        Runs that another writer appends meanwhile stay beside it. The merged runs' files are
        deleted by the next compaction, so that readers of this one's can end.
        """
        old = list(self.runs)
        if len(old) < 2:
            return
        # a task has one whole bucket in key order, which Spark can't know
        run = self._write(self.read(tombstones=True))
        gone: list[str] = []

        def swap(state: dict) -> dict | None:
            gone[:] = state["retired"]
            if not set(old) <= set(state["runs"]):  # another compaction has been here; this one's run is dropped
                gone[:] = [run]
                return None
            return state | {"runs": [run, *[r for r in state["runs"] if r not in old]], "retired": old}

        self._take(self.versions.change(swap))
        for name in gone:
            fs, p = hadoop_path(self.spark, f"{self.path}/{name}")
            fs.delete(p, True)

    # -- reading ----------------------------------------------------------------------------

    def files(self) -> dict[int, list[str]]:
        """Files of each bucket over all runs, oldest run first."""
        out: dict[int, list[str]] = {}
        for run in self.runs:
            fs, p = hadoop_path(self.spark, f"{self.path}/{run}")
            found = fs.listFiles(p, True)
            while found.hasNext():
                name = found.next().getPath().toString()
                if name.endswith(".parquet"):
                    out.setdefault(int(name.rsplit("bucket=", 1)[1].split("/")[0]), []).append(name)
        return out

    def read(self, columns: list[str] | None = None, tombstones: bool = False) -> DataFrame:
        """The last change of each key, without deleted keys unless ``tombstones``; one task per bucket."""
        keys, schema = self.keys, self.schema
        if schema is None:
            raise ValueError("no run has been appended")
        want = columns or schema.names
        need = list(dict.fromkeys([*keys, "seq", "tie", "deleted", *want]))
        files = list(self.files().items())
        if not files:
            return self.spark.createDataFrame([], schema).select(*want)
        ship(self.spark)
        plan = self.spark.createDataFrame(files, "bucket int, files array<string>")

        def merge(batches):
            for batch in batches:
                for names in batch.column(1).to_pylist():
                    for table in merge_blocks([_blocks(n, need) for n in names], keys):
                        # equal keys lie together in one table: the newest change of each is its last
                        table = table.sort_by([(k, "ascending") for k in [*keys, "seq", "tie"]]).combine_chunks()
                        table = table.take(pa.array(last_of_each(table, keys)))
                        if not tombstones:
                            table = table.filter(pc.invert(table["deleted"]))
                        yield from table.select(want).combine_chunks().to_batches()

        types = {f.name: f.dataType.simpleString() for f in schema}
        out = ", ".join(f"`{n}` {types[n]}" for n in want)
        return plan.repartitionByRange(len(files), "bucket").mapInArrow(merge, out)


def _blocks(uri: str, columns: list[str]) -> Iterator[pa.Table]:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as source:
        for batch in pq.ParquetFile(source).iter_batches(BLOCK_ROWS, columns=columns):
            yield pa.Table.from_batches([batch])


def log_changes(wal: DataFrame) -> DataFrame:
    """Changes (index_name, document_id, seq, tie, deleted, payload) of write-ahead log rows.

    A row counts if its record is one complete JSON object; the document is the one the record
    names, else that of the row. Mapping announcements and unknown shapes change no document.
    The payload is the record of a write and null for a delete.
    """
    rows = cr.parsed(wal.select("index_name", "document_id", "sequence_number", "entry_id", "record"), "record", "r")
    rows = rows.where(F.col("r.op").isin(cr.INDEX, cr.DELETE))
    deleted = F.col("r.op") == cr.DELETE
    return rows.select(
        "index_name",
        F.coalesce("r.id", "document_id").alias("document_id"),
        F.col("sequence_number").alias("seq"),
        F.col("entry_id").alias("tie"),
        deleted.alias("deleted"),
        F.when(~deleted, F.col("record")).alias("payload"),
    )


def source_of(record: Column) -> Column:
    """The document's JSON within the record of a write."""
    return F.coalesce(*[F.get_json_object(record, p) for p in ("$.document.source", "$.index.source", "$.IndexDocument.document.source", "$.IndexDocument.source")])


def apply_feed(wal: DataFrame, path: str | None = None, runs: int = 4, compact_at: int = 3) -> LogStructuredTable:
    """Appends a whole feed in ``runs`` runs by order of arrival, as the feed would have come, and compacts on the way."""
    spark = wal.sparkSession
    table = LogStructuredTable(spark, path or scratch_path(spark, "lsm"), ["index_name", "document_id"], compact_at=compact_at)
    lo, hi = wal.agg(F.min("entry_id"), F.max("entry_id")).first()
    if lo is None:
        table.append(log_changes(wal))
        return table
    edges = [lo + (hi - lo + 1) * i // runs for i in range(1, runs)]
    bounds = list(zip([None, *edges], [*edges, None]))
    for a, b in bounds:
        part = wal
        if a is not None:
            part = part.where(F.col("entry_id") >= a)
        if b is not None:
            part = part.where((F.col("entry_id") < b) if a is not None else (F.col("entry_id") < b) | F.col("entry_id").isNull())
        table.append(log_changes(part))
    return table
