"""Named indexes in a folder: change log, segments, snapshots and settings.

An index is a list of immutable segments and a log of newer changes. ``refresh`` makes logged
changes searchable, ``flush`` turns them into a segment, ``merge`` folds segments. A flush also writes which documents
of older segments the new one overtakes, so a search reads each segment beside its own list of
deletions. Readers see the state of one manifest, a numbered file whose successor is created exclusively: a
writer that dies leaves the state before or after its change. Writers of one process take
turns; of two processes the one whose state has been overtaken is refused with ``ConcurrentWrite``.
"""

from __future__ import annotations

import functools
import json
import logging
import re
import threading
import time
import uuid
from collections import defaultdict
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import ConcurrentWrite, Versions, create_exclusive, names, read_bytes
from ..functions import text as tx
from ..functions.json_types import type_sql
from ..functions.once import computed_once
from ..operators.index import SearchIndex
from ..operators.postings import term_places
from ..plans import ast
from ..plans import mapping as mp
from ..plans.errors import AlreadyExists, InvalidRequest, LimitExceeded, MappingConflict, NotFound
from ..session import hadoop_path

DEFAULT_MERGE_THRESHOLD = 8
_NAME = re.compile(r"[a-z0-9_-]{1,255}\Z")
_NAMESPACE = re.compile(r"[A-Za-z0-9_-]{1,64}\Z")
_slow = logging.getLogger("skerry.slow")
_LOG = "_id string, _seq bigint, _deleted boolean, _source string"


# -- files ------------------------------------------------------------------------------------


class Files:
    """The few file operations the store needs, on any file system Spark reads."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def exists(self, path: str) -> bool:
        fs, p = hadoop_path(self.spark, path)
        return fs.exists(p)

    def read_json(self, path: str) -> Any:
        return json.loads(read_bytes(self.spark, path))

    def create_json(self, path: str, value: Any) -> None:
        """A file that must not be there yet."""
        if not create_exclusive(self.spark, path, json.dumps(value).encode()):
            raise AlreadyExists(path)

    def state(self, path: str) -> Versions:
        return Versions(self.spark, path)

    def delete(self, path: str) -> bool:
        fs, p = hadoop_path(self.spark, path)
        return fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        return names(self.spark, path)


_LOCKS: dict[str, threading.RLock] = defaultdict(threading.RLock)


def _in_turn(method):
    """Writers of an index in this process one after another."""

    @functools.wraps(method)
    def run(self, *args, **kwargs):
        with _LOCKS[self.path]:
            return method(self, *args, **kwargs)

    return run


@dataclass
class Settings:
    mapping_mode: str = mp.DYNAMIC
    primary_time_field: str | None = None
    namespace: str | None = None
    retention_secs: int | None = None
    merge_threshold_docs: int | None = None

    def check(self) -> None:
        if self.mapping_mode not in (mp.STRICT, mp.DYNAMIC):
            raise InvalidRequest(f"unknown mapping mode {self.mapping_mode}")
        if self.namespace is not None and not _NAMESPACE.match(self.namespace):
            raise InvalidRequest("a namespace has 1 to 64 letters, digits, _ or -")
        if self.retention_secs is not None and self.retention_secs <= 0:
            raise InvalidRequest("retention_secs must be above 0")


class Store:
    """The catalog of indexes under ``root``."""

    def __init__(self, spark: SparkSession, root: str, max_indexes: int | None = None, max_documents: int | None = None):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.max_indexes, self.max_documents = max_indexes, max_documents
        self.counters: dict[str, int] = {}

    def _path(self, name: str) -> str:
        if not _NAME.match(name):
            raise InvalidRequest("an index name has 1 to 255 lower-case letters, digits, _ or -")
        return f"{self.root}/{name}"

    def create_index(self, name: str, settings: Settings | None = None, mappings: mp.Mapping | None = None) -> dict:
        path, settings = self._path(name), settings or Settings()
        settings.check()
        if self.files.state(f"{path}/metadata.json").numbers():
            raise AlreadyExists(name)
        if self.max_indexes is not None and len(self.indexes()) >= self.max_indexes:
            raise LimitExceeded(f"{self.max_indexes} indexes")
        if bad := [t for t in (mappings or {}).values() if t not in mp.SPARK_TYPES]:
            raise InvalidRequest(f"unknown types {bad}")
        now = _now()
        meta = {"id": str(uuid.uuid4()), "name": name, "created_at": now, "updated_at": now, "settings": settings.__dict__, "mappings": mappings or {}}
        # the index is there once its metadata are, so its manifest comes first; one that a dead writer left is as good
        empty = {"segments": [], "log": [], "refreshed_seq": 0, "next_seq": 1, "number": 0, "batches": {}}
        self.files.state(f"{path}/manifest.json").change(lambda state: None if state else empty)
        try:
            self.files.state(f"{path}/metadata.json").put(0, meta)
        except ConcurrentWrite:
            raise AlreadyExists(name) from None
        return meta

    def indexes(self) -> list[str]:
        return [n for n in self.files.names(self.root) if self.files.state(f"{self.root}/{n}/metadata.json").numbers()]

    def get_index(self, name: str) -> dict:
        meta = self.files.state(f"{self._path(name)}/metadata.json").latest()[1]
        if meta is None:
            raise NotFound(name)
        return meta

    def delete_index(self, name: str) -> None:
        self.get_index(name)
        self.files.delete(self._path(name))

    def update_settings(self, name: str, retention_secs: int | None) -> dict:
        """Only the retention can change."""
        self.get_index(name)

        def step(meta: dict) -> dict:
            settings = meta["settings"] | {"retention_secs": retention_secs}
            Settings(**settings).check()
            return meta | {"settings": settings, "updated_at": _now()}

        return self.files.state(f"{self._path(name)}/metadata.json").change(step)

    def open(self, name: str) -> "Index":
        """The index for reading and writing; what was logged before is searchable."""
        self.get_index(name)
        index = Index(self, name)
        index.refresh()
        return index


@dataclass
class Index:
    store: Store
    name: str
    _search: dict = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self.spark, self.files, self.path = self.store.spark, self.store.files, self.store._path(self.name)

    # -- state ------------------------------------------------------------------------------

    @property
    def meta(self) -> dict:
        return self.files.state(f"{self.path}/metadata.json").latest()[1]

    @property
    def mapping(self) -> mp.Mapping:
        return self.meta["mappings"]

    @property
    def settings(self) -> Settings:
        return Settings(**self.meta["settings"])

    @property
    def manifest(self) -> dict:
        """The state, with its version."""
        version, state = self.files.state(f"{self.path}/manifest.json").latest()
        if state is None:
            raise NotFound(self.name)
        return state | {"version": version}

    def _save(self, manifest: dict) -> None:
        """The state that follows the one ``manifest`` was read as; refused if another writer's does already."""
        state = {k: v for k, v in manifest.items() if k != "version"}
        self.files.state(f"{self.path}/manifest.json").put(manifest["version"], state)

    def _set_mapping(self, mapping: mp.Mapping) -> None:
        self.files.state(f"{self.path}/metadata.json").change(lambda meta: None if meta["mappings"] == mapping else meta | {"mappings": mapping, "updated_at": _now()})

    def _count(self, what: str, n: int = 1) -> None:
        self.store.counters[f"{self.name}.{what}"] = self.store.counters.get(f"{self.name}.{what}", 0) + n

    # -- writing ----------------------------------------------------------------------------

    def index_document(self, doc_id: str, source: dict) -> dict:
        """Writes one document; ``result`` tells whether it was there."""
        result = "updated" if self.get_document(doc_id) is not None else "created"
        item = self.bulk([{"index": {"id": doc_id, "source": source}}])["items"][0]
        if item["status"] >= 400:
            raise MappingConflict(item["error"])
        return {"_id": doc_id, "result": result, "_seq": item["_seq"]}

    def delete_document(self, doc_id: str) -> dict:
        """Deletes one document; one that isn't there is no error."""
        return self.bulk([{"delete": {"id": doc_id}}])["items"][0]

    @_in_turn
    def bulk(self, operations: list[dict]) -> dict:
        """Operations in order, each by itself: one that fails doesn't stop the others. An index always says ``created``."""
        began = time.monotonic()
        manifest, mapping, mode = self.manifest, self.mapping, self.settings.mapping_mode
        seq, rows, items = manifest["next_seq"], [], []
        for op in operations:
            [(kind, body)] = op.items()
            if kind == "delete":
                rows.append((body["id"], seq, True, None))
                items.append({"_id": body["id"], "status": 200, "result": "deleted", "_seq": seq})
            elif kind == "index":
                try:
                    mapping = mp.extend(mapping, body.get("source"), mode)
                except MappingConflict as e:
                    items.append({"_id": body["id"], "status": 400, "error": str(e)})
                    continue
                rows.append((body["id"], seq, False, json.dumps(body["source"], ensure_ascii=False)))
                items.append({"_id": body["id"], "status": 201, "result": "created", "_seq": seq})
            else:
                raise InvalidRequest(f"unknown bulk operation {kind}")
            seq += 1
        if rows:
            self._set_mapping(mapping)
            self._append(self.spark.createDataFrame(rows, _LOG).coalesce(1), manifest, seq)
        self._count("bulk_operations", len(operations))
        if (took := time.monotonic() - began) > 0.2:
            _slow.info("bulk on %s took %.0f ms", self.name, took * 1000)
        return {"errors": any(i["status"] >= 400 for i in items), "items": items}

    @_in_turn
    def bulk_frame(self, operations: DataFrame, batch: tuple[str, int] | None = None) -> DataFrame:
        """Bulk from a DataFrame (position, op, id, source): any size, in order of ``position``.

        Gives the operations refused, with the reason. A field's type is the mapping's, else that of its first document by
        position; documents that hold another type, lists, or no object are refused whole.
        ``batch`` (stream, number) makes a repeated batch do nothing.
        """
        manifest = self.manifest
        empty = self.spark.createDataFrame([], "position bigint, id string, error string")
        if batch is not None and manifest["batches"].get(batch[0], -1) >= batch[1]:
            return empty
        base, number, mapping = manifest["next_seq"], manifest["number"] + 1, self.mapping
        # each source is parsed once; what is found of it is written beside it
        ops = operations.select(F.coalesce(F.col("position").cast("bigint"), F.lit(0)).alias("position"), "op", "id", "source").where("op = 'index' or op = 'delete' and id is not null")
        value = computed_once(F.expr("CASE WHEN op = 'index' THEN try_parse_json(source) END"))
        parsed = ops.withColumn("_v", value).withColumn("_object", F.expr("coalesce(schema_of_variant(_v) LIKE 'OBJECT%', false)"))
        kinds = f"map_filter(transform_values(cast(_v as map<string, variant>), (k, v) -> {type_sql('v')}), (k, t) -> t IS NOT NULL)"
        staged = parsed.select(
            F.col("id").alias("_id"), (F.col("position") + base).alias("_seq"), (F.col("op") == "delete").alias("_deleted"), F.when(F.col("op") == "index", F.col("source")).alias("_source"),
            F.col("position").alias("_position"), "_object", F.when(F.col("_object"), F.expr(kinds)).alias("_kinds"),
        )
        staged.write.mode("overwrite").parquet(f"{self.path}/log/{number:08d}")
        staged = self.spark.read.parquet(f"{self.path}/log/{number:08d}")
        # the types of an index are few; one more than allowed tells that there are too many
        each = staged.select("_position", F.explode("_kinds").alias("field", "type")).where("type <> 'Array'")
        first = {r["field"]: r["type"] for r in each.groupBy("field").agg(F.min_by("type", "_position").alias("type")).limit(mp.MAX_FIELDS + 1).collect()}
        if len(first | mapping) > mp.MAX_FIELDS:
            raise MappingConflict(f"more than {mp.MAX_FIELDS} fields")
        mapping = mapping if self.settings.mapping_mode == mp.STRICT else first | mapping
        known = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]) if mapping else F.expr("cast(map() as map<string, string>)")
        odd = F.map_keys(F.map_filter("_kinds", lambda k, t: ~F.coalesce(F.try_element_at(known, k) == t, F.lit(False))))
        error = F.when(F.col("_deleted"), None).when(~F.col("_object"), F.lit("a document must be a JSON object")).when(F.size(odd) > 0, F.concat(F.lit("field conflicts with the mapping: "), F.array_min(odd)))
        staged = staged.withColumn("_error", error)
        good = F.col("_error").isNull() & F.col("_id").isNotNull()
        got = staged.agg(F.max("_seq").alias("top"), F.count_if(~good).alias("bad"), F.count_if(good).alias("rows"), F.bit_xor(F.when(good, _row_hash())).alias("checksum")).first()
        if got["top"] is None:
            return empty
        refused = empty
        if got["bad"]:
            staged.where("_error is not null").select(F.col("_position").alias("position"), F.col("_id").alias("id"), F.col("_error").alias("error")).write.mode("overwrite").parquet(f"{self.path}/refused/{number:08d}")
            refused = self.spark.read.parquet(f"{self.path}/refused/{number:08d}")
            staged.where(good).select("_id", "_seq", "_deleted", "_source").write.mode("overwrite").parquet(f"{self.path}/log/{number + 1:08d}")
            self.files.delete(f"{self.path}/log/{number:08d}")
            number += 1
        self._set_mapping(mapping)
        self._logged(manifest, number, got["top"] + 1, {"rows": got["rows"], "checksum": got["checksum"] or 0}, batch)
        return refused

    def _append(self, rows: DataFrame, manifest: dict, next_seq: int) -> None:
        number = manifest["number"] + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/log/{number:08d}")
        self._logged(manifest, number, next_seq, self._log_checksum(number))

    def _logged(self, manifest: dict, number: int, next_seq: int, checksum: dict, batch: tuple[str, int] | None = None) -> None:
        """The log part ``number`` belongs to the index from here on."""
        if self.store.max_documents is not None and self.searchable().count() >= self.store.max_documents:
            raise LimitExceeded(f"{self.store.max_documents} documents")
        log = [*manifest["log"], {"number": number, "first_seq": manifest["next_seq"], "last_seq": next_seq - 1} | checksum]
        batches = manifest["batches"] | ({batch[0]: batch[1]} if batch else {})
        self._save(manifest | {"log": log, "next_seq": next_seq, "number": number, "batches": batches})

    def _log_checksum(self, number: int) -> dict:
        rows = self.spark.read.schema(_LOG).parquet(f"{self.path}/log/{number:08d}")
        got = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(_row_hash()), F.lit(0)).alias("checksum")).first()
        return got.asDict()

    def verify_log(self) -> None:
        """Reads the log's parts and compares rows and checksum with those noted when they were written."""
        for part in self.manifest["log"]:
            if self._log_checksum(part["number"]) != {k: part[k] for k in ("rows", "checksum")}:
                raise InvalidRequest(f"log part {part['number']} of {self.name} is damaged")

    # -- visibility -------------------------------------------------------------------------

    @_in_turn
    def refresh(self) -> int:
        """Makes all logged changes searchable; gives how many numbers that were."""
        manifest = self.manifest
        new = manifest["next_seq"] - 1 - manifest["refreshed_seq"]
        if new:
            self._save(manifest | {"refreshed_seq": manifest["next_seq"] - 1})
            self._search.clear()
        return new

    def _log(self, manifest: dict, upto: int | None) -> DataFrame | None:
        parts = [f"{self.path}/log/{x['number']:08d}" for x in manifest["log"] if upto is None or x["first_seq"] <= upto]
        if not parts:
            return None
        rows = self.spark.read.schema(_LOG).parquet(*parts)
        return rows if upto is None else rows.where(F.col("_seq") <= upto)

    def _typed(self, rows: DataFrame, mapping: mp.Mapping) -> DataFrame:
        """Adds a column per mapped field. Names that begin with _ or differ from an earlier one only by case stay in ``_source`` alone."""
        doc = rows.withColumn("_v", F.expr("try_parse_json(_source)"))
        columns = {}
        for name, kind in _columns(mapping).items():
            value = f"try_variant_get(_v, '$[\\'{name}\\']', '%s')" if "'" not in name else None
            if value is None:
                continue
            if kind == mp.TIMESTAMP:
                columns[name] = F.expr(f"try_cast({value % 'string'} as timestamp)")
            elif kind == mp.OBJECT:
                columns[name] = F.to_json(F.expr(value % "variant"))
            else:
                columns[name] = F.expr(value % mp.SPARK_TYPES[kind])
        typed = doc.withColumns(columns).drop("_v")
        # the words are stored with a segment, so that searches don't split texts, and their number, so that it can be counted without them
        texts = _texts(mapping)
        if not texts:
            return typed
        typed = typed.withColumns({f"_tok_{name}": tx.tokens(F.col(f"`{name}`")) for name in texts})
        return typed.withColumns({f"_len_{name}": F.size(f"`_tok_{name}`") for name in texts})

    def _write_segment(self, rows: DataFrame, number: int) -> dict:
        """Writes a segment with its posting lists, and gives its line of the manifest."""
        path, texts = f"{self.path}/segments/{number:08d}", [c.removeprefix("_tok_") for c in rows.columns if c.startswith("_tok_")]
        rows.write.mode("overwrite").parquet(path)
        stored = self.spark.read.parquet(path)
        live = ~F.col("_deleted")
        sums = [a for f in texts for a in _length_sums(f, live)]
        got = stored.agg(F.count(F.lit(1)).alias("rows"), F.count_if(live).alias("documents"), F.max("_seq").alias("last_seq"), *sums).first()
        if texts:
            lists = term_places(stored.where(live), texts)
            lists.repartitionByRange("term", "_id").sortWithinPartitions("term", "_id").write.mode("overwrite").parquet(f"{self.path}/terms/{number:08d}")
        lengths = {f: [got[f"sum_{f}"] or 0, got[f"count_{f}"]] for f in texts}
        return {"number": number, "documents": got["documents"], "rows": got["rows"], "last_seq": got["last_seq"], "lengths": lengths}

    def _without_deletions(self, rows: DataFrame, s: dict) -> DataFrame:
        lists = [f"{self.path}/deletions/{n:08d}/segment={s['number']}" for n in s.get("deletions", [])]
        return rows.join(self.spark.read.schema("_id string").parquet(*lists), "_id", "left_anti") if lists else rows

    def _segment(self, s: dict) -> DataFrame:
        """A segment without the documents that newer segments overtake."""
        return self._without_deletions(self.spark.read.parquet(f"{self.path}/segments/{s['number']:08d}"), s)

    def _segments(self, manifest: dict) -> list[DataFrame]:
        return [self._segment(s) for s in manifest["segments"]]

    def _state(self, manifest: dict, upto: int | None) -> DataFrame:
        """The last change of every id, deletes included.

        Each segment is read beside its list of deletions, and all of them once beside the ids of the log, which is newer
        than any segment. Columns a search doesn't use aren't read, and small lists are broadcast.
        """
        mapping, log = self.mapping, self._log(manifest, upto)
        parts = self._segments(manifest)
        if log is None:
            return _union(parts) if parts else self._typed(self.spark.createDataFrame([], _LOG), mapping)
        newest = self._typed(_last(log), mapping)
        return _union([_union(parts).join(log.select("_id"), "_id", "left_anti"), newest]) if parts else newest

    def searchable(self) -> DataFrame:
        manifest = self.manifest
        return self._state(manifest, manifest["refreshed_seq"]).where("not _deleted").drop("_deleted")

    def get_document(self, doc_id: str) -> dict | None:
        """The newest form, refreshed or not."""
        manifest = self.manifest
        parts = [d.where(F.col("_id") == doc_id).select("_seq", "_deleted", "_source") for d in (self._log(manifest, None), *self._segments(manifest)) if d is not None]
        rows = [r for p in parts for r in p.orderBy(F.desc("_seq")).limit(1).collect()]
        newest = max(rows, key=lambda r: r["_seq"], default=None)
        return None if newest is None or newest["_deleted"] else json.loads(newest["_source"])

    # -- retention --------------------------------------------------------------------------

    def alive(self, rows: DataFrame, now: datetime | None = None) -> DataFrame:
        """Without documents whose time plus retention has come. One without a readable time doesn't expire.

        The time is RFC 3339 text or seconds since 1970.
        """
        s, mapping = self.settings, self.mapping
        if s.retention_secs is None or s.primary_time_field not in rows.columns:
            return rows
        c, kind = F.col(f"`{s.primary_time_field}`"), mapping.get(s.primary_time_field)
        at = c if kind == mp.TIMESTAMP else F.timestamp_seconds(c) if kind in (mp.INTEGER, mp.LONG) else None
        if at is None:
            return rows
        limit = F.lit((now or datetime.now(timezone.utc)).astimezone(timezone.utc).replace(tzinfo=None).isoformat(" ")).cast("timestamp")
        return rows.where(at.isNull() | (at + F.make_interval(secs=F.lit(s.retention_secs)) > limit))

    @_in_turn
    def evict(self, now: datetime | None = None) -> int:
        """Deletes expired documents for good."""
        expired = self.searchable().select("_id").join(self.alive(self.searchable(), now).select("_id"), "_id", "left_anti")
        # deletes of different documents may share a number
        ops = expired.select(F.lit(0).alias("position"), F.lit("delete").alias("op"), F.col("_id").alias("id"), F.lit(None).cast("string").alias("source")).persist()
        n = ops.count()
        if n:
            self.bulk_frame(ops)
            self.refresh()
        ops.unpersist()
        return n

    # -- segments ---------------------------------------------------------------------------

    @_in_turn
    def flush(self) -> dict:
        """Turns the searchable part of the log into a segment; its number is the highest it contains."""
        manifest = self.manifest
        upto = manifest["refreshed_seq"]
        log = self._log(manifest, upto)
        if log is None:
            return {"flushed_documents": 0, "seq": upto}
        self.verify_log()
        number = manifest["number"] + 1
        new = self._write_segment(self._typed(_last(log), self.mapping), number)
        kept = [x for x in manifest["log"] if x["last_seq"] > upto]
        gone = [x for x in manifest["log"] if x["last_seq"] <= upto]
        segments = [*self._overtaken(manifest["segments"], number), new] if new["rows"] else manifest["segments"]
        self._save(manifest | {"segments": segments, "log": kept, "number": number})
        for x in gone:
            self.files.delete(f"{self.path}/log/{x['number']:08d}")
        self._search.clear()
        if plan := self.plan_merge():
            self._fold(plan)
        return {"flushed_documents": new["documents"], "seq": upto}

    def _overtaken(self, segments: list[dict], number: int) -> list[dict]:
        """``segments`` with the lists of their documents that the new segment ``number`` overtakes; only ids are read."""
        if not segments:
            return []
        ids = self.spark.read.parquet(f"{self.path}/segments/{number:08d}").select("_id")
        narrow = lambda df: df.select("_id", "_deleted", *[F.col(f"`{c}`") for c in df.columns if c.startswith("_len_")])
        older = _union([narrow(self._segment(s)).withColumn("segment", F.lit(s["number"])) for s in segments])
        path = f"{self.path}/deletions/{number:08d}"
        # sorted by segment, so a segment's list is few files
        older.join(ids, "_id", "left_semi").repartitionByRange("segment", "_id").sortWithinPartitions("segment", "_id").write.mode("overwrite").partitionBy("segment").parquet(path)
        texts, live = [c.removeprefix("_len_") for c in older.columns if c.startswith("_len_")], ~F.col("_deleted")
        found = self.spark.read.schema(older.schema).parquet(path)
        sums = [a for f in texts for a in _length_sums(f, live)]
        gone = {r["segment"]: r for r in found.groupBy("segment").agg(F.count(F.lit(1)).alias("rows"), F.count_if(live).alias("documents"), *sums).collect()}

        def rest(s: dict) -> dict:
            g = gone.get(s["number"])
            if g is None:
                return s
            lengths = {f: [a - (g[f"sum_{f}"] or 0), b - g[f"count_{f}"]] for f, (a, b) in s["lengths"].items()}
            return s | {"documents": s["documents"] - g["documents"], "rows": s["rows"] - g["rows"], "lengths": lengths, "deletions": [*s.get("deletions", []), number]}

        return [rest(s) for s in segments]

    def plan_merge(self) -> list[int]:
        """Numbers of the segments to fold: all small ones where there are two or more, each of fewer documents than the threshold; else a
        lone segment of at least as many that holds deleted documents, which only a merge takes out."""
        threshold = self.settings.merge_threshold_docs or DEFAULT_MERGE_THRESHOLD
        segments = self.manifest["segments"]
        small = [s["number"] for s in segments if 0 < s["documents"] < threshold]
        if len(small) >= 2:
            return small
        lone = segments[0] if len(segments) == 1 else None
        return [lone["number"]] if lone and lone["documents"] >= threshold and (lone["rows"] > lone["documents"] or lone.get("deletions")) else []

    @_in_turn
    def merge(self) -> dict:
        """Folds the pending changes and all segments into one."""
        self.refresh()
        self.flush()
        numbers = [s["number"] for s in self.manifest["segments"]]
        return {"merged_documents": self._fold(numbers)}

    @_in_turn
    def _fold(self, numbers: list[int]) -> int:
        manifest = self.manifest
        chosen = [s for s in manifest["segments"] if s["number"] in numbers]
        if not chosen:
            return 0
        number = manifest["number"] + 1
        rows = _union(self._segments(manifest | {"segments": chosen}))
        if len(chosen) == len(manifest["segments"]):  # no older segment is left that a tombstone could be for
            rows = rows.where("not _deleted")
        new = self._write_segment(rows, number)
        rest = [s for s in manifest["segments"] if s["number"] not in numbers]
        self._save(manifest | {"segments": [*rest, new], "number": number})
        for s in chosen:
            self.files.delete(f"{self.path}/segments/{s['number']:08d}")
            self.files.delete(f"{self.path}/terms/{s['number']:08d}")
        self._search.clear()
        return new["documents"]

    # -- snapshots --------------------------------------------------------------------------

    def _snapshot_path(self, name: str) -> str:
        if not name or "/" in name or "\\" in name or name in (".", ".."):
            raise InvalidRequest("a snapshot name has no separators")
        return f"{self.path}/snapshots/{name}"

    @_in_turn
    def create_snapshot(self, name: str) -> dict:
        """A copy of all documents, unrefreshed changes included."""
        path = self._snapshot_path(name)
        if self.files.exists(f"{path}/meta.json"):
            raise AlreadyExists(name)
        manifest = self.manifest
        self._state(manifest, None).where("not _deleted").select("_id", "_seq", "_deleted", "_source").write.mode("overwrite").parquet(f"{path}/data")
        meta = {"name": name, "created_at": _now(), "seq": manifest["next_seq"] - 1, "mappings": self.mapping} | _checksum(self.spark.read.parquet(f"{path}/data"))
        self.files.create_json(f"{path}/meta.json", meta)
        return meta

    def snapshots(self) -> list[dict]:
        names = [n for n in self.files.names(f"{self.path}/snapshots") if self.files.exists(f"{self.path}/snapshots/{n}/meta.json")]
        return sorted((self.get_snapshot(n) for n in names), key=lambda m: (m["created_at"], m["name"]))

    def get_snapshot(self, name: str) -> dict:
        path = f"{self._snapshot_path(name)}/meta.json"
        if not self.files.exists(path):
            raise NotFound(name)
        return self.files.read_json(path)

    def delete_snapshot(self, name: str) -> None:
        self.files.delete(self._snapshot_path(name))

    @_in_turn
    def restore_snapshot(self, name: str) -> dict:
        """Replaces the index's state; pending changes are gone."""
        meta = self.get_snapshot(name)
        data = self.spark.read.schema(_LOG).parquet(f"{self._snapshot_path(name)}/data")
        if _checksum(data) != {k: meta[k] for k in ("documents", "checksum")}:
            raise InvalidRequest(f"snapshot {name} is damaged")
        manifest = self.manifest
        self._set_mapping(meta["mappings"])
        number = manifest["number"] + 1
        new = self._write_segment(self._typed(data, meta["mappings"]), number) | {"last_seq": meta["seq"]}
        self._save(manifest | {"segments": [new], "log": [], "refreshed_seq": manifest["next_seq"] - 1, "number": number})
        self._search.clear()
        return meta

    # -- searching --------------------------------------------------------------------------

    def search_index(self, now: datetime | None = None) -> SearchIndex:
        """What can be searched now; statistics are kept until the next refresh. They count expired documents not evicted yet."""
        key = json.dumps(self.manifest, sort_keys=True)
        if key not in self._search:
            self._search.clear()
            mapping = _columns(self.mapping)
            whole = SearchIndex(self.searchable(), mapping, stored=self._stored_counts())
            self._search[key] = whole
        whole = self._search[key]
        return SearchIndex(self.alive(whole.df, now), whole.mapping, whole.profile, _Shared(whole), whole.stored)

    def _stored_counts(self) -> "SegmentCounts | None":
        """The segments' counts, where they hold all that can be searched."""
        manifest = self.manifest
        pending = any(x["first_seq"] <= manifest["refreshed_seq"] for x in manifest["log"])
        return None if pending or not manifest["segments"] else SegmentCounts(self, manifest["segments"])

    def search(self, body: dict, now: datetime | None = None) -> dict:
        from ..plans import dsl
        from ..plans.response import search_response

        began = time.monotonic()
        out = search_response(self.search_index(now), dsl.request(body), "_source", highlight=True)
        self._count("searches")
        if (took := time.monotonic() - began) > 0.05:
            _slow.info("search on %s took %.0f ms", self.name, took * 1000)
        return out

    def search_string(self, text: str) -> dict:
        """By a query string."""
        from ..plans import qstring
        from ..plans.response import search_response

        self._count("searches")
        return search_response(self.search_index(), ast.Request(qstring.parse(text)), "_source", highlight=True)

    def suggest(self, prefix: str, fields: dict[str, float], size: int = 10) -> list[dict]:
        from ..operators import suggest

        index = self.search_index()
        words = index.stored.vocabulary() if index.stored is not None else suggest.vocabulary(index)
        return [r.asDict() for r in suggest.suggest(words, prefix, fields, size).collect()]

    def metrics(self) -> dict[str, int]:
        """Counters and gauges of the index."""
        manifest = self.manifest
        own = {k.split(".", 1)[1]: v for k, v in self.store.counters.items() if k.startswith(f"{self.name}.")}
        return own | {"segments": len(manifest["segments"]), "pending_operations": manifest["next_seq"] - 1 - manifest["refreshed_seq"], "last_sequence_number": manifest["next_seq"] - 1}


@dataclass
class SegmentCounts:
    """What a search needs to know of an index whose documents all lie in segments, without reading texts: documents and
    lengths stand in the manifest, frequencies in the segments' posting lists."""

    index: Index
    segments: list[dict]

    def _lists(self) -> DataFrame | None:
        parts = [s for s in self.segments if s["lengths"] and s["documents"] > 0]
        read = lambda s: self.index.spark.read.parquet(f"{self.index.path}/terms/{s['number']:08d}").select("term", "field", "_id")
        # a document's lists go with it
        return _union([self.index._without_deletions(read(s), s) for s in parts]) if parts else None

    def documents(self) -> int:
        return sum(s["documents"] for s in self.segments)

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """Documents that hold each term in any field; row groups without the terms are skipped."""
        lists = self._lists()
        if lists is None or not terms:
            return {}
        held = lists.where(F.col("term").isin(list(terms))).select("term", "_id").distinct()
        return {r["term"]: r["count"] for r in held.groupBy("term").count().collect()}

    def averages(self, fields: list[str]) -> dict[str, float | None]:
        out = {}
        for f in fields:
            got = [s["lengths"][f] for s in self.segments if f in s["lengths"]]
            out[f] = sum(a for a, _ in got) / n if (n := sum(b for _, b in got)) else None
        return out

    def vocabulary(self) -> DataFrame:
        """(field, term, doc_freq, score): documents that hold a term in a field, and their share of all."""
        lists, n = self._lists(), self.documents()
        if lists is None:
            return self.index.spark.createDataFrame([], "field string, term string, doc_freq bigint, score double")
        # a document has a term once in a field's list
        return lists.groupBy("field", "term").agg(F.count(F.lit(1)).alias("doc_freq")).withColumn("score", F.col("doc_freq") / F.lit(max(n, 1)))


class _Shared(dict):
    """Statistics of the whole index, used where expired documents are hidden."""

    def __init__(self, whole: SearchIndex):
        super().__init__()
        self.whole = whole

    def _fetch(self, key: tuple) -> Any:
        kind = key[0]
        self.whole.statistics({key[1]} if kind == "df" else set(), {key[1]} if kind == "avg" else set())
        return self.whole._stats[key]

    def __contains__(self, key: object) -> bool:
        return True

    def __getitem__(self, key: tuple) -> Any:
        return self.whole._stats[key] if key in self.whole._stats else self._fetch(key)


def _last(rows: DataFrame) -> DataFrame:
    """The newest row of each id; older ones end before the shuffle."""
    rest = [c for c in rows.columns if c not in ("_id", "_seq")]
    return rows.groupBy("_id").agg(F.max_by(F.struct("_seq", *[F.col(f"`{c}`") for c in rest]), "_seq").alias("_m")).select("_id", "_m.*")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _row_hash() -> Any:
    return F.xxhash64("_id", "_seq", "_deleted", "_source")


def _texts(mapping: mp.Mapping) -> list[str]:
    return [name for name, kind in _columns(mapping).items() if kind == mp.KEYWORD]


def _length_sums(f: str, live: Any) -> list[Any]:
    length = F.when(live, F.col(f"`_len_{f}`"))
    return [F.sum(length).alias(f"sum_{f}"), F.count(length).alias(f"count_{f}")]


def _columns(mapping: mp.Mapping) -> mp.Mapping:
    out: dict[str, str] = {}
    seen: set[str] = set()
    for name, kind in mapping.items():
        if not name.startswith("_") and name.lower() not in seen and "'" not in name and "`" not in name:
            seen.add(name.lower())
            out[name] = kind
    return out


def _checksum(rows: DataFrame) -> dict:
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("_id", "_source")), F.lit(0)).alias("c")).first()
    return {"documents": got["n"], "checksum": got["c"]}


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()

