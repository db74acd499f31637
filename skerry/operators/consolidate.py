"""Problem 5: far too many small segments, consolidated into few of good size with every document once.

Sorted-run consolidation, without a shuffle of documents:

1. Each input split is sorted by (index, document, segment) and written as a sorted run of small row groups.
2. While there are more than ``FAN_IN`` runs, groups of so many are merged k ways into longer runs.
3. The runs' key columns alone are merged per key range. That gives each segment's true size and the
   number of its documents that lie elsewhere too: the plan. Small segments and those that hold copies are
   rewritten; segments of good size whose documents lie nowhere else stay as they are.
4. The rewritten segments' rows are merged per key range, the newest copy of each document goes to the outputs, which are
   closed by bytes, and the segments' ranges are updated.
"""

from __future__ import annotations

import bisect
import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kway import last_of_each, merge_blocks
from ..session import scratch_path, ship

DEFAULT_THRESHOLD = 8
#: Columns the operator knows; any others go along under names of its own, so theirs can't clash.
COLUMNS = ["index_name", "segment_number", "document_id", "sequence_number", "written_at", "source"]
#: Bytes of documents at which a segment is closed, and of a written file.
SEGMENT_BYTES, FILE_BYTES = 32 << 20, 128 << 20
#: Bytes of a run's row group, the unit in which runs are read, and the runs that are merged at once: a merging task holds a row group of each.
GROUP_BYTES, FAN_IN = 1 << 20, 48
#: Keys noted for each file of a run, from which key ranges of even size are cut.
SAMPLES = 32
#: Rows of the segments' metadata up to which it is broadcast (a few MB); beyond, it is joined by shuffle.
BROADCAST_ROWS = 50_000

#: Columns of a run. _n: 1 where the index's name is null, and 2 more where the document's is; _i, _d: the names, and of a document without name
#: its whole row; _s: the segment; _c: rows of the document in the segment; _b: bytes; _q, _w: number and time of writing; c0…: other columns; _x: the source.
KEYS, DOCUMENT = ["_n", "_i", "_d", "_s"], ["_n", "_i", "_d"]
NO_SEGMENT = -(2**63)
Key = tuple[int, str, str]


@dataclass
class Consolidated:
    """``plan``: every segment with size, threshold, whether it was small (merge) and whether it was rewritten; ``segments``: those there are now
    with their ranges; ``documents``: each document once, with its segment."""

    plan: DataFrame
    segments: DataFrame
    documents: DataFrame


@dataclass
class RunFile:
    """A file of a run: its first and last document's key, some keys between, rows and bytes."""

    path: str
    first: Key
    last: Key
    samples: list[Key]
    bytes: int


# -- runs -------------------------------------------------------------------------------------


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with a run's columns, unsorted."""
    others = [c for c in docs.columns if c not in COLUMNS]
    no_index, no_document = F.col("index_name").isNull(), F.col("document_id").isNull()
    own = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    return docs.select(
        (no_index.cast("int") + 2 * no_document.cast("int")).alias("_n"),
        F.coalesce("index_name", F.lit("")).alias("_i"),
        F.when(no_document, own).otherwise(F.col("document_id")).alias("_d"),
        F.coalesce(F.col("segment_number").cast("bigint"), F.lit(NO_SEGMENT)).alias("_s"),
        F.lit(1).cast("bigint").alias("_c"),
        F.coalesce(F.octet_length("source"), F.lit(0)).cast("bigint").alias("_b"),
        F.col("sequence_number").alias("_q"),
        F.col("written_at").alias("_w"),
        *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)],
        F.col("source").alias("_x"),
    )


def _order(schema: pa.Schema) -> list[str]:
    """What tells which of two rows of a document is the newer: number, time, segment, then the other columns (those that can be compared)."""
    plain = [f.name for f in schema if f.name.startswith("c") and not pa.types.is_nested(f.type)]
    return [n for n in ["_q", "_w", "_s", *plain, "_x"] if n in schema.names]


def _sorted(table: pa.Table, keys: list[str], order: list[str]) -> pa.Table:
    by = [*keys, *[o for o in order if o not in keys]]
    return table.take(pc.sort_indices(table, [(k, "ascending") for k in by], null_placement="at_start")).combine_chunks()


def _once(table: pa.Table) -> pa.Table:
    """The last row of each document and segment in a sorted table, with the rows of all of them counted."""
    at = last_of_each(table, KEYS)
    starts = np.concatenate([[0], at[:-1] + 1])
    counts = np.add.reduceat(table["_c"].to_numpy(), starts)
    table, c = table.take(pa.array(at)), table.schema.get_field_index("_c")
    return table.set_column(c, table.schema.field(c), pa.array(counts, pa.int64()))


def _key(table: pa.Table, row: int) -> Key:
    return tuple(table[k][row].as_py() for k in DOCUMENT)


class RunWriter:
    """Writes a sorted run's file in row groups of ``GROUP_BYTES``, whose first keys are kept in the file.

    The name is the attempt's own, so what a lost attempt leaves is never read: only files that a finished task has named count.
    """

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.parquet"
        self.writer: pq.ParquetWriter | None = None
        self.held: list[pa.Table] = []
        self.firsts: list[Key] = []
        self.bytes = self.waiting = 0
        self.last: Key | None = None

    def write(self, table: pa.Table) -> None:
        if not table.num_rows:
            return
        self.held.append(table)
        self.waiting += table.nbytes
        if self.waiting >= GROUP_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self.held:
            return
        table = pa.concat_tables(self.held)
        if self.writer is None:
            fs, path = pafs.FileSystem.from_uri(self.uri)
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            self.sink = fs.open_output_stream(path)
            self.writer = pq.ParquetWriter(self.sink, table.schema, compression="zstd", compression_level=1, write_statistics=False)
        each = max(1, table.num_rows * GROUP_BYTES // max(self.waiting, 1))
        for at in range(0, table.num_rows, each):
            part = table.slice(at, each)
            self.firsts.append(_key(part, 0))
            self.writer.write_table(part, row_group_size=each)
        self.last = _key(table, table.num_rows - 1)
        self.bytes += self.waiting
        self.held, self.waiting = [], 0

    def close(self) -> RunFile | None:
        self._flush()
        if self.writer is None:
            return None
        self.writer.add_key_value_metadata({"firsts": json.dumps(self.firsts)})
        self.writer.close()
        self.sink.close()
        step = max(1, math.ceil(len(self.firsts) / SAMPLES))
        return RunFile(self.uri, self.firsts[0], self.last, self.firsts[::step], self.bytes)


_FILE_SCHEMA = "run bigint, part bigint, path string, keys string, bytes bigint"


def _file_batch(run: int, part: int, file: RunFile) -> pa.RecordBatch:
    keys = json.dumps([file.first, file.last, file.samples])
    return pa.RecordBatch.from_pydict({"run": pa.array([run], pa.int64()), "part": pa.array([part], pa.int64()), "path": [file.path], "keys": [keys], "bytes": pa.array([file.bytes], pa.int64())})


def _files(rows: DataFrame, path: str) -> list[list[RunFile]]:
    """Runs the job and reads what its finished tasks have named: a row per file, and so per stretch of ``FILE_BYTES`` of the data."""
    rows.write.parquet(path)
    runs: dict[int, list[tuple[int, RunFile]]] = {}
    for r in rows.sparkSession.read.parquet(path).collect():
        first, last, samples = json.loads(r["keys"])
        runs.setdefault(r["run"], []).append((r["part"], RunFile(r["path"], tuple(first), tuple(last), [tuple(s) for s in samples], r["bytes"])))
    return [[f for _, f in sorted(runs[k], key=lambda x: x[0])] for k in sorted(runs)]


def make_runs(docs: DataFrame, path: str) -> list[list[RunFile]]:
    """A sorted run of each input split. Within a run a document has one row per segment: the newest, with the others counted."""
    rows = keyed(docs)
    order = [*KEYS, "_q", "_w", *[n for n, t in rows.dtypes if n.startswith("c") and not t.startswith(("struct", "array", "map", "variant"))], "_x"]

    def run(batches):
        writer, held = RunWriter(f"{path}/files"), None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if table.num_rows:
                once = _once(table)
                # the last document may go on in the next batch
                writer.write(once.slice(0, once.num_rows - 1))
                held = once.slice(once.num_rows - 1)
        if held is not None:
            writer.write(held)
        if (file := writer.close()) is not None:
            yield _file_batch(uuid.uuid4().int >> 65, 0, file)

    return _files(rows.sortWithinPartitions(*order).mapInArrow(run, _FILE_SCHEMA), f"{path}/made")


def _stream(files: list[str], lo: Key | None, hi: Key | None, columns: list[str] | None) -> Iterator[pa.Table]:
    """A run's rows with keys from ``lo`` to below ``hi``, a row group at a time; row groups outside aren't read."""
    for uri in files:
        fs, path = pafs.FileSystem.from_uri(uri)
        with fs.open_input_file(path) as source:
            file = pq.ParquetFile(source)
            firsts = [tuple(k) for k in json.loads(file.metadata.metadata[b"firsts"])]
            # a document's rows may begin in the row group before the one that begins with it
            begin = 0 if lo is None else max(0, bisect.bisect_left(firsts, lo) - 1)
            end = len(firsts) if hi is None else bisect.bisect_left(firsts, hi)
            for g in range(begin, end):
                table = file.read_row_group(g, columns=columns)
                a = 0 if lo is None else _first_at(table, lo)
                z = table.num_rows if hi is None else _first_at(table, hi)
                if z > a:
                    yield table.slice(a, z - a)


def _first_at(table: pa.Table, key: Key) -> int:
    lo, hi = 0, table.num_rows
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if _key(table, mid) < key else (lo, mid)
    return lo


# -- merging ----------------------------------------------------------------------------------


def key_ranges(runs: list[list[RunFile]], parts: int) -> list[tuple[Key | None, Key | None]]:
    """At most ``parts`` ranges that hold about equally much, cut at the files' noted keys."""
    keys = sorted(k for run in runs for f in run for k in f.samples)
    cuts = sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []
    return list(zip([None, *cuts], [*cuts, None]))


def _tasks(spark: SparkSession, groups: list[list[list[RunFile]]], parts: list[int]) -> tuple[DataFrame, int]:
    """A row per group and key range, with the files of each run that have keys in it."""
    rows = []
    for g, (runs, n) in enumerate(zip(groups, parts)):
        for p, (lo, hi) in enumerate(key_ranges(runs, n)):
            files = [[f.path for f in run if (hi is None or f.first < hi) and (lo is None or f.last >= lo)] for run in runs]
            rows.append((len(rows), g, p, json.dumps([lo, hi]), [f for f in files if f]))
    return spark.createDataFrame(rows, "task int, run bigint, part bigint, bounds string, files array<array<string>>").repartitionByRange(max(1, len(rows)), "task"), len(rows)


def _each_task(batches) -> Iterator[tuple[int, int, Key | None, Key | None, list[list[str]]]]:
    for batch in batches:
        for r in batch.to_pylist():
            lo, hi = (None if k is None else tuple(k) for k in json.loads(r["bounds"]))
            yield r["run"], r["part"], lo, hi, r["files"]


def _merged(files: list[list[str]], lo: Key | None, hi: Key | None, columns: list[str] | None = None) -> Iterator[pa.Table]:
    """One row per document and segment in key order, from all runs."""
    for table in merge_blocks([_stream(f, lo, hi, columns) for f in files], KEYS):
        yield _once(_sorted(table, KEYS, _order(table.schema)))


def fold(spark: SparkSession, runs: list[list[RunFile]], path: str, fan_in: int, file_bytes: int) -> list[list[RunFile]]:
    """Merges groups of ``fan_in`` runs into one each until no more than that are left."""
    level = 0
    while len(runs) > fan_in:
        level += 1
        groups = [runs[i:i + fan_in] for i in range(0, len(runs), fan_in)]
        parts = [max(1, math.ceil(sum(f.bytes for run in g for f in run) / file_bytes)) for g in groups]

        def run(batches):
            for group, part, lo, hi, files in _each_task(batches):
                writer = RunWriter(f"{path}/files")
                for table in _merged(files, lo, hi):
                    writer.write(table)
                if (file := writer.close()) is not None:
                    yield _file_batch(group, part, file)

        runs = _files(_tasks(spark, groups, parts)[0].mapInArrow(run, _FILE_SCHEMA), f"{path}/level-{level}")
    return runs


def _names(table: pa.Table) -> list[pa.Array]:
    """index_name and document_id as they were."""
    n = table["_n"].to_numpy()
    null = pa.scalar(None, pa.string())
    return [pc.if_else(pa.array((n & bit) == 0), table[c].combine_chunks(), null) for c, bit in (("_i", 1), ("_d", 2))]


_LINEAGE = "index_name string, segment_number bigint, size bigint, shared bigint, bytes bigint, first_document string, last_document string, last_sequence_number bigint"


def lineage(tasks: DataFrame) -> DataFrame:
    """(index_name, segment_number, size, shared, …) by a merge of the runs' key columns: partial sums per key range and segment.

    ``size`` counts documents, ``shared`` rows of documents that are in another segment too or more than once in this one.
    """
    columns = [*KEYS, "_c", "_b", "_q"]

    def report(table: pa.Table, shared: np.ndarray) -> pa.RecordBatch:
        index, document = _names(table)
        t = pa.table({"index_name": index, "s": table["_s"], "there": pc.cast(pc.is_valid(document), pa.int64()), "shared": pa.array(shared.astype(np.int64)), "b": table["_b"], "d": document, "q": table["_q"]})
        t = t.group_by(["index_name", "s"]).aggregate([("there", "sum"), ("shared", "sum"), ("b", "sum"), ("d", "min"), ("d", "max"), ("q", "max")])
        segment = pc.if_else(pc.equal(t["s"], NO_SEGMENT), pa.scalar(None, pa.int64()), t["s"])
        cols = [t["index_name"], segment, t["there_sum"], t["shared_sum"], t["b_sum"], t["d_min"], t["d_max"], t["q_max"]]
        return pa.Table.from_arrays(cols, ["index_name", "segment_number", "size", "shared", "bytes", "first_document", "last_document", "last_sequence_number"]).combine_chunks().to_batches()[0]

    def run(batches):
        for _, _, lo, hi, files in _each_task(batches):
            before, lone = None, None  # the last document so far, and its row if it has only one yet
            for table in _merged(files, lo, hi, columns):
                ends = last_of_each(table, DOCUMENT)
                sizes = np.diff(np.concatenate([[-1], ends]))
                shared = np.repeat(sizes > 1, sizes) | (table["_c"].to_numpy() > 1)
                goes_on = before is not None and _key(table, 0) == before
                shared[: sizes[0]] |= goes_on
                if lone is not None:
                    yield report(lone[0], np.array([lone[1] or goes_on]))
                rows, lone = table.num_rows, None
                before = _key(table, rows - 1)
                if sizes[-1] == 1 and not (goes_on and len(sizes) == 1):
                    rows, lone = rows - 1, (table.slice(rows - 1), bool(shared[-1]))
                if rows:
                    yield report(table.slice(0, rows), shared[:rows])
            if lone is not None:
                yield report(lone[0], np.array([lone[1]]))

    return tasks.mapInArrow(run, _LINEAGE)


def segment_plan(found: DataFrame, settings: DataFrame, default: int = DEFAULT_THRESHOLD) -> DataFrame:
    """Every segment with size, threshold, merge and rewrite.

    Size is the number of distinct document ids. A segment is to be merged if its size is at
    least 1 and below its index's threshold (``default`` where the setting is null or the index
    has none) and its index has at least two of that kind. It is rewritten then, and where it holds copies.
    """
    first, last = F.min("first_document").alias("first_document"), F.max("last_document").alias("last_document")
    sums = [F.sum(c).alias(c) for c in ("size", "shared", "bytes")]
    sizes = found.groupBy("index_name", "segment_number").agg(*sums, first, last, F.max("last_sequence_number").alias("last_sequence_number"))
    limits = settings.groupBy("index_name").agg(F.max("merge_threshold_docs").alias("threshold"))
    known = sizes.join(limits, "index_name", "left").withColumn("threshold", F.coalesce("threshold", F.lit(default).cast("bigint")))
    small = (F.col("size") >= 1) & (F.col("size") < F.col("threshold"))
    per_index = known.where(small).groupBy("index_name").agg(F.count(F.lit(1)).alias("small"))
    merge = small & (F.coalesce("small", F.lit(0)) >= 2)
    planned = known.alias("k").join(per_index.alias("p"), F.expr("k.index_name <=> p.index_name"), "left").select("k.*", "p.small").withColumn("merge", merge).withColumn("rewrite", merge | (F.col("shared") > 0))
    return planned.drop("small")


def _kept_segments(path: str, lo: Key | None, hi: Key | None) -> set[tuple[str | None, int]]:
    """(index or null, segment) of the segments that stay, among the indexes of a key range."""
    import pyarrow.dataset as ds

    fs, folder = pafs.FileSystem.from_uri(path)
    table = ds.dataset(folder, schema=pa.schema([("index_name", pa.string()), ("segment_number", pa.int64())]), filesystem=fs, format="parquet")
    index = ds.field("index_name")
    inside = None
    # names of one kind (null or not) lie together, so a range within one kind bounds them
    if lo is not None and hi is not None and lo[0] == hi[0]:
        inside = (index >= lo[1]) & (index <= hi[1]) | index.is_null()
    got = table.to_table(columns=["index_name", "segment_number"], filter=inside)
    segments = got["segment_number"].fill_null(NO_SEGMENT).to_pylist()
    return set(zip(got["index_name"].to_pylist(), segments))


def _rewritten(table: pa.Table, kept: set) -> pa.Table:
    """Without the rows of segments that stay."""
    if not kept:
        return table
    index = _names(table)[0].dictionary_encode(null_encoding="encode")
    index = index.combine_chunks() if isinstance(index, pa.ChunkedArray) else index
    names = index.dictionary.to_pylist()
    codes, (segments, which) = index.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.unique(table["_s"].to_numpy(), return_inverse=True)
    pairs, at = np.unique(codes * len(segments) + which, return_inverse=True)
    stays = np.array([(names[p // len(segments)], int(segments[p % len(segments)])) in kept for p in pairs])
    return table.filter(pa.array(~stays[at]))


_PIECES = "part bigint, piece int, path string, index_name string, documents bigint, bytes bigint, first_document string, last_document string, last_sequence_number bigint"


def consolidate(docs: DataFrame, settings: DataFrame, path: str | None = None, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES, fan_in: int = FAN_IN) -> Consolidated:
    """Merges the segments of ``docs`` and writes the result under ``path``.

    A document's row of the highest sequence number counts, then of the latest writing, the highest segment and the
    largest other columns; the other copies end in the merge. Rows of null index are an index of their own. Rows of null document
    name no document: equal ones come out once, different ones all. While a key range streams by, segments are closed at ``segment_bytes`` and at the end of an
    index. A range's end can leave a segment below its index's threshold; such a piece joins the segment before it (or
    after it), which changes metadata only. Files hold many segments in key order, so their number follows the bytes and not the indexes.

    The driver holds a line for each file of the runs and for each key range, so for each ``file_bytes`` of the data. A task holds
    a row group (or one row) of each of at most ``fan_in`` runs and the numbers of the segments that stay in its indexes, and no document's copies at once.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or scratch_path(spark, "segments")
    runs = fold(spark, make_runs(docs, f"{path}/runs"), f"{path}/runs", fan_in, file_bytes)
    total = sum(f.bytes for run in runs for f in run)
    parts = max(1, math.ceil(total / file_bytes), min(spark.sparkContext.defaultParallelism, math.ceil(total / (4 << 20))))
    tasks, _ = _tasks(spark, [runs], [parts])
    plan = segment_plan(lineage(tasks), settings)
    plan.repartitionByRange("index_name", "segment_number").sortWithinPartitions("index_name", "segment_number").write.mode("overwrite").parquet(f"{path}/plan")
    plan = spark.read.parquet(f"{path}/plan")
    stay_path = f"{path}/stay"
    # a null name would be sorted first; ranges of names keep an index's segments in few files
    plan.where("not rewrite").repartitionByRange("index_name", "segment_number").sortWithinPartitions("index_name", "segment_number").write.mode("overwrite").parquet(stay_path)
    data_path = f"{path}/data"

    def roll(batches):
        for _, part, lo, hi, files in _each_task(batches):
            kept = _kept_segments(stay_path, lo, hi)
            output, held = Output(data_path, part, segment_bytes, file_bytes), None
            for table in _merged(files, lo, hi):
                table = _rewritten(table, kept)
                # the newest row so far of the last document, which may go on
                table = table if held is None else pa.concat_tables([held, table])
                if table.num_rows:
                    table = _sorted(table, DOCUMENT, _order(table.schema))
                    table = table.take(pa.array(last_of_each(table, DOCUMENT)))
                    held = table.slice(table.num_rows - 1)
                    yield from output.write(table.slice(0, table.num_rows - 1))
            if held is not None:
                yield from output.write(held)
            output.close()

    tasks.mapInArrow(roll, _PIECES).write.mode("overwrite").parquet(f"{path}/pieces")
    stretches = spark.read.parquet(f"{path}/pieces")
    pieces = stretches.groupBy("index_name", "part", "piece").agg(
        F.sum("documents").alias("documents"), F.sum("bytes").alias("bytes"), F.min("first_document").alias("first_document"), F.max("last_document").alias("last_document"), F.max("last_sequence_number").alias("last_sequence_number")
    )
    limits = plan.groupBy("index_name").agg(F.max("threshold").alias("threshold"), F.max("segment_number").alias("highest"))
    pieces = pieces.alias("p").join(limits.alias("l"), F.expr("p.index_name <=> l.index_name"), "left").select("p.*", "l.threshold", "l.highest")
    # metadata only: a few pieces per task, whatever the documents
    order = Window.partitionBy("index_name").orderBy("part", "piece")
    enough = F.sum("documents").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    left = F.sum("documents").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    full = (F.col("documents") >= F.col("threshold")) & (left >= F.col("threshold"))
    # a piece opens a new segment if it is large enough and what lies before is too
    opens = (full & (enough - F.col("documents") >= F.col("threshold"))).cast("int")
    number = F.coalesce("highest", F.lit(0)) + 1 + F.sum("opens").over(order)
    numbered = pieces.withColumn("opens", opens).withColumn("segment_number", number)
    numbered.select("index_name", "part", "piece", "segment_number", "documents", "bytes", "first_document", "last_document", "last_sequence_number").write.mode("overwrite").parquet(f"{path}/segments")
    numbered = spark.read.parquet(f"{path}/segments")
    new = numbered.groupBy("index_name", "segment_number").agg(
        F.sum("documents").alias("document_count"), F.sum("bytes").alias("size_bytes"), F.min("first_document").alias("first_document"), F.max("last_document").alias("last_document"), F.max("last_sequence_number").alias("last_sequence_number")
    )
    stay = plan.where("not rewrite")
    stayed = stay.where("size > 0").select("index_name", "segment_number", F.col("size").alias("document_count"), F.col("bytes").alias("size_bytes"), "first_document", "last_document", "last_sequence_number")
    others = [c for c in docs.columns if c not in COLUMNS]
    # the documents of segments that stay are where they were
    few = stay.count() <= BROADCAST_ROWS
    kept_rows = stay.select(F.col("index_name").alias("_index"), F.col("segment_number").alias("_segment"))
    same = docs["index_name"].eqNullSafe(F.col("_index")) & docs["segment_number"].eqNullSafe(F.col("_segment"))
    documents = docs.join(F.broadcast(kept_rows) if few else kept_rows, same, "left_semi").select(*COLUMNS, *[F.col(f"`{c}`") for c in others])
    files = [r["path"] for r in stretches.select("path").distinct().collect()]  # one for each FILE_BYTES
    if files:
        data = spark.read.parquet(*files)
        at = numbered.select(F.col("part").alias("_part"), F.col("piece").alias("_piece"), "segment_number")
        at = F.broadcast(at) if at.count() <= BROADCAST_ROWS else at
        found = data.join(at, ["_part", "_piece"]).select(
            "index_name", "segment_number", "document_id", F.col("_q").alias("sequence_number"), F.col("_w").alias("written_at"), F.col("_x").alias("source"), *[F.col(f"c{k}").alias(c) for k, c in enumerate(others)]
        )
        documents = documents.unionByName(found)
    return Consolidated(plan, new.unionByName(stayed), documents)


class Output:
    """Rolls a key range's documents into segments by bytes and writes them to files by bytes.

    ``write`` gives a line of metadata for each stretch of a piece that it has put into a file.
    """

    def __init__(self, folder: str, part: int, segment_bytes: int, file_bytes: int):
        self.folder, self.part, self.segment_bytes, self.file_bytes = folder, part, segment_bytes, file_bytes
        self.piece = self.held = self.in_file = 0
        self.index: tuple | None = None
        self.waiting: list[pa.Table] = []
        self.writer: pq.ParquetWriter | None = None

    def write(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        index, document = _names(table)
        codes = index.dictionary_encode(null_encoding="encode")
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
        size = table["_b"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        piece = np.empty(len(size), np.int32)
        for k, (lo, hi) in enumerate(zip(starts, [*starts[1:], len(size)])):
            if k or (self.index is not None and self.index != (index[0].as_py(),)):
                # a new piece begins at a new index, and where the bytes of the present piece reach the limit
                self.piece, self.held = self.piece + 1, 0
            before = self.held + np.cumsum(size[lo:hi]) - size[lo:hi]
            piece[lo:hi] = self.piece + before // self.segment_bytes
            end = int(before[-1] + size[hi - 1])
            self.held = end - (int(piece[hi - 1]) - self.piece) * self.segment_bytes
            self.piece = int(piece[hi - 1])
        self.index = (index[len(index) - 1].as_py(),)
        rest = [n for n in table.column_names if n in ("_q", "_w", "_x") or n.startswith("c")]
        out = pa.table({"index_name": index, "document_id": document, "_part": pa.array(np.full(len(size), self.part, np.int64)), "_piece": pa.array(piece)} | {n: table[n] for n in rest})
        if self.writer is not None and self.in_file >= self.file_bytes:
            self.close()
        if self.writer is None:
            self.uri, self.in_file = f"{self.folder}/{uuid.uuid4().hex}.parquet", 0
            fs, path = pafs.FileSystem.from_uri(self.uri)
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            self.sink = fs.open_output_stream(path)
            self.writer = pq.ParquetWriter(self.sink, out.schema, compression="zstd", compression_level=1)
        self.waiting.append(out)
        self.in_file += int(size.sum())
        if sum(t.nbytes for t in self.waiting) >= 8 * GROUP_BYTES:
            self._flush()
        t = pa.table({"piece": pa.array(piece), "index_name": index, "b": table["_b"], "d": document, "q": table["_q"]})
        t = t.group_by(["piece", "index_name"]).aggregate([([], "count_all"), ("b", "sum"), ("d", "min"), ("d", "max"), ("q", "max")])
        n = t.num_rows
        yield pa.Table.from_arrays(
            [pa.array(np.full(n, self.part, np.int64)), t["piece"], pa.array([self.uri] * n), t["index_name"], t["count_all"], t["b_sum"], t["d_min"], t["d_max"], t["q_max"]],
            ["part", "piece", "path", "index_name", "documents", "bytes", "first_document", "last_document", "last_sequence_number"],
        ).combine_chunks().to_batches()[0]

    def _flush(self) -> None:
        if self.waiting:
            self.writer.write_table(pa.concat_tables(self.waiting))
            self.waiting = []

    def close(self) -> None:
        if self.writer is not None:
            self._flush()
            self.writer.close()
            self.sink.close()
            self.writer = None


def replaced(done: Consolidated) -> DataFrame:
    """(index_name, segment_number) of the small segments that the new ones replace, as the merge has found them."""
    return done.plan.where("merge").select("index_name", "segment_number")
