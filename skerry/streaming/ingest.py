"""Feeding an index from a stream, and calendar buckets on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Index


def ingest(stream: DataFrame, index: Index, checkpoint: str, name: str = "ingest", order: Column | str = "position", available_now: bool = True, interval: str = "1 second", refresh: bool = True) -> StreamingQuery:
    """Applies a stream of operations (op, id, source and a column to order by) to the index.

    Each micro-batch is one bulk, with its number noted in the manifest together with its
    changes, so a batch that is run again after a failure changes nothing. ``refresh`` after each batch
    makes it searchable.
    """

    def apply(batch: DataFrame, number: int) -> None:
        # positions within the batch; a sorted range per partition, offset by the rows before it
        rows = batch.select("op", "id", "source", F.col(order).alias("_o") if isinstance(order, str) else order.alias("_o"))
        ranged = rows.repartitionByRange("_o").sortWithinPartitions("_o").withColumn("_p", F.spark_partition_id()).persist()
        counts = {r["_p"]: r["n"] for r in ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}
        before, at = {}, 0
        for p in sorted(counts):
            before[p], at = at, at + counts[p]
        if at:
            start = F.create_map(*[x for p, b in before.items() for x in (F.lit(p), F.lit(b).cast("bigint"))])
            within = F.row_number().over(Window.partitionBy("_p").orderBy("_o"))
            index.bulk_frame(ranged.select((start[F.col("_p")] + within).alias("position"), "op", "id", "source"), batch=(name, number))
        ranged.unpersist()
        if refresh:
            index.refresh()

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def histogram(stream: DataFrame, time: str, interval: str, late: str) -> DataFrame:
    """(key, doc_count) per calendar interval (``1 minute``, ``1 hour``, ``1 day``), closed once ``late`` has passed."""
    counts = stream.withWatermark(time, late).groupBy(F.window(time, interval)).agg(F.count(F.lit(1)).alias("doc_count"))
    return counts.select(F.date_format("window.start", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("key"), "doc_count")
