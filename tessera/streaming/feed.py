"""Streams over arriving files and rows. A file stream knows new paths, not changed or deleted ones, so a
workspace stream only says *when* to look; what changed comes from the snapshot diff."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.upsert import upsert
from tessera.sources.store import VersionedTable


def watch_workspace(engine, workspace: str, checkpoint: str, continuous: str | None = None) -> StreamingQuery:
    """Update a workspace whenever files arrive; once for all that is there if ``continuous`` (a trigger interval) is not given."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    arrived = engine.spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(workspace).select("path")

    def on_batch(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            engine.update(workspace)

    writer = arrived.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)).start()


def upsert_stream(rows: DataFrame, target: VersionedTable, keys: list[str], sequence: str, checkpoint: str) -> StreamingQuery:
    """Keep ``target`` at the latest row of every key, one new snapshot per batch."""

    def on_batch(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            target.write(upsert(target.read(), batch, keys, sequence))

    return rows.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def edges_per_window(edges: DataFrame, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """(start, predicate, n) of an edge stream by the time of record; rows later than ``late`` are dropped, others still counted."""
    timed = edges.withColumn("at", F.col("recorded_at").cast("timestamp")).where("at is not null").withWatermark("at", late)
    return timed.groupBy(F.window("at", window).alias("w"), "predicate").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "predicate", "n")


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there into an in-memory table (for tests and small results)."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
