"""Structured Streaming from a drop folder into the store. An extension: the batch engine's upserts make it idempotent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.plans.engine import Engine

FILES = "path string, modificationTime timestamp, length long, content binary"


def read_folder(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """A stream of (path, modified, size, content) of new files."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def ingest_folder(engine: Engine, folder: str, checkpoint: str, glob: str | None = None, once: bool = True) -> StreamingQuery:
    """Ingests new files batch by batch; a batch that is run again replaces the same documents."""

    def put(batch: DataFrame, batch_id: int) -> None:
        engine.ingest_files(batch, at=f"batch-{batch_id:08d}")

    writer = read_folder(engine.spark, folder, glob).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts per window and key of a stream or table, with rows later than `late` left out of a stream's state."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))
