"""Structured Streaming around the engine: continuous ingest, and windowed counts with late data.

These are extensions; batches use the same operators as the batch path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sedgeway.config import Scope
from sedgeway.plans.engine import Engine

FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest_stream(engine: Engine, scope: Scope, folder: str, checkpoint: str) -> StreamingQuery:
    """Ingest files as they appear; a content that is stored already is skipped, so replays are harmless."""
    found = engine.spark.readStream.format("binaryFile").schema(FILES).load(folder)
    rows = found.select(
        F.element_at(F.split("path", "/"), -1).alias("source"), "content", F.lit(None).cast("string").alias("media_type"), F.xxhash64("path").alias("ingest_seq")
    ).where(~F.col("source").startswith("."))

    def batch(df: DataFrame, _: int) -> None:
        df = df.persist()
        try:
            if df.take(1):
                engine.ingest(scope, df)
        finally:
            df.unpersist()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per type and tumbling window, closed by a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def event_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
