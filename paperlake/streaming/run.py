"""Running a stream over files that are there to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import folder


def events_stream(spark: SparkSession, sf_dir: str, late: str = "10 minutes") -> DataFrame:
    """events as a stream (ts, metric, value, event_id, user_id) with a watermark."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withWatermark("ts", late).withColumnRenamed("event_type", "metric")


def run_to_end(stream: DataFrame, mode: str = "append", paged: bool = False) -> DataFrame:
    """Process all there is, exactly once, into the shared folder, and read the result.

    paged: the source learns of further data only by reading on, so the stream runs until a read brings nothing.
    """
    spark = stream.sparkSession
    out = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}-state")
    q = writer.start(out) if paged else writer.trigger(availableNow=True).start(out)
    try:
        q.processAllAvailable() if paged else q.awaitTermination()
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(out)
