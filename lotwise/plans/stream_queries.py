"""Queries that run a stream to its end."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from lotwise.sources.tables import read, shared_folder
from lotwise.streaming import ingest


def stream_event_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events by day and kind, counted by a stream over the landed file with a watermark."""
    schema = read(spark, folder, "events").schema
    counted = ingest.event_counts(ingest.landing(spark, folder, schema, "events.parquet"))
    # state and result must lie where all executors reach them; only on one machine there may be no such folder
    base = f"{shared_folder(spark) or tempfile.mkdtemp(prefix='lotwise-stream-')}/event_counts_{uuid.uuid4().hex}"
    writer = counted.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/table"))
    writer.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/table")


def queries() -> dict:
    return {"stream_event_counts": stream_event_counts}


def oracle_sql() -> dict[str, str]:
    return {"stream_event_counts": "SELECT date_trunc('day', ts) AS begins, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"}
