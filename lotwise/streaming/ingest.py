"""Incremental ingest: records that never change are appended once; late events still count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def landing(spark: SparkSession, folder: str, schema: StructType, pattern: str | None = None, kind: str = "parquet") -> DataFrame:
    """A stream of the files that land in a folder."""
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder)


def append_new(stream: DataFrame, key: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append the records whose key this stream hasn't seen yet to a parquet folder, then stop.

    A key names one immutable record, so what came before is passed over, in this run or an earlier
    one with the same ``checkpoint``; of one batch any is kept. The keys seen are the stream's state, so
    the target is never read again, and a batch that is run twice is written once. Null keys are dropped.
    """
    new = stream.filter(F.col(key).isNotNull()).dropDuplicates([key])
    return new.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and their value by window and kind; events up to ``late`` behind the newest still count.

    Times without a zone are in UTC, as are the windows' beginnings in the result.
    """
    if dict(events.dtypes)[at] == "timestamp_ntz":
        events = events.withColumn(at, F.convert_timezone(F.lit("UTC"), F.current_timezone(), at).cast("timestamp"))
    begins = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("w.start").cast("timestamp_ntz"))
    return (
        events.withWatermark(at, late)
        .groupBy(F.window(at, every).alias("w"), F.col(kind))
        .agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
        .select(begins.alias("begins"), kind, "events", "total")
    )
