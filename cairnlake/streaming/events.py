"""Structured Streaming over event files: an extension beyond the batch operators, in the same vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 10) -> DataFrame:
    """New Parquet files of a folder as a stream, a bounded number of them at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def without_repeats(events: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Each key once, as long as its repeat is not later than the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def sliding_counts(events: DataFrame, key: str, ts: str, width: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events per key in sliding windows; a window closes when the watermark passes it."""
    counts = events.withWatermark(ts, late).groupBy(F.window(ts, width, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counts.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends closed rows as Parquet until what is there now has been read."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
