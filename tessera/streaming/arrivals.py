"""Documents as they arrive: a file stream whose batches run the same plans as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream_tables(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def extract_arrivals(arrivals: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Appends ``plan`` of each batch to ``out``, each batch in a folder of its own: a batch that is run again replaces its rows."""

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def step_rates(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts and mean values by event type and window of an event stream or table, late rows up to a limit."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value")).select(F.col("w.start").alias("window_start"), "event_type", "n", "mean_value")
