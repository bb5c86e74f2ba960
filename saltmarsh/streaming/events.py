"""Event streams: windows, sessions, duplicates, metric roll-ups and hand-over to other sinks.

All take a streaming or a batch DataFrame of (event_id, ts, user_id, event_type, value); ts is cast to TIMESTAMP, which
watermarks ask for. State is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "10 minutes"


def read(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream over a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def timed(events: DataFrame, late: str = LATE) -> DataFrame:
    x = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return x.withWatermark("ts", late) if events.isStreaming else x


def _window(events: DataFrame, window, late: str, by: list[str]) -> DataFrame:
    g = timed(events, late).groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def tumbling(events: DataFrame, size: str = "1 hour", late: str = LATE, by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    return _window(events, F.window("ts", size), late, list(by))


def sliding(events: DataFrame, size: str = "1 hour", slide: str = "15 minutes", late: str = LATE, by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    return _window(events, F.window("ts", size, slide), late, list(by))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE, by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    return _window(events, F.session_window("ts", gap), late, list(by))


def deduplicated(events: DataFrame, late: str = LATE, keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    x = timed(events, late)
    return x.dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else x.dropDuplicates(list(keys))


def start(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append", available_now: bool = True):
    """Runs a stream into a function of (batch, batch id); with the checkpoint every batch takes effect once per id."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class Handlers:
    """Named handlers of event batches; one that fails doesn't stop the others."""

    def __init__(self):
        self.handlers: dict[str, Callable[[DataFrame, int], None]] = {}
        self.failures: list[tuple[str, int, str]] = []

    def add(self, name: str, handler: Callable[[DataFrame, int], None]) -> "Handlers":
        self.handlers[name] = handler
        return self

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        for name, handler in self.handlers.items():
            try:
                handler(batch, batch_id)
            except Exception as e:  # handlers are the user's code
                self.failures.append((name, batch_id, str(e)))
