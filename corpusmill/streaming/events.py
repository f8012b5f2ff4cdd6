"""Operators on event streams; each works on a stream and, with the same rows, on a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rates(events: DataFrame, ts: str, key: str, width: str, limit: int, late: str | None = None) -> DataFrame:
    """Events of each key in tumbling windows, and whether they are over a limit. ``late`` is the watermark of a stream."""
    rows = events.withWatermark(ts, late) if late else events
    counts = rows.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("w.start").alias("window_start"), "n", (F.col("n") > limit).alias("over_limit"))


def first_of_repeats(events: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """Events of a stream without those that repeat one of the same keys within a time; state goes with the watermark."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def new_rows(spark: SparkSession, path: str, schema: T.StructType | str, key: str, known: Callable[[], DataFrame], write: Callable[[DataFrame], None], checkpoint: str, files: int = 100):
    """Reads what has come to a folder since the last run, drops rows whose key is known, and writes the rest batch by batch.

    The checkpoint holds what was read, so a run that is stopped goes on where it was.
    """

    def batch(rows: DataFrame, _: int) -> None:
        write(rows.dropDuplicates([key]).join(known().select(key), key, "left_anti"))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
