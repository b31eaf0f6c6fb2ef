"""Streaming forms of the gates and logs; an extension, as batch is the usual way to curate.

Rows pass the same gate columns as in batch. Late deliveries of a key are dropped within the watermark, and window counts are
final once the watermark has passed. State is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.gates import waterfall


def gated_stream(stream: DataFrame, gates: list[tuple[str, Column]], key: str, time: str, lateness: str = "1 hour") -> DataFrame:
    """Each key once within the lateness, with the reason of its first failing gate."""
    return waterfall(stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key]), gates)


def reasons_by_window(gated: DataFrame, time: str, window: str = "1 hour", reason: str = "reason") -> DataFrame:
    """(start, reason, rows) per window of event time."""
    counts = gated.groupBy(F.window(time, window), F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("rows"))
    return counts.select(F.col("window.start").alias("start"), "reason", "rows")


def log_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the rows as JSON lines, each exactly once, and ends when what is there has been read."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
