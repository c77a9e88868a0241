"""Streams whose state expires: one row per key and span of time, by the engine's own keyed state and a watermark.

A row is the first of its key in its span; later ones of that span are dropped. The state holds a key until the watermark
is past the row that made it, so its size follows the keys of the last spans, not the stream. The delay must be at least
the span, and rows that come later than the delay are dropped: they are past the freshness that the delay stands for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_of_span(rows: DataFrame, keys: list[str], at: str, span: str = "1 day", delay: str = "2 days") -> DataFrame:
    """rows (a stream) with the beginning of their span as `span_start`, one per keys and span."""
    timed = rows.withWatermark(at, delay).withColumn("span_start", F.window(at, span)["start"])
    return timed.dropDuplicatesWithinWatermark([*keys, "span_start"])


def run(rows: DataFrame, keys: list[str], at: str, out: str, checkpoint: str, span: str = "1 day", delay: str = "2 days") -> StreamingQuery:
    """Start a run over all that is there; a later run goes on from the checkpoint, with the state of this one."""
    found = first_of_span(rows, keys, at, span, delay)
    return found.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
