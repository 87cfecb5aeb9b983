"""Progress reports that grow as results come in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_reports(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append streamed report lines (line) as text, each micro-batch once, until the source is used up."""
    return lines.select("line").writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
