"""Call logs as streams: an extension beside the batch operators, with the same functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.redact import redact


def redact_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str) -> StreamingQuery:
    """New files of a JSON-lines log, redacted into another; each file once, also over restarts."""
    calls = redact(spark.readStream.schema(schema).json(source))
    return calls.writeStream.format("json").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity_stream(events: DataFrame, time: str, author: str, group: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts per author and group in windows of event time; what comes later than ``late`` is left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), author, group).agg(F.count(F.lit(1)).alias("total"))
