"""Statistics of run reports by period on a stream (an extension: the batch form is E7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import scenario_id
from ..operators.metrics import c


def run_statistics(stream: DataFrame, metric: str = "costs", period: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, scenario_id, n, mean, low, high) of runs (test:nodeid, test:start, a metric) by period; rows later than `late` are dropped by the watermark.

    Works on batch frames too, where the watermark has no effect.
    """
    at = F.timestamp_seconds(c("test:start")).alias("at")
    rows = stream.select(at, scenario_id(c("test:nodeid")).alias("scenario_id"), c(metric).cast("double").alias("value"))
    grouped = rows.withWatermark("at", late).groupBy(F.window("at", period).alias("w"), "scenario_id")
    return grouped.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")).select(F.col("w.start").alias("start"), "scenario_id", "n", "mean", "low", "high")
