"""Daily rates of a stream: late rows are taken for three days, as the batch side fetches the last three days anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.measures import ppm

LATENESS = "3 days"


def daily_rates(events: DataFrame, time: str = "ts") -> DataFrame:
    """day, event_type, input, ng_qty and ppm of a stream (or a table) of events; errors count as defects."""
    days = events.withWatermark(time, LATENESS).groupBy(F.window(time, "1 day").alias("w"), "event_type")
    sums = days.agg(F.count("*").alias("input"), F.count_if(F.col("value") > 50).alias("ng_qty"))
    return sums.select(F.to_date("w.start").alias("day"), "event_type", "input", "ng_qty", ppm(F.col("ng_qty"), F.col("input")).alias("ppm"))
