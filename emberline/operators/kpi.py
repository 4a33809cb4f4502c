"""Deterioration over time, from hourly deviations (tag, hr, z)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.config import DEFAULT, Config


def _w() -> Window:
    return Window.partitionBy("tag").orderBy("hr")


def smoothed(z: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Mean over the last smooth_rows hours, by the clock: an hour without readings is a hole in the mean, and brings no older one in."""
    w = Window.partitionBy("tag").orderBy("us").rangeBetween((1 - config.smooth_rows) * 3_600_000_000, 0)
    return z.withColumn("us", F.unix_micros(F.col("hr").cast("timestamp"))).select("tag", "hr", F.avg("z").over(w).alias("kpi"))


def cusum(z: DataFrame) -> DataFrame:
    return z.select("tag", "hr", F.sum("z").over(_w().rowsBetween(Window.unboundedPreceding, 0)).alias("cs"))


def rise(z: DataFrame) -> DataFrame:
    """How far the cumulated deviation has risen above its lowest value so far; never negative."""
    cs = cusum(z)
    return cs.select("tag", "hr", (F.col("cs") - F.min("cs").over(_w().rowsBetween(Window.unboundedPreceding, 0))).alias("rise"))


def trend(z: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Slope of z per day, by tag."""
    day = F.date_diff(F.to_date("hr"), F.lit(config.start[:10]).cast("date")).cast("double")
    return z.withColumn("day", day).groupBy("tag").agg(F.regr_slope("z", "day").alias("slope"))


def periods(z: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Mean z before and after the cutoff, and the change."""
    late = F.col("hr") >= F.lit(config.cutoff).cast("timestamp_ntz")
    return z.groupBy("tag").agg(F.avg(F.when(~late, F.col("z"))).alias("before"), F.avg(F.when(late, F.col("z"))).alias("after")).withColumn("change", F.col("after") - F.col("before"))
