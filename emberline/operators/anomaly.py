"""Anomaly rules and the episodes that flagged hours make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.config import DEFAULT, Config
from emberline.operators.baseline import mad
from emberline.operators.features import sessions
from emberline.operators.ordered import SLICE_ROWS, carried, quantiles, sliced, with_carried, with_sums_before


def by_z(z: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return z.where(F.abs("z") > config.z_alert)


def by_iqr(events: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Readings outside the quartiles by iqr_factor times their distance."""
    q = quantiles(events, "event_type", "value", {"q1": 0.25, "q3": 0.75}).withColumnRenamed("event_type", "tag")
    far = config.iqr_factor * (F.col("q3") - F.col("q1"))
    return events.join(F.broadcast(q), F.col("event_type") == F.col("tag")).where((F.col("value") < F.col("q1") - far) | (F.col("value") > F.col("q3") + far)).select("event_id", "tag", "value")


def by_mad(events: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Readings with a modified z-score above mad_alert. Nothing where the deviation is 0."""
    score = F.try_divide(0.6745 * F.abs(F.col("value") - F.col("med")), F.col("mad"))
    return events.join(F.broadcast(mad(events)), F.col("event_type") == F.col("tag")).where(score > config.mad_alert).select("event_id", "tag", "value")


def episodes(flagged: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """tag, episode, start, until, n, peak: flagged hours (tag, hr, z) at most episode_gap_hours apart."""
    w = Window.partitionBy("tag").orderBy("hr")
    gap = F.timestamp_diff("HOUR", F.lag("hr").over(w), F.col("hr"))
    new = F.coalesce((gap > config.episode_gap_hours).cast("long"), F.lit(1).cast("long"))
    numbered = flagged.withColumn("new", new).withColumn("episode", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("tag", "episode").agg(F.min("hr").alias("start"), F.max("hr").alias("until"), F.count("*").alias("n"), F.max(F.abs("z")).alias("peak"))


def unit_sessions(events: DataFrame, config: Config = DEFAULT, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Sessions by flags and a running sum; equal to the session window.

    A unit may lie in many slices: the time before a slice and the number of
    sessions begun before it are carried into it.
    """
    s = sliced(events.select("user_id", "ts", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")), "user_id", ("ts", "event_id"), slice_rows)
    s = with_carried(s, "user_id", carried(s, "user_id", {"us_before": F.max("us")}, {"us_before": F.max}))
    w = Window.partitionBy("user_id", "slice").orderBy("ts", "event_id")
    gap = F.col("us") - F.coalesce(F.lag("us").over(w), "us_before")
    new = F.coalesce((gap > config.session_gap_minutes * 60_000_000).cast("long"), F.lit(1).cast("long"))
    flagged = with_sums_before(s.withColumn("new", new), "user_id", {"begun": F.sum("new")})
    numbered = flagged.withColumn("session", F.col("begun") + F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("until"), F.count("*").alias("n"))


def pareto(found: DataFrame) -> DataFrame:
    """Episodes per tag, ranked, with the running share. One row a tag."""
    n = found.groupBy("tag").agg(F.count_distinct("episode").alias("episodes"))
    w = Window.orderBy(F.desc("episodes"), "tag")
    total = F.sum("episodes").over(Window.partitionBy())
    return n.select("tag", "episodes", F.rank().over(Window.orderBy(F.desc("episodes"))).cast("long").alias("place"), (F.sum("episodes").over(w.rowsBetween(Window.unboundedPreceding, 0)) / total.cast("double")).alias("share"))


__all__ = ["by_iqr", "by_mad", "by_z", "episodes", "pareto", "sessions", "unit_sessions"]
