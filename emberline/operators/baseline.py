"""The normal operating baseline and deviation from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.config import DEFAULT, Config
from emberline.functions.numeric import adjusted_skewness, zscore
from emberline.operators.features import behind
from emberline.operators.ordered import BLOCK_ROWS, quantiles
from emberline.operators.quality import hourly


def normal(events: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return events.where(F.col("ts") < F.lit(config.cutoff).cast("timestamp_ntz"))


def bands(events: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Per tag, over the normal period: med, p05, p95, mu, sd. One row a tag."""
    rows = normal(events, config)
    exact = quantiles(rows, "event_type", "value", {"med": 0.5, "p05": 0.05, "p95": 0.95}).withColumnRenamed("event_type", "of")
    found = moments(rows)
    return found.join(F.broadcast(exact), F.col("tag").eqNullSafe(F.col("of")), "left").select("tag", "med", "p05", "p95", "mu", "sd")


def moments(rows: DataFrame) -> DataFrame:
    """Per tag: mu and sd."""
    return rows.groupBy(F.col("event_type").alias("tag")).agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))


def mad(events: DataFrame) -> DataFrame:
    """Per tag: median, and median absolute deviation from it. The medians (a row a tag) are broadcast."""
    med = quantiles(events, "event_type", "value", {"med": 0.5}).withColumnRenamed("event_type", "tag")
    both = events.join(F.broadcast(med), F.col("event_type") == F.col("tag"))
    apart = quantiles(both.select("tag", F.abs(F.col("value") - F.col("med")).alias("apart")), "tag", "apart", {"mad": 0.5})
    return med.join(F.broadcast(apart), "tag")


def deviations(events: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """tag, hr, z: how far each hour's mean lies from the baseline, in its standard deviations; null where the baseline does not vary."""
    b = moments(normal(events, config))
    return hourly(events).join(F.broadcast(b), "tag").select("tag", "hr", zscore(F.col("v"), F.col("mu"), F.col("sd")).alias("z"))


def shape(events: DataFrame) -> DataFrame:
    """Per tag: adjusted skewness and population kurtosis."""
    return events.groupBy(F.col("event_type").alias("tag")).agg(adjusted_skewness("value").alias("skew"), F.kurtosis("value").alias("kurt"))


def rolling_z(events: DataFrame, rows: int = 50, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each reading against the tag's rows before it."""
    blocks, w = behind(events, rows, block_rows)
    w = w.rowsBetween(-rows, -1)
    return blocks.withColumn("z", zscore(F.col("value"), F.avg("value").over(w), F.stddev_samp("value").over(w))).where("own").select("event_id", "z")


def quick_p95(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("event_type").alias("tag")).agg(F.percentile_approx("value", F.lit(0.95), F.lit(10000)).alias("p95"))
