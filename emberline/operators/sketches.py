"""Mergeable sketches in the curated tier: quantiles and distinct counts of any longer time, or of several tags, without going back to the readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators.quality import hour

#: Size of the quantile sketch, and how far a quantile's rank may lie off by it (the sketch's published bound, twice over for merges of many).
KLL_K, RANK_ERROR = 400, 0.02
#: Registers (log2) of the distinct-count sketch, and its relative error at three standard deviations.
HLL_LG_K, COUNT_ERROR = 12, 0.05


def hourly_sketches(events: DataFrame) -> DataFrame:
    """tag, hr, n, readings (quantile sketch of value), units (distinct sketch of user_id): a row an hour, whatever it held. An hour without known values has a null sketch."""
    g = events.groupBy(F.col("event_type").alias("tag"), hour().alias("hr"))
    return g.agg(F.count("*").alias("n"), F.kll_sketch_agg_double("value", F.lit(KLL_K)).alias("readings"), F.hll_sketch_agg("user_id", F.lit(HLL_LG_K)).alias("units"))


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """by, n, readings, units: the sketches of each group's rows merged; what was merged can be merged again."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("readings", F.lit(KLL_K)).alias("readings"), F.hll_union_agg("units").alias("units"))


def estimates(sketches: DataFrame, *by: str, share: float = 0.95) -> DataFrame:
    """by, n, quantile, units of merged sketches."""
    quantile = F.when(F.kll_sketch_get_n_double("readings") > 0, F.kll_sketch_get_quantile_double("readings", F.lit(share)))
    return sketches.select(*by, "n", quantile.alias("quantile"), F.hll_sketch_estimate("units").alias("units"))


def compared(estimated: DataFrame, events: DataFrame, by: dict[str, F.Column], share: float = 0.95) -> DataFrame:
    """by, n, users (exact), quantile_near, users_near: whether the estimates lie within the stated errors of the exact values. by: the groups' columns, made from events."""
    names = list(by)
    rows = events.select(*(c.alias(k) for k, c in by.items()), "value", "user_id")
    e = estimated.withColumnsRenamed({k: f"{k}_" for k in names} | {"units": "about", "n": "n_"})
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in names]
    both = rows.join(F.broadcast(e) if len(names) == 1 else e, same)
    g = both.groupBy(*names).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.avg((F.col("value") <= F.col("quantile")).cast("double")).alias("upto"), F.avg((F.col("value") < F.col("quantile")).cast("double")).alias("below"), F.first("about").alias("about"))
    one = 1 / F.col("n")  # a quantile is a reading: between two of them there is none
    near = (F.col("upto") >= share - RANK_ERROR - one) & (F.col("below") <= share + RANK_ERROR + one)
    return g.select(*names, "n", "users", near.alias("quantile_near"), (F.abs(F.col("about") - F.col("users")) <= COUNT_ERROR * F.col("users") + 1).alias("users_near"))
