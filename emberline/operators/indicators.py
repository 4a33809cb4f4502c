"""Leading indicators: what comes before the target tag; and the impact of fuel substitution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.config import DEFAULT, Config
from emberline.functions.linear import least_squares
from emberline.functions.numeric import safe_corr
from emberline.operators.ordered import SLICE_ROWS, carried, last_known, sliced, with_carried, with_sums_before
from emberline.operators.quality import hour

HOUR_US = 3_600_000_000


def _us(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def lagged_correlation(grid: DataFrame, driver: str, target: str, lag: int) -> DataFrame:
    """One row: correlation of the driver's hour with the target's hour `lag` later. grid: tag, hr, v, any hours missing.

    The later hour is found by its time, not by counting rows, so holes do no harm.
    """
    wide = grid.where(F.col("tag").isin(driver, target)).groupBy("hr").pivot("tag", [driver, target]).agg(F.first("v")).withColumnsRenamed({driver: "d", target: "t"})
    later = wide.select((F.col("hr") - F.make_interval(hours=F.lit(lag))).cast("timestamp_ntz").alias("hr"), F.col("t").alias("later"))
    return wide.select("hr", "d").join(later, "hr").agg(safe_corr("d", "later").alias("r"), F.count(F.when(F.col("d").isNotNull() & F.col("later").isNotNull(), 1)).alias("n"))


def precursors(events: DataFrame, precursor: str, target: str, config: Config = DEFAULT) -> DataFrame:
    """target_id, precursor_id: the precursors of the same unit in the hours before each target event."""
    return tagged_precursors(events, [precursor], target, config).select("target_id", "precursor_id")


def tagged_precursors(events: DataFrame, tags: list[str], target: str, config: Config = DEFAULT) -> DataFrame:
    """target_id, precursor_id, tag: the events of these tags of the same unit in the hours before each target event.

    A range join by time buckets: a target event looks up the two buckets that its
    range can touch, so a unit's events are compared with near ones only.
    """
    us, size = "us", config.precursor_hours * HOUR_US
    e = events.select("event_id", "user_id", "event_type", _us("ts").alias(us))
    target_rows = e.where(F.col("event_type") == target).select(F.col("event_id").alias("target_id"), F.col("user_id").alias("unit"), F.col(us).alias("t_us"))
    target_rows = target_rows.withColumn("bucket", F.explode(F.array((F.col("t_us") / size).cast("long"), (F.col("t_us") / size).cast("long") - 1)))
    early = e.where(F.col("event_type").isin(tags)).select(F.col("event_id").alias("precursor_id"), F.col("event_type").alias("tag"), F.col("user_id").alias("unit"), F.col(us).alias("p_us"), (F.col(us) / size).cast("long").alias("bucket"))
    near = target_rows.join(early, ["unit", "bucket"])
    return near.where((F.col("p_us") < F.col("t_us")) & (F.col("p_us") >= F.col("t_us") - size)).select("target_id", "precursor_id", "tag")


def precursor_rate(events: DataFrame, precursor: str, target: str, config: Config = DEFAULT, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row: target events and those with a precursor of the unit in the hours before, their rate, the base rate (of all other readings), and the lift of the one over the other.

    Only the last precursor before a reading matters, and that is found, or carried
    from an earlier slice, in one pass over the unit's readings in time order.
    """
    span = config.precursor_hours * HOUR_US
    rows = events.select("user_id", "event_type", _us("ts").alias("us"), F.coalesce(F.col("event_type") == precursor, F.lit(False)).alias("is_precursor"))
    s = sliced(rows, "user_id", ("us",), slice_rows)  # readings of one time lie in one slice
    precursor_us = F.when(F.col("is_precursor"), F.col("us"))
    s = with_carried(s, "user_id", carried(s, "user_id", {"earlier_us": F.max(precursor_us)}, {"earlier_us": F.max}))
    before = Window.partitionBy("user_id", "slice").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("last_us", F.coalesce(F.max(precursor_us).over(before), "earlier_us"))
    found = s.withColumn("hit", F.coalesce(F.col("us") - F.col("last_us") <= span, F.lit(False)).cast("long"))
    is_target = F.coalesce(F.col("event_type") == target, F.lit(False))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = found.agg(n(is_target.cast("long")).alias("events"), n(F.when(is_target, F.col("hit"))).alias("hits"), n((~is_target).cast("long")).alias("others"), n(F.when(~is_target, F.col("hit"))).alias("other_hits"))
    rate, base = (F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")) for a, b in (("hits", "events"), ("other_hits", "others")))
    return sums.select("events", "hits", rate.alias("rate"), base.alias("base"), F.try_divide(rate, base).alias("lift"))


def as_of(events: DataFrame, precursor: str, target: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """For each target event the unit's last precursor at or before it: target_id, precursor_id (null if none).

    One pass over the union in time order, so no candidate pairs are made; of a unit
    in many slices the last precursor before a slice is carried into it.
    """
    both = events.where(F.col("event_type").isin(precursor, target)).select("event_id", "user_id", "ts", (F.col("event_type") == target).alias("is_target"))
    order = ("ts", "is_target", "event_id")
    found = last_known(sliced(both, "user_id", order, slice_rows), "user_id", order, F.when(~F.col("is_target"), F.col("event_id")), "precursor_id")
    return found.where("is_target").select(F.col("event_id").alias("target_id"), "precursor_id")


def fuel_share(events: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """hr, share of rows that stand for substituted fuel."""
    return events.groupBy(hour().alias("hr")).agg((F.sum((F.col("event_type") == config.fuel).cast("int")) / F.count("*").cast("double")).alias("share"))


def fuel_impact(share: DataFrame, z: DataFrame, quartiles: int = 4) -> DataFrame:
    """Per quartile of the share and tag: n, mean and spread of z. Hours are few, so one window over them is small."""
    bucketed = share.select("hr", F.ntile(quartiles).over(Window.orderBy("share", "hr")).cast("long").alias("bucket"))
    return z.join(bucketed, "hr").groupBy("bucket", "tag").agg(F.count("*").alias("n"), F.avg("z").alias("mean_z"), F.stddev_samp("z").alias("sd_z"))


def fuel_effect(events: DataFrame, z: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """tag, n, share, se_share, hour_of_day, se_hour_of_day, load, se_load: the regression of the tag's z on the substitution share, adjusted for the hour of the day and the load (readings of the hour)."""
    share = events.groupBy(hour().alias("hr")).agg((F.sum((F.col("event_type") == config.fuel).cast("int")) / F.count("*").cast("double")).alias("share"), F.count("*").alias("load"))
    rows = z.join(share, "hr").withColumn("hour_of_day", F.hour("hr"))
    return least_squares(rows, "tag", "z", ["share", "hour_of_day", "load"])


def unit_regression(events: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Per unit: correlation, slope and fit of value on time in seconds; null where either does not vary. No result depends on where time begins, so it begins at config.start."""
    start = F.unix_micros(F.lit(config.start).cast("timestamp_ntz").cast("timestamp"))
    t = events.select("user_id", "value", ((_us("ts") - start) / 1e6).alias("s"))
    r = safe_corr("s", "value")
    both = F.col("s").isNotNull() & F.col("value").isNotNull()
    return t.where(both).groupBy("user_id").agg(r.alias("r"), F.try_divide(F.covar_pop("s", "value"), F.var_pop("s")).alias("slope"), (r * r).alias("r2"))


def root_causes(events: DataFrame, target: str, config: Config = DEFAULT, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Per other tag: pairs with a target event of the same unit within the precursor range, and target events in such pairs.

    No pair is made. A sweep over a unit's time counts the precursors before each end of
    a target's range; the difference of the two counts is the target's number of pairs.
    """
    tags = [t for t in config.tags if t != target]
    counts = precursor_counts(events, tags, target, config, slice_rows)
    sums = counts.agg(*(F.coalesce(F.sum(f"n_{t}"), F.lit(0)).alias(f"n_{t}") for t in tags), *(F.count_if(F.col(f"n_{t}") > 0).alias(f"t_{t}") for t in tags))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(t).alias("tag"), F.col(f"n_{t}").alias("pairs"), F.col(f"t_{t}").alias("targets")) for t in tags))).alias("x")).select("x.*")


def precursor_counts(events: DataFrame, tags: list[str], target: str, config: Config = DEFAULT, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """A row a target event, with n_<tag>: how many events of the tag the unit has in the hours before. Events of no unit or time have no pairs."""
    span = config.precursor_hours * HOUR_US
    e = events.where("user_id is not null and ts is not null").select("event_id", "user_id", "event_type", _us("ts").alias("us"))
    # the ends of a range come before the precursors of the same time: those at its begin count, those at its end don't
    ends = e.where(F.col("event_type") == target).select("user_id", F.explode(F.array(F.struct((F.col("us") - span).alias("us"), F.lit(-1).alias("sign")), F.struct("us", F.lit(1).alias("sign")))).alias("x"), "event_id")
    ends = ends.select("user_id", "x.us", F.lit(0).alias("kind"), "event_id", "x.sign", F.lit(None).cast("string").alias("tag"))
    early = e.where(F.col("event_type").isin(tags)).select("user_id", "us", F.lit(1).alias("kind"), "event_id", F.lit(0).alias("sign"), F.col("event_type").alias("tag"))
    order = ("us", "kind", "event_id")
    s = sliced(ends.unionAll(early), "user_id", order, slice_rows)
    one = {t: F.coalesce((F.col("tag") == t).cast("long"), F.lit(0)) for t in tags}
    s = with_sums_before(s, "user_id", {f"b_{t}": F.sum(one[t]) for t in tags})
    w = Window.partitionBy("user_id", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = s.select("event_id", "kind", "sign", *((F.col(f"b_{t}") + F.sum(one[t]).over(w)).alias(f"c_{t}") for t in tags))
    return swept.where("kind = 0").groupBy("event_id").agg(*(F.sum(F.col("sign") * F.col(f"c_{t}")).alias(f"n_{t}") for t in tags))
