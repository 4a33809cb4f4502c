"""Quality, coverage and cleaning of readings (event_id, ts, user_id, event_type, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.config import DEFAULT, Config
from emberline.functions.numeric import rounded
from emberline.operators.ordered import BLOCK_ROWS, in_blocks, numbered


def hour(c: str = "ts"):
    return F.date_trunc("hour", F.col(c)).cast("timestamp_ntz")


def profile(events: DataFrame) -> DataFrame:
    """Per tag: rows, known values, different users, extremes."""
    return events.groupBy(F.col("event_type").alias("tag")).agg(F.count("*").alias("n"), F.count("value").alias("known"), F.count_distinct("user_id").alias("users"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def coverage(events: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Per tag: hours with data, of the hours expected."""
    seen = events.groupBy(F.col("event_type").alias("tag")).agg(F.count_distinct(hour()).alias("hours"))
    return seen.withColumn("coverage", rounded(F.col("hours") / F.lit(float(config.hours))))


def hourly(events: DataFrame) -> DataFrame:
    """tag, hr, v: the mean of each hour."""
    return events.groupBy(F.col("event_type").alias("tag"), hour().alias("hr")).agg(F.avg("value").alias("v"))


def grid(events: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Every tag at every expected hour, with the hour's mean or, in gaps, the last one before; null before the first."""
    spark = events.sparkSession
    start = F.lit(config.start).cast("timestamp_ntz")
    hours = spark.range(config.hours).select((start + F.make_interval(hours=F.col("id").cast("int"))).cast("timestamp_ntz").alias("hr"))
    tags = events.select(F.col("event_type").alias("tag")).distinct()
    every = hours.crossJoin(F.broadcast(tags))  # expected hours x tags: both lists are fixed
    filled = every.join(hourly(events), ["tag", "hr"], "left")
    w = Window.partitionBy("tag").orderBy("hr").rowsBetween(Window.unboundedPreceding, 0)
    return filled.select("tag", "hr", F.last("v", ignorenulls=True).over(w).alias("v"), F.col("v").isNull().alias("filled"))


def keep_first(events: DataFrame) -> DataFrame:
    """The first reading of each (user_id, event_type), by ts, then event_id."""
    first = F.min_by(F.struct(*events.columns), F.struct("ts", "event_id")).alias("first")  # kept on the map side
    return events.groupBy(F.col("user_id").alias("unit"), F.col("event_type").alias("tag")).agg(first).select("first.*")


def stuck(events: DataFrame, config: Config = DEFAULT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Runs of readings of a tag that barely change: tag, run, n, start, until. Runs of one reading are left out.

    Runs are numbered along the blocks of a tag, so one may lie in several.
    """
    found = numbered(events.select("event_id", "event_type", "ts", "value"), "event_type", ("ts", "event_id"), block_rows)
    w = Window.partitionBy("event_type", "block").orderBy("at")
    flagged = in_blocks(found, 1, block_rows).withColumn("new", F.coalesce((F.abs(F.col("value") - F.lag("value").over(w)) > config.stuck_eps).cast("int"), F.lit(1))).where("own")
    begun = flagged.groupBy(F.col("event_type").alias("of"), F.col("block").alias("of_block")).agg(F.sum("new").alias("begun"))  # a row a block
    earlier = Window.partitionBy("of").orderBy("of_block").rowsBetween(Window.unboundedPreceding, -1)
    begun = begun.withColumn("begun", F.coalesce(F.sum("begun").over(earlier), F.lit(0)))
    local = flagged.withColumn("local", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = local.join(F.broadcast(begun), F.col("event_type").eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block"))).withColumn("run", F.col("begun") + F.col("local"))
    return runs.groupBy(F.col("event_type").alias("tag"), "run").agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("until")).where("n > 1")


def json_attribute(events: DataFrame, path: str = "$.k", name: str = "k") -> DataFrame:
    return events.withColumn(name, F.get_json_object("props", path))


def tolerant(events: DataFrame) -> DataFrame:
    """value over a JSON number that may be missing, zero or no number."""
    k = F.get_json_object("props", "$.k").try_cast("double")
    return events.select("event_id", k.alias("k"), rounded(F.try_divide(F.col("value"), k)).alias("ratio"))
