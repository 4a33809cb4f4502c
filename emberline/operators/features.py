"""Resampling, rolling features and reshaping."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.config import DEFAULT, Config
from emberline.functions.numeric import rounded
from emberline.operators.ordered import BLOCK_ROWS, in_blocks, numbered, sliced, with_sums_before
from emberline.operators.scan import FAN, exclusive_scan
from emberline.session import shared_dir


def tumbling(events: DataFrame, size: str = "1 hour") -> DataFrame:
    g = events.groupBy(F.window("ts", size).alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("v"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "v")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour") -> DataFrame:
    g = events.groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("v"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "v")


def sessions(events: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """A user's events with no gap above the session gap. An event exactly one gap later belongs to the session.

    Events of one stretch as long as the gap are never further apart, so they are one
    row before users meet: a user has a row a stretch, however many its events. Events
    without a time are in no session; those without a user are one user's.
    """
    gap = config.session_gap_minutes * 60_000_000
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    at = us(F.col("ts"))
    stretches = events.where("ts is not null").groupBy("user_id", (at - F.pmod(at, F.lit(gap))).alias("stretch")).agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("until"))
    w = Window.partitionBy("user_id").orderBy("stretch")
    new = F.coalesce((us(F.col("start")) - us(F.lag("until").over(w)) > gap).cast("long"), F.lit(1).cast("long"))
    numbered = stretches.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.min("start").alias("start"), F.max("until").alias("until"), F.sum("n").alias("n")).drop("session")


def behind(events: DataFrame, rows: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, Window]:
    """A tag's readings in blocks of time order that also hold the rows just before, and the window over a block."""
    found = numbered(events.select("event_id", "event_type", "ts", "value"), "event_type", ("ts", "event_id"), block_rows)
    return in_blocks(found, rows, block_rows), Window.partitionBy("event_type", "block").orderBy("at")


def rolling_rows(events: DataFrame, rows: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean of the tag's readings just before each reading."""
    blocks, w = behind(events, rows, block_rows)
    return blocks.withColumn("roll", F.avg("value").over(w.rowsBetween(-rows, -1))).where("own").select("event_id", "roll")


#: Smaller readings are summed as decimals of 15 places, so that differences of long sums lose nothing.
EXACT_BELOW = 1e10


def rolling_time(events: DataFrame, hours: int = 6, slice_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean of a tag's readings in the hours up to each reading, itself and its peers included.

    Readings of one tag and time have one mean, so they are added up first. A sweep
    along the tag's time then sums what lies before both ends of each range, and the
    difference is the range's sum: no task holds a range, however dense it is.
    Missing readings don't count; a range without others has no mean. NaN and infinite
    ones are counted, so they leave no trace in later ranges. Those from EXACT_BELOW on
    are summed as doubles. Readings without a time have only each other.
    """
    span = hours * 3_600_000_000
    v = F.col("value").cast("double")
    size = F.abs(v)
    finite = size < float("inf")  # NaN is above all
    rows = events.select("event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    amounts = {
        "known": F.count(v), "exact": F.coalesce(F.sum(F.when(size < EXACT_BELOW, v.cast("decimal(28,15)"))), F.lit(0)),
        "large": F.coalesce(F.sum(F.when(finite & (size >= EXACT_BELOW), v)), F.lit(0.0)), "n_large": F.count_if(finite & (size >= EXACT_BELOW)),
        "n_nan": F.count_if(F.isnan(v)), "n_up": F.count_if(v == float("inf")), "n_down": F.count_if(v == -float("inf")),
    }
    cells = rows.groupBy("event_type", "us").agg(*(c.alias(k) for k, c in amounts.items()))
    # the begin of a range comes before the readings of the same time, which count in it
    nothing = [F.lit(0).cast(cells.schema[k].dataType).alias(k) for k in amounts]
    begin = F.struct((F.col("us") - span).alias("us"), F.lit(0).alias("kind"), *nothing)
    end = F.struct("us", F.lit(1).alias("kind"), *amounts)
    points = cells.select("event_type", F.col("us").alias("of"), F.explode(F.array(begin, end)).alias("x")).select("event_type", "of", "x.*")
    s = with_sums_before(sliced(points, "event_type", ("us", "kind"), slice_rows), "event_type", {f"{k}_before": F.sum(k) for k in amounts})
    w = Window.partitionBy("event_type", "slice").orderBy("us", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = s.select("event_type", "of", "kind", *(f"{k}_before" for k in amounts), *(F.sum(k).over(w).alias(k) for k in amounts))

    def between(c: str) -> Column:
        found = F.sum(F.when(F.col("kind") == 1, F.col(c)).otherwise(-F.col(c)))
        return found.cast("decimal(37,15)") if c.startswith("exact") else found  # two such add up in 38 digits

    sums = swept.groupBy("event_type", "of").agg(*((between(f"{k}_before") + between(k)).alias(k) for k in amounts))
    mean = F.try_divide(F.col("exact").cast("double") + F.when(F.col("n_large") > 0, F.col("large")).otherwise(0.0), F.col("known").cast("double"))
    up, down = F.col("n_up") > 0, F.col("n_down") > 0
    mean = F.when((F.col("n_nan") > 0) | (up & down), float("nan")).when(up, float("inf")).when(down, -float("inf")).otherwise(mean)
    means = sums.select(F.col("event_type").alias("tag"), "of", mean.alias("roll"))
    return rows.join(means, F.col("event_type").eqNullSafe(F.col("tag")) & F.col("us").eqNullSafe(F.col("of"))).select("event_id", "roll")


def differenced(events: DataFrame, lag: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each reading less the tag's reading `lag` before it."""
    blocks, w = behind(events, lag, block_rows)
    return blocks.withColumn("diff", F.col("value") - F.lag("value", lag).over(w)).where("own").select("event_id", "diff")


#: Rows of a chunk of the exponentially weighted means: what one group holds in a task.
CHUNK_ROWS = 200_000
#: A reading's weight behind so many missing ones is 0 in double precision.
LONGEST_GAP = 10_000


def _kept(w: np.ndarray | int, a: float) -> np.ndarray | float:
    """How much of the mean stays, when a reading comes w steps behind the one before."""
    old = (1 - a) ** w
    return old / (old + a)


def ewma_map(a: float) -> Callable[[tuple, tuple], tuple]:
    """Composition of what two stretches of readings do to a mean.

    A stretch is (lead, first, last, decay, trail): missing readings before its first
    known one, that one, the mean at its end if it began there, how much of a mean at
    its first reading is left at its end, and missing readings at its end. So it maps
    the mean e at its first reading to last + decay * (e - first). One without known
    readings is its length as lead and trail, and nulls.
    """

    def compose(x: tuple, y: tuple) -> tuple:
        if x[1] is None or y[1] is None:
            if x[1] is None and y[1] is None:
                return (x[0] + y[0], None, None, None, x[0] + y[0])
            return (x[0] + y[0], *y[1:]) if x[1] is None else (*x[:4], x[4] + y[4])
        kept = float(_kept(min(x[4] + y[0] + 1, LONGEST_GAP), a))
        return (x[0], x[1], y[2] + y[3] * kept * (x[2] - y[1]), x[3] * kept * y[3], y[4])

    return compose


def _ewma_by_chunks(events: DataFrame, config: Config, chunk_rows: int, fan: int = FAN) -> DataFrame:
    """events (event_id, user_id, ts, value) with ewma, the mean after each reading.

    Rows are ranged by user and time into chunks of about chunk_rows, so a long
    series lies in many. What a chunk does to the mean before it is an associative
    map; the maps of users that lie in several chunks (two a chunk at most) are
    scanned by levels in Spark (see scan), and every chunk then starts from the mean
    before it. Missing readings count as steps, and repeat the mean.
    """
    a = config.ewma_alpha
    spark = events.sparkSession
    root = f"{shared_dir(spark)}/ewma-{uuid.uuid4().hex}"
    # a chunk can hold several users: as text, the names of users stay exact beside a null one
    rows = events.select("event_id", F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("user"), "ts", "value", "user_id")
    count = max(1, -(-events.count() // chunk_rows))
    rows = rows.repartitionByRange(count, "user_id", "ts", "event_id").drop("user_id")
    rows.withColumn("chunk", F.spark_partition_id()).write.parquet(f"{root}/rows")
    chunks = spark.read.parquet(f"{root}/rows")

    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for user, one in pdf.sort_values(["ts", "event_id"]).groupby("user"):
            v = one["value"].to_numpy(dtype=float)
            at = np.flatnonzero(~np.isnan(v))
            if not len(at):
                out.append((user, int(pdf["chunk"].iloc[0]), len(v), None, None, None, len(v)))
                continue
            last = one["value"].ewm(alpha=a, adjust=False).mean().iloc[-1]
            out.append((user, int(pdf["chunk"].iloc[0]), int(at[0]), float(v[at[0]]), last, float(np.prod(_kept(np.diff(at), a))), len(v) - 1 - int(at[-1])))
        return pd.DataFrame(out, columns=["user", "chunk", "lead", "first", "last", "decay", "trail"])

    found = chunks.groupBy("chunk").applyInPandas(maps, "user string, chunk int, lead long, first double, last double, decay double, trail long")
    found.withColumn("parts", F.count("*").over(Window.partitionBy("user"))).where("parts > 1").drop("parts").write.parquet(f"{root}/maps")
    split = spark.read.parquet(f"{root}/maps")
    before = exclusive_scan(split, "user", ewma_map(a), count, fan)

    def finish(pdf: pd.DataFrame, carried: pd.DataFrame) -> pd.DataFrame:
        had = {r.user: (r.last, r.trail) for r in carried.itertuples() if not pd.isna(r.last)}
        parts = [pd.DataFrame({"event_id": pdf["event_id"][:0], "user": pdf["user"][:0], "ts": pdf["ts"][:0], "ewma": []})]
        for user, one in pdf.sort_values(["ts", "event_id"]).groupby("user"):
            lead = [had[user][0]] + [np.nan] * min(int(had[user][1]), LONGEST_GAP) if user in had else []
            means = pd.Series([*lead, *one["value"]], dtype=float).ewm(alpha=a, adjust=False).mean()
            parts.append(one[["event_id", "user", "ts"]].assign(ewma=means.to_numpy()[len(lead) :]))
        return pd.concat(parts[1:] or parts)

    done = chunks.groupBy("chunk").cogroup(before.groupBy("chunk")).applyInPandas(finish, f"event_id long, user string, ts {events.schema['ts'].dataType.simpleString()}, ewma double")
    return done.select("event_id", F.nullif("user", F.lit("")).cast("long").alias("user_id"), "ts", "ewma")


def ewma_last(events: DataFrame, config: Config = DEFAULT, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The last exponentially weighted mean of each user: a fold over the user's readings in time order."""
    series = _ewma_by_chunks(events.where("value is not null"), config, chunk_rows)
    return series.groupBy("user_id").agg(F.max_by("ewma", F.struct("ts", "event_id")).alias("ewma"))


def ewma_series(events: DataFrame, config: Config = DEFAULT, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The exponentially weighted mean after each reading of a user, however long the series."""
    return _ewma_by_chunks(events, config, chunk_rows).select("event_id", "user_id", "ewma")


def ranked(rows: DataFrame, by: str, order: tuple[str, ...], tiles: int, slice_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with rn, rk, dr, tile, pr and cd: row number, rank, dense rank, tile, percent rank and cumulative distribution in the group's order."""
    s = with_sums_before(sliced(rows, by, order, slice_rows), by, {"rows": F.count("*"), "keys": F.count_distinct(F.struct(*order))})
    w = Window.partitionBy(by, "slice").orderBy(*order)
    # peers never lie in two slices, so ranks in a slice need only what lies before it
    local = s.withColumns({"rn": F.row_number().over(w), "rk": F.rank().over(w), "dr": F.dense_rank().over(w), "peers": F.count("*").over(Window.partitionBy(by, "slice", *order))})
    totals = s.groupBy(F.col(by).alias("of")).agg(F.count("*").alias("total"))
    out = local.join(totals, F.col(by).eqNullSafe(F.col("of")))
    rn, rk, total = F.col("rows") + F.col("rn"), F.col("rows") + F.col("rk"), F.col("total")
    small, large = F.floor(total / tiles), total % tiles  # the first tiles have one more
    head = large * (small + 1)
    tile = F.when(rn <= head, F.floor((rn - 1) / (small + 1)) + 1).otherwise(large + F.floor(F.try_divide(rn - head - 1, small)) + 1)
    share = F.when(total > 1, (rk - 1) / (total - 1).cast("double")).otherwise(F.lit(0.0))
    return out.select(*rows.columns, rn.alias("rn"), rk.alias("rk"), (F.col("keys") + F.col("dr")).alias("dr"), tile.alias("tile"), share.alias("pr"), ((rk - 1 + F.col("peers")) / total.cast("double")).alias("cd"))


def daily_pivot(events: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """A row a day, a column a tag. The list of tags is fixed, so no extra pass finds it."""
    return events.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).pivot("event_type", list(config.tags)).agg(F.avg("value"))


def histogram(events: DataFrame, low: float = 0.0, high: float = 200.0, bins: int = 8) -> DataFrame:
    """Rows by bin: 0 below low, bins + 1 from high on."""
    return events.groupBy(F.width_bucket("value", F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def unpivoted(wide: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return wide.unpivot(ids, values, "name", "x")


def rounded_columns(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), digits) for c in names})
