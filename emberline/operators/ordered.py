"""Positions in the order of a group's rows, for windows over groups of any size.

A window by tag alone sends all readings of a tag to one task. Here rows are ranged
by group and order into slices first; a slice's rows are numbered in the slice, and
what the group's slices before it hold (sums, last values, gaps) is carried into
it by a row a slice. Windows then run over a slice, or over blocks of so many
positions, into which the rows just before are copied.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.session import shared_dir

#: Rows of a slice, and positions of a block.
SLICE_ROWS = BLOCK_ROWS = 500_000


def sliced(rows: DataFrame, by: str, order: tuple[str, ...], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """rows with `slice`: ranges of (by, order). Equal rows lie in one slice. Written, as a lost task could not deal them again alike."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/slices-{uuid.uuid4().hex}"
    # a range of equal keys is never cut, so by and order alone decide
    rows.repartitionByRange(max(1, -(-rows.count() // slice_rows)), by, *order).withColumn("slice", F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def carried(slices: DataFrame, by: str, amounts: dict[str, Column], combine: dict[str, Callable[[str], Column]], after: bool = False) -> DataFrame:
    """by_, slice_, and each amount (an aggregate) combined over the group's slices before (or after) this one.

    Only groups that lie in several slices have rows: a group between the first and
    the last of a slice lies in no other, so these are two rows a slice at most,
    however many groups there are. Where a group has no row, nothing is carried.
    """
    parts = slices.groupBy(by, "slice").agg(*(a.alias(k) for k, a in amounts.items()))
    parts = parts.withColumn("in_slices", F.count("*").over(Window.partitionBy(by))).where("in_slices > 1")
    w = Window.partitionBy(by).orderBy(F.desc("slice") if after else F.asc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(F.col(by).alias("by_"), F.col("slice").alias("slice_"), *(combine[k](k).over(w).alias(k) for k in amounts))


def with_carried(slices: DataFrame, by: str, base: DataFrame) -> DataFrame:
    """slices with the columns of base (of carried()), null where nothing is carried."""
    same = F.col(by).eqNullSafe(F.col("by_")) & (F.col("slice") == F.col("slice_"))
    return slices.join(F.broadcast(base), same, "left").drop("by_", "slice_")  # two rows a slice


def with_sums_before(slices: DataFrame, by: str, amounts: dict[str, Column]) -> DataFrame:
    """slices with each amount summed over the group's slices before."""
    out = with_carried(slices, by, carried(slices, by, amounts, dict.fromkeys(amounts, F.sum)))
    return out.withColumns({k: F.coalesce(k, F.lit(0)) for k in amounts})


def numbered(rows: DataFrame, by: str, order: tuple[str, ...], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """rows with `at`: the position, from 1, in the group's order. A null group is one, too."""
    s = with_sums_before(sliced(rows, by, order, slice_rows), by, {"before": F.count("*")})
    local = F.row_number().over(Window.partitionBy(by, "slice").orderBy(*order))
    return s.withColumn("at", F.col("before") + local).drop("slice", "before")


def last_known(slices: DataFrame, by: str, order: tuple[str, ...], value: Column, name: str) -> DataFrame:
    """slices with the last known value at or before each row, however many slices before it lies."""
    s = slices.withColumn(name, value)
    key = F.struct(*order)
    base = carried(s, by, {"earlier": F.max_by(name, F.when(F.col(name).isNotNull(), key))}, {"earlier": lambda c: F.last(c, ignorenulls=True)})
    here = F.last(name, ignorenulls=True).over(Window.partitionBy(by, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return with_carried(s, by, base).withColumn(name, F.coalesce(here, "earlier")).drop("earlier")


def in_blocks(positioned: DataFrame, rows_before: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows with `at` dealt to blocks of positions; the last rows_before of a block are also copies in the next, with `own` false."""
    size = max(block_rows, rows_before)
    block = F.floor((F.col("at") - 1) / size)
    copied = F.col("at") > (block + 1) * size - rows_before
    home = F.struct(block.alias("block"), F.lit(True).alias("own"))
    halo = F.struct((block + 1).alias("block"), F.lit(False).alias("own"))
    return positioned.withColumn("x", F.explode(F.when(copied, F.array(home, halo)).otherwise(F.array(home)))).select(*positioned.columns, "x.block", "x.own")


def quantiles(rows: DataFrame, by: str, value: str, shares: dict[str, float], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """by, and a column for each share: the exact quantile of value, interpolated between the two nearest. Nulls don't count.

    Different values are counted first, and their counts summed along the order, so
    no task holds a group's values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("by"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    s = sliced(counts, "by", ("v",), slice_rows)
    running = F.sum("n").over(Window.partitionBy("by", "slice").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = with_sums_before(s, "by", {"before": F.sum("n")}).withColumn("upto", running).select("by", "v", (F.col("before") + F.col("upto")).alias("upto"), (F.col("before") + F.col("upto") - F.col("n")).alias("from"))
    totals = s.groupBy(F.col("by").alias("of")).agg(F.sum("n").alias("total"))  # a row a group
    names = list(shares)
    both = placed.join(F.broadcast(totals), F.col("by").eqNullSafe(F.col("of")))
    picked = []
    for name in names:
        at = (F.col("total") - 1) * F.lit(shares[name])
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picked.append(F.max(F.when((F.col("from") <= place) & (place < F.col("upto")), F.col("v"))).alias(f"{name}_{side}"))
    got = both.groupBy("by").agg(F.first("total").alias("total"), *picked)
    part = lambda name: (F.col("total") - 1) * F.lit(shares[name]) - F.floor((F.col("total") - 1) * F.lit(shares[name]))
    return got.select(F.col("by").alias(by), *((F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * part(n)).alias(n) for n in names))
