"""Sinks: the processed and curated tiers. The raw tier is only read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = ("processed", "curated")


def write_tier(rows: DataFrame, root: str, tier: str, name: str, time: str, rows_a_file: int = 5_000_000) -> str:
    """Parquet partitioned by the date of `time`; only dates among rows are replaced. Returns the folder."""
    if tier not in TIERS:
        raise ValueError(f"no such tier to write: {tier}")
    path = f"{root.rstrip('/')}/{tier}/{name}"
    dated = rows.withColumn("date", F.to_date(time))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_a_file).partitionBy("date").parquet(path)
    return path
