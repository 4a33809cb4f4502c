"""The Spark session that the queries expect."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; everything else is the cluster's."""
    b = SparkSession.builder.appName("emberline").config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The application's folder inside the one that the cluster shares (spark.checkpoint.dir); delete it when its results are no longer needed.

    Only a local master may go without the setting, as in tests: its tasks share the driver's temp folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.gettempdir()}/emberline-shared"
    return f"{where.rstrip('/')}/emberline-{spark.sparkContext.applicationId}"
