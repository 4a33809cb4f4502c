"""Sources: Parquet tables, delimited and JSON text with a given schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])
CORRUPT = "_corrupt"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_text_table(spark: SparkSession, path: str, schema: T.StructType, kind: str = "csv", **options: str) -> DataFrame:
    """csv or json rows of a given schema. Rows that don't fit keep their text in CORRUPT and don't stop the read."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if kind == "csv":
        reader = reader.option("header", "true")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.format(kind).load(path)


def split_corrupt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows without CORRUPT, and the corrupt ones."""
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT), rows.where(F.col(CORRUPT).isNotNull())
