"""The supplied tables as feature tables: derived points and boxes, dates in UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ecql import Layout


def lon_of(key: str | Column) -> Column:
    """A longitude from an integer key, exact in any engine."""
    k = F.col(key) if isinstance(key, str) else key
    return ((k * 7919) % 36000).cast("double") / 100 - 180


def lat_of(key: str | Column) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return ((k * 104729) % 18000).cast("double") / 100 - 90


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; timestamps without zone are taken as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"})


def points(df: DataFrame, key: str) -> DataFrame:
    return df.withColumns({"lon": lon_of(key), "lat": lat_of(key)})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(read(spark, sf_dir, "events"), "event_id").withColumn("fid", F.col("event_id").cast("string"))


def nation_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 boxes that tile the world, one for each nation."""
    n = F.col("n_nationkey")
    x0, y0 = -180.0 + (n % 5) * 72.0, -90.0 + F.floor(n / 5) * 36.0
    return read(spark, sf_dir, "nation").select("n_nationkey", "n_name", x0.alias("x0"), y0.alias("y0"), (x0 + 72.0).alias("x1"), (y0 + 36.0).alias("y1"))


def layout(df: DataFrame) -> Layout:
    return Layout(df.schema, points={"geom": ("lon", "lat")}, fid="fid")
