"""Series from tables: times in days, values, and a row id for a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def days(timestamp: Column) -> Column:
    """A timestamp (with or without zone, read as UTC) as a number of days."""
    return F.unix_micros(timestamp.cast("timestamp")) / F.lit(86400e6)


def zero_to_null(flux: Column) -> Column:
    """Zeros, which some instruments write for missing values, as null."""
    return F.nullif(flux, F.lit(0.0))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, time, flux) of the events table, a series a user."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", days(F.col("ts")).alias("time"), F.col("value").cast("double").alias("flux"))


def order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, o_custkey, time, flux) of the orders table, a series a customer; times have ties."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", days(F.col("o_orderdate")).alias("time"), F.col("o_totalprice").cast("double").alias("flux"))
