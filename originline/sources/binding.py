"""Bind the provided star-schema tables to the analytic model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from originline.functions.scalar import micros


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_bookings(spark: SparkSession, folder: str) -> DataFrame:
    """Events as bookings: the value is the lead in hours, at least half an hour."""
    booked = F.col("ts").cast("timestamp")
    lead_us = F.greatest(F.round(F.col("value") * 100), F.lit(50.0)).cast("long") * 36_000_000
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("booking_id"),
        F.col("user_id").cast("string").alias("resident_id"),
        F.col("event_type").alias("facility_id"),
        booked.alias("booking_timestamp"),
        F.timestamp_micros(micros(booked) + lead_us).alias("usage_timestamp"),
    )


def order_bookings(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as bookings: long spans and repeated (customer, day) instants."""
    booked = F.col("o_orderdate").cast("timestamp")
    lead_us = F.greatest(F.round("o_totalprice"), F.lit(1.0)).cast("long") * 1_000_000
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("booking_id"),
        F.col("o_custkey").cast("string").alias("resident_id"),
        F.col("o_orderpriority").alias("facility_id"),
        booked.alias("booking_timestamp"),
        F.timestamp_micros(micros(booked) + lead_us).alias("usage_timestamp"),
    )


def roster(spark: SparkSession, folder: str) -> DataFrame:
    """Every configured resident: the customers that the events draw users from."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("resident_id")
    )
