"""Small booking tables written by hand."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from originline.params import Facility, Params

THREE = Params(facilities=(
    Facility("Gym", 0.5, 5, 23), Facility("Pool", 0.3, 6, 21), Facility("Tennis", 0.2, 6, 22),
))


def bookings(spark, rows):
    """(id, resident, facility, booked, used) rows with text instants."""
    df = spark.createDataFrame(
        rows, "booking_id string, resident_id string, facility_id string, b string, u string"
    )
    return df.select(
        "booking_id", "resident_id", "facility_id",
        F.col("b").cast("timestamp").alias("booking_timestamp"),
        F.col("u").cast("timestamp").alias("usage_timestamp"),
    )


FOUR = [
    ("B0000001", "R001", "Gym", "2024-01-01 08:00", "2024-01-02 07:00"),
    ("B0000002", "R001", "Pool", "2024-01-03 08:00", "2024-01-04 18:00"),
    ("B0000003", "R001", "Gym", "2024-01-11 08:00", "2024-01-12 09:00"),
    ("B0000004", "R001", "Tennis", "2024-02-20 08:00", "2024-02-21 20:00"),
]


def small_blocks(p: Params) -> Params:
    """Settings that send every resident through the hot-key paths."""
    return dataclasses.replace(p, block_rows=20, median_rows=10)
