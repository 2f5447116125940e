"""Habit rules: community fallbacks fitted on the past, and per-sample modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from originline.functions.ordered import exact_quantiles
from originline.functions.scalar import attach
from originline.operators.history import KEY, History
from originline.params import MINUTE_US


def known_by(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Booking rows up to the latest training origin."""
    latest = train.agg(F.max("origin_us").alias("_latest"))
    return rows.filter(F.col("us") <= latest.scalar())


def _commonest(rows: DataFrame, keys: list[str], value: str, seen: Column) -> DataFrame:
    """Commonest value per key, ties to the largest ``seen``; two partial aggregates."""
    counts = rows.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_n"), F.max(seen).alias("_seen")
    )
    best = F.max_by(F.col(value), F.struct("_n", "_seen")).alias("best")
    return counts.groupBy(*keys).agg(best)


def fit_fallbacks(history: DataFrame, train: DataFrame) -> DataFrame:
    """Long table (kind, key, label, minutes) of the community fallbacks."""
    rows = known_by(history, train)
    seen = F.struct("us", "booking_id")
    parts = []
    for kind, value in (
        ("facility", "facility_id"), ("usage_weekday", "used_weekday"),
        ("usage_hour", "used_hour"),
    ):
        parts.append(
            _commonest(rows.withColumn("_all", F.lit(1)), ["_all"], value, seen).select(
                F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("key"),
                F.col("best").cast("string").alias("label"),
            )
        )
    parts.append(
        _commonest(rows, ["facility_id"], "used_hour", seen).select(
            F.lit("hour_by_facility").alias("kind"), F.col("facility_id").alias("key"),
            F.col("best").cast("string").alias("label"),
        )
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    delay = exact_quantiles(train, [], "notification_delay_minutes", {"m": 0.5})
    none = F.lit(None).cast("string")
    return out.withColumn("minutes", F.lit(None).cast("double")).unionByName(
        delay.select(F.lit("delay").alias("kind"), none.alias("key"), none.alias("label"),
                     F.col("m").alias("minutes"))
    )


def fit_transitions(history: DataFrame, train: DataFrame) -> DataFrame:
    """Commonest successor of each facility over all residents.

    Ties go to the pair last seen when residents follow one another by their
    first booking.
    """
    rows = known_by(history, train).filter("prev_facility is not null")
    seen = F.struct(F.col("first.us").alias("a"), F.col("first.booking_id").alias("b"), "us")
    return _commonest(rows, ["prev_facility"], "facility_id", seen).select(
        F.col("prev_facility").alias("facility_id"), F.col("best").alias("successor")
    )


def _one_row(fallbacks: DataFrame) -> DataFrame:
    def pick(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col("label")))

    return fallbacks.agg(
        pick("facility").alias("fb_facility"),
        pick("usage_weekday").cast("int").alias("fb_weekday"),
        pick("usage_hour").cast("int").alias("fb_hour"),
        F.max("minutes").alias("fb_delay"),
    )


def predict(
    samples: DataFrame, resident: DataFrame, fallbacks: DataFrame, transitions: DataFrame
) -> DataFrame:
    """Both rule models for every sample, from the history at its origin."""
    rows = resident.select(
        F.col("booking_id").alias("origin_booking_id"), "facility_id", "mode_facility",
        "mode_used_weekday", "mode_used_hour", "_median_gap_us", "mode_successor",
    )
    joined = samples.select("sample_id", "origin_booking_id").join(rows, "origin_booking_id")
    # One row per catalog facility.
    joined = attach(joined.join(F.broadcast(transitions), "facility_id", "left"),
                    _one_row(fallbacks))
    own = joined.withColumn(
        "transition", F.coalesce("mode_successor", "successor", "fb_facility")
    )
    # Both rows come out of one reading of the resident's history.
    habit = F.struct(
        F.lit("baseline").alias("track"), F.lit("habit").alias("model"), "sample_id",
        F.coalesce("mode_facility", "fb_facility").alias("predicted_facility_id"),
        F.coalesce("mode_used_weekday", "fb_weekday").alias("predicted_usage_weekday"),
        F.coalesce("mode_used_hour", "fb_hour").alias("predicted_usage_hour"),
        F.coalesce(F.col("_median_gap_us") / float(MINUTE_US), "fb_delay")
        .alias("predicted_delay_minutes"),
        F.col("transition").alias("predicted_transition_facility_id"),
    )
    rule = F.struct(
        F.lit("traditional").alias("track"), F.lit("transition").alias("model"), "sample_id",
        F.col("transition").alias("predicted_facility_id"),
        F.col("fb_weekday").alias("predicted_usage_weekday"),
        F.col("fb_hour").alias("predicted_usage_hour"),
        F.col("fb_delay").alias("predicted_delay_minutes"),
        F.col("transition").alias("predicted_transition_facility_id"),
    )
    return own.select(F.inline(F.array(habit, rule)))
