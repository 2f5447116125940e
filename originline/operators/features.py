"""The assembled feature table and the audit of what its rows have read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originline.functions.scalar import attach
from originline.operators.history import KEY
from originline.params import Params

IDENTIFIERS = ("sample_id", "resident_id", "booking_id")


def text_features(p: Params) -> list[str]:
    return [
        "resident_profile_id",
        *(f"last_{k}_facility" for k in range(1, p.recent_slots + 1)),
        *(f"rolling_top_facility_last_{d}" for d in p.rolling_depths),
    ]


def community_names(p: Params) -> list[str]:
    return [
        *(f"community_facility_share_{s}" for s in p.slugs),
        *(f"community_facility_share_origin_weekday_{s}" for s in p.slugs),
        *(f"community_facility_share_origin_band_{s}" for s in p.slugs),
        *(f"community_facility_share_{d}d_{s}" for d in p.community_days for s in p.slugs),
        *(f"community_lead_minutes_mean_{s}" for s in p.slugs),
    ]


def numeric_features(p: Params) -> list[str]:
    """Names of the double columns, in table order: own history, then community."""
    bands = [b.slug for b in p.bands]
    short, long = p.trend_days
    cycle = [f"origin_{c}_{t}" for c in ("hour", "weekday", "month") for t in ("sin", "cos")]
    gaps = [f"inter_booking_interval_{s}_days" for s in ("mean", "median", "std")]
    return [
        "n_prior_bookings", "origin_weekday", "origin_hour", "origin_month",
        "origin_week_of_year", *cycle,
        "days_since_previous_booking", "days_since_first_booking",
        *(f"bookings_prior_{d}d" for d in p.prior_windows_days),
        f"booking_rate_ratio_{short}d_{long}d", *gaps,
        "last_booking_weekday", "last_booking_hour", "booking_weekday_mode",
        "days_until_booking_weekday_mode", "cadence_progress_ratio",
        "last_usage_weekday", "last_usage_hour",
        *(f"facility_{k}_{s}" for k in ("count", "share") for s in p.slugs),
        *(f"usage_weekday_{k}_{d}" for k in ("count", "share") for d in range(7)),
        *(f"time_band_{k}_{b}" for k in ("count", "share") for b in bands),
        *(f"rolling_top_facility_share_last_{d}" for d in p.rolling_depths),
        "lead_minutes_mean", "lead_minutes_median", "lead_minutes_recent",
        *(f"ewma_facility_share_{s}" for s in p.slugs),
        *(f"ewma_time_band_share_{b}" for b in bands),
        "facility_entropy_bits", "facility_entropy_normalised", "transitions_from_last_total",
        *(f"transition_{k}_from_last_{s}" for k in ("count", "share") for s in p.slugs),
        *community_names(p),
    ]


def table_columns(p: Params) -> list[str]:
    return [*IDENTIFIERS, *text_features(p), *numeric_features(p)]


def feature_table(
    samples: DataFrame, resident: DataFrame, community: DataFrame, p: Params, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per sample: identifiers, text features, then doubles, then ``keep`` of the samples.

    Both joins are equi-joins on a key that is unique on one side. The community's
    columns are joined to the narrow samples first, so that the widest rows, those of
    the residents, go through one exchange only.
    """
    ids = samples.select(
        "sample_id", "target_booking_id", "origin_booking_id", F.col("origin_us").alias("us"), *keep)
    own = resident.select(
        KEY, F.col("booking_id").alias("origin_booking_id"), *text_features(p),
        *(n for n in numeric_features(p) if not n.startswith("community_")),
    )
    joined = ids.join(community.select("us", *community_names(p)), "us").join(
        own, "origin_booking_id"
    )
    return joined.select(
        "sample_id", KEY, F.col("target_booking_id").alias("booking_id"),
        *(F.col(n).cast("string").alias(n) for n in text_features(p)),
        *(F.col(n).cast("double").alias(n) for n in numeric_features(p)), *keep,
    )


def as_of_audit(samples: DataFrame, resident: DataFrame, community: DataFrame) -> DataFrame:
    """Totals of what was read, and rows that read at or past their origin."""
    read = resident.select(
        F.col("booking_id").alias("origin_booking_id"), F.col("us").alias("newest_read_us"), "n"
    )
    rows = samples.join(read, "origin_booking_id", "left").join(
        community.select(F.col("us").alias("origin_us"), "n_community", "newest_us"),
        "origin_us", "left",
    )
    return rows.agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(
            F.col("newest_read_us").isNull() | (F.col("newest_read_us") > F.col("origin_us"))
        ).alias("resident_reads_past_origin"),
        F.count_if(F.col("origin_us") >= F.col("target_us")).alias("origins_past_target"),
        F.count_if(F.col("n") != F.col("n_prior_bookings")).alias("prior_count_mismatches"),
        F.count_if(F.col("newest_us") >= F.col("origin_us")).alias("community_reads_at_origin"),
        F.sum("n").alias("resident_events_read"),
        F.sum("n_community").alias("community_events_covered"),
    )


def require_features(samples: DataFrame, features: DataFrame) -> DataFrame:
    """Samples that have no feature row; a caller must find none."""
    return samples.join(features.select("sample_id"), "sample_id", "left_anti")
