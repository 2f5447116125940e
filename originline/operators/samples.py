"""Rolling-origin samples: each booking with a past becomes a prediction target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originline.functions.ordered import BLOCK, REAL, global_rank
from originline.functions.scalar import instant, micros
from originline.operators.history import KEY, History
from originline.params import MINUTE_US, Params


def rolling_origins(h: History) -> DataFrame:
    """One row per target booking with at least ``min_prior`` earlier ones.

    The row of the origin booking already sees the next booking, so samples need
    no join: the origin's running count is the number of prior bookings.
    """
    p = h.params
    if p.min_prior < 1:
        raise ValueError("a sample needs at least one prior booking")
    rows = h.frame.filter(F.col("next_booking_id").isNotNull() & (F.col("n") >= p.min_prior))
    if h.blocked:
        rows = rows.filter(F.col(REAL)).drop(REAL, BLOCK)
    return rows.select(
        KEY, F.col("us").alias("origin_us"), F.col("booking_id").alias("origin_booking_id"),
        F.col("n").cast("int").alias("n_prior_bookings"),
        F.col("next_booking_id").alias("target_booking_id"), F.col("next_us").alias("target_us"),
        F.col("next_usage_us").alias("target_usage_us"),
        F.col("next_facility").alias("target_facility_id"),
        F.col("next_used_weekday").alias("target_usage_weekday"),
        F.col("next_used_hour").alias("target_usage_hour"),
    )


def with_labels(origins: DataFrame) -> DataFrame:
    """The delay label; a target at or before its origin is an error."""
    delay = (F.col("target_us") - F.col("origin_us")) / float(MINUTE_US)
    checked = F.when(delay > 0, delay).otherwise(
        F.raise_error(F.lit("a target is not after its origin")).cast("double")
    )
    return origins.withColumn("notification_delay_minutes", checked)


def with_sample_ids(labelled: DataFrame) -> DataFrame:
    """Dense ids in (origin, target id) order."""
    ranked = global_rank(labelled, ["origin_us", "target_booking_id"], "_rank")
    return ranked.select(
        F.format_string("S%07d", F.col("_rank").cast("long")).alias("sample_id"),
        *labelled.columns,
    )


def build_samples(h: History) -> DataFrame:
    return with_sample_ids(with_labels(rolling_origins(h)))


def sample_table(samples: DataFrame) -> DataFrame:
    """The declared sample table, instants as timestamps."""
    return samples.select(
        "sample_id", KEY, instant(F.col("origin_us")).alias("origin"), "origin_booking_id",
        "n_prior_bookings", "target_booking_id",
        instant(F.col("target_us")).alias("target_booking_timestamp"),
        instant(F.col("target_usage_us")).alias("target_usage_timestamp"),
        "target_facility_id", "target_usage_weekday", "target_usage_hour",
        "notification_delay_minutes",
    )


def booking_ids(bookings: DataFrame) -> DataFrame:
    """Dense booking ids in (booked, resident, facility, used, id) order."""
    rows = bookings.select(
        "booking_id", KEY, "facility_id", micros(F.col("booking_timestamp")).alias("us"),
        micros(F.col("usage_timestamp")).alias("usage_us"),
    )
    ranked = global_rank(rows, ["us", KEY, "facility_id", "usage_us", "booking_id"], "_rank")
    return ranked.select(
        F.format_string("B%07d", F.col("_rank").cast("long")).alias("stable_id"), "booking_id"
    )


def sample_accounting(bookings: DataFrame, samples: DataFrame, roster: DataFrame) -> DataFrame:
    """One row of counts tying bookings, residents and samples together."""
    per = bookings.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(micros(F.col("booking_timestamp"))).alias("first_us"),
        F.max(micros(F.col("usage_timestamp"))).alias("last_us"),
    )
    sampled = samples.groupBy(KEY).agg(F.count(F.lit(1)).alias("s"))
    members = (
        roster.join(per.select(KEY, "n"), KEY, "left")
        .agg(
            F.count(F.lit(1)).alias("residents_configured"),
            F.count("n").alias("residents_with_bookings"),
            F.count_if(F.col("n").isNull()).alias("residents_without_bookings"),
        )
    )
    totals = per.join(sampled, KEY, "left").agg(
        F.sum("n").alias("bookings"),
        F.coalesce(F.sum("s"), F.lit(0)).alias("samples"),
        F.count_if(F.col("s").isNull()).alias("excluded_no_history"),
        F.count("s").alias("residents_with_samples"),
        F.count_if(F.col("s").isNotNull()).alias("censored_bookings"),
        instant(F.min("first_us")).alias("observation_start"),
        instant(F.max("last_us")).alias("observation_end"),
    )
    one = members.select(F.struct("*").alias("m")).scalar()
    return totals.withColumn("_m", one).select(
        "bookings", "samples", "_m.residents_configured", "_m.residents_with_bookings",
        "_m.residents_without_bookings", "excluded_no_history", "residents_with_samples",
        "censored_bookings", "observation_start", "observation_end",
    )


def order_ties(bookings: DataFrame) -> DataFrame:
    """Rows that do not come strictly after the resident's previous booking.

    Such a row shares its instant with an earlier id, so a pre-aggregated minimum
    per instant finds it without sorting any resident.
    """
    keyed = bookings.withColumn("_us", micros(F.col("booking_timestamp")))
    firsts = (
        keyed.groupBy(KEY, "_us")
        .agg(F.min("booking_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .filter("_rows > 1")
    )
    return keyed.join(firsts, [KEY, "_us"]).filter(F.col("booking_id") > F.col("_first")).drop(
        "_us", "_first", "_rows"
    )


def keep_strictly_increasing(bookings: DataFrame) -> DataFrame:
    """First row of every (resident, instant), with how many rows it replaced."""
    row = F.struct("facility_id", "usage_timestamp")
    rank = F.struct("usage_timestamp", "booking_id")
    kept = bookings.groupBy(KEY, "booking_timestamp").agg(
        F.min(rank).alias("_k"), F.min_by(row, rank).alias("_r"),
        (F.count(F.lit(1)) - 1).alias("dropped"),
    )
    return kept.select(
        F.col("_k.booking_id").alias("booking_id"), KEY, F.col("_r.facility_id"),
        "booking_timestamp", F.col("_r.usage_timestamp"), "dropped",
    )
