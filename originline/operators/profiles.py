"""Distribution profiles of the booking table and their consistency checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from originline.functions.ordered import exact_quantiles
from originline.operators.contracts import catalog
from originline.operators.scoring import bootstrap_shares
from originline.params import Params

QUANTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def lead_quantiles(leads: DataFrame) -> DataFrame:
    """Quantiles of lead hours overall and per facility, mean and mean/median."""
    both = leads.select(
        F.explode(F.array(F.lit("(all)"), F.col("facility_id"))).alias("facility_id"),
        "lead_hours",
    )
    means = both.groupBy("facility_id").agg(F.avg("lead_hours").alias("mean"))
    spread = exact_quantiles(both, ["facility_id"], "lead_hours", QUANTILES)
    return spread.join(means, "facility_id").withColumn(
        "mean_over_median", F.try_divide("mean", "p50")
    )


def popularity(bookings: DataFrame, p: Params) -> DataFrame:
    """Configured and realised share per facility, with a bootstrap interval."""
    counts = bookings.groupBy("facility_id").agg(F.count(F.lit(1)).alias("bookings"))
    band = bootstrap_shares(bookings, "booking_id", "facility_id", p)
    dim = catalog(bookings.sparkSession, p).select("facility_id", "popularity")
    every = Window.partitionBy()
    full = dim.join(counts, "facility_id", "left").join(band, "facility_id", "left").withColumn(
        "bookings", F.coalesce("bookings", F.lit(0))
    )
    share = F.col("bookings") / F.sum("bookings").over(every)
    return full.select(
        "facility_id", F.col("popularity").alias("configured"), share.alias("realised"),
        (share - F.col("popularity")).alias("deviation"), "lower", "upper", "bookings",
    )


def activity(bookings: DataFrame, roster: DataFrame, p: Params) -> DataFrame:
    """Bookings per resident over the whole roster, absent members as zero."""
    counts = bookings.groupBy("resident_id").agg(F.count(F.lit(1)).alias("n"))
    full = roster.join(counts, "resident_id", "left").select(
        F.coalesce("n", F.lit(0)).alias("n")
    )
    spread = exact_quantiles(full, [], "n", QUANTILES)
    one = spread.select(F.struct(*QUANTILES).alias("q")).scalar()
    totals = full.agg(
        F.count(F.lit(1)).alias("residents_configured"),
        F.count_if(F.col("n") > 0).alias("residents_with_bookings"),
        F.avg((F.col("n") < p.sparse_bookings).cast("int")).alias("sparse_share"),
    )
    return totals.withColumn("_q", one).select(
        *totals.columns, *(F.col(f"_q.{q}").alias(q) for q in QUANTILES)
    )


def period_shares(bookings: DataFrame, period: str) -> DataFrame:
    """Bookings and facility shares per usage period (month, or day on short spans)."""
    start = F.date_trunc(period, F.col("usage_timestamp")).cast("timestamp_ntz")
    counts = bookings.groupBy(start.alias("period"), "facility_id").agg(
        F.count(F.lit(1)).alias("bookings")
    )
    return counts.withColumn(
        "share", F.col("bookings") / F.sum("bookings").over(Window.partitionBy("period"))
    )


def profile_checks(
    popular: DataFrame, leads: DataFrame, active: DataFrame, periods: DataFrame
) -> DataFrame:
    """One row per internal contradiction a profile could hold."""
    near = 0.01
    pop = popular.agg(
        F.count_if(~F.col("realised").between(F.col("lower"), F.col("upper"))).alias("a"),
        (F.abs(F.sum("realised") - 1) > near).cast("long").alias("b"),
    ).select(F.inline(F.array(
        F.struct(F.lit("popularity_sums_to_one").alias("check"), F.col("b").alias("violations")),
        F.struct(F.lit("realised_inside_interval").alias("check"), F.col("a").alias("violations")),
    )))
    order = list(QUANTILES)
    falling = F.lit(False)
    for low, high in zip(order, order[1:], strict=False):
        falling = falling | (F.col(low) > F.col(high))
    lead = leads.agg(
        F.count_if(falling).alias("a"),
        F.count_if((F.col("facility_id") == "(all)") & (F.col("mean") <= F.col("p50"))).alias("b"),
    ).select(F.inline(F.array(
        F.struct(F.lit("lead_quantiles_monotone").alias("check"), F.col("a").alias("violations")),
        F.struct(F.lit("lead_right_skewed").alias("check"), F.col("b").alias("violations")),
    )))
    act = active.select(
        F.lit("residents_within_roster").alias("check"),
        (F.col("residents_with_bookings") > F.col("residents_configured")).cast("long")
        .alias("violations"),
    )
    per = periods.groupBy("period").agg(F.sum("share").alias("s")).agg(
        F.count_if(F.abs(F.col("s") - 1) > near).alias("violations")
    ).select(F.lit("period_shares_sum_to_one").alias("check"), "violations")
    return pop.unionByName(lead).unionByName(act).unionByName(per).withColumn(
        "passed", F.col("violations") == 0
    )
