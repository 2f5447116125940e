"""Error analysis: slice labels, slice report, confusions and worst errors."""

from __future__ import annotations

import statistics

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from originline.functions.ordered import Running, exact_quantiles, range_blocks, running
from originline.functions.scalar import attach
from originline.operators.scoring import SUMMARY, submitted, summary_columns
from originline.params import Params

DIMENSIONS = (
    "activity_quartile", "sparse_history", "facility_band", "history_length", "day_type",
    "lead_bucket", "cold_start_resident",
)


def slice_columns(scored: DataFrame, train: DataFrame, p: Params) -> DataFrame:
    """Seven slice labels per scored row."""
    depth = "n_prior_bookings"
    # Average rank of a value = rows below it + half of its own ties.
    hist = range_blocks(
        scored.groupBy(depth).agg(F.count(F.lit(1)).alias("_ties")), [depth]
    )
    ranks = running(
        hist, [], [depth], {"_upto": Running("sum", F.col("_ties"))}, blocked=True
    ).select(
        depth, (F.col("_upto") - F.col("_ties") + (F.col("_ties") + 1) / 2).alias("_rank")
    )
    # The rank grows with the value, so a quartile is a bound on the value itself:
    # three numbers, and no join on a column in which a few values hold most rows.
    n = scored.agg(F.count(F.lit(1)).alias("_n"))
    share = F.col("_rank") / F.col("_n")
    quartiles = attach(ranks, n).agg(*(
        F.max(F.when(share <= q, F.col(depth))).alias(f"_q{i}")
        for i, q in enumerate((0.25, 0.5, 0.75), start=1)
    ))
    median = exact_quantiles(scored, [], depth, {"_median": 0.5}).select("_median")
    seen = train.select("resident_id").distinct().withColumn("_seen", F.lit(True))
    cut = statistics.median(f.popularity for f in p.facilities)
    head = [f.name for f in p.facilities if f.popularity >= cut]
    rows = scored.join(seen, "resident_id", "left")
    rows = attach(attach(rows, quartiles), median)
    upto = lambda i: F.col(depth) <= F.coalesce(F.col(f"_q{i}"), F.lit(-1))
    hours = F.col("notification_delay_minutes") / 60.0
    labels = {
        "activity_quartile": F.when(upto(1), "q1").when(upto(2), "q2")
        .when(upto(3), "q3").otherwise("q4"),
        "sparse_history": F.when(F.col(depth) < p.sparse_bookings,
                                 f"under_{p.sparse_bookings}_prior")
        .otherwise(f"{p.sparse_bookings}_or_more"),
        "facility_band": F.when(F.col("target_facility_id").isin(head), "head").otherwise("tail"),
        "history_length": F.when(F.col(depth) >= F.col("_median"), "long").otherwise("short"),
        "day_type": F.when(F.col("target_usage_weekday") >= 5, "weekend").otherwise("weekday"),
        "lead_bucket": F.when(hours < 6, "under_6h").when(hours < 24, "6h_to_1d")
        .when(hours < 72, "1d_to_3d").otherwise("over_3d"),
        "cold_start_resident": F.when(F.col("_seen"), "seen_in_training")
        .otherwise("unseen_in_training"),
    }
    return rows.select(*scored.columns, *(v.alias(k) for k, v in labels.items()))


def slice_report(sliced: DataFrame) -> DataFrame:
    """Match summary of every slice of every dimension, in one aggregation."""
    n = sliced.agg(F.count(F.lit(1)).alias("_n"))
    cells = F.array(*(
        F.struct(F.lit(d).alias("dimension"), F.col(d).alias("slice")) for d in DIMENSIONS
    ))
    marks = [c for c in sliced.columns if c.startswith("match_")]
    long = sliced.select("score", *marks, F.inline(cells))
    report = long.groupBy("dimension", "slice").agg(
        F.count(F.lit(1)).alias("rows"), *summary_columns()
    )
    return attach(report, n).select(
        "dimension", "slice", "rows",
        F.round(F.col("rows") / F.col("_n"), 4).alias("share_of_split"),
        *(F.round(m, 4).alias(m) for m in SUMMARY),
    )


def partition_check(report: DataFrame, sliced: DataFrame) -> DataFrame:
    """Every dimension covers the split once; every overall lies in [0, 1]."""
    n = sliced.agg(F.count(F.lit(1)).alias("split_rows"))
    sums = report.groupBy("dimension").agg(
        F.sum("rows").alias("rows"),
        F.count_if((F.col("overall") < 0) | (F.col("overall") > 1)).alias("out_of_range"),
    )
    return attach(sums, n).withColumn(
        "passed", (F.col("rows") == F.col("split_rows")) & (F.col("out_of_range") == 0)
    )


def top_confusions(pairs: DataFrame, k: int = 10) -> DataFrame:
    """The k commonest wrong pairs of each head; pairs are already counted."""
    w = Window.partitionBy("head").orderBy(F.desc("n"), "actual", "predicted")
    wrong = pairs.filter(F.col("actual") != F.col("predicted"))
    return wrong.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "head", "actual", "predicted", "n", "rank"
    )


def largest_delay_errors(scored: DataFrame, k: int = 20) -> DataFrame:
    """The k rows whose submitted delay misses by most minutes: a distributed top-k."""
    gap = F.abs(submitted(F.col("predicted_delay_minutes")) - F.col("notification_delay_minutes"))
    return (
        scored.select(
            "sample_id", F.col("notification_delay_minutes").alias("actual_minutes"),
            submitted(F.col("predicted_delay_minutes")).alias("submitted_minutes"),
            gap.alias("error_minutes"),
        )
        .orderBy(F.desc("error_minutes"), "sample_id")
        .limit(k)
    )
