"""Table contracts: one row per check, from single aggregation passes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from originline.functions.ordered import exact_quantiles
from originline.functions.scalar import js_distance, ratio
from originline.params import NULL_SPELLINGS, Params
from originline.schemas import BOOKINGS

COLUMNS = tuple(BOOKINGS.fieldNames())


def checks(one_row: DataFrame, violations: Mapping[str, Column]) -> DataFrame:
    """Unpivot violation counts of a one-row frame into (check, violations, passed)."""
    cells = F.array(*(
        F.struct(F.lit(name).alias("check"), v.cast("long").alias("violations"))
        for name, v in violations.items()
    ))
    return one_row.select(F.inline(cells)).withColumn("passed", F.col("violations") == 0)


def booking_contract(bookings: DataFrame, p: Params) -> DataFrame:
    """Row-level rules of the booking table, counted in one pass plus one for ids."""
    columns = tuple(bookings.columns)
    ids = bookings.groupBy("booking_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated")
    )
    one = bookings.agg(
        *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in COLUMNS),
        F.count_if(~F.col("facility_id").isin(*p.names)).alias("outside"),
        F.count_if(F.col("booking_timestamp") >= F.col("usage_timestamp")).alias("disordered"),
    ).withColumn("repeated", ids.scalar())
    rules = {f"non_null_{c}": F.col(f"null_{c}") for c in COLUMNS}
    rules["unique_booking_id"] = F.col("repeated")
    rules["facility_in_catalog"] = F.col("outside")
    rules["booked_before_used"] = F.col("disordered")
    rules["declared_columns"] = F.lit(int(columns != COLUMNS))
    return checks(one, rules)


def quarantine(bookings: DataFrame, p: Params, reference: DataFrame | None = None) -> DataFrame:
    """Every violating row with its reasons."""
    repeats = (
        bookings.groupBy("booking_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    )
    rows = bookings.join(repeats, "booking_id", "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("_n") > 1, "repeated_booking_id"),
        *(F.when(F.col(c).isNull(), f"null_{c}") for c in COLUMNS),
        F.when(~F.col("facility_id").isin(*p.names), "facility_outside_catalog"),
        F.when(F.col("booking_timestamp") >= F.col("usage_timestamp"), "not_booked_before_used"),
    ))
    return rows.withColumn("reasons", F.array_join(reasons, ",")).filter("reasons <> ''").drop("_n")


def catalog(spark, p: Params) -> DataFrame:
    """The facility dimension: one row per configured facility."""
    rows = [
        (i, f.name, f.popularity, f.open_hour, f.close_hour, f.opens_on)
        for i, f in enumerate(p.facilities)
    ]
    return spark.createDataFrame(
        rows,
        "position int, facility_id string, popularity double, open_hour int, close_hour int, "
        "opens_on string",
    )


def availability(bookings: DataFrame, p: Params) -> DataFrame:
    """Uses before a facility's opening date, and presence after it."""
    dim = catalog(bookings.sparkSession, p).select(
        "facility_id", F.col("opens_on").cast("timestamp").alias("opens")
    )
    counted = bookings.join(F.broadcast(dim), "facility_id").groupBy("facility_id", "opens").agg(
        F.count_if(F.col("usage_timestamp") < F.col("opens")).alias("before_opening"),
        F.count_if(F.col("usage_timestamp") >= F.col("opens")).alias("after_opening"),
    )
    full = dim.join(counted.drop("opens"), "facility_id", "left")
    before, after = (F.coalesce(c, F.lit(0)) for c in ("before_opening", "after_opening"))
    return full.select(
        "facility_id", F.col("opens").cast("timestamp_ntz").alias("opens"),
        before.alias("before_opening"), after.alias("after_opening"),
        ((before == 0) & (after > 0)).alias("passed"),
    )


def lead_checks(
    leads: DataFrame, long_name: str, short_name: str, band: tuple[float, float], least: float
) -> DataFrame:
    """Median lead in a band, right skew, and a long/short facility ratio."""
    overall = exact_quantiles(leads, [], "lead_hours", {"median": 0.5})
    mean = leads.agg(F.avg("lead_hours").alias("mean"))
    per = exact_quantiles(leads, ["facility_id"], "lead_hours", {"median": 0.5})
    ratio_row = per.agg(
        F.max(F.when(F.col("facility_id") == long_name, F.col("median"))).alias("long"),
        F.max(F.when(F.col("facility_id") == short_name, F.col("median"))).alias("short"),
    ).select(ratio(F.col("long"), F.col("short")).alias("ratio"))
    one = overall.select("median").withColumn("mean", mean.scalar()).withColumn(
        "ratio", ratio_row.scalar()
    )
    m = F.col("median")
    cells = F.array(
        F.struct(F.lit("median_in_band").alias("check"), m.alias("value"),
                 ((m >= band[0]) & (m <= band[1])).alias("passed")),
        F.struct(F.lit("mean_above_median").alias("check"), F.col("mean").alias("value"),
                 (F.col("mean") > m).alias("passed")),
        F.struct(F.lit("long_short_ratio").alias("check"), F.col("ratio").alias("value"),
                 F.coalesce(F.col("ratio") >= least, F.lit(False)).alias("passed")),
    )
    return one.select(F.inline(cells)).withColumn("value", F.round("value", 6))


def popularity_checks(
    bookings: DataFrame, p: Params, before: str, top: int, imbalance: float
) -> DataFrame:
    """Realised top-N order against the configured one, and the imbalance."""
    dim = catalog(bookings.sparkSession, p)
    counts = bookings.filter(F.col("booking_timestamp") < F.lit(before).cast("timestamp")).groupBy(
        "facility_id"
    ).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    full = dim.join(counts, "facility_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # One row per catalog entry from here on.
    ranked = full.select(
        "facility_id", "n", F.round(F.col("n") / F.sum("n").over(every), 6).alias("share"),
        F.row_number().over(Window.orderBy(F.desc("n"), "facility_id")).alias("realised_rank"),
        F.row_number().over(Window.orderBy(F.desc("popularity"), "facility_id"))
        .alias("configured_rank"),
        (F.max("n").over(every) >= F.lit(imbalance) * F.min("n").over(every))
        .alias("imbalance_passed"),
    )
    return ranked.withColumn(
        "order_passed",
        (F.col("configured_rank") > top) | (F.col("configured_rank") == F.col("realised_rank")),
    )


def sparsity(bookings: DataFrame, roster: DataFrame, fewer_than: int, least: float) -> DataFrame:
    """Share of the full roster with fewer than N bookings; absent members count."""
    counts = bookings.groupBy("resident_id").agg(F.count(F.lit(1)).alias("n"))
    share = F.avg((F.coalesce("n", F.lit(0)) < fewer_than).cast("int"))
    return roster.join(counts, "resident_id", "left").agg(
        F.count(F.lit(1)).alias("residents"), F.round(share, 9).alias("sparse_share"),
        (share >= least).alias("passed"),
    )


def category_drift(bookings: DataFrame, p: Params, cut: str, focus: str) -> DataFrame:
    """Jensen-Shannon distance of each resident's mix before and after a date."""
    at = F.lit(cut).cast("timestamp")
    pre, post = F.col("booking_timestamp") < at, F.col("booking_timestamp") >= at
    aggs = [F.count_if(pre).alias("n_before"), F.count_if(post).alias("n_after")]
    for f in p.facilities:
        here = F.col("facility_id") == f.name
        aggs += [F.count_if(pre & here).alias(f"a_{f.slug}"),
                 F.count_if(post & here).alias(f"b_{f.slug}")]
    per = bookings.groupBy("resident_id").agg(*aggs)
    pairs = [(F.col(f"a_{s}"), F.col(f"b_{s}")) for s in p.slugs]
    slug_focus = next(f.slug for f in p.facilities if f.name == focus)
    drop = ratio(F.col(f"a_{slug_focus}"), F.col("n_before")) - ratio(
        F.col(f"b_{slug_focus}"), F.col("n_after")
    )
    return per.select(
        "resident_id", "n_before", "n_after",
        F.round(js_distance(pairs, F.col("n_before"), F.col("n_after")), 9).alias("distance"),
        F.round(drop, 9).alias("share_drop"),
    )


def feature_contract(features: DataFrame, text: list[str], numeric: list[str]) -> DataFrame:
    """Text columns never null or spelling a null; all others double; exact order."""
    spelled = {
        c: F.count_if(
            F.col(c).isNull() | F.lower(F.trim(F.col(c))).isin(*NULL_SPELLINGS)
        )
        for c in text
    }
    one = features.agg(*(v.alias(c) for c, v in spelled.items()))
    kinds = dict(features.dtypes)
    rules = {f"text_{c}": F.col(c) for c in text}
    rules["numeric_columns_double"] = F.lit(sum(kinds.get(c) != "double" for c in numeric))
    rules["column_order"] = F.lit(int(features.columns != [*text, *numeric]))
    return checks(one, rules)


def reconcile(recorded: DataFrame, live: DataFrame, strays: DataFrame) -> DataFrame:
    """Recorded counts against live counts, and comparison ids outside the holdout."""
    both = recorded.join(live, "name", "full_outer").select(
        "name", "recorded", "live", F.col("recorded").eqNullSafe(F.col("live")).alias("passed")
    )
    outside = strays.agg(F.count(F.lit(1)).alias("live")).select(
        F.lit("comparison_outside_holdout").alias("name"), F.lit(0).cast("long").alias("recorded"),
        "live", (F.col("live") == 0).alias("passed"),
    )
    return both.unionByName(outside)
