"""Display tables for reviewers: one row per prediction, and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from originline.functions.ordered import global_rank
from originline.operators.contracts import catalog
from originline.operators.scoring import (
    MATCHES, circular_hours, hour_metrics, log_ratio, match_summary, submitted,
)
from originline.params import HEADS, WEEKDAYS, Params
from originline.session import freeze

# Glyphs and formats of the sheet.
YES, NO = "✓", "✗"
BREAK = " ⏎ "
STAMP = "EEE yyyy-MM-dd HH:mm"
NO_ROWS = "no rows written yet"


def stamp(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us.cast("long")), STAMP)


def day_name(index: Column, length: int = 3) -> Column:
    names = F.array(*(F.lit(d[:length]) for d in WEEKDAYS))
    return F.coalesce(F.get(names, index.cast("int")), F.lit(""))


def hour_label(hour: Column) -> Column:
    return F.coalesce(F.format_string("%02d:00", hour.cast("int")), F.lit(""))


def history_strings(resident: DataFrame, depth: int) -> DataFrame:
    """The newest prior bookings of every origin, newest first, as one text."""
    newest = F.slice(F.reverse("recent_events"), 1, depth)
    line = F.transform(
        newest,
        lambda e: F.concat(
            e["facility_id"], F.lit(" / "), day_name(e["used_weekday"]), F.lit(" / "),
            F.lpad(e["used_hour"].cast("string"), 2, "0"), F.lit(":00 / booked "),
            F.date_format(e["booked"], STAMP),
        ),
    )
    return resident.select(
        F.col("booking_id").alias("origin_booking_id"),
        F.array_join(line, BREAK).alias("past_bookings"),
    )


def semantic_validity(predictions: DataFrame, p: Params) -> DataFrame:
    """Whether the predicted facility is open at the predicted hour."""
    dim = catalog(predictions.sparkSession, p).select(
        F.col("facility_id").alias("predicted_facility_id"), "open_hour", "close_hour"
    )
    hour = F.col("predicted_usage_hour")
    open_then = (hour >= F.col("open_hour")) & (hour < F.col("close_hour"))
    return predictions.join(F.broadcast(dim), "predicted_facility_id", "left").withColumn(
        "semantically_valid", F.coalesce(open_then, F.lit(False))
    ).drop("open_hour", "close_hour")


def review_sheet(
    scored: DataFrame, history: DataFrame, comparison: DataFrame, p: Params
) -> DataFrame:
    """One display row per scored prediction."""
    listed = comparison.select("sample_id", F.lit(True).alias("_listed"))
    rows = semantic_validity(scored, p).join(history, "origin_booking_id", "left").join(
        F.broadcast(listed), "sample_id", "left"  # the comparison set's size is a setting
    )
    raw = F.col("predicted_delay_minutes")
    sent = submitted(raw)
    actual = F.col("notification_delay_minutes")
    booking_us = F.col("origin_us") + F.floor(sent * 60_000_000.0)
    lead_us = p.notification_lead_minutes * 60_000_000
    marks = {
        f"match_{h}": F.when(F.col(m), YES).otherwise(NO)
        for h, m in zip(HEADS, MATCHES, strict=True)
    }
    cells = {
        "track": F.col("track"), "model": F.col("model"), "record": F.col("target_booking_id"),
        "resident": F.col("resident_id"), "origin": stamp(F.col("origin_us")),
        "past_bookings": F.coalesce("past_bookings", F.lit("")),
        "predicted_facility": F.col("predicted_facility_id"),
        "predicted_usage_weekday": day_name(F.col("predicted_usage_weekday")),
        "predicted_usage_hour": hour_label(F.col("predicted_usage_hour")),
        "predicted_booking_time": stamp(booking_us),
        "suggested_send": stamp(booking_us - lead_us),
        "actual_facility": F.col("target_facility_id"),
        "actual_usage_weekday": day_name(F.col("target_usage_weekday")),
        "actual_usage_hour": hour_label(F.col("target_usage_hour")),
        "actual_booked": stamp(F.col("target_us")),
        **marks,
        "score": F.col("score"),
        "in_comparison_manifest": F.coalesce("_listed", F.lit(False)),
        "cold_start": F.col("n_prior_bookings") <= p.min_prior,
        "semantically_valid": F.col("semantically_valid"),
        "circular_hour_error": circular_hours(
            F.col("predicted_usage_hour"), F.col("target_usage_hour")
        ),
        "predicted_delay_minutes_raw": F.bround(raw, 1),
        "predicted_delay_minutes_submitted": F.bround(sent, 1),
        "delay_clamped": raw < 0,
        "notification_abs_error_minutes": F.bround(F.abs(sent - actual), 1),
        "notification_log_ratio": F.bround(log_ratio(raw, actual), 4),
    }
    return rows.select(*(v.alias(k) for k, v in cells.items()))


def review_summary(scored: DataFrame, p: Params, split: str) -> DataFrame:
    """(item, value) rows: coverage, then rounded metrics per model."""
    cover = scored.agg(
        F.count(F.lit(1)).cast("string").alias("Rows rendered"),
        F.lit(split).alias("Split rendered"),
        F.count_distinct("target_booking_id").cast("string").alias("Records"),
        F.count_distinct("resident_id").cast("string").alias("Residents"),
        stamp(F.min("origin_us")).alias("First origin"),
        stamp(F.max("origin_us")).alias("Last origin"),
    )
    sent = submitted(F.col("predicted_delay_minutes"))
    by = ["track", "model"]
    extra = scored.groupBy(*by).agg(
        F.avg(F.abs(sent - F.col("notification_delay_minutes"))).alias("mae"),
        F.avg((F.col("predicted_delay_minutes") < 0).cast("int")).alias("clamp"),
    )
    wide = match_summary(scored, by).join(hour_metrics(scored, by), by).join(extra, by)
    four = {
        "facility accuracy": "facility", "weekday accuracy": "usage_weekday",
        "hour accuracy": "usage_hour", "hour within 1 hour": "within_1_hour",
        "delay clamp rate": "clamp", "SCORE of 4": "score_mean", "OVERALL": "overall",
        "STRICT": "strict", "at least 3 of 4": "at_least_three",
    }
    cells = [
        F.struct(F.lit("rows").alias("name"), F.col("rows").cast("string").alias("value")),
        F.struct(F.lit("delay MAE (minutes)").alias("name"),
                 F.format_string("%.1f", "mae").alias("value")),
        *(F.struct(F.lit(k).alias("name"), F.format_string("%.4f", v).alias("value"))
          for k, v in four.items()),
    ]
    models = wide.select("track", "model", F.inline(F.array(*cells))).select(
        F.concat_ws(" - ", F.concat_ws(" / ", "track", "model"), "name").alias("item"), "value"
    )
    items = F.array(*(
        F.struct(F.lit(n).alias("item"), F.col(n).alias("value")) for n in cover.columns
    ))
    return cover.select(F.inline(items)).unionByName(models)


def track_states(predictions: DataFrame, tracks: list[str]) -> DataFrame:
    """Per track, the models that wrote rows."""
    spark = predictions.sparkSession
    written = predictions.select("track", "model").distinct().groupBy("track").agg(
        F.array_join(F.sort_array(F.collect_set("model")), ", ").alias("state")
    )
    names = spark.createDataFrame([(t,) for t in tracks], "track string")
    return names.join(written, "track", "left").select(
        "track", F.coalesce("state", F.lit(NO_ROWS)).alias("state")
    )


def dictionary(frame: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """Sorted distinct values over the columns, with their positions.

    The positions are global ranks, counted in blocks; a column may have any number of
    values.
    """
    values = frame.select(F.explode(F.array(*(F.col(c) for c in columns))).alias("value")).filter("value is not null").distinct()
    ranked = global_rank(values, ["value"], "_rank")
    return ranked.select(F.lit(kind).alias("kind"), "value", (F.col("_rank") - 1).cast("int").alias("code"))


def encode(frame: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """Replace text columns by their dictionary positions; a null has none.

    A dictionary is staged, so Spark knows its size and picks the join.
    """
    out = frame
    for kind, columns in kinds.items():
        words = freeze(dictionary(frame, kind, columns))
        for c in columns:
            side = words.select(F.col("value").alias(c), F.col("code").alias(f"{c}_code"))
            out = out.join(side, c, "left")
    drop = [c for columns in kinds.values() for c in columns]
    return out.drop(*drop)
