"""Resident history: every feature of a booking row read at or before itself.

An origin is a booking of the same resident, so a feature "at the origin" is a
window over the booking table evaluated on that row. All resident windows share
one hash exchange on the resident.
"""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from originline.functions.medians import running_medians
from originline.functions.ordered import (
    BLOCK, REAL, Running, blocked_history, hot_keys, range_blocks, running,
)
from originline.functions.scalar import js_distance, micros, ratio, time_band, weekday
from originline.params import DAY_US, MINUTE_US, MISSING, Params
from originline.session import width

KEY = "resident_id"
ORDER = ["us", "booking_id"]
#: Bookings of one task of the resident windows. Their rows grow from a few columns to
#: over two hundred behind the exchange, so its bytes say nothing of a task's memory.
ROWS_PER_TASK = 25_000


def prepare(bookings: DataFrame, p: Params) -> DataFrame:
    """Bookings with the numeric and calendar columns every window reads."""
    booked, used = F.col("booking_timestamp"), F.col("usage_timestamp")
    base = bookings.select(
        "booking_id", KEY, "facility_id", booked.alias("booked"), used.alias("used"),
        micros(booked).alias("us"), micros(used).alias("usage_us"),
    )
    return base.select(
        "*",
        (F.col("usage_us") - F.col("us")).cast("double").alias("lead_us"),
        ((F.col("usage_us") - F.col("us")) / float(MINUTE_US)).alias("lead_minutes"),
        weekday(F.col("booked")).alias("booked_weekday"),
        F.hour("booked").alias("booked_hour"),
        F.minute("booked").alias("booked_minute"),
        weekday(F.col("used")).alias("used_weekday"),
        F.hour("used").alias("used_hour"),
        time_band(F.hour("used"), p.bands).alias("used_band"),
        time_band(F.hour("booked"), p.bands).alias("booked_band"),
    )


@dataclasses.dataclass(frozen=True)
class History:
    """Prepared bookings with neighbours, and how their windows must run."""

    frame: DataFrame
    blocked: bool
    large: DataFrame | None
    params: Params

    def run(self, df: DataFrame, extra: list[str], specs: dict[str, Running]) -> DataFrame:
        return running(df, [KEY, *extra], ORDER, specs, self.blocked)

    def window(self) -> Window:
        by = [KEY, BLOCK] if self.blocked else [KEY]
        return Window.partitionBy(*by).orderBy(*ORDER)

    def real(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col(REAL)).drop(REAL, BLOCK) if self.blocked else df


def build_history(bookings: DataFrame, p: Params) -> History:
    """Prepare bookings; cut residents too large for one task into blocks."""
    base = prepare(bookings, p)
    hot, large = hot_keys(bookings, KEY, p.block_rows, p.median_rows)
    if hot is not None:
        back = max(*p.rolling_depths, p.recent_slots, p.prompt_events, p.change_depth,
                   p.review_depth) + 1
        base = blocked_history(base, KEY, "us", hot, back)
    h = History(base, hot is not None, large, p)
    by = [KEY, BLOCK] if h.blocked else [KEY]
    base = base.repartition(window_tasks(bookings), *by)
    w = h.window()
    frame = base.select(
        "*",
        F.lag("us").over(w).alias("prev_us"),
        F.lag("facility_id").over(w).alias("prev_facility"),
        F.lead("us").over(w).alias("next_us"),
        F.lead("usage_us").over(w).alias("next_usage_us"),
        F.lead("booking_id").over(w).alias("next_booking_id"),
        F.lead("facility_id").over(w).alias("next_facility"),
        F.lead("used_weekday").over(w).alias("next_used_weekday"),
        F.lead("used_hour").over(w).alias("next_used_hour"),
    ).withColumn("gap_us", F.col("us") - F.col("prev_us"))
    frame = running(
        frame, [KEY], ORDER,
        {
            "n": Running("sum", F.lit(1)),
            "first": Running("min", F.struct("us", "booking_id")),
        },
        h.blocked,
    ).withColumn("first_us", F.col("first.us"))
    return dataclasses.replace(h, frame=frame)


def window_tasks(bookings: DataFrame) -> int:
    """Partitions of the resident exchange, by the number of bookings: their tasks' memory is bounded."""
    rows = bookings.count()
    return max(1, min(width(bookings.sparkSession), rows // 1_000), -(-rows // ROWS_PER_TASK))


def _mode_column(name: str) -> Column:
    return F.col(name)["v"]


def with_modes(
    h: History, df: DataFrame, values: dict[str, str], within: tuple[str, ...] = (),
    before: bool = False,
) -> DataFrame:
    """Running mode of each value column, ties to the most recent.

    A row's own visit number within (resident, value) is the running count of
    its value, so the largest (visit number, instant) seen so far names the mode:
    two windows for any number of distinct values.
    """
    ranked = df
    for value in values:
        ranked = h.run(
            ranked, [*within, value], {f"_visit_{value}": Running("sum", F.lit(1))}
        )
    best = h.run(
        ranked, list(within),
        {
            out: Running("max", F.struct(
                F.col(f"_visit_{value}").alias("c"), F.col("us").alias("at"),
                F.col(value).alias("v"),
            ), before)
            for value, out in values.items()
        },
    )
    keep = [c for c in best.columns if not c.startswith("_visit_")]
    return best.select(
        *(_mode_column(c).alias(c) if c in values.values() else c for c in keep)
    )


def window_counts(h: History, df: DataFrame) -> DataFrame:
    """Bookings in (origin - w, origin] for every configured window."""
    p = h.params
    by = [KEY, BLOCK] if h.blocked else [KEY]
    spans = {d: d * DAY_US for d in p.prior_windows_days}
    trend = {d: d * DAY_US for d in p.trend_days}
    spans.update(trend)
    in_range = Window.partitionBy(*by).orderBy("us")
    direct = {
        d: F.count(F.lit(1)).over(in_range.rangeBetween(-span + 1, 0)) for d, span in spans.items()
    }
    if not h.blocked:
        return df.select("*", *(c.alias(f"_in_{d}d") for d, c in direct.items()))
    # A hot resident's window can reach into earlier blocks: count the events up
    # to origin - w instead, by merging events and look-ups into one order.
    hot = df.filter(F.col(REAL) & (F.col(BLOCK) > 0))
    zero = F.lit(0)
    events = hot.select(KEY, F.col("us").alias("at"), zero.alias("kind"),
                        F.lit(1).alias("one"), F.lit(None).cast("string").alias("id"),
                        zero.alias("d"))
    asks = [
        hot.select(KEY, (F.col("us") - F.lit(span)).alias("at"), F.lit(1).alias("kind"),
                   zero.alias("one"), F.col("booking_id").alias("id"), F.lit(d).alias("d"))
        for d, span in spans.items()
    ]
    merged = events
    for ask in asks:
        merged = merged.unionByName(ask)
    counted = running(
        range_blocks(merged, [KEY, "at", "kind"]), [KEY], ["at", "kind"],
        {"upto": Running("sum", F.col("one"))}, blocked=True,
    )
    found = counted.filter("kind = 1").groupBy(F.col("id").alias("booking_id")).agg(
        *(F.max(F.when(F.col("d") == d, F.col("upto"))).alias(f"_before_{d}") for d in spans)
    )
    joined = df.select("*", *(c.alias(f"_direct_{d}") for d, c in direct.items())).join(
        found, "booking_id", "left"
    )
    return joined.select(
        *df.columns,
        *(
            F.when(F.col(BLOCK) == 0, F.col(f"_direct_{d}"))
            .otherwise(F.col("n") - F.coalesce(F.col(f"_before_{d}"), zero))
            .alias(f"_in_{d}d")
            for d in spans
        ),
    )


def resident_features(h: History) -> DataFrame:
    """All resident-history features of every booking row, by feature name.

    Unused columns are pruned by the optimizer, so a caller may select one
    family and pay for that family only.
    """
    p = h.params
    w = h.window()
    df = with_modes(
        h, h.frame,
        {
            "booked_weekday": "_mode_booked_weekday",
            "facility_id": "mode_facility",
            "used_weekday": "mode_used_weekday",
            "used_hour": "mode_used_hour",
        },
    )
    df = with_modes(
        h, df, {"next_facility": "mode_successor"}, within=("facility_id",), before=True
    )
    df = h.run(
        df, ["facility_id"],
        {
            f"_to_{f.slug}": Running("sum", (F.col("next_facility") == f.name).cast("int"), True)
            for f in p.facilities
        },
    )
    # Weights grow towards the present; the factor of the origin cancels in a
    # share. The shift uses the whole double range: about 1,900 half-lives.
    halflives = (F.col("us") - F.col("first_us")) / F.lit(p.halflife_days * DAY_US)
    weight = F.pow(F.lit(2.0), halflives - 900.0)

    def flag(column: str, value: object) -> Column:
        return (F.col(column) == value).cast("int")

    specs = {
        "_sum_lead": Running("sum", F.col("lead_us")),
        "inter_booking_interval_std_days": Running("std", F.col("gap_us") / float(DAY_US)),
    }
    for f in p.facilities:
        specs[f"_f_{f.slug}"] = Running("sum", flag("facility_id", f.name))
        specs[f"_wf_{f.slug}"] = Running(
            "sum", F.when(F.col("facility_id") == f.name, weight).otherwise(0.0)
        )
    for d in range(7):
        specs[f"_d_{d}"] = Running("sum", flag("used_weekday", d))
    for b in p.bands:
        specs[f"_b_{b.slug}"] = Running("sum", flag("used_band", b.name))
        specs[f"_wb_{b.slug}"] = Running(
            "sum", F.when(F.col("used_band") == b.name, weight).otherwise(0.0)
        )
    df = h.run(df, [], specs)
    df = running_medians(
        df, KEY, "booking_id", "us",
        {"gap_us": "_median_gap_us", "lead_minutes": "_median_lead"}, h.blocked, h.large,
    )
    df = window_counts(h, df)
    deepest = max(*p.rolling_depths, p.change_depth)
    recent = F.struct(
        "facility_id", "booked", "booked_weekday", "booked_hour", "booked_minute",
        "used_weekday", "used_hour",
        (F.col("lead_minutes") / 60.0).alias("lead_hours"),
        (F.col("gap_us") / float(DAY_US)).alias("gap_days"),
    )
    df = df.select(
        "*",
        F.collect_list("facility_id").over(w.rowsBetween(1 - deepest, 0)).alias("_last"),
        F.collect_list(recent).over(w.rowsBetween(1 - p.prompt_events, 0)).alias("_recent"),
        *(
            F.lag("facility_id", k - 1, MISSING).over(w).alias(f"last_{k}_facility")
            for k in range(1, p.recent_slots + 1)
        ),
    )
    # Staged, so that the final projection refers to these instead of repeating them.
    df = df.select(
        "*", _tail(p.change_depth).alias("_tail"),
        *(_rolling(depth).alias(f"_best_{depth}") for depth in p.rolling_depths),
    )
    df = df.select("*", *(
        (F.size("_tail") - F.size(F.array_remove("_tail", f.name))).alias(f"_now_{f.slug}")
        for f in p.facilities
    ))
    return h.real(df.select("*", *_derived(p)))


def _tail(depth: int) -> Column:
    return F.slice("_last", F.greatest(F.size("_last") - depth + 1, F.lit(1)), F.lit(depth))


def _rolling(depth: int) -> Column:
    """(count, position, facility) of the favourite of the last ``depth`` rows."""
    tail = _tail(depth)
    return F.array_max(
        F.transform(
            tail,
            lambda x, i: F.struct(
                F.size(F.filter(tail, lambda y: y == x)).alias("c"), i.alias("at"), x.alias("v")
            ),
        )
    )


def _derived(p: Params) -> list[Column]:
    """Feature columns that follow from the running state of a row."""
    c, n = F.col, F.col("n")
    day = float(DAY_US)
    turn = 2.0 * math.pi
    week = F.weekofyear("booked")
    month = F.month("booked")
    out: dict[str, Column] = {
        "resident_profile_id": c(KEY),
        "n_prior_bookings": n,
        "origin_weekday": c("booked_weekday"),
        "origin_hour": c("booked_hour"),
        "origin_month": month,
        "origin_week_of_year": week,
        "origin_hour_sin": F.sin(c("booked_hour") * (turn / 24)),
        "origin_hour_cos": F.cos(c("booked_hour") * (turn / 24)),
        "origin_weekday_sin": F.sin(c("booked_weekday") * (turn / 7)),
        "origin_weekday_cos": F.cos(c("booked_weekday") * (turn / 7)),
        "origin_month_sin": F.sin((month - 1) * (turn / 12)),
        "origin_month_cos": F.cos((month - 1) * (turn / 12)),
        "days_since_previous_booking": c("gap_us") / day,
        "days_since_first_booking": (c("us") - c("first_us")) / day,
    }
    for d in p.prior_windows_days:
        out[f"bookings_prior_{d}d"] = c(f"_in_{d}d")
    short, long = p.trend_days
    out[f"booking_rate_ratio_{short}d_{long}d"] = ratio(
        c(f"_in_{short}d") / F.lit(float(short)), c(f"_in_{long}d") / F.lit(float(long))
    )
    out["inter_booking_interval_mean_days"] = ratio(c("us") - c("first_us"), n - 1) / day
    median_gap = c("_median_gap_us")
    out["inter_booking_interval_median_days"] = median_gap / day
    mode = c("_mode_booked_weekday")
    ahead = F.pmod(mode - c("booked_weekday"), F.lit(7))
    out["last_booking_weekday"] = c("booked_weekday")
    out["last_booking_hour"] = c("booked_hour")
    out["booking_weekday_mode"] = mode
    out["days_until_booking_weekday_mode"] = F.when(ahead == 0, 7).otherwise(ahead)
    out["cadence_progress_ratio"] = F.when(median_gap > 0, c("gap_us") / median_gap)
    out["last_usage_weekday"] = c("used_weekday")
    out["last_usage_hour"] = c("used_hour")
    for f in p.facilities:
        out[f"facility_count_{f.slug}"] = c(f"_f_{f.slug}")
        out[f"facility_share_{f.slug}"] = c(f"_f_{f.slug}") / n
    for d in range(7):
        out[f"usage_weekday_count_{d}"] = c(f"_d_{d}")
        out[f"usage_weekday_share_{d}"] = c(f"_d_{d}") / n
    for b in p.bands:
        out[f"time_band_count_{b.slug}"] = c(f"_b_{b.slug}")
        out[f"time_band_share_{b.slug}"] = c(f"_b_{b.slug}") / n
    for depth in p.rolling_depths:
        best = c(f"_best_{depth}")
        out[f"rolling_top_facility_last_{depth}"] = best["v"]
        out[f"rolling_top_facility_share_last_{depth}"] = best["c"] / F.least(F.lit(depth), n)
    out["lead_minutes_mean"] = c("_sum_lead") / n / float(MINUTE_US)
    out["lead_minutes_median"] = c("_median_lead")
    out["lead_minutes_recent"] = c("lead_minutes")
    for kind, items in (("facility", p.facilities), ("time_band", p.bands)):
        letter = "_wf_" if kind == "facility" else "_wb_"
        total = sum((c(f"{letter}{i.slug}") for i in items), F.lit(0.0))
        for i in items:
            out[f"ewma_{kind}_share_{i.slug}"] = c(f"{letter}{i.slug}") / total
    bits = F.lit(0.0)
    for f in p.facilities:
        share = c(f"_f_{f.slug}") / n
        bits = bits + F.when(share > 0, -share * F.log2(share)).otherwise(0.0)
    out["facility_entropy_bits"] = bits
    size = len(p.facilities)
    out["facility_entropy_normalised"] = (
        bits / math.log2(size) if size > 1 else F.lit(None).cast("double")
    )
    moves = sum((c(f"_to_{f.slug}") for f in p.facilities), F.lit(0))
    out["transitions_from_last_total"] = moves
    for f in p.facilities:
        out[f"transition_count_from_last_{f.slug}"] = c(f"_to_{f.slug}")
        out[f"transition_share_from_last_{f.slug}"] = ratio(c(f"_to_{f.slug}"), moves)
    out["preferred_usage_hour"] = c("mode_used_hour")
    pairs = [
        (c(f"_now_{f.slug}"), c(f"_f_{f.slug}") - c(f"_now_{f.slug}")) for f in p.facilities
    ]
    recent_n = F.least(F.lit(p.change_depth), n)
    distance = js_distance(pairs, recent_n, n - recent_n)
    enough = n >= p.change_min_priors
    out["change_distance"] = F.when(enough, distance)
    out["recent_behaviour_change"] = F.when(
        enough & (distance >= p.change_threshold), 1
    ).otherwise(0)
    out["change_history_insufficient"] = F.when(enough, 0).otherwise(1)
    events = F.transform(
        "_recent",
        lambda e, i: e.withField(
            "gap_days", F.when(i > 0, e["gap_days"])
        ),
    )
    out["recent_events"] = events
    return [expr.alias(name) for name, expr in out.items()]
