"""Prompt datasets from features and history, and typed parsing of answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from originline.functions.ordered import exact_quantiles
from originline.operators.delays import Ladder, labels, ladder_label
from originline.operators.review import day_name
from originline.params import WEEKDAYS, Params

# The instruction, the answer fields and the section titles.
SYSTEM = (
    "You predict a resident's next facility booking from history available at the prediction "
    "origin.\n"
    "Return one JSON object matching the supplied schema. Use only the allowed facility and "
    "weekday values.\n"
    "notification_delay_bucket is one of the supplied bucket labels measured from the "
    "prediction origin."
)
FIELDS = ("facility", "usage_day", "usage_hour", "notification_delay_bucket")
LEGEND_TITLE = "ALLOWED_DELAY_BUCKETS (delay from the origin; contiguous, no gaps):"
INVALID = "__INVALID__"


def two_places(value: Column) -> Column:
    """A number with two decimals, halves away from zero; null stays null."""
    return F.round(value.cast("decimal(18,6)"), 2).cast("decimal(18,2)").cast("string")


def _or_none(value: Column) -> Column:
    return F.coalesce(value, F.lit("none"))


def _counts(pairs: Sequence[tuple[str, Column]]) -> Column:
    """Non-zero counts as ``{label:n, ...}`` in the given order."""
    cells = F.array(*(
        F.when(n > 0, F.concat(F.lit(f"{name}:"), n.cast("long").cast("string")))
        for name, n in pairs
    ))
    return F.concat(F.lit("{"), F.array_join(F.array_compact(cells), ", "), F.lit("}"))


def prompt_summary(
    samples: DataFrame, resident: DataFrame, p: Params, keep: Sequence[str] = (), how: str = "inner"
) -> DataFrame:
    """Summary values per sample, as rendered, plus the recent events and ``keep``.

    All of them come from the resident's own history, so the feature table with its
    community columns is not read.
    """
    slugs = [f.slug for f in p.facilities]
    own = resident.select(
        F.col("booking_id").alias("origin_booking_id"), F.col("us").alias("origin_us"),
        "n_prior_bookings", "days_since_previous_booking", *(f"facility_count_{s}" for s in slugs),
        *(f"usage_weekday_count_{i}" for i in range(7)), "preferred_usage_hour", "last_1_facility",
        "inter_booking_interval_median_days", "lead_minutes_median", "recent_behaviour_change",
        "change_history_insufficient", "recent_events",
    )
    counts = [(f.name, F.col(f"facility_count_{f.slug}")) for f in p.facilities]
    top = F.array_max(F.array(*(
        F.struct(n.alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("v"))
        for i, (name, n) in enumerate(counts)
    )))
    days = [(d[:3], F.col(f"usage_weekday_count_{i}")) for i, d in enumerate(WEEKDAYS)]
    rows = samples.select("sample_id", "origin_booking_id", *keep)
    return rows.join(own, "origin_booking_id", how).select(
        "sample_id", *keep, "origin_us",
        F.col("n_prior_bookings").cast("int").alias("total_bookings"),
        _or_none(two_places(F.col("days_since_previous_booking")))
        .alias("days_since_last_booking"),
        _counts(counts).alias("facility_counts"),
        _counts(days).alias("usage_day_counts"),
        F.when(top["n"] > 0, top["v"]).otherwise("none").alias("most_frequent_facility"),
        _or_none(F.col("preferred_usage_hour").cast("string")).alias("preferred_usage_hour"),
        F.col("last_1_facility").alias("last_facility"),
        _or_none(two_places(F.col("inter_booking_interval_median_days") * 24))
        .alias("median_interbooking_hours"),
        _or_none(two_places(F.col("lead_minutes_median") / 60)).alias("median_lead_hours"),
        "recent_behaviour_change", "change_history_insufficient", "recent_events",
    )


SUMMARY = (
    "total_bookings", "days_since_last_booking", "facility_counts", "usage_day_counts",
    "most_frequent_facility", "preferred_usage_hour", "last_facility",
    "median_interbooking_hours", "median_lead_hours", "recent_behaviour_change",
    "change_history_insufficient",
)


def legend(ladder: Ladder) -> Column:
    """One line per bucket label with the minutes it covers; constant text."""
    lines = []
    for name, (lower, upper) in zip(labels(ladder), ladder.spans(), strict=True):
        low = two_places(F.lit(lower - 1))
        if upper is None:
            lines.append(F.concat(F.lit(f"  {name} >= "), low, F.lit(" min")))
        else:
            high = two_places(F.lit(upper - 1))
            lines.append(F.concat(F.lit(f"  {name} "), low, F.lit("-"), high, F.lit(" min")))
    return F.concat_ws("\n", *lines)


def _clock(hour: Column, minute: Column | None = None) -> Column:
    tail = F.lit("00") if minute is None else F.lpad(minute.cast("string"), 2, "0")
    return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), tail)


def render_events(events: Column) -> Column:
    lines = F.transform(
        events,
        lambda e, i: F.concat(
            (i + 1).cast("string"), F.lit("|facility="), e["facility_id"], F.lit("|booked="),
            day_name(e["booked_weekday"]), F.lit(" "),
            _clock(e["booked_hour"], e["booked_minute"]), F.lit("|used="),
            day_name(e["used_weekday"]), F.lit(" "), _clock(e["used_hour"]),
            F.lit("|lead_hours="), two_places(e["lead_hours"]), F.lit("|gap_days="),
            _or_none(two_places(e["gap_days"])),
        ),
    )
    return F.when(F.size(events) > 0, F.array_join(lines, "\n")).otherwise("none")


def prompt_text(ladder: Ladder, p: Params) -> Column:
    """The prompt of a row of summary values."""
    origin = F.date_format(
        F.timestamp_micros("origin_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("PREDICTION_ORIGIN: "), origin),
        F.lit(f"ALLOWED_FACILITIES: [{', '.join(p.names)}]"),
        F.lit(LEGEND_TITLE), legend(ladder), F.lit(""), F.lit("HISTORY_SUMMARY:"),
        *(F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in SUMMARY),
        F.lit(""), F.lit("RECENT_BOOKINGS_OLDEST_TO_NEWEST:"),
        render_events(F.col("recent_events")), F.lit(""), F.lit("Predict the next booking."),
    )


def render_prompts(summary: DataFrame, ladder: Ladder, p: Params) -> DataFrame:
    return summary.select("sample_id", prompt_text(ladder, p).alias("prompt"))


def answer_json(facility: Column, weekday: Column, hour: Column, bucket: Column) -> Column:
    """Answer object with fixed field order and spacing."""
    return F.concat(
        F.lit('{"facility": "'), facility, F.lit('", "usage_day": "'), day_name(weekday, 9),
        F.lit('", "usage_hour": '), hour.cast("string"),
        F.lit(', "notification_delay_bucket": "'), bucket, F.lit('"}'),
    )


def target_text(ladder: Ladder) -> Column:
    """The answer text of a sample; out-of-range labels are errors."""
    day, hour = F.col("target_usage_weekday"), F.col("target_usage_hour")
    bucket = ladder_label(F.col("notification_delay_minutes"), ladder)
    fine = day.between(0, 6) & hour.between(0, 23)
    return F.when(fine, answer_json(F.col("target_facility_id"), day, hour, bucket)).otherwise(
        F.raise_error(F.lit("a weekday or hour is out of range"))
    )


def render_targets(samples: DataFrame, ladder: Ladder) -> DataFrame:
    return samples.select("sample_id", target_text(ladder).alias("target"))


def prompt_dataset(
    split_samples: DataFrame, prompts: DataFrame, targets: DataFrame, with_targets: bool = True
) -> DataFrame:
    """Prompt rows per split; a sample without a prompt is an error."""
    rows = split_samples.select("sample_id", "split").join(prompts, "sample_id", "left")
    prompt = F.when(F.col("prompt").isNotNull(), F.col("prompt")).otherwise(
        F.raise_error(F.lit("a sample has no feature row"))
    )
    rows = rows.select("sample_id", "split", F.lit(SYSTEM).alias("system"), prompt.alias("prompt"))
    return rows.join(targets, "sample_id") if with_targets else rows


def rendered_dataset(split_samples: DataFrame, resident: DataFrame, ladder: Ladder, p: Params) -> DataFrame:
    """The prompt rows of :func:`prompt_dataset`, rendered behind one join.

    Texts are several times the size of the values they show; here only the values
    are shuffled, once, and the texts are made where the row is put out.
    """
    rows = split_samples.withColumn("target", target_text(ladder))
    summary = prompt_summary(rows, resident, p, ("split", "target"), "left")
    prompt = F.when(F.col("origin_us").isNotNull(), prompt_text(ladder, p)).otherwise(
        F.raise_error(F.lit("a sample has no feature row"))
    )
    return summary.select("sample_id", "split", F.lit(SYSTEM).alias("system"), prompt.alias("prompt"), "target")


def sealed_check(fitted: DataFrame, scored: DataFrame, sealed: DataFrame) -> DataFrame:
    """Holdout ids among fitted rows, and scored rows that are not exactly the sealed ids."""
    ids = sealed.select("sample_id")
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(name).alias("check"), "violations"
        )

    leaked = count(fitted.join(ids, "sample_id", "left_semi"), "fitted_rows_in_holdout")
    extra = count(scored.join(ids, "sample_id", "left_anti"), "scored_rows_not_sealed")
    missing = count(ids.join(scored, "sample_id", "left_anti"), "sealed_rows_not_scored")
    targets = scored.agg(
        F.lit(int("target" in scored.columns)).cast("long").alias("violations")
    ).select(F.lit("scored_rows_with_target").alias("check"), "violations")
    return leaked.unionByName(extra).unionByName(missing).unionByName(targets).withColumn(
        "passed", F.col("violations") == 0
    )


def dedup(rows: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """First row of every distinct content, and how many later copies it stands for.

    Only ids and digests are shuffled, and copies are combined before they move,
    so a group of copies of any size costs one row per partition.
    """
    # A null has a text no digest has, so its place among the columns counts.
    cells = (F.coalesce(F.sha2(F.col(c), 256), F.lit("null")) for c in columns)
    digest = F.sha2(F.concat_ws("\x1f", *cells), 256)
    return rows.groupBy(digest.alias("_d")).agg(
        F.min(row_id).alias(row_id), (F.count(F.lit(1)) - 1).alias("dropped")
    ).select(row_id, "dropped")


def length_percentiles(rows: DataFrame, group: str, column: str) -> DataFrame:
    lengths = rows.select(group, F.length(column).alias("chars"))
    return exact_quantiles(lengths, [group], "chars", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


def chat_messages(rows: DataFrame) -> DataFrame:
    """System, user and assistant message of every row; an answer is required."""
    answer = F.when(F.length("target") > 0, F.col("target")).otherwise(
        F.raise_error(F.lit("a chat row has no answer"))
    )
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.col("system").alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")),
        F.struct(F.lit("assistant").alias("role"), answer.alias("content")),
    )
    return rows.select("sample_id", messages.alias("messages"))


def conversation_messages(turns: DataFrame) -> DataFrame:
    """The messages of every conversation, in order of turns.

    One conversation is one chat row, so its turns belong together in one array.
    """
    turn = F.struct("turn", "role", "text")
    ordered = F.transform(
        F.array_sort(F.collect_list(turn)),
        lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")),
    )
    return turns.groupBy("conv_id").agg(ordered.alias("messages"))


def parse_answers(answers: DataFrame, names: Sequence[str], buckets: Sequence[str]) -> DataFrame:
    """Answer text to typed fields, or the stage and reason of its rejection."""
    v = F.try_parse_json("text")
    keys = F.json_object_keys("text")
    need = F.array(*map(F.lit, FIELDS))
    missing = F.array_sort(F.array_except(need, keys))
    extra = F.array_sort(F.array_except(keys, need))
    rows = answers.withColumn("_v", v).withColumn("_keys", keys)
    kind = {f: F.schema_of_variant(F.try_variant_get("_v", f"$.{f}", "variant")) for f in FIELDS}
    text = {f: F.try_variant_get("_v", f"$.{f}", "string") for f in FIELDS}
    hour = F.try_variant_get("_v", "$.usage_hour", "double")
    allowed = {
        "facility": (kind["facility"] == "STRING") & text["facility"].isin(*names),
        "usage_day": (kind["usage_day"] == "STRING") & text["usage_day"].isin(*WEEKDAYS),
        "usage_hour": (kind["usage_hour"] != "STRING") & hour.isin(*map(float, range(24))),
        "notification_delay_bucket": (kind["notification_delay_bucket"] == "STRING")
        & text["notification_delay_bucket"].isin(*buckets),
    }
    stage = F.when(F.col("_v").isNull() | F.col("_keys").isNull(), "parse")
    reason = F.when(F.col("_v").isNull(), "not JSON").when(
        F.col("_keys").isNull(), "not a JSON object"
    )
    reason = reason.when(
        F.size(missing) > 0, F.concat(F.lit("missing field(s) "), F.array_join(missing, ", "))
    ).when(F.size(extra) > 0, F.concat(F.lit("unexpected field(s) "), F.array_join(extra, ", ")))
    for f in FIELDS:
        reason = reason.when(
            ~F.coalesce(allowed[f], F.lit(False)), f"{f} is outside its allowed values"
        )
    marked = rows.select(*answers.columns, "_v", stage.alias("_stage"), reason.alias("_reason"))
    ok = F.col("_reason").isNull()
    fields = F.struct(
        text["facility"].alias("facility"), text["usage_day"].alias("usage_day"),
        hour.cast("int").alias("usage_hour"),
        text["notification_delay_bucket"].alias("notification_delay_bucket"),
    )
    return marked.select(
        *(c for c in answers.columns if c != "text"),
        F.when(ok, "valid").otherwise("failed").alias("status"),
        F.when(ok, fields).alias("fields"),
        F.when(~ok, F.coalesce("_stage", F.lit("schema"))).alias("failure_stage"),
        F.col("_reason").alias("failure_reason"),
    )


def to_predictions(parsed: DataFrame, arm: str, ladder: Ladder) -> DataFrame:
    """Prediction columns of one arm; failed rows stay, as nulls."""
    names = labels(ladder)
    places = F.array(*map(F.lit, WEEKDAYS))
    reps = F.array(*map(F.lit, ladder.representatives))
    bucket = F.col("fields.notification_delay_bucket")
    at = F.array_position(F.array(*map(F.lit, names)), bucket) - 1
    delay = F.when(bucket.isNull(), F.lit(None).cast("double")).when(
        at < 0, F.raise_error(F.lit("an answer names an unknown bucket")).cast("double")
    ).otherwise(F.get(reps, at.cast("int")))
    return parsed.filter(F.col("arm") == arm).select(
        "sample_id", (F.col("status") == "valid").alias("valid"),
        F.col("fields.facility").alias("predicted_facility_id"),
        (F.array_position(places, F.col("fields.usage_day")) - 1).cast("int")
        .alias("predicted_usage_weekday"),
        F.col("fields.usage_hour").alias("predicted_usage_hour"),
        bucket.alias("predicted_notification_bucket"), delay.alias("predicted_delay_minutes"),
    )
