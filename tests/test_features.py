"""Hand-checked feature values, and hot-key paths against the plain ones."""

import math
import random

import pytest
from pyspark.sql import functions as F

from originline.operators.community import community_features
from originline.operators.features import as_of_audit, feature_table
from originline.operators.candidates import candidate_labels
from originline.operators.history import ROWS_PER_TASK, build_history, prepare, resident_features
from originline.operators.samples import build_samples
from originline.plans.workspace import Workspace
from originline.params import TEST
from tests.helpers import FOUR, THREE, bookings, small_blocks


@pytest.fixture(scope="module")
def four(spark):
    df = bookings(spark, FOUR)
    h = build_history(df, THREE)
    resident = resident_features(h)
    samples = build_samples(h)
    community = community_features(prepare(df, THREE), THREE)
    table = feature_table(samples, resident, community, THREE)
    rows = {r["sample_id"]: r.asDict() for r in table.collect()}
    return [rows[f"S000000{i}"] for i in (1, 2, 3)]


def test_third_sample_counts_and_recency(four):
    t = four[2]
    assert t["n_prior_bookings"] == 3
    assert (t["bookings_prior_7d"], t["bookings_prior_30d"], t["bookings_prior_180d"]) == (1, 3, 3)
    assert t["booking_rate_ratio_30d_90d"] == pytest.approx(3.0)
    assert t["days_since_previous_booking"] == 8 and t["days_since_first_booking"] == 10
    assert t["inter_booking_interval_mean_days"] == 5
    assert t["inter_booking_interval_median_days"] == 5
    assert t["inter_booking_interval_std_days"] == pytest.approx(math.sqrt(18))


def test_third_sample_preferences(four):
    t = four[2]
    assert t["facility_count_gym"] == 2 and t["facility_share_gym"] == pytest.approx(2 / 3)
    assert t["last_1_facility"] == "Gym"
    assert t["transitions_from_last_total"] == 1
    assert t["transition_count_from_last_pool"] == 1
    assert t["transition_share_from_last_pool"] == 1
    assert t["transition_count_from_last_gym"] == 0
    old, mid = 0.5 ** (10 / 30), 0.5 ** (8 / 30)
    assert t["ewma_facility_share_gym"] == pytest.approx((old + 1) / (old + mid + 1), abs=1e-12)
    bits = -(2 / 3) * math.log2(2 / 3) - (1 / 3) * math.log2(1 / 3)
    assert t["facility_entropy_bits"] == pytest.approx(bits)


def test_third_sample_community(four):
    t = four[2]
    assert t["community_facility_share_gym"] == 0.5
    assert t["community_facility_share_pool"] == 0.5
    assert t["community_facility_share_tennis"] == 0
    assert t["community_facility_share_origin_weekday_gym"] is None
    assert t["community_facility_share_origin_band_gym"] == 0.5
    assert t["community_lead_minutes_mean_gym"] == 1380
    assert t["community_lead_minutes_mean_pool"] == 2040
    assert t["community_lead_minutes_mean_tennis"] is None


def test_second_sample_favourite_goes_to_the_most_recent(four):
    assert four[1]["rolling_top_facility_last_3"] == "Pool"
    assert four[1]["rolling_top_facility_share_last_3"] == 0.5


def test_first_sample_has_gaps(four):
    t = four[0]
    for name in ("days_since_previous_booking", "transition_share_from_last_gym",
                 "community_facility_share_gym", "inter_booking_interval_mean_days"):
        assert t[name] is None
    assert t["lead_minutes_recent"] == 1380 and t["facility_entropy_bits"] == 0


def test_moving_the_first_booking_back_moves_only_long_windows(spark):
    rows = [("B0000001", "R001", "Gym", "2023-11-02 08:00", "2023-11-03 07:00"), *FOUR[1:]]
    df = bookings(spark, rows)
    found = community_features(prepare(df, THREE), THREE)
    at = found.filter(F.col("us") == 1704960000000000).first()  # the third booking
    assert at["community_facility_share_30d_pool"] == 1.0
    assert at["community_facility_share_90d_pool"] == 0.5


def skewed(spark, n=300, seed=7):
    """One resident holds most rows; gaps repeat so that medians tie."""
    rng = random.Random(seed)
    rows, clock = [], {}
    for i in range(n):
        who = "hot" if rng.random() < 0.6 else f"r{rng.randrange(12)}"
        clock[who] = clock.get(who, rng.randrange(86_400)) + rng.choice(
            [3_600, 86_400, 86_400, 200_000, rng.randrange(1, 400_000)]
        )
        rows.append((f"b{i:05d}", who, rng.choice(TEST.names), clock[who],
                     rng.choice([1_800, 7_200, 90_000])))
    df = spark.createDataFrame(
        rows, "booking_id string, resident_id string, facility_id string, s long, lead long"
    )
    base = 1_704_067_200
    return df.select(
        "booking_id", "resident_id", "facility_id",
        F.timestamp_seconds(F.col("s") + base).alias("booking_timestamp"),
        F.timestamp_seconds(F.col("s") + F.col("lead") + base).alias("usage_timestamp"),
    )


CHECKED = [
    "booking_id", "n", "next_booking_id", "facility_share_click", "ewma_facility_share_view",
    "inter_booking_interval_median_days", "inter_booking_interval_std_days",
    "lead_minutes_median", "bookings_prior_7d", "mode_facility", "mode_successor",
    "rolling_top_facility_last_10", "last_3_facility", "transition_count_from_last_click",
    "change_distance", "days_since_first_booking",
]


def test_blocked_residents_equal_whole_residents(spark):
    df = skewed(spark)
    whole = resident_features(build_history(df, TEST)).select(*CHECKED)
    p = small_blocks(TEST)
    h = build_history(df, p)
    assert h.blocked and h.large is not None
    cut = resident_features(h).select(*CHECKED)
    a = {r["booking_id"]: r.asDict() for r in whole.collect()}
    b = {r["booking_id"]: r.asDict() for r in cut.collect()}
    assert a.keys() == b.keys()
    for key, row in a.items():
        for name, value in row.items():
            if isinstance(value, float):
                assert b[key][name] == pytest.approx(value, abs=1e-9), (key, name)
            else:
                assert b[key][name] == value, (key, name)


def test_several_hot_residents_in_many_blocks(spark):
    """Running medians of residents with many small blocks each, beside residents with none."""
    parts = [skewed(spark, 220, seed=s).select(
        *(F.concat(F.lit(f"{s}-"), c).alias(c) for c in ("booking_id", "resident_id")), "facility_id", "booking_timestamp", "usage_timestamp")
        for s in (5, 6, 7)]
    df = parts[0].unionByName(parts[1]).unionByName(parts[2])
    names = ["booking_id", "inter_booking_interval_median_days", "lead_minutes_median"]
    whole = {r[0]: r for r in resident_features(build_history(df, TEST)).select(*names).collect()}
    h = build_history(df, small_blocks(TEST))
    assert h.blocked and h.frame.filter("resident_id like '%-%'").select("resident_id").distinct().count() > 3
    cut = {r[0]: r for r in resident_features(h).select(*names).collect()}
    assert cut.keys() == whole.keys()
    for name, row in whole.items():
        assert cut[name][1:] == pytest.approx(row[1:], nan_ok=True) if None not in row else cut[name] == row


def test_the_future_does_not_change_earlier_rows(spark):
    """Deleting or moving later bookings leaves earlier origins' features as they were."""
    df = skewed(spark, 160, seed=3)
    cut = 1_704_067_200 + 900_000
    shifted = df.select(
        "booking_id", "resident_id",
        F.when(F.col("booking_timestamp").cast("long") >= cut, "view")
        .otherwise(F.col("facility_id")).alias("facility_id"),
        "booking_timestamp", "usage_timestamp",
    )
    gone = df.filter(F.col("booking_timestamp").cast("long") < cut)
    names = [c for c in CHECKED if c != "next_booking_id"]

    def before(frame):
        resident = resident_features(build_history(frame, TEST)).filter(
            F.col("us") < cut * 1_000_000
        )
        community = community_features(prepare(frame, TEST), TEST).select(
            "us", "community_facility_share_click", "community_facility_share_7d_view"
        )
        return sorted(map(str, resident.join(community, "us").select(
            *names, "community_facility_share_click", "community_facility_share_7d_view"
        ).collect()))

    kept = before(df)
    assert kept and before(gone) == kept and before(shifted) == kept


def test_a_changed_past_is_noticed(spark):
    df = skewed(spark, 160, seed=3)
    changed = df.withColumn("facility_id", F.lit("view"))
    one = resident_features(build_history(df, TEST)).agg(F.sum("facility_share_view")).first()[0]
    two = resident_features(build_history(changed, TEST)).agg(
        F.sum("facility_share_view")).first()[0]
    assert one != two


def test_audit_finds_nothing_on_sound_samples(spark):
    df = bookings(spark, FOUR)
    h = build_history(df, THREE)
    audit = as_of_audit(
        build_samples(h), resident_features(h), community_features(prepare(df, THREE), THREE)
    ).first().asDict()
    assert audit["samples"] == 3 and audit["resident_events_read"] == 6
    assert audit["community_events_covered"] == 3
    assert all(audit[k] == 0 for k in (
        "resident_reads_past_origin", "origins_past_target", "prior_count_mismatches",
        "community_reads_at_origin"))


def test_tasks_of_the_resident_windows_hold_a_bounded_number_of_rows(spark):
    rows = 9 * ROWS_PER_TASK
    many = spark.range(rows).select(
        F.col("id").cast("string").alias("booking_id"), (F.col("id") % 5000).cast("string").alias("resident_id"),
        F.lit("Gym").alias("facility_id"), F.timestamp_micros(F.col("id") * 1_000_000).alias("booking_timestamp"),
        F.timestamp_micros(F.col("id") * 1_000_000 + 1).alias("usage_timestamp"))
    h = build_history(many, THREE)
    assert h.frame.select("n").rdd.getNumPartitions() == 9


def test_expanded_candidates_are_not_broadcast(spark):
    table = spark.createDataFrame([("S1", ["Gym", "Pool"])], "sample_id string, names array<string>")
    long = table.select("sample_id", F.explode("names").alias("candidate_facility"))
    targets = spark.createDataFrame([("S1", "Pool")], "sample_id string, target_facility_id string")
    labels = candidate_labels(long, targets)
    assert "SortMergeJoin" in labels._jdf.queryExecution().sparkPlan().toString()
    assert sorted((r["candidate_facility"], r["relevance"]) for r in labels.collect()) == [("Gym", 0), ("Pool", 1)]


def test_the_residents_columns_are_shuffled_once(spark):
    ws = Workspace(spark, "/root/testdata/sf0.001")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = feature_table(ws.samples, ws.resident, ws.community, ws.params)
        plan = table._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [line for line in plan.splitlines() if "Join" in line]
    # The last join, first in the plan, is that with the residents' rows; nothing deals its result out again.
    assert "origin_booking_id" in joins[0]
    assert "Exchange" not in plan[: plan.index("Join")]
