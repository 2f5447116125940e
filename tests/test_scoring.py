"""Scoring, delays, answers and tables on hand fixtures."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oracle_check import difference, oracle
from originline.operators import delays as D
from originline.operators import prompts as G
from originline.operators import scoring as S
from originline.operators import splits as P
from originline.params import TEST, bucket_edges
from originline.sources import tables as T
from tests.helpers import FOUR, THREE, bookings


@pytest.fixture(scope="module")
def frame(spark):
    rows = [
        ("a", "Gym", 2, 7, 99.0, "Gym", 2, 7, 99.0), ("b", "Pool", 2, 7, 99.0, "Gym", 2, 7, 99.0),
        ("c", "Pool", 3, 8, 400.0, "Gym", 2, 7, 99.0), ("d", "Gym", 3, 7, 400.0, "Gym", 2, 7, 99.0),
    ]
    df = spark.createDataFrame(
        rows, "sample_id string, predicted_facility_id string, predicted_usage_weekday int, "
        "predicted_usage_hour int, predicted_delay_minutes double, target_facility_id string, "
        "target_usage_weekday int, target_usage_hour int, notification_delay_minutes double",
    )
    return S.score(df, THREE)


def test_scores_and_summary(frame):
    scores = {r["sample_id"]: r["score"] for r in frame.collect()}
    assert scores == {"a": 4, "b": 3, "c": 0, "d": 2}
    s = S.match_summary(frame, []).first()
    assert s["score_mean"] == 2.25 and s["overall"] == 0.5625
    assert s["strict"] == 0.25 and s["at_least_three"] == 0.5


@pytest.mark.parametrize(("actual", "predicted", "match"), [
    (99.0, 124.0, True), (99.0, 79.0, True), (99.0, 124.5, False), (99.0, 78.5, False),
    (0.0, 0.25, True), (0.0, 0.3, False), (0.0, -30.0, True),
])
def test_delay_tolerance(spark, actual, predicted, match):
    row = spark.createDataFrame([(actual, predicted)], "a double, p double")
    gap = row.select(F.abs(S.log_ratio(F.col("p"), F.col("a"))) <= THREE.tolerance).first()[0]
    assert gap is match


def test_hours_go_round_the_clock(spark):
    df = spark.createDataFrame([(23, 0), (0, 23), (6, 7), (12, 0)], "p int, a int")
    got = [r[0] for r in df.select(S.circular_hours(F.col("p"), F.col("a"))).collect()]
    assert got == [1, 1, 1, 12]


def test_macro_f1_counts_labels_of_both_sides(spark):
    df = spark.createDataFrame(
        [("facility", "Gym", "Gym", 2), ("facility", "Pool", "Gym", 1)],
        "head string, actual string, predicted string, n long",
    )
    assert S.macro_f1(df, []).first()["macro_f1"] == pytest.approx(0.4)
    assert S.class_accuracy(df, []).first()["accuracy"] == pytest.approx(2 / 3)


def test_delay_errors(spark):
    df = spark.createDataFrame(
        [(float(i), 0.0) for i in range(0, 100, 10)],
        "predicted_delay_minutes double, notification_delay_minutes double",
    ).withColumn("model", F.lit("m"))
    m = S.delay_metrics(df, THREE, ["model"]).first()
    assert (m["mae_minutes"], m["median_ae_minutes"], m["signed_bias_minutes"]) == (45, 45, 45)
    assert m["p90_ae_minutes"] == pytest.approx(81)
    assert [m[f"within_{k}_minutes"] for k in (30, 60, 180)] == [0.4, 0.7, 1.0]


def test_fixed_buckets_and_ladder():
    edges = bucket_edges(THREE)
    assert edges[0] == 60 and edges[-1] == 144_000 and edges[1] == 90
    ladder = D.fine_ladder(THREE)
    names = D.labels(ladder)
    assert names[0] == "UNDER_60M" and names[-1] == "OVER_144000M"
    assert all(high / low <= 1.5 + 1e-9 for low, high in ladder.spans()[1:-1])


def test_sparse_buckets_merge_downwards_and_the_first_upwards():
    ladder = D.Ladder((61.0, 91.0, 120.0), (5, 300, 10, 250))
    merged, log = D.merged(ladder, 200)
    assert (merged.cuts, merged.rows) == ((120.0,), (315, 250))
    assert D.labels(merged) == ["UNDER_119M", "OVER_119M"]
    assert [(m.lower, m.upper, m.into, m.lower_rows, m.upper_rows) for m in log] == [
        ("UNDER_60M", "M60_90", "UNDER_90M", 5, 300), ("UNDER_90M", "M90_119", "UNDER_119M", 305, 10)]


def test_merging_equals_repeated_merging_of_the_first_sparse_bucket():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 9)
        cuts = tuple(float(2 + 3 * k) for k in range(n))
        counts = tuple(rng.randrange(0, 30) for _ in range(n + 1))
        spans = [[low, high, c] for (low, high), c in zip(D.Ladder(cuts).spans(), counts, strict=True)]
        while len(spans) > 1 and any(s[2] < 12 for s in spans):
            at = max(next(i for i, s in enumerate(spans) if s[2] < 12) - 1, 0)
            spans[at : at + 2] = [[spans[at][0], spans[at + 1][1], spans[at][2] + spans[at + 1][2]]]
        got, log = D.merged(D.Ladder(cuts, counts), 12)
        assert [[*s, c] for s, c in zip(got.spans(), got.rows, strict=True)] == spans
        assert len(log) == n + 1 - len(spans)


def test_window_mode_finds_the_fullest_window(spark):
    values = [round(0.05 * i, 2) for i in range(9)] + [40.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    row = D.window_mode(df, "x", 0.25).first()
    assert row["held"] == 9 and row["mode"] == pytest.approx(0.2)


def test_window_decode_takes_the_heaviest_window(spark):
    grid = D.delay_grid(THREE)
    n = len(bucket_edges(THREE)) + 1
    p = [0.0] * n
    p[3], p[4], p[9] = 0.35, 0.3, 0.35
    df = spark.createDataFrame([(p,)], "p array<double>")
    minutes = math.exp(df.select(D.window_decode(F.col("p"), grid)).first()[0])
    edges = bucket_edges(THREE)
    assert edges[2] < minutes < edges[4]


def test_answers_fail_with_a_stage_and_a_reason(spark):
    good = '{"facility": "Gym", "usage_day": "Monday", "usage_hour": 7, "notification_delay_bucket": "LOW"}'
    texts = {
        "good": good, "text": "no answer", "list": "[1]", "missing": '{"facility": "Gym"}',
        "extra": good.replace("{", '{"x": 1, '), "enum": good.replace("Gym", "Sauna"),
        "kind": good.replace(": 7", ': "7"'), "hour": good.replace(": 7", ": 24"),
    }
    df = spark.createDataFrame(
        [(k, "one", v) for k, v in texts.items()], "sample_id string, arm string, text string"
    )
    got = {r["sample_id"]: r for r in G.parse_answers(df, THREE.names, ["LOW"]).collect()}
    assert got["good"]["status"] == "valid" and got["good"]["fields"]["usage_hour"] == 7
    assert got["text"]["failure_stage"] == "parse" and got["list"]["failure_stage"] == "parse"
    for k in ("missing", "extra", "enum", "kind", "hour"):
        assert (got[k]["status"], got[k]["failure_stage"]) == ("failed", "schema"), k
    ladder = D.Ladder((), (9,), (30.0,), ("empirical",))
    unknown = G.to_predictions(G.parse_answers(df, THREE.names, ["LOW"]), "one", ladder)
    with pytest.raises(Exception, match="unknown bucket"):
        unknown.collect()


def test_allocation_keeps_every_stratum_and_the_total(spark):
    df = spark.createDataFrame(
        [(f"s{i}", "big" if i < 90 else f"rare{i}") for i in range(100)],
        "sample_id string, stratum string",
    )
    plan = {r["stratum"]: r["allocated"] for r in P.allocation(df, 24).collect()}
    assert sum(plan.values()) == 24 and min(plan.values()) == 1 and len(plan) == 11
    assert P.stratified_sample(df, 24, 1).count() == 24
    with pytest.raises(Exception, match="cannot serve"):
        P.allocation(df, 5).collect()


def test_label_floor_draw_has_exactly_the_asked_rows(spark):
    df = spark.createDataFrame(
        [(f"s{i}", "a" if i < 40 else "b" if i < 59 else "rare") for i in range(60)],
        "sample_id string, label string",
    )
    drawn = P.label_floor_sample(df, "label", 12, 2, 5).collect()
    assert len(drawn) == 12 == len({r["sample_id"] for r in drawn})
    assert sum(r["label"] == "rare" for r in drawn) == 1


def test_predictions_partition_is_replaced_alone(spark):
    path = T.scratch(spark, "t")
    base = [("t1", "m1", "s1", "Gym", 1, 1, 1.0, "Gym"), ("t1", "m2", "s1", "Pool", 1, 1, 1.0, "Gym")]
    names = T.declared("predictions")[0].fieldNames()
    T.conform(spark.createDataFrame(base, names), "predictions").write.partitionBy(
        "track", "model").parquet(path)
    new = spark.createDataFrame([("t1", "m1", "s2", "Gym", 2, 2, 2.0, "Gym")], names)
    T.overwrite_predictions(new, "t1", "m1", path)
    left = {(r["model"], r["sample_id"]) for r in spark.read.parquet(path).collect()}
    assert left == {("m1", "s2"), ("m2", "s1")}
    with pytest.raises(ValueError, match="another track"):
        T.overwrite_predictions(new, "t1", "m2", path)
    with pytest.raises(ValueError, match="no column"):
        T.conform(new.withColumn("zz", F.lit(1)), "predictions")
    with pytest.raises(ValueError, match="unknown table"):
        T.declared("nope")


def test_csv_keeps_instants(spark):
    df = bookings(spark, FOUR)
    path = T.scratch(spark, "csv")
    T.export_csv(df, path)
    assert sorted(T.scan_csv(spark, "bookings", path).collect()) == sorted(df.collect())


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.range(400).select(F.col("id"), (F.col("id") % 10).cast("double").alias("v"))
    row = S.bootstrap_mean(df, "id", "v", TEST).first()
    assert row["lower"] < 4.5 < row["upper"]
    assert row["upper"] - row["lower"] == pytest.approx(4 * 2.87 / 20, rel=0.15)


def test_single_draws_are_not_broadcast(spark):
    df = spark.range(400).select(F.col("id"), (F.col("id") % 10).cast("double").alias("v"))
    drawn = S._resampled(df, "id", None, {"x": F.col("v")}, TEST)
    plan = drawn._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "_rank" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


FOLDER = "/root/testdata/sf0.01"
QUICK = (
    "booking_row_contract", "booking_quarantine", "strict_order_ties", "keep_strictly_increasing",
    "category_drift_js", "sample_labels", "assign_stable_ids", "split_shape", "tail_fraction_fold",
    "stratified_sample", "row_digest", "table_fingerprint", "feat_recency", "feat_window_counts",
    "feat_booking_routine", "time_band", "delay_ladder_assign", "delay_ladder_representatives",
    "lead_quantiles", "operational_metrics", "monthly_shares",
)


@pytest.fixture(scope="module")
def con() -> duckdb.DuckDBPyConnection:
    return oracle(FOLDER)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_oracle(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    assert difference(got, want) is None
