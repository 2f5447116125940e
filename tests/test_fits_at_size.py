"""Fits on many rows: histograms by halves, borders in one pass, candidates inside rows, heads only where asked for."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from originline.operators import boosting as B
from originline.operators import candidates as K
from originline.operators import framings as G
from originline.operators import heads as M
from originline.operators import splits as P
from originline.params import TEST
from originline.plans import models as J
from originline.plans.workspace import Workspace

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("width", [1, 4])
def test_half_of_the_leaves_tells_the_other_half(width):
    rng = np.random.default_rng(5)
    n, k = 700, 3 if width == 1 else 1
    block = B.Block(rng.integers(0, 6, (n * width, 5)).astype(np.uint8), rng.integers(0, width if width > 1 else k, n).astype(np.int32), rng.random(n) < 0.2, width)
    trees = [B.Tree((1, 2), (2, 3), tuple(map(tuple, rng.normal(size=(4, k)))))]
    start, features = np.zeros(k), [4, 0, 3]
    before, _ = B.histogram(block, trees, start, ((), ()), features, 8)
    for splits in (((0,), (1,)), ((0, 3), (1, 4)), ((0, 3, 4), (1, 4, 0))):
        counted = B.lighter(before[features.index(splits[0][-1])], splits[1][-1])
        part, told = B.histogram(block, trees, start, splits, features, 8, counted)
        whole, _ = B.histogram(block, trees, start, splits, features, 8)
        assert part.shape[1] == before.shape[1] and 2 * part[0, ..., k:].sum() <= before[0, ..., k:].sum() and not told.any()
        assert (B.completed(before, part, counted) == whole).all()
        before = whole


def test_borders_are_quantiles_of_all_rows(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.gauss(0, 1), float(rng.randrange(4)), rng.randrange(50), None, None if rng.random() < 0.3 else rng.random()) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "a double, b double, c int, d double, e double")
    found = [B.find_borders(frame.repartition(parts), frame.columns, 31) for parts in (1, 7)]
    assert found[0] == found[1] and found[0][3] == []  # no quantile moves with the partitions
    for i in (0, 1, 2, 4):
        x = np.sort([r[i] for r in rows if r[i] is not None])
        exact = np.unique(x[[-(-(k + 1) * len(x) // 32) - 1 for k in range(31)]])
        assert found[0][i] == exact[exact > x[0]].tolist()
    monkeypatch.setattr(B, "SORTED", 500)
    monkeypatch.setattr(B, "RANKS", 50)
    assert B.find_borders(frame.limit(0), frame.columns, 31) == [[]] * 5
    x = np.sort([r[0] for r in rows])
    ranks = np.searchsorted(x, B.find_borders(frame.repartition(3), ["a"], 31)[0], side="right")
    assert np.abs(ranks - np.arange(1, 32) * len(x) / 32).max() <= 2 * len(x) / 50
    assert "percentile" not in B.find_borders.__code__.co_names


@pytest.fixture(scope="module")
def work(spark):
    return Workspace(spark, SMALL)


def test_candidates_are_made_inside_the_row(work):
    table = work.model_rows.limit(300)
    arrays = G.candidate_rows(table, TEST)
    assert "Exchange" not in G.candidate_rows(work.model_rows, TEST)._jdf.queryExecution().executedPlan().toString()
    long = M.candidate_matrix(K.build_candidates(work.model_rows, TEST), TEST)
    want = {}
    for r in long.select("sample_id", *[F.col(c).cast("double") for c in M.candidate_inputs(TEST)]).collect():
        want.setdefault(r[0], []).append(tuple(r[1:]))
    rows = arrays.collect()
    assert len(rows) == 300
    assert all([tuple(c) for c in r["candidates"]] == sorted(want[r["sample_id"]]) for r in rows)


@pytest.mark.parametrize("frac", [0.15, 0.0, 1.0])
def test_the_tail_is_told_by_its_first_row(spark, frac):
    rng = random.Random(2)
    rows = spark.createDataFrame([(f"s{i:03}", rng.randrange(40)) for i in range(500)], "sample_id string, target_us long").repartition(5)
    want = {r[0] for r in P.tail_fold(rows, frac).filter("fold = 'held_out'").collect()}
    assert {r[0] for r in rows.filter(P.in_tail(rows, frac)).collect()} == want and len(want) == round(500 * frac)


def test_the_control_shuffles_bins_not_features(work):
    train, held = (work.model_rows.filter(F.col("split") == s) for s in ("train", "validation"))
    size = M.Settings(10, 5)
    n = len(M.model_inputs(TEST, size))
    rows = M.control_rows(train, held, TEST, size, work.input_borders)
    found = rows.withColumn("n", F.length("x")).collect()
    assert {r["n"] for r in found} == {n + 1} and all(r["x"][-1] == r["y"] + 1 for r in found)  # a byte each, the label's last
    mixed = M.shuffled_labels(train, "target_facility_id", TEST.seed).collect()
    own = G.prepared(train, TEST).select("sample_id", "features").collect()
    x = {r[0]: B.binned(np.array([r[1]], float), work.input_borders).tobytes() for r in own}
    want = sorted((x[r["sample_id"]], TEST.names.index(r["permuted"])) for r in mixed)
    assert sorted((bytes(r["x"][:-1]), r["y"]) for r in found if not r["late"]) == want
    assert sum(r["late"] for r in found) == held.count()
    # The rows of the only wide shuffle are an id and its bins.
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join Inner, (sample_id"):].splitlines()[1]
    assert joined.strip(" :+-").startswith("Project [sample_id") and joined.count(",") == 1
    control = {r["control"]: r for r in M.shuffled_control(train, held, TEST, size).collect()}
    assert not control["shuffled"]["tripped"] and control["planted"]["tripped"] and control["planted"]["accuracy"] > 0.9


def test_only_heads_that_are_asked_for_are_fitted(spark):
    own = Workspace(spark, SMALL)
    rows = J.cadence_calibration(own).collect()
    assert len(rows) > 1 and "model_rows" not in own.__dict__ and "heads" not in own.__dict__
    assert J.rank_facility_head(own).filter("picked_is_best and answer_is_picked and best_is_likely").count() > 0
    assert set(own.heads.done) == {"facility_ranked"}
    other = Workspace(spark, SMALL)
    other.model_rows = own.model_rows
    assert J.predict_probabilities(other).filter("not same_when_loaded").count() == 0
    assert set(other.heads.done) == {"facility", "usage_weekday", "usage_hour"}
    with pytest.raises(KeyError):
        other.heads["weather"]


def test_no_variant_is_left_out(work):
    found = J.variant_sweep(work).collect()
    assert {(r["variant"], r["head"]) for r in found} == {(v.name, h) for v in G.DECLARED for h in v.heads}
    assert all(r["state"] == "done" and r["rounds_of_the_frozen"] and r["rates_are_shares"] for r in found)


def test_a_budget_only_deals_variants_into_passes(work):
    train, held = (work.model_rows.filter(F.col("split") == s) for s in ("train", "validation"))
    declared = (G.DECLARED[5], G.DECLARED[1])  # three fits, and a decoding
    found = G.run_variants(train, held, TEST, work.base_heads, 1, declared, work.input_borders).collect()
    assert [(r["variant"], r["head"], r["state"]) for r in found] == [
        ("likeliest_bucket", "notification", "done"), *(("stronger_leaves", h, "done") for h in G.CLASSIFIERS)]
    assert all(r["rounds"] == work.heads[r["head"]].model.rounds for r in found)
