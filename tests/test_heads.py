"""Boosted heads, their framings, search, calibration and variants."""

import dataclasses
import math
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from originline.operators import boosting as B
from originline.operators import cadence as C
from originline.operators import delays as D
from originline.operators import framings as G
from originline.operators import scoring as S
from originline.params import TEST
from originline.plans import models as J
from originline.plans.workspace import Workspace

SMALL = "/root/testdata/sf0.001"


# ---------------------------------------------------------------------- boosting


def block(n=60, k=3, width=1, seed=1, features=4, bins=6):
    rng = np.random.default_rng(seed)
    return B.Block(rng.integers(0, bins, (n * width, features)).astype(np.uint8), rng.integers(0, width if width > 1 else k, n).astype(np.int32),
                   rng.random(n) < 0.2, width)


@pytest.mark.parametrize("width", [1, 5])
def test_gradients_equal_finite_differences(width):
    """Of the log-likelihood: a softmax over classes, and over the candidates of a group."""
    rng = np.random.default_rng(3)
    n, k = 12, width if width > 1 else 4
    m, y = rng.normal(size=(n, k)), rng.integers(0, k, n)
    value = lambda x: np.log(B.softmax(x)[np.arange(n), y]).sum()
    g, h = B.gradients(B.softmax(m), y, np.zeros(n, bool)) / B.UNIT
    step = 1e-4
    for i in range(n):
        for j in range(k):
            up, down = m.copy(), m.copy()
            up[i, j] += step
            down[i, j] -= step
            assert g[i, j] == pytest.approx((value(up) - value(down)) / (2 * step), abs=1e-5)
            assert -h[i, j] == pytest.approx((value(up) - 2 * value(m) + value(down)) / step**2, abs=1e-4)


@pytest.mark.parametrize("width", [1, 3])
def test_histogram_by_plain_loops(width):
    b = block(width=width)
    trees = [B.Tree((1, 2), (2, 3), tuple(tuple(x) for x in np.random.default_rng(4).normal(size=(4, 3 if width == 1 else 1))))]
    start, splits = np.zeros(3 if width == 1 else 1), ((0,), (2,))
    sums, told = B.histogram(b, trees, start, splits, [3, 1], 8)
    p = B.shares(b.bins, trees, start, width)
    g = B.gradients(p, b.labels, b.held)
    want = np.zeros_like(sums)
    for row in range(len(b.labels)):
        for c in range(width):
            at = row * width + c
            own = (g[0][row], g[1][row]) if width == 1 else (g[0][row, c : c + 1], g[1][row, c : c + 1])
            for i, f in enumerate((3, 1)):
                want[i, int(b.bins[at, 0] > 2), b.bins[at, f]] += np.concatenate(own)
    assert (sums == want).all()
    assert told[0] == b.held.sum() and told[1] == (p[b.held].argmax(axis=1) == b.labels[b.held]).sum()


def test_split_gains_by_plain_loops():
    rng = np.random.default_rng(8)
    g, h = rng.integers(-B.UNIT, B.UNIT, (5, 2, 7, 3)), rng.integers(1, B.UNIT, (5, 2, 7, 3))
    sums = np.concatenate([g, h], axis=3)
    gain = lambda f, cut: sum(
        side[..., k] ** 2 / (side[..., 3 + k] + 2.0 * B.UNIT) for leaf in range(2) for k in range(3)
        for side in (sums[f, leaf, : cut + 1].sum(axis=0).astype(float), sums[f, leaf, cut + 1 :].sum(axis=0).astype(float)))
    f, cut = B.best_split(sums, 2.0)
    assert gain(f, cut) == pytest.approx(max(gain(a, b) for a in range(5) for b in range(6)))
    values = np.asarray(B.leaf_values(sums[f], cut, 2.0, 0.5))
    low = sums[f, 1, : cut + 1].sum(axis=0)
    assert values.shape == (4, 3) and values[1, 2] == pytest.approx(0.5 * low[2] / (low[5] + 2.0 * B.UNIT))


def signal(spark, n=900, seed=2, parts=3):
    """Class 0..2 by two of four numbers, a fifth of the labels wrong, some numbers missing."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [None if rng.random() < 0.05 else rng.gauss(0, 1) for _ in range(4)]
        y = (x[0] or 0) > 0.3
        y = int(y) + int(y and (x[2] or 0) > 0)
        rows.append((i, x, rng.randrange(3) if rng.random() < 0.2 else y))
    return spark.createDataFrame(rows, "i int, features array<double>, label int").repartition(parts)


def test_estimator_learns_saves_and_does_not_depend_on_partitions(spark, tmp_path):
    fit = lambda parts: B.BoostedTrees(classes=3, settings='{"rounds": 12, "depth": 3, "share": 1.0}').fit(signal(spark, parts=parts))
    model, other = fit(1), fit(6)
    assert model.getOrDefault("fitted") == other.getOrDefault("fitted") and model.rounds == 12
    scored = model.transform(signal(spark, seed=5))
    rate = scored.select(F.avg((F.array_position("probability", F.array_max("probability")) - 1 == F.col("label")).cast("int"))).first()[0]
    assert rate > 0.75
    assert scored.filter(F.abs(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9).count() == 0
    PipelineModel(stages=[model]).save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(signal(spark, seed=5))
    assert sorted(map(tuple, again.select("i", "probability").collect())) == sorted(map(tuple, scored.select("i", "probability").collect()))
    gains = dict(model.gains())
    assert gains[0] > gains[1] and gains[2] > gains[3] and sum(gains.values()) == pytest.approx(1)


def test_groups_are_ranked(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        cells = [[rng.gauss(0, 1), rng.gauss(0, 1)] for _ in range(4)]
        rows.append((i, cells, max(range(4), key=lambda c: cells[c][1])))
    frame = spark.createDataFrame(rows, "i int, features array<array<double>>, label int")
    model = B.BoostedTrees(classes=4, ranked=True, settings='{"rounds": 15, "share": 1.0}').fit(frame)
    rate = model.transform(frame).select(F.avg((F.array_position("probability", F.array_max("probability")) - 1 == F.col("label")).cast("int"))).first()[0]
    assert rate > 0.85


def test_the_stop_and_the_choice():
    told = [B.Round(i + 1, 10, hits, 0.0) for i, hits in enumerate([3, 5, 5, 4, 4])]
    assert B.best_round(told) == 2 and B.stopped(told, 3) and not B.stopped(told[:4], 3)
    assert B.best_round([]) == 1


def test_no_rows_and_constant_features(spark):
    with pytest.raises(ValueError):
        B.BoostedTrees(classes=2).fit(signal(spark).limit(0))
    same = signal(spark, 50).withColumn("features", F.array(F.lit(1.0), F.lit(None).cast("double")))
    model = B.BoostedTrees(classes=3).fit(same)
    assert model.rounds == 0
    assert model.transform(same).select("probability").distinct().collect()[0][0] == pytest.approx([1 / 3] * 3)


# ----------------------------------------------------------------------- cadence


def gaps(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        gap = rng.choice([None, 0.0, 0.5, 2.0, 9.0])
        rows.append((gap, (gap or 1.0) * 1440 * math.exp(rng.gauss(0, 0.4))))
    return spark.createDataFrame(rows, "gap_median_days double, notification_delay_minutes double"), rows


def plain_calibration(rows, p):
    logs = sorted(math.log(d) for _, d in rows)
    held = [sum(x <= y <= x + 2 * p.tolerance for y in logs) for x in logs]
    start = held.index(max(held))
    fallback = (logs[start] + max(y for y in logs if y <= logs[start] + 2 * p.tolerance)) / 2
    n = D.residual_count(p)
    counts = [1] * n
    for gap, delay in rows:
        residual = math.log(delay) - (math.log(gap * 1440) if gap else fallback)
        counts[min(max(int((residual + p.residual_span) // (2 * p.residual_span / n)), 0), n - 1)] += 1
    return fallback, [c / sum(counts) for c in counts]


def test_calibration_by_plain_loops(spark):
    frame, rows = gaps(spark)
    model = C.Cadence().fit(frame)
    fallback, marginal = plain_calibration(rows, TEST)
    assert model.getOrDefault("fallback") == pytest.approx(fallback)
    assert model.getOrDefault("marginal") == pytest.approx(marginal) and sum(marginal) == pytest.approx(1)


def test_calibration_is_saved_and_loaded(spark, tmp_path):
    model = C.Cadence(blend=0.25).fit(gaps(spark)[0])
    model.save(str(tmp_path / "c"))
    again = C.CadenceModel.load(str(tmp_path / "c"))
    assert {p.name: again.getOrDefault(p) for p in again.params if again.isDefined(p)} == {
        p.name: model.getOrDefault(p) for p in model.params if model.isDefined(p)}
    with pytest.raises(Exception, match="(?i)not exist|no such|Unable"):
        C.CadenceModel.load(str(tmp_path / "never"))


def test_calibration_refuses(spark):
    frame, _ = gaps(spark, 20)
    with pytest.raises(ValueError):
        C.Cadence().fit(frame.limit(0))
    with pytest.raises(Exception, match="logarithm"):
        C.Cadence().fit(frame.withColumn("notification_delay_minutes", F.lit(0.0)))
    model = C.Cadence().fit(frame)
    with pytest.raises(Exception, match="buckets"):
        frame.select(model.decoded(F.array(F.lit(1.0)))).collect()


def decoded(model, spark, density, gap=2.0):
    row = spark.createDataFrame([(gap, density)], "gap_median_days double, probability array<double>")
    return model.transform(row).first()["decoded_delay_minutes"]


def test_decoding(spark):
    n = D.residual_count(TEST)
    flat = [1.0 / n] * n
    sure = lambda at: [1.0 if i == at else 0.0 for i in range(n)]
    own = C.CadenceModel(fallback=3.0, marginal=flat, blend=1.0)
    assert decoded(own, spark, sure(n // 2)) == pytest.approx(2.0 * 1440, rel=0.35)  # near its own offset
    assert decoded(own, spark, sure(n // 2), None) == pytest.approx(math.exp(3.0), rel=0.35)
    # Two buckets side by side outweigh one likelier bucket far away.
    split = [0.0] * n
    split[10], split[40], split[41] = 0.4, 0.3, 0.3
    centre = math.log(decoded(own, spark, split) / (2.0 * 1440))
    width = 2 * TEST.residual_span / n
    assert centre == pytest.approx(-TEST.residual_span + 41 * width, abs=2 * width)
    # A thin row is drawn to the marginal.
    peak = [0.001] * n
    peak[5] = 1 - 0.001 * (n - 1)
    drawn = C.CadenceModel(fallback=3.0, marginal=peak, blend=0.1)
    assert math.log(decoded(drawn, spark, sure(50)) / (2.0 * 1440)) == pytest.approx(-TEST.residual_span + 5.5 * width, abs=3 * width)


# ---------------------------------------------------------------------- variants


def test_the_plan_stops_at_the_first_that_does_not_fit():
    v = lambda k, n: G.Variant(k, f"v{k}", {"depth": 2}, G.HEADS[:n])
    declared = [v(3, 1), v(1, 2), v(2, 3)]
    assert [[x.name for x in part] for part in G.plan(4, declared)] == [["v1"], ["v2", "v3"]]
    assert [[x.name for x in part] for part in G.plan(6, declared)] == [["v1", "v2", "v3"], []]
    assert G.plan(0, declared)[0] == []


def test_a_variant_changes_one_setting():
    base = G.Framing()
    for variant in G.DECLARED:
        own, other = dataclasses.asdict(variant.framing(base)), dataclasses.asdict(base)
        flat = lambda d: {**{k: v for k, v in d.items() if k != "boost"}, **d["boost"]}
        changed = {k for k in flat(own) if flat(own)[k] != flat(other)[k]}
        assert changed == set(variant.change) and len(changed) == 1 and variant.fits >= 1
    with pytest.raises(ValueError):
        G.Framing(delay="weekly")


# ------------------------------------------------- the jobs notice a wrong model


@pytest.fixture(scope="module")
def work(spark):
    return Workspace(spark, SMALL)


def all_true(frame, *columns):
    return frame.filter(~F.expr(" and ".join(columns))).count() == 0


def test_jobs_hold_and_notice_wrong_answers(work):
    again = ["facility_again", "weekday_again", "hour_again", "delay_again", "cadence_delay_again"]
    assert all_true(J.predict_heads(work), *again)
    right = work.head_answers
    try:
        for column, wrong in (
            ("predicted_facility_id", F.lit(TEST.names[0])), ("predicted_usage_weekday", (F.col("predicted_usage_weekday") + 1) % 7),
            ("predicted_usage_hour", F.lit(0)), ("predicted_delay_minutes", F.col("predicted_delay_minutes") * 1.01),
            ("cadence_delay_minutes", F.col("predicted_delay_minutes")),
        ):
            work.head_answers = right.withColumn(column, wrong)
            assert not all_true(J.predict_heads(work), *again), column
        work.head_answers = right.withColumn("ranked_facility_id", F.lit(TEST.names[0]))
        assert not all_true(J.rank_facility_head(work), "answer_is_picked")
    finally:
        work.head_answers = right
    assert all_true(J.rank_facility_head(work), "picked_is_best", "answer_is_picked", "best_is_likely")


def test_search_and_importance_jobs_notice_wrong_fits(work):
    assert all_true(J.search_rounds(work), "rounds_without_gap", "chosen_is_first_best", "stopped_by_patience")
    right = dict(work.heads)
    head = right["usage_hour"]
    trees, start, borders = head.model.parts()
    shorter = B.boosted_model(trees[:-1], start, borders, len(head.classes), False) if len(trees) > 1 else B.boosted_model(trees * 2, start, borders, len(head.classes), False)
    try:
        work.heads = right | {"usage_hour": dataclasses.replace(head, model=shorter)}
        assert not all_true(J.search_rounds(work), "chosen_is_first_best")
        work.heads = right | {"usage_hour": dataclasses.replace(head, curve=head.curve[:2])}
        assert not all_true(J.search_rounds(work), "stopped_by_patience")
    finally:
        work.heads = right


def test_predicting_reads_no_target(work):
    table = work.features.limit(50)
    heads = {h: work.heads[h] for h in G.HEADS}
    assert not [c for c in table.columns if c.startswith("target_")]
    assert G.predict(heads, table, TEST).count() == 50
    with pytest.raises(ValueError, match="usage_hour"):
        G.predict({h: heads[h] for h in heads if h != "usage_hour"}, table, TEST)


def test_saved_heads_answer_the_same(work):
    loaded = work.saved_heads
    assert list(loaded) == list(work.heads) and loaded["facility_ranked"].name == "facility"
    assert loaded["notification"].curve == work.heads["notification"].curve and loaded["notification_cadence"].framing.delay == "cadence"
    table = work.features.limit(40)
    answers = lambda heads: sorted(map(tuple, G.submitted(heads, G.probabilities(heads, table, TEST), TEST).collect()))
    assert answers(loaded) == answers(work.heads)


def test_heads_top_three_in_the_report(work):
    rows = work.split_samples.filter("split = 'test'").select(
        "sample_id", "split", "target_facility_id", "target_usage_weekday", "target_usage_hour", "notification_delay_minutes")
    heads = {h: work.heads[h] for h in G.HEADS}
    hits = G.likely_hits(heads, work.head_scores, rows.drop("split").join(rows.select("sample_id", "split"), "sample_id"), TEST)
    got = {r["head"]: r["rate"] for r in hits.groupBy("head").agg(F.avg(F.col("hit").cast("int")).alias("rate")).collect()}
    table = {r["sample_id"]: r for r in work.head_scores.collect()}
    want, n = dict.fromkeys(G.CLASSIFIERS, 0), 0
    for r in rows.collect():
        n += 1
        labels = (TEST.names.index(r["target_facility_id"]), r["target_usage_weekday"], r["target_usage_hour"])
        for head, y in zip(G.CLASSIFIERS, labels, strict=True):
            p = table[r["sample_id"]][f"p_{head}"]
            want[head] += y in sorted(range(len(p)), key=lambda i: (-p[i], i))[:3]
    assert got == pytest.approx({h: c / n for h, c in want.items()})
    scored = S.score(work.head_answers.join(rows, "sample_id").withColumns({"track": F.lit("ml"), "model": F.lit("boosted")}), TEST)
    likely = hits.select("split", "head", "hit").withColumns({"track": F.lit("ml"), "model": F.lit("boosted")})
    report = {r["metric"]: r["value"] for r in S.evaluation_report(scored, TEST, likely=likely).collect()}
    assert {h: report[f"{h}_top_3_accuracy"] for h in G.CLASSIFIERS} == pytest.approx(got)
    assert 0 <= report["overall"] <= 1


def test_answers_are_computed_again_inside_the_rows(spark):
    rows = spark.createDataFrame([("a", [0.2, 0.4, 0.4]), ("b", [0.5, 0.2, 0.3])], "sample_id string, p_x array<double>").localCheckpoint()
    again = J.likeliest(rows, "x", ("q", "r", "s"))
    assert sorted(map(tuple, again.collect())) == [("a", "r"), ("b", "q")]
    grid = D.make_grid([0.0, 1.0, 2.0], [1.0, 2.0, 3.0], 7, TEST)
    density = rows.select("sample_id", F.col("p_x").alias("p"))
    centre = J.fullest_window(density, grid)
    same = centre.join(density.select("sample_id", D.window_decode(F.col("p"), grid).alias("other")), "sample_id")
    assert same.filter("centre = other").count() == 2
    for frame in (again, centre):
        assert "Exchange hashpartitioning" not in frame._jdf.queryExecution().executedPlan().toString()


def test_staged_probabilities_are_not_broadcast(spark):
    rows = spark.createDataFrame([("a", [0.2, 0.4, 0.4]), ("b", [0.5, 0.2, 0.3])], "sample_id string, p_x array<double>")
    long = rows.select("sample_id", F.lit("x").alias("head"), F.posexplode("p_x").alias("position", "probability")).withColumn("class", F.lit("c"))
    told = J.loaded_beside_staged(long, rows, ("x",))
    assert "SortMergeJoin" in told._jdf.queryExecution().sparkPlan().toString()
    assert all(r["same_when_loaded"] for r in told.collect())
    swapped = rows.withColumn("p_x", F.reverse("p_x"))
    assert not any(r["same_when_loaded"] for r in J.loaded_beside_staged(long, swapped, ("x",)).collect())


def test_histogram_of_many_rows_is_exact():
    rng = np.random.default_rng(3)
    n = 2 * B.STRETCH + 7
    block = B.Block(rng.integers(0, 4, (n, 2)).astype(np.uint8), np.zeros(n, np.int32), rng.random(n) < 0.1, 1)
    sums, _ = B.histogram(block, [], np.zeros(2), ((), ()), [1, 0], 4)
    g = B.gradients(np.full((n, 2), 0.5), block.labels, block.held).transpose(1, 0, 2).reshape(n, 4)
    for at, feature in enumerate((1, 0)):
        for cell in range(4):
            assert (sums[at, 0, cell] == g[block.bins[:, feature] == cell].sum(axis=0)).all()


def drifting(spark):
    """A label told by the last of many features; the others tell the time, and with it a commonest label that later rows do not keep."""
    rng = random.Random(8)
    rows = []
    for i in range(2000):
        late, own = i >= 1700, rng.randrange(4)
        y = own if rng.random() < 0.4 else (0 if late else 1 + i * 3 // 1700)
        rows.append((i, [i + rng.gauss(0, 30) for _ in range(19)] + [float(own)], y, late))
    return spark.createDataFrame(rows, "i int, x array<double>, y int, late boolean")


def test_the_first_tree_sees_every_feature(spark):
    rows = drifting(spark)
    borders = [list(map(float, range(50, 2000, 60)))[:31]] * 19 + [[1.0, 2.0, 3.0]]
    matrix = B.Matrix(rows, F.col("x"), {"y": F.col("y")}, F.col("late"), borders)
    size = B.Boost(rounds=3, share=0.1)
    assert matrix.counts("y", 4).tolist() == [rows.filter(f"y = {k} and not late").count() for k in range(4)]
    trees, start, curve = B.boost(matrix, "y", 4, size, curve=True)
    assert start == pytest.approx(np.log((matrix.counts("y", 4) + 1) / (matrix.counts("y", 4).sum() + 4)).tolist())
    assert [r.rounds for r in curve] == [0, 1, 2, 3] and {r.rows for r in curve} == {300}
    other = {b.features for b in (B.boost(matrix, "y", 4, dataclasses.replace(size, rounds=1, seed=s))[0][0] for s in range(4))}
    assert len(other) == 1  # no draw decides the first tree


def test_no_tree_is_a_choice_of_the_search():
    told = [B.Round(i, 10, hits, 0.0) for i, hits in enumerate([5, 3, 5, 4])]
    assert B.best_round(told) == 0 and B.stopped(told, 3)
    assert B.best_round([B.Round(i, 0, 0, 0.0) for i in range(3)]) == 1
