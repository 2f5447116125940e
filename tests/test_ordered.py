"""The parallel rank, quantile and running primitives against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from originline.functions import medians as M
from originline.functions.ordered import Running, exact_quantiles, global_rank, range_blocks, running


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [
        (i, "hot" if rng.random() < 0.7 else f"k{rng.randrange(4)}", rng.choice([1, 2, 2, 5, 9, i]))
        for i in range(500)
    ]
    return data, spark.createDataFrame(data, "id long, k string, v long").repartition(5)


def test_global_rank_is_dense_and_total(rows):
    data, df = rows
    got = {r["id"]: r["rank"] for r in global_rank(df, ["v", "id"], "rank").collect()}
    want = {x[0]: i + 1 for i, x in enumerate(sorted(data, key=lambda x: (x[2], x[0])))}
    assert got == want


def test_quantiles_equal_numpy(rows):
    data, df = rows
    got = {r["k"]: r for r in exact_quantiles(
        df, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.9}).collect()}
    for k in {x[1] for x in data}:
        mine = [x[2] for x in data if x[1] == k]
        assert got[k]["n"] == len(mine)
        for name, q in (("a", 5), ("b", 50), ("c", 90)):
            assert got[k][name] == pytest.approx(np.percentile(mine, q))


def test_running_over_blocks_equals_cumulative(rows):
    data, df = rows
    blocks = range_blocks(df, ["k", "v", "id"])
    got = {r["id"]: r for r in running(
        blocks, ["k"], ["v", "id"],
        {
            "s": Running("sum", F.col("v")), "b": Running("sum", F.col("v"), True),
            "m": Running("max", F.col("id")), "lo": Running("min", F.col("id")),
            "sd": Running("std", F.col("v")),
        },
        blocked=True,
    ).collect()}
    for k in {x[1] for x in data}:
        mine = sorted((x for x in data if x[1] == k), key=lambda x: (x[2], x[0]))
        for i, x in enumerate(mine):
            seen = mine[: i + 1]
            r = got[x[0]]
            assert r["s"] == sum(y[2] for y in seen)
            assert r["b"] == sum(y[2] for y in seen[:-1])
            assert r["m"] == max(y[0] for y in seen) and r["lo"] == min(y[0] for y in seen)
            if i:
                assert r["sd"] == pytest.approx(np.std([y[2] for y in seen], ddof=1), abs=1e-6)
            else:
                assert r["sd"] is None


def test_order_statistics_of_all_prefixes():
    rng = np.random.default_rng(4)
    for n, top in ((1, 1), (7, 3), (300, 40), (500, 10_000)):
        ranks, weights = rng.integers(0, top, n), rng.integers(1, 4, n)
        ends = np.arange(1, n + 1)
        wanted = 1 + (rng.random(n) * np.cumsum(weights)).astype(int).clip(max=np.cumsum(weights) - 1)
        got = M.order_statistics(ranks, weights, ends, wanted)
        for end, k, rank in zip(ends, wanted, got, strict=True):
            spread = np.sort(np.repeat(ranks[:end], weights[:end]))
            assert spread[k - 1] == rank


def test_block_medians_by_plain_loops():
    rng = np.random.default_rng(6)
    context = [(None, None, v, int(w), 0) for v, w in ((-np.inf, 5), (1.0, 2), (2.0, 1), (2.5, 3), (np.inf, 6))]
    rows = [(f"r{i}", i, None if rng.random() < 0.2 else float(rng.choice([1.0, 1.5, 2.0, 2.25, 3.0])), 1, 1) for i in range(40)]
    for parts in (rows, context + rows):
        frame = pd.DataFrame(parts, columns=["id", "at", "v", "w", "kind"]).sample(frac=1, random_state=1)
        got = M._block_medians(frame).set_index("id")["m"]
        seen = [v for _, _, v, w, kind in parts if kind == 0 for _ in range(w)]
        for name, _, v, _, _ in rows:
            seen += [] if v is None else [v]
            want = np.median(seen) if seen else np.nan
            assert got[name] == want or (np.isnan(got[name]) and np.isnan(want)), name
