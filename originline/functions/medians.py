"""Exact running medians, for small keys in SQL and for large ones in batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from originline.functions.ordered import BLOCK, REAL, Running, range_blocks, running
from originline.session import freeze


def running_medians(
    df: DataFrame,
    key: str,
    row_id: str,
    order: str,
    columns: dict[str, str],
    blocked: bool,
    large: DataFrame | None,
) -> DataFrame:
    """Append the median of every value up to the current row, per key.

    ``columns`` maps value column to output column. Keys named in ``large`` are
    too long for the quadratic SQL window and take the batch path.
    """
    by = [key, BLOCK] if blocked else [key]
    w = (
        Window.partitionBy(*by).orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def in_window(frame: DataFrame) -> DataFrame:
        return frame.select(
            "*",
            *(F.percentile(v, F.lit(0.5)).over(w).alias(out) for v, out in columns.items()),
        )

    if large is None:
        return in_window(df)
    # This list may grow with the table, so it carries no broadcast hint.
    names = large.select(key)
    small = in_window(df.join(names, key, "left_anti"))
    rows = freeze(df.join(names, key, "left_semi"))
    result = rows
    for value, out in columns.items():
        result = result.join(_large(rows, key, row_id, order, value, out, blocked), row_id, "left")
    return small.unionByName(result.select(*small.columns))


def _large(
    rows: DataFrame, key: str, row_id: str, order: str, value: str, out: str, blocked: bool
) -> DataFrame:
    block = F.col(BLOCK) if blocked else F.lit(0)
    real = F.col(REAL) if blocked else F.lit(True)
    own = rows.filter(real).select(
        key, block.alias("b"), F.col(row_id).alias("id"), F.col(order).alias("at"),
        F.col(value).cast("double").alias("v"), F.lit(1).cast("long").alias("w"),
        F.lit(1).alias("kind"),
    )
    parts = own
    if blocked:
        parts = own.unionByName(_context(freeze(own.filter("v is not null")), key))
    found = parts.groupBy(key, "b").applyInPandas(_block_medians, "id string, m double")
    median = F.when(~F.isnan("m"), F.col("m"))
    return found.select(F.col("id").alias(row_id), median.alias(out))


def _context(own: DataFrame, key: str) -> DataFrame:
    """What a block must know of its key's earlier rows to place its medians.

    While a block of m rows is read, the median moves by at most m/2 ranks from
    where it stood, so only earlier values near that rank can ever be it. All
    others are replaced by how many lie below and above. Values are grouped by rank
    into bins of one block's size, however many blocks the key has, to find the
    neighbourhood, so a block receives a constant multiple of its own rows.
    """
    sizes = own.groupBy(key, "b").agg(F.count(F.lit(1)).alias("m"))
    along = Window.partitionBy(key).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    need = sizes.select(key, "b", "m", F.sum("m").over(along).alias("p")).filter("p > 0")
    weighted = freeze(own.groupBy(key, "b", "v").agg(F.sum("w").alias("w")))
    hist = weighted.groupBy(key, "v").agg(F.sum("w").alias("n"))
    ranked = running(
        range_blocks(hist, [key, "v"]), [key], ["v"], {"upto": Running("sum", F.col("n"))}, blocked=True)
    most = sizes.groupBy(key).agg(F.max("m").alias("most"))
    bins = ranked.join(most, key).select(key, "v", F.floor((F.col("upto") - 1) / F.col("most")).cast("int").alias("bin"))
    last = freeze(bins.groupBy(key).agg(F.max("bin").alias("last")))
    binned = weighted.join(bins, [key, "v"]).select(key, "b", "bin", "v", "w")
    binned = freeze(binned)
    cells = binned.groupBy(key, "b", "bin").agg(F.sum("w").alias("c"))
    # Earlier rows per (block, bin): each block meets every bin once, a grid of
    # about as many bins as blocks.
    met = need.join(last, key).withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")
    prior = (
        met.join(cells.withColumnRenamed("c", "own_c"), [key, "b", "bin"], "left")
        .select(key, "b", "bin", "m", "p", F.coalesce("own_c", F.lit(0)).alias("own_c"))
    )
    first = (
        cells.join(need.select(key, "b").distinct(), [key, "b"], "left_anti")
        .select(key, "b", "bin", F.lit(None).cast("long").alias("m"),
                F.lit(None).cast("long").alias("p"), F.col("c").alias("own_c"))
    )
    per_bin = Window.partitionBy(key, "bin").orderBy("b").rowsBetween(
        Window.unboundedPreceding, -1
    )
    counts = (
        prior.unionByName(first)
        .withColumn("c", F.coalesce(F.sum("own_c").over(per_bin), F.lit(0)))
        .filter("p is not null")
    )
    up = Window.partitionBy(key, "b").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("c").over(up))
    # Ranks among earlier values that can become the median inside the block.
    low = F.greatest(F.floor((F.col("p") + 1) / 2) - F.col("m") - 1, F.lit(1))
    high = F.least(F.ceil((F.col("p") + F.col("m")) / 2) + 2, F.col("p"))
    inside = (F.col("upto") >= low) & (F.col("upto") - F.col("c") < high) & (F.col("c") > 0)
    wanted = freeze(
        counts.select(key, "b", "bin", "c", "p", "upto", inside.alias("inside"))
    )
    span = wanted.filter("inside").groupBy(key, "b").agg(
        F.min(F.col("upto") - F.col("c")).alias("below"), F.max("upto").alias("through"),
        F.max("p").alias("p"),
    )
    near = (
        wanted.filter("inside").select(key, F.col("b").alias("to"), "bin")
        .join(binned, [key, "bin"])
        .filter("b < to")
        .groupBy(key, F.col("to").alias("b"), "v")
        .agg(F.sum("w").alias("w"))
    )
    shape = [F.lit(None).cast("string").alias("id"), F.lit(None).cast("long").alias("at")]
    low_end = span.select(
        key, "b", *shape, F.lit(float("-inf")).alias("v"), F.col("below").alias("w"),
        F.lit(0).alias("kind"),
    )
    high_end = span.select(
        key, "b", *shape, F.lit(float("inf")).alias("v"),
        (F.col("p") - F.col("through")).alias("w"), F.lit(0).alias("kind"),
    )
    middle = near.select(key, "b", *shape, "v", "w", F.lit(0).alias("kind"))
    return middle.unionByName(low_end).unionByName(high_end).filter("w > 0")


def order_statistics(ranks: np.ndarray, weights: np.ndarray, ends: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The rank at which the first ``ends[i]`` items reach a weight of ``wanted[i]``, for all i at once.

    A wavelet matrix: the items are split by the bits of their ranks, the highest
    first, each time keeping their order, so the items of a prefix that share the
    higher bits stay one stretch. A step tells for every i how much weight of its
    stretch has a 0 next, and follows the 0s or the 1s. As many steps as a rank has
    bits, each a few operations on whole arrays.
    """
    low, high, wanted = np.zeros(len(ends), np.int64), ends.astype(np.int64), wanted.astype(np.int64)
    found = np.zeros(len(ends), np.int64)
    for bit in reversed(range(max(1, int(ranks.max(initial=0)).bit_length()))):
        zero = (ranks >> bit) & 1 == 0
        count = np.concatenate([[0], np.cumsum(zero)])
        weight = np.concatenate([[0], np.cumsum(np.where(zero, weights, 0))])
        inside = weight[high] - weight[low]
        ones = wanted > inside
        to_zero, to_one = (count[low], count[high]), (count[-1] + low - count[low], count[-1] + high - count[high])
        low, high = (np.where(ones, one, null) for one, null in zip(to_one, to_zero, strict=True))
        wanted = np.where(ones, wanted - inside, wanted)
        found |= ones.astype(np.int64) << bit
        order = np.concatenate([np.flatnonzero(zero), np.flatnonzero(~zero)])
        ranks, weights = ranks[order], weights[order]
    return found


def _block_medians(pdf: pd.DataFrame) -> pd.DataFrame:
    """Median after each row of one block: of the context, which lies before all rows, and the rows so far.

    Memory is a few arrays of the block's and its context's length.
    """
    rows = pdf[pdf["kind"] == 1].sort_values("at", kind="stable")
    valued = rows["v"].notna().to_numpy()
    context = pdf[pdf["kind"] == 0]
    values = np.concatenate([context["v"].to_numpy(float), rows["v"].to_numpy(float)[valued]])
    weights = np.concatenate([context["w"].to_numpy(np.int64), np.ones(int(valued.sum()), np.int64)])
    out = np.full(len(rows), np.nan)
    distinct, ranks = np.unique(values, return_inverse=True)
    ends = len(context) + np.cumsum(valued)
    total = np.concatenate([[0], np.cumsum(weights)])[ends]
    some = np.flatnonzero(total > 0)
    if len(some):
        lower = order_statistics(ranks, weights, ends[some], (total[some] + 1) // 2)
        upper = order_statistics(ranks, weights, ends[some], total[some] // 2 + 1)
        out[some] = (distinct[lower] + distinct[upper]) / 2.0
    return pd.DataFrame({"id": rows["id"].to_numpy(), "m": out})
