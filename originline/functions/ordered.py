"""Running aggregates, ranks and exact quantiles that survive hot keys.

Spark evaluates a window one partition key at a time, so a key that holds a
third of all rows, or no key at all, would put that share of the table into one
task. Everything here avoids that in the same way: rows are range partitioned on
(key, order), which cuts a hot key into even, contiguous blocks; windows run
inside a block; and what a block needs to know of the blocks before it (its
carry) is computed from one aggregated row per block. Only the key that spans a
partition boundary has a carry, so that table never has more rows than there are
blocks (times the values of a bounded dimension) and is safe to broadcast.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from originline.session import freeze, width

BLOCK = "_block"
REAL = "_real"
ROWS_PER_BLOCK = 1_000_000


def range_blocks(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Cut a frame into even blocks that are contiguous in ``order``.

    The input is written once, so that sampling and counting do not evaluate it
    again; the number of blocks follows from its rows. The bounds are sampled, so
    the result is written out too: every later reader, and every retried task,
    sees the same block of every row.
    """
    rows = freeze(df)
    n = max(width(df.sparkSession), -(-rows.count() // ROWS_PER_BLOCK))
    return freeze(rows.repartitionByRange(n, *order).withColumn(BLOCK, F.spark_partition_id()))


@dataclasses.dataclass(frozen=True)
class Running:
    """One running aggregate: ``sum``, ``min``, ``max`` or ``std`` of a column."""

    kind: str
    value: Column
    before: bool = False  # leave the current row out


def _plain(kind: str, value: Column) -> Column:
    return {"sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp}[kind](value)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: Mapping[str, Running],
    blocked: bool,
    source: DataFrame | None = None,
) -> DataFrame:
    """Append running aggregates along ``order`` inside each key.

    ``blocked`` says whether the frame carries a block column; without one every
    key is known to fit a task and a single window does the work. ``source`` is a
    frame with the same rows to compute the carries from, where ``df`` already
    holds other results and would be evaluated again for them.
    """
    by = [*keys, BLOCK] if blocked else list(keys)
    base = Window.partitionBy(*by).orderBy(*order)
    upto = base.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prior = base.rowsBetween(Window.unboundedPreceding, -1)
    if not blocked:
        return df.select(
            "*",
            *(
                _zero(s.kind, _plain(s.kind, s.value).over(prior if s.before else upto)).alias(name)
                for name, s in specs.items()
            ),
        )

    masked = {
        name: F.when(F.col(REAL), s.value) if REAL in df.columns else s.value
        for name, s in specs.items()
    }
    totals = []
    for name, s in specs.items():
        if s.kind == "std":
            v = masked[name].cast("double")
            totals += [
                F.count(v).alias(f"_n_{name}"),
                F.sum(v).alias(f"_s_{name}"),
                (
                    F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0))
                    + F.coalesce(F.count(v) * F.avg(v) * F.avg(v), F.lit(0.0))
                ).alias(f"_q_{name}"),
            ]
        else:
            totals.append(_plain(s.kind, masked[name]).alias(f"_c_{name}"))
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    per_block = (df if source is None else source).groupBy(*by).agg(*totals)
    cols = []
    for name, s in specs.items():
        if s.kind == "std":
            cols += [F.sum(f"_{x}_{name}").over(earlier).alias(f"_{x}_{name}") for x in "nsq"]
        else:
            cols.append(_plain(s.kind, F.col(f"_c_{name}")).over(earlier).alias(f"_c_{name}"))
    spanning = F.row_number().over(Window.partitionBy(*keys).orderBy(BLOCK)).alias("_nth")
    carry = per_block.select(*by, *cols, spanning).filter("_nth > 1").drop("_nth")
    joined = _null_safe_left(df, carry, by)
    out = []
    for name, s in specs.items():
        w = prior if s.before else upto
        if s.kind == "std":
            v = masked[name].cast("double")
            n0, s0, q0 = (F.coalesce(F.col(f"_{x}_{name}"), F.lit(0.0)) for x in "nsq")
            n1 = F.count(v).over(w)
            s1 = F.coalesce(F.sum(v).over(w), F.lit(0.0))
            q1 = F.coalesce(F.var_pop(v).over(w), F.lit(0.0)) * n1 + F.when(
                n1 > 0, s1 * s1 / n1
            ).otherwise(0.0)
            n, total, square = n0 + n1, s0 + s1, q0 + q1
            value = F.when(
                n > 1, F.sqrt(F.greatest(square - total * total / n, F.lit(0.0)) / (n - 1))
            )
        else:
            here, before = _plain(s.kind, masked[name]).over(w), F.col(f"_c_{name}")
            if s.kind == "sum":
                value = F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
            else:
                value = (F.greatest if s.kind == "max" else F.least)(before, here)
        out.append(value.alias(name))
    return joined.select(*df.columns, *out)


def _zero(kind: str, value: Column) -> Column:
    return F.coalesce(value, F.lit(0)) if kind == "sum" else value


def _null_safe_left(df: DataFrame, carry: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join of the carry; its size is bounded by the number of blocks."""
    renamed = carry.select(
        *(F.col(c).alias(f"_k_{c}") for c in by), *(c for c in carry.columns if c not in by)
    )
    condition = None
    for c in by:
        term = df[c].eqNullSafe(renamed[f"_k_{c}"])
        condition = term if condition is None else condition & term
    return df.join(F.broadcast(renamed), condition, "left")


def global_rank(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Dense 1-based rank of every row along a total order, in parallel."""
    blocks = range_blocks(df, order)
    ranked = running(blocks, [], order, {name: Running("sum", F.lit(1))}, blocked=True)
    return ranked.drop(BLOCK)


def exact_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Linearly interpolated quantiles per group, exact at any group size.

    The built-in exact percentile gathers a group's values in one task. Here
    equal values are counted first, the counts are accumulated in parallel along
    the value, and the two neighbouring order statistics are picked out. Each row
    also carries ``n``, the number of non-null values of its group.
    """
    hist = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    blocks = range_blocks(hist, [*groups, "_v"])
    cum = running(blocks, groups, ["_v"], {"_upto": Running("sum", F.col("_n"))}, blocked=True)
    totals = blocks.groupBy(*groups).agg(F.sum("_n").alias("n"))
    if groups:
        ready = cum.join(totals, list(groups))
    else:
        ready = cum.withColumn("n", totals.select("n").scalar())
    picks = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("n") - 1)
        for tag, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("_upto") > index) & (F.col("_upto") - F.col("_n") <= index)
            picks.append(F.max(F.when(inside, F.col("_v"))).alias(f"_{tag}_{name}"))
    picked = ready.groupBy(*groups).agg(F.max("n").alias("n"), *picks)
    out = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return picked.select(*groups, "n", *out)


def hot_keys(
    df: DataFrame, key: str, block_rows: int, large_rows: int
) -> tuple[DataFrame | None, DataFrame | None]:
    """Keys too big for one task, and keys too big for quadratic work; None if none.

    Both limits are fixed numbers of rows whatever the table's size. Either list
    may grow with the table and is joined without a hint.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    biggest = counts.agg(F.max("_rows")).first()[0] or 0
    hot = counts.filter(F.col("_rows") > block_rows) if biggest > block_rows else None
    large = counts.filter(F.col("_rows") > large_rows) if biggest > large_rows else None
    return hot, large


def blocked_history(df: DataFrame, key: str, order: str, hot: DataFrame, back: int) -> DataFrame:
    """Split the hot keys into blocks and give each block its neighbouring rows.

    Every block receives copies of the ``back`` rows before it and of the one row
    after it, marked not real, so that bounded look-backs and look-aheads inside
    a block equal those over the whole key. Other keys stay in block 0.
    """
    names = hot.select(key)
    cold = df.join(names, key, "left_anti")
    parts = range_blocks(df.join(names, key, "left_semi"), [key, order])
    parts = parts.withColumn(BLOCK, F.col(BLOCK) + 1)
    inside = Window.partitionBy(key, BLOCK)
    edges = parts.select(
        "*",
        F.row_number().over(inside.orderBy(F.desc(order))).alias("_fromend"),
        F.row_number().over(inside.orderBy(order)).alias("_fromstart"),
    ).filter((F.col("_fromend") <= back) | (F.col("_fromstart") == 1))
    edges = freeze(edges)
    tails = edges.filter(F.col("_fromend") <= back)
    sizes = tails.groupBy(key, BLOCK).agg(F.count(F.lit(1)).alias("_tail"))
    along = Window.partitionBy(key).orderBy(BLOCK)
    chain = sizes.select(
        key,
        BLOCK,
        F.sum("_tail").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("_cum"),
        F.lag(BLOCK).over(along).alias("_prev"),
    )
    # A row is handed to the following blocks for as long as fewer than `back`
    # rows lie between it and the start of that block.
    chain = chain.select(
        "*",
        F.collect_list(F.struct(F.col(BLOCK).alias("to"), (F.col("_cum")).alias("cum")))
        .over(along.rowsBetween(0, back))
        .alias("_next"),
    )
    hops = F.transform(
        F.slice("_next", 2, back),
        lambda x, i: F.struct(x["to"].alias("to"), F.col("_next")[i]["cum"].alias("upto")),
    )
    chain = chain.withColumn("_hops", hops)
    reach = tails.join(chain.drop("_prev", "_next"), [key, BLOCK])
    index = F.col("_cum") - F.col("_fromend") + 1
    before = reach.select(
        *df.columns,
        F.explode(
            F.filter("_hops", lambda h: h["upto"] < index + back)
        ).alias("_hop"),
    ).select(*df.columns, F.col("_hop.to").alias(BLOCK))
    after = (
        edges.filter(F.col("_fromstart") == 1)
        .join(chain.select(key, BLOCK, "_prev"), [key, BLOCK])
        .filter("_prev is not null")
        .select(*df.columns, F.col("_prev").alias(BLOCK))
    )
    real, copy = F.lit(True).alias(REAL), F.lit(False).alias(REAL)
    return freeze(
        cold.select(*df.columns, F.lit(0).alias(BLOCK), real)
        .unionByName(parts.select(*df.columns, BLOCK, real))
        .unionByName(before.select(*df.columns, BLOCK, copy))
        .unionByName(after.select(*df.columns, BLOCK, copy))
    )
