"""Chronological splits, seeded draws and stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from originline.functions.ordered import global_rank
from originline.functions.scalar import attach, draw_key, instant
from originline.params import SPLITS, Params


def cutoffs(samples: DataFrame, p: Params, embargo_days: int = 0) -> DataFrame:
    """Start, end and the two cuts, as fractions of elapsed target time."""
    if embargo_days:
        raise ValueError("only a zero embargo is supported")
    ends = samples.agg(F.min("target_us").alias("start_us"), F.max("target_us").alias("end_us"))
    span = F.col("end_us") - F.col("start_us")

    def cut(frac: float) -> Column:
        return F.col("start_us") + F.floor(span * F.lit(round(frac, 9))).cast("long")

    checked = F.when(F.col("start_us").isNotNull(), cut(p.train_frac)).otherwise(
        F.raise_error(F.lit("cannot split an empty sample table")).cast("long")
    )
    return ends.select(
        "start_us", "end_us", checked.alias("train_cut_us"),
        cut(p.train_frac + p.val_frac).alias("validation_cut_us"),
    )


def assign_split(samples: DataFrame, cuts: DataFrame) -> DataFrame:
    return with_split(samples, cuts).select("sample_id", "split", "target_us")


def with_split(samples: DataFrame, cuts: DataFrame) -> DataFrame:
    """The samples, all their columns, and their split."""
    at = F.col("target_us")
    label = (
        F.when(at < F.col("train_cut_us"), SPLITS[0])
        .when(at < F.col("validation_cut_us"), SPLITS[1])
        .otherwise(SPLITS[2])
    )
    return attach(samples, cuts, "train_cut_us", "validation_cut_us").select(
        *samples.columns, label.alias("split")
    )


def _split_order() -> Column:
    return F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split"))


def boundary_check(splits: DataFrame) -> DataFrame:
    """Each partition ends strictly before the next begins."""
    ends = splits.groupBy("split").agg(
        F.min("target_us").alias("first_us"), F.max("target_us").alias("last_us")
    )
    # At most three rows: one per partition.
    w = Window.orderBy(_split_order())
    ahead = F.lead("first_us").over(w)
    return ends.select(
        "split", instant(F.col("last_us")).alias("last_target"),
        instant(ahead).alias("next_first_target"),
        F.coalesce(F.col("last_us") < ahead, F.lit(True)).alias("passed"),
    )


def split_shape(splits: DataFrame) -> DataFrame:
    spark = splits.sparkSession
    found = splits.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.min("target_us").alias("a"), F.max("target_us").alias("b")
    )
    names = spark.createDataFrame([(s,) for s in SPLITS], "split string")
    total = F.sum(F.coalesce("rows", F.lit(0))).over(Window.partitionBy())
    return names.join(found, "split", "left").select(
        "split", F.coalesce("rows", F.lit(0)).alias("rows"),
        F.round(F.coalesce("rows", F.lit(0)) / total, 6).alias("share"),
        instant(F.col("a")).alias("first_target"), instant(F.col("b")).alias("last_target"),
    )


def moved_rows(rebuilt: DataFrame, frozen: DataFrame) -> DataFrame:
    """Ids whose label differs, or that one side lacks."""
    a = rebuilt.select("sample_id", F.col("split").alias("rebuilt"))
    b = frozen.select("sample_id", F.col("split").alias("frozen"))
    return a.join(b, "sample_id", "full_outer").filter(
        ~F.col("rebuilt").eqNullSafe(F.col("frozen"))
    )


def membership_audit(ids: DataFrame, splits: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Unknown ids and ids of a partition a fit may not read, with counts."""
    joined = ids.join(splits.select("sample_id", "split"), "sample_id", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("audited"),
        F.count_if(F.col("split").isNull()).alias("unknown"),
        F.count_if(~F.col("split").isin(*allowed)).alias("intruders"),
    )


def tail_fold(rows: DataFrame, frac: float) -> DataFrame:
    """Mark the latest ``frac`` of the rows by target time as held out."""
    reverse = rows.withColumn("_back", -F.col("target_us"))
    ranked = global_rank(reverse, ["_back", "sample_id"], "_rank")
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    held = F.col("_rank") <= F.bround(F.col("n") * F.lit(frac))
    return attach(ranked, n).select(
        *rows.columns, F.when(held, "held_out").otherwise("fit").alias("fold")
    )


def in_tail(rows: DataFrame, frac: float) -> Column:
    """Whether a row is among those that :func:`tail_fold` holds out, told by the earliest of these alone: no join."""
    reverse = rows.select("sample_id", "target_us", (-F.col("target_us")).alias("_back"))
    held = int(rows.select(F.bround(F.count(F.lit(1)) * F.lit(frac))).first()[0])
    first = global_rank(reverse, ["_back", "sample_id"], "_rank").filter(F.col("_rank") == held).first()
    if first is None:
        return F.lit(False)
    # Of one instant, the fold takes the lesser ids first.
    at = F.col("target_us")
    return (at > first["target_us"]) | ((at == first["target_us"]) & (F.col("sample_id") <= first["sample_id"]))


def seeded_draw(ids: DataFrame, k: int, seed: int, column: str = "sample_id") -> DataFrame:
    """k ids in seeded order; fewer are returned whole. Distributed top-k."""
    return (
        ids.select(column)
        .orderBy(draw_key(seed, F.col(column)), column)
        .limit(k)
    )


def history_band(count: Column, edges: tuple[int, ...]) -> Column:
    chain = F.when(count < edges[0], f"under_{edges[0]}")
    for low, high in zip(edges, edges[1:], strict=False):
        chain = chain.when(count < high, f"{low}_to_{high - 1}")
    return chain.otherwise(f"{edges[-1]}_plus")


def stratum(p: Params) -> Column:
    return F.concat(
        F.col("target_facility_id"), F.lit(" | "),
        history_band(F.col("n_prior_bookings"), p.history_bins),
    )


def allocation(rows: DataFrame, total: int) -> DataFrame:
    """Share a draw over strata: one each, a proportional floor, then leftovers.

    The strata are facility by history band, a fixed small set.
    """
    sizes = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("size"))
    every = Window.partitionBy()
    s = sizes.select(
        "*", F.sum("size").over(every).alias("_available"),
        F.count(F.lit(1)).over(every).alias("_k"),
    )
    fits = (F.col("_available") >= total) & (F.col("_k") <= total)
    remaining = F.when(fits, F.lit(total) - F.col("_k")).otherwise(
        F.raise_error(F.lit("the strata cannot serve this draw")).cast("long")
    )
    share = F.coalesce(
        F.try_divide(
            ((F.col("size") - 1) * remaining).cast("double"),
            (F.col("_available") - F.col("_k")).cast("double"),
        ),
        F.lit(0.0),
    )
    s = s.withColumn("share", share).withColumn("_remaining", remaining)
    s = s.withColumn("_take", F.least(F.floor("share"), F.col("size") - 1))
    s = s.withColumn("_left", F.col("_remaining") - F.sum("_take").over(every))
    room = F.col("_take") + 1 < F.col("size")
    turn = F.when(
        room,
        F.row_number().over(Window.partitionBy(room).orderBy(F.desc("share"), F.desc("stratum"))),
    )
    extra = F.when(turn <= F.col("_left"), 1).otherwise(0)
    return s.select("stratum", "size", "share", (F.col("_take") + 1 + extra).alias("allocated"))


def stratified_sample(rows: DataFrame, total: int, seed: int) -> DataFrame:
    plan = allocation(rows, total).select("stratum", "allocated")
    order = Window.partitionBy("stratum").orderBy(
        draw_key(seed, F.col("sample_id")), "sample_id"
    )
    # The constant bound lets every partition keep its own top rows before the
    # shuffle, so a stratum of any size stays cheap.
    drawn = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= total)
    return drawn.join(F.broadcast(plan), "stratum").filter("_n <= allocated").select(
        "sample_id", "stratum"
    )


def label_floor_sample(rows: DataFrame, label: str, total: int, floor: int, seed: int) -> DataFrame:
    """Up to ``floor`` rows of each label first, then a uniform fill to ``total``."""
    key = draw_key(seed, F.col("sample_id"))
    order = Window.partitionBy(label).orderBy(key, "sample_id")
    first = (
        rows.select("sample_id", label)
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= floor)
        .select("sample_id", label, F.lit("floor").alias("drawn_by"))
    )
    rest = rows.select("sample_id", label).join(first.select("sample_id"), "sample_id", "left_anti")
    # The fill's size depends on what the floor took, so take the most it could
    # need and cut it by its seeded position: both are bounded by ``total``.
    fill = rest.withColumn("_key", key).orderBy("_key", "sample_id").limit(total)
    fill = fill.withColumn("_turn", F.row_number().over(Window.orderBy("_key", "sample_id")))
    taken = first.agg(F.count(F.lit(1)).alias("_taken"))
    fill = attach(fill, taken).filter(F.col("_turn") <= F.lit(total) - F.col("_taken")).select(
        "sample_id", label, F.lit("fill").alias("drawn_by")
    )
    return first.unionByName(fill)


def share_deviation(drawn: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    """Share of each label in the draw and in the training rows."""
    a = drawn.groupBy(label).agg(F.count(F.lit(1)).alias("drawn"))
    b = rows.groupBy(label).agg(F.count(F.lit(1)).alias("available"))
    every = Window.partitionBy()
    both = b.join(a, label, "full_outer").select(
        label, F.coalesce("drawn", F.lit(0)).alias("drawn"),
        F.coalesce("available", F.lit(0)).alias("available"),
    )
    shares = both.select(
        "*",
        (F.col("drawn") / F.sum("drawn").over(every)).alias("_d"),
        (F.col("available") / F.sum("available").over(every)).alias("_a"),
    )
    gap = F.abs(F.col("_d") - F.col("_a"))
    return shares.select(
        label, "drawn", "available", F.round("_d", 9).alias("drawn_share"),
        F.round("_a", 9).alias("available_share"), F.round(gap, 9).alias("deviation"),
        F.round(F.max(gap).over(every), 9).alias("largest_deviation"),
    )
