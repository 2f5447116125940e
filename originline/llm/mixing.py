"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from originline.functions.ordered import BLOCK, range_blocks
from originline.llm.common import n_words, prepare
from originline.session import stage

BINS = 4096


def bin_of(seed: int) -> F.Column:
    """The seeded bin (0 to 4095) of a row: the first three hex digits of an MD5 of its id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 3), 16, 10).cast("int")


def ranked_sources(sizes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """A row per source with its rank by code point (null last) and its weight.

    ``sizes`` has ``source`` and ``source_size``. The rank is a count inside a
    range block plus the rows of the blocks before it, so it needs no single task.
    """
    blocks = range_blocks(sizes.withColumn("_last", F.col("source").isNull()), ["_last", "source"])
    counts = blocks.groupBy(BLOCK).agg(F.count("*").alias("_n"))
    before = counts.withColumn(
        "_before", F.sum("_n").over(Window.orderBy(BLOCK)) - F.col("_n")).drop("_n")
    within = F.row_number().over(Window.partitionBy(BLOCK).orderBy("_last", "source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rank = blocks.withColumn("_within", within).join(F.broadcast(before), BLOCK)
    return rank.select(
        "source", "source_size",
        F.element_at(cycle, ((F.col("_within") + F.col("_before") - 1) % len(weights) + 1).cast("int")).alias("weight"))


def water_fill(sources: DataFrame, epochs: float) -> DataFrame:
    """``target`` of every source: its weight's share of all sizes, clamped at ``epochs`` sizes.

    What a clamp cuts off is shared out again by weight among the sources that are
    not clamped, round by round, until none is above its clamp. A round sends
    three sums to the driver; the sources stay distributed.
    """
    cap = F.col("source_size") * F.lit(float(epochs))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = None, F.lit(False)
    while True:
        row = sources.agg(
            F.sum(F.when(full, cap).otherwise(0.0)).alias("held"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if not row["free"]:
            break
        level = (total - row["held"]) / row["free"]
        above = full | (F.col("weight") * F.lit(level) > cap)
        if sources.where(above).count() == row["n"]:
            break
        full = above
    share = cap if level is None else F.when(full, cap).otherwise(F.col("weight") * F.lit(level))
    return sources.withColumn("target", share.cast("double"))


def mixing_plan(
    sized: DataFrame, weights: Sequence[float] = (5, 2, 1), epochs: float = 3.0, seed: int = 17,
) -> DataFrame:
    """A row per source: ``source_size``, ``target``, whole repetitions ``whole`` and bin limit ``cut``.

    ``sized`` has ``doc_id``, ``source``, ``size``. A row is taken ``whole`` times,
    and once more if its seeded bin is below ``cut``; ``cut`` is the limit whose
    bins' sizes come nearest to the fraction of the target that is left.
    """
    bins = stage(
        sized.groupBy("source", bin_of(seed).alias("bin")).agg(F.sum("size").alias("bin_size")), "bins")
    sizes = bins.groupBy("source").agg(F.sum("bin_size").alias("source_size"))
    filled = stage(water_fill(stage(ranked_sources(sizes, weights), "sources"), epochs), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    filled = filled.withColumn("whole", F.floor(ratio).cast("int"))
    filled = filled.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    # A source has at most 4096 bins, so a window over them is bounded.
    upto = Window.partitionBy("source").orderBy("bin")
    runs = bins.withColumn("upto", F.sum("bin_size").over(upto)).join(
        filled.select(F.col("source").alias("_source"), "need"), F.col("source").eqNullSafe(F.col("_source")))
    near = runs.groupBy("_source").agg(
        F.min(F.struct(F.abs(F.col("upto") - F.col("need")).alias("gap"), (F.col("bin") + 1).alias("cut"))).alias("best"),
        F.first("need").alias("need"))
    cut = F.when(F.col("best.gap") < F.col("need"), F.col("best.cut")).otherwise(0)
    cuts = near.select("_source", cut.cast("int").alias("cut"))
    plan = filled.join(cuts, F.col("source").eqNullSafe(F.col("_source")), "left")
    return plan.select("source", "source_size", "target", "weight", "whole", F.coalesce("cut", F.lit(0)).alias("cut"))


#: Up to this many sources the plan is sent to all workers; beyond it, it is joined by shuffle.
SENT_SOURCES = 100_000


def with_copies(rows: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """Rows with their source's row of ``plan`` as ``_plan`` and ``_copies``, how often the mix takes them."""
    plan = stage(plan, "plan")
    small = plan.count() <= SENT_SOURCES
    side = plan.select(F.col("source").alias("_source"), F.struct("*").alias("_plan"))
    joined = rows.join(
        F.broadcast(side) if small else side,
        F.col("source").cast("string").eqNullSafe(F.col("_source")), "inner").drop("_source")
    return joined.withColumn("_copies", F.col("_plan.whole") + (bin_of(seed) < F.col("_plan.cut")).cast("int"))


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), epochs: float = 3.0, seed: int = 17,
) -> DataFrame:
    """``doc_id``, ``size`` (words), ``source_size``, ``target`` and ``taken`` words of every row.

    A null text has size 0; a null source is a source of its own, last in order;
    rows that share a doc_id share their draw; an empty table gives an empty
    result; other columns are ignored. The same rows give the same mix.
    """
    prepare(docs.sparkSession)
    sized = stage(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size")), "sizes")
    rows = with_copies(sized, mixing_plan(sized, weights, epochs, seed), seed)
    return rows.select(
        "doc_id", "size", "_plan.source_size", "_plan.target",
        (F.col("size") * F.col("_copies")).cast("long").alias("taken"), F.col("_copies").alias("copies"))


def mixed_rows(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), epochs: float = 3.0, seed: int = 17,
) -> DataFrame:
    """The mix itself: every row of ``docs``, all its columns, as often as the mix takes it."""
    prepare(docs.sparkSession)
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    packed = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"))
    rows = with_copies(packed, mixing_plan(sized, weights, epochs, seed), seed).where("_copies > 0")
    return rows.select("_all", F.explode(F.expr("sequence(1, _copies)"))).select("_all.*")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 3) AS INTEGER) AS bin
  FROM documents),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
              WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sizes),
filling AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         row_number() OVER o AS k,
         coalesce(sum(3.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
         (SELECT sum(source_size) FROM ranked)::DOUBLE AS total
  FROM ranked WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST)),
level AS (
  SELECT k, (total - held) / free AS height FROM filling
  WHERE weight * ((total - held) / free) <= cap ORDER BY k LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN level.k IS NULL OR filling.k < level.k THEN cap ELSE weight * height END AS target
  FROM filling LEFT JOIN level ON true),
plans AS (
  SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS INTEGER) AS whole,
         target - floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) * source_size AS need
  FROM targets),
upto AS (
  SELECT source, bin, sum(sum(size)) OVER (PARTITION BY source ORDER BY bin) AS upto
  FROM sized GROUP BY source, bin),
cuts AS (
  SELECT u.source, arg_min(CASE WHEN abs(upto - need) < need THEN bin + 1 ELSE 0 END, (abs(upto - need), bin)) AS cut
  FROM upto u JOIN plans p ON u.source IS NOT DISTINCT FROM p.source GROUP BY u.source)
SELECT s.doc_id, CAST(s.size AS BIGINT) AS size, p.source_size, p.target,
       CAST(s.size * (whole + CASE WHEN s.bin < c.cut THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(whole + CASE WHEN s.bin < c.cut THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM sized s JOIN plans p ON s.source IS NOT DISTINCT FROM p.source
JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source
"""
