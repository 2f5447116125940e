"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originline.session import stage_once, unstage

#: A table of up to ``SMALL`` links goes in tasks of ``TASK_ROWS``, and its least nodes to all executors (16 bytes each).
TASK_ROWS, SMALL = 2_000, 40_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _few(df: DataFrame, rows: int) -> DataFrame:
    """A table of at most ``rows`` rows without hundreds of nearly empty tasks and files, if small."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS))) if rows <= SMALL else df


def _least(edges: DataFrame, rows: int) -> DataFrame:
    """``x`` and ``m``, the least neighbour of every node that is a ``u``."""
    least = _few(edges.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")), rows)
    return F.broadcast(least) if rows <= SMALL else least


def _large(edges: DataFrame, rows: int) -> DataFrame:
    """Larger neighbours of every node are tied to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, rows).select("x", F.least("x", "m").alias("m"))
    tied = both.join(least, F.col("u") == F.col("x")).where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _few(tied.distinct(), rows)


def _small(edges: DataFrame, rows: int) -> DataFrame:
    """Smaller neighbours of every node, and itself, are tied to the least of them."""
    least = _least(edges, rows)
    rest = edges.join(least, F.col("u") == F.col("x")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _few(rest.unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct(), rows)


def components(links: DataFrame, a: str, b: str, rounds: int = 60, known: DataFrame | None = None) -> DataFrame:
    """``node`` and ``component`` (its least node) of every node that has a link, staged.

    ``known`` has the result for earlier links, which are then left out of ``links``:
    what is new ties components, not their members.

    Takes a number of rounds that grows with the logarithm of the longest path. A
    round is two joins on a node with a table of one row per node, so a hub's
    links can be split; its result is written to the shared folder. Rounds on few links
    take few tasks.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    if known is not None:
        for end in ("a", "b"):
            of = known.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
            pairs = pairs.join(of, F.col(end) == F.col("_node"), "left").withColumn(end, F.coalesce("_component", end)).select("a", "b")
    edges = stage_once(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    before = _state(edges)
    for _ in range(rounds):
        if before[0] == 0:
            break
        # A node of a link is its u or v, and a star has no more links than what it is made of.
        last, edges = edges, stage_once(_small(_large(edges, before[0]), before[0]), "stars")
        unstage(last)
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    heads = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)
    if known is not None:
        moved = edges.select(F.col("u").alias("component"), F.col("v").alias("_to"))
        kept = known.join(moved, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
        found = kept.unionByName(found.join(known.select("node"), "node", "left_anti"))
    found = stage_once(found, "components")
    unstage(edges)
    return found
