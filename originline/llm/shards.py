"""Sharding by sampled splitters: size-weighted samples, quantile bounds, range partition.

A row's place is a 64-bit number: 32 bits of a hash of its text, then 32 bits of a
hash of its id. Equal texts are therefore neighbours, and a group of copies too
large for one range can still be cut, by id. Samples weighted by size give the
splitters of many small ranges; the exact size of every range decides which
contiguous ranges form a shard; a range that came out overfull is sampled again
and subdivided first, until none is or only a single place is left in it. Where rows
equal in text and id overfill a place, the rows are numbered and placed by number too.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from originline.llm.common import extended, free_name, prepare
from originline.session import stage

PER_RANGE = 16  # samples to a range
HIGH = np.int64(-(1 << 32))  # mask of the text's half of a place


def sizes_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def place_of(number: str | None = None) -> Column:
    """Text hash (high half) and hash of id and row number, if there is one (low half); a null text counts as empty."""
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    own = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col(f"`{number}`") if number else F.lit(1))
    return F.shiftleft(F.shiftright(text, 32), 32).bitwiseOR(F.shiftrightunsigned(own, 32))


def _sample(rows: DataFrame, n: int, total: float, mean: float, round_: int) -> np.ndarray:
    """About ``n`` places, drawn with a chance proportional to size plus the mean size.

    The mean is added so that very many tiny rows also get splitters.
    """
    chance = (F.col("size") + F.lit(mean)) * F.lit(n / max(total, 1.0))
    # A row heavier than one sample's share is drawn as often as its chance says.
    seeded = F.pmod(F.xxhash64("place", "size", F.lit(round_)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = (F.floor(chance) + (seeded < chance - F.floor(chance)).cast("int")).cast("int")
    drawn = rows.select("place", times.alias("n")).where("n > 0").toArrow()
    return np.sort(np.repeat(drawn["place"].to_numpy(), drawn["n"].to_numpy()))


def splitters(sample: np.ndarray, hot: int = 2) -> np.ndarray:
    """Every 16th sample as a bound, moved down to the start of its text.

    A text that holds ``hot`` bounds or more is larger than a range; only such a
    text keeps the bounds inside it.
    """
    bounds = sample[PER_RANGE // 2 :: PER_RANGE]
    starts = bounds & HIGH
    keys, counts = np.unique(starts, return_counts=True)
    inside = np.isin(starts, keys[counts >= hot])
    return np.unique(np.concatenate([starts, bounds[inside], (keys[counts >= hot] + (1 << 32))]))


def range_of(bounds: np.ndarray, spark) -> Column:
    """Number of bounds at or below a place."""
    shared = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def find(place):
        import pandas as pd

        return pd.Series(np.searchsorted(shared.value, place.to_numpy(np.int64), side="right").astype(np.int32))

    return find(F.col("place"))


def cut_points(bounds: np.ndarray, whole: int) -> np.ndarray:
    """Which bounds may end a shard: those between texts, and those inside a text of ``whole`` bounds or more."""
    starts = bounds & HIGH
    keys, counts = np.unique(starts, return_counts=True)
    return (bounds == starts) | np.isin(starts, keys[counts >= whole])


def shard_ranges(
    sizes: np.ndarray, rows: np.ndarray, free: np.ndarray, shards: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Shard of every range, and the number of rows of its shard before it.

    A shard ends at the free bound nearest to its share of all bytes.
    """
    ends = np.concatenate([[0], np.cumsum(sizes)])
    marks = ends[-1] * np.arange(1, shards) / shards
    at = np.concatenate([[0], np.flatnonzero(free) + 1, [len(sizes)]])
    edges = ends[at]
    right = np.clip(np.searchsorted(edges, marks), 1, len(edges) - 1)
    cut = at[np.where(marks - edges[right - 1] <= edges[right] - marks, right - 1, right)]
    shard = np.searchsorted(cut, np.arange(len(sizes)), side="right").astype(np.int32)
    before = np.cumsum(rows) - rows
    first = np.zeros(shards, np.int64)
    seen, begin = np.unique(shard, return_index=True)
    first[seen] = before[begin]
    return shard, before - first[shard]


def assign_shards(
    docs: DataFrame, shards: int = 40, per_shard: int = 128, range_bytes: int = 256 << 20, number: str | None = None,
) -> DataFrame:
    """Every row of ``docs``, all its columns, with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``.

    Law ``bytes``: shards 0 to ``shards`` - 1 have nearly equal sizes (UTF-8 bytes
    plus 16). Equal texts stay together unless they fill a
    quarter of a shard. A shard has ``per_shard`` ranges or more. ``slot`` counts the rows of a
    shard from 0. ``grown_shard`` is null under this law. A null text has size 16
    and the checksum of an empty one; a null doc_id counts as an empty one; repeated
    rows each get a slot, and a group of them beyond a range is cut by row number (a
    numbered copy of the table is written then); an empty table gives an empty result; a
    column with a name of the result is replaced. ``number`` names a column that numbers
    the rows, if there is one; it is not returned.
    """
    spark = prepare(docs.sparkSession)
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    kept = [c for c in docs.columns if c not in made and c != number]
    text = F.col("text").cast("string")
    place, in_range, before_it = (free_name(kept, c) for c in ("place", "range", "before"))
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], sizes_of(text).alias("size"), place_of(number).alias(place))
    narrow = stage(rows.select("size", F.col(place).alias("place")), "places")
    n, total = narrow.agg(F.count("*"), F.sum("size")).first()
    total = float(total or 0)
    mean = total / max(n, 1)
    ranges = max(shards * per_shard, int(total / range_bytes))
    bounds = splitters(_sample(narrow, ranges * PER_RANGE, 2 * total, mean, 0))
    for again in itertools.count(1):
        found = narrow.withColumn("range", range_of(bounds, spark)).groupBy("range").agg(
            F.sum("size").alias("size"), F.count("*").alias("rows"), F.min("place").alias("low"), F.max("place").alias("high"))
        sizes, counts = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
        over, repeated = {}, False
        for r in found.toLocalIterator():
            sizes[r["range"]], counts[r["range"]] = r["size"], r["rows"]
            if r["rows"] > 1 and r["size"] + r["rows"] * mean > 8 * total / ranges:
                repeated |= r["low"] == r["high"]
                if r["low"] < r["high"]:
                    over[r["range"]] = (r["low"], r["high"])
        if repeated and number is None:
            numbered = docs.select(*[F.col(f"`{c}`") for c in kept], F.monotonically_increasing_id().alias(place))
            return assign_shards(stage(numbered, "numbered"), shards, per_shard, range_bytes, place)
        if not over:
            break
        crowded = narrow.withColumn("range", range_of(bounds, spark)).where(F.col("range").isin(list(over)))
        heavy = float(sizes[list(over)].sum() + counts[list(over)].sum() * mean)
        more = _sample(crowded, max(PER_RANGE, int(heavy / (2 * total) * ranges * PER_RANGE)) * 4, heavy, mean, again)
        more = splitters(more)
        # A range that no new bound meets is halved, so that every round cuts it.
        low, high = np.array(list(over.values()), np.int64).T
        missed = np.searchsorted(more, low, side="right") == np.searchsorted(more, high, side="right")
        halves = (low >> 1) + (high >> 1) + (low & high & 1) + 1
        halves = np.where(halves & HIGH > low, halves & HIGH, halves)  # between texts if there are two
        bounds = np.unique(np.concatenate([bounds, more, halves[missed]]))
    shard, before = shard_ranges(sizes, counts, cut_points(bounds, per_shard // 4), shards)
    shared = spark.sparkContext.broadcast((bounds, shard, before))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, shard, before = shared.value
        for batch in batches:
            at = np.searchsorted(bounds, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False), side="right")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(at.astype(np.int32)), pa.array(shard[at]), pa.array(before[at])],
                [*batch.schema.names, in_range, "shard", before_it])

    dealt = rows.mapInArrow(deal, extended(rows, f"`{in_range}` int, shard int, `{before_it}` long"))
    within = F.row_number().over(Window.partitionBy(in_range).orderBy(place, *[c for c in ("doc_id",) if c in kept]))
    return dealt.select(
        *[F.col(f"`{c}`") for c in kept], "size",
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", (F.col(before_it) + within - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
