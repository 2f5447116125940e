"""Small column expressions shared across the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from originline.params import Band


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of an instant."""
    return F.unix_micros(ts.cast("timestamp"))


def instant(us: Column) -> Column:
    """The zone-free UTC timestamp of a microsecond count."""
    return F.timestamp_micros(us).cast("timestamp_ntz")


def weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def time_band(hour: Column, bands: Sequence[Band]) -> Column:
    """Name of the half-open band an hour lies in."""
    hours = [h for b in bands for h in range(b.open_hour, b.close_hour)]
    if sorted(hours) != list(range(24)):
        raise ValueError("time bands must tile the day exactly once")
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for b in bands:
        chain = chain.when((hour >= b.open_hour) & (hour < b.close_hour), b.name)
    return chain


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient as a double, null over zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def draw_key(seed: int, *ids: Column) -> Column:
    """Seeded order of rows: stable across runs, machines and partitionings."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in ids]))


def js_distance(pairs: Sequence[tuple[Column, Column]], left: Column, right: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two count vectors; 0 when one is empty."""
    divergence = F.lit(0.0)
    for a, b in pairs:
        p, q = a / left, b / right
        m = (p + q) / 2
        for x in (p, q):
            divergence = divergence + F.when(x > 0, 0.5 * x * F.log2(x / m)).otherwise(0.0)
    return F.when(
        (left > 0) & (right > 0), F.sqrt(F.greatest(divergence, F.lit(0.0)))
    ).otherwise(0.0)


def attach(df: DataFrame, one_row: DataFrame, *names: str) -> DataFrame:
    """Put the columns of a one-row frame on every row, as scalar subqueries."""
    picked = names or tuple(one_row.columns)
    if len(picked) == 1:
        return df.withColumn(picked[0], one_row.select(picked[0]).scalar())
    packed = one_row.select(F.struct(*picked).alias("_one")).scalar()
    wide = df.withColumn("_one", packed)
    return wide.select(*df.columns, *(F.col(f"_one.{n}").alias(n) for n in picked))
