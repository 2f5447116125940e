"""Community features: what all residents did strictly before an instant.

There is no partition key here, so instants (one aggregated row each) are cut
into even time blocks and prefix sums run in two levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originline.functions.ordered import Running, range_blocks, running
from originline.functions.scalar import ratio
from originline.params import DAY_US, MINUTE_US, Params


def instants(prepared: DataFrame, p: Params) -> DataFrame:
    """One row per distinct booking instant: counts and summed leads per facility."""
    cells = []
    for f in p.facilities:
        here = F.col("facility_id") == f.name
        cells.append(F.count_if(here).alias(f"n_{f.slug}"))
        cells.append(
            F.coalesce(F.sum(F.when(here, F.col("lead_us"))), F.lit(0.0))
            .alias(f"l_{f.slug}")
        )
    return prepared.groupBy("us", "booked_weekday", "booked_band").agg(*cells)


def _so_far(blocks: DataFrame, p: Params) -> DataFrame:
    """Counts and summed leads strictly before every instant, and the newest instant in them."""
    return running(
        blocks, [], ["us"],
        {
            **{f"all_{s}": Running("sum", F.col(f"n_{s}"), True) for s in p.slugs},
            **{f"lead_{s}": Running("sum", F.col(f"l_{s}"), True) for s in p.slugs},
            "newest_us": Running("max", F.col("us"), True),
        },
        blocked=True,
    )


def community_reach(prepared: DataFrame, p: Params) -> DataFrame:
    """What the community features of an instant have read: ``us``, ``n_community``, ``newest_us``."""
    df = _so_far(range_blocks(instants(prepared, p), ["us"]), p)
    return df.select("us", _total(df, "all_", p.slugs).alias("n_community"), "newest_us")


def community_features(prepared: DataFrame, p: Params) -> DataFrame:
    """Community features of every distinct instant, keyed by ``us``."""
    slugs = p.slugs
    blocks = range_blocks(instants(prepared, p), ["us"])
    counts = {s: F.col(f"n_{s}") for s in slugs}
    df = _so_far(blocks, p)
    for tag, key in (("day", "booked_weekday"), ("band", "booked_band")):
        df = running(
            df, [key], ["us"],
            {f"{tag}_{s}": Running("sum", v, True) for s, v in counts.items()}, blocked=True,
            source=blocks,
        )
    shifted = _counts_before(blocks, p)
    df = df.join(shifted, "us")
    out = [F.col("us"), _total(df, "all_", slugs).alias("n_community"),
           F.col("newest_us")]
    for tag, name in (("all_", ""), ("day_", "origin_weekday_"), ("band_", "origin_band_")):
        total = _total(df, tag, slugs)
        for s in slugs:
            out.append(
                ratio(F.col(f"{tag}{s}"), total).alias(f"community_facility_share_{name}{s}")
            )
    for d in p.community_days:
        parts = {s: F.col(f"all_{s}") - F.col(f"b{d}_{s}") for s in slugs}
        total = sum(parts.values(), F.lit(0))
        for s in slugs:
            out.append(ratio(parts[s], total).alias(f"community_facility_share_{d}d_{s}"))
    for s in slugs:
        out.append(
            (ratio(F.col(f"lead_{s}"), F.col(f"all_{s}")) / float(MINUTE_US))
            .alias(f"community_lead_minutes_mean_{s}")
        )
    return df.select(*out)


def _total(df: DataFrame, tag: str, slugs: tuple[str, ...]):
    return sum((F.col(f"{tag}{s}") for s in slugs), F.lit(0))


def _counts_before(blocks: DataFrame, p: Params) -> DataFrame:
    """Counts strictly before (instant - window), for every window.

    Events and shifted look-ups are merged into one order, look-ups first on a
    tie, and one running sum answers them all.
    """
    slugs = p.slugs
    merged = blocks.select(
        F.col("us").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("d"),
        F.col("us").alias("src"), *(F.col(f"n_{s}") for s in slugs),
    )
    for d in p.community_days:
        merged = merged.unionByName(
            blocks.select(
                (F.col("us") - F.lit(d * DAY_US)).alias("at"), F.lit(0).alias("kind"),
                F.lit(d).alias("d"), F.col("us").alias("src"),
                *(F.lit(0).cast("long").alias(f"n_{s}") for s in slugs),
            )
        )
    found = running(
        range_blocks(merged, ["at", "kind"]), [], ["at", "kind"],
        {f"p_{s}": Running("sum", F.col(f"n_{s}"), True) for s in slugs}, blocked=True,
    ).filter("kind = 0")
    return found.groupBy(F.col("src").alias("us")).agg(
        *(
            F.max(F.when(F.col("d") == d, F.col(f"p_{s}"))).alias(f"b{d}_{s}")
            for d in p.community_days
            for s in slugs
        )
    )
