"""Candidate expansion: one row per sample and facility, ranked and scored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from originline.operators.features import numeric_features, text_features
from originline.params import Params

RANKED = ("facility_share", "ewma_facility_share", "transition_share_from_last")
CANDIDATE = "candidate_facility"


def families(p: Params) -> list[str]:
    """Feature families that hold one column per facility."""
    return [
        "facility_count", "facility_share", "ewma_facility_share",
        "transition_count_from_last", "transition_share_from_last",
        "community_facility_share", "community_facility_share_origin_weekday",
        "community_facility_share_origin_band",
        *(f"community_facility_share_{d}d" for d in p.community_days),
        "community_lead_minutes_mean",
    ]


def shared_columns(p: Params) -> list[str]:
    mine = {f"{f}_{s}" for f in families(p) for s in p.slugs}
    return [*text_features(p), *(n for n in numeric_features(p) if n not in mine)]


def _rank(values: Column, v: Column, i: Column) -> Column:
    """0-based descending rank in catalog order on ties, nulls last."""
    ahead = F.filter(
        values,
        lambda y, j: (
            F.coalesce(y > v, F.lit(False))
            | (y.isNotNull() & v.isNull())
            | (y.eqNullSafe(v) & (j < i))
        ),
    )
    return F.size(ahead)


def family_arrays(p: Params) -> list[Column]:
    """The facilities' names and, by family, their values, as arrays in catalog order."""
    return [
        F.array(*(F.lit(n) for n in p.names)).alias("_names"),
        *(F.array(*(F.col(f"{f}_{s}") for s in p.slugs)).alias(f"_{f}") for f in families(p)),
    ]


def candidate_structs(p: Params) -> Column:
    """A row's candidates in catalog order, from its :func:`family_arrays`."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(len(p.names) - 1)),
        lambda i: F.struct(
            F.get("_names", i).alias(CANDIDATE),
            *(F.get(f"_{f}", i).alias(f"candidate_{f}") for f in families(p)),
            *(
                _rank(F.col(f"_{f}"), F.get(f"_{f}", i), i).cast("double")
                .alias(f"candidate_rank_{f}")
                for f in RANKED
            ),
            *(
                (F.array_max(f"_{f}") - F.get(f"_{f}", i)).alias(f"candidate_gap_to_top_{f}")
                for f in RANKED
            ),
        ),
    )


def candidate_flags(p: Params, cell: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """What is told by a candidate, whose columns ``cell`` gives, and its sample together."""
    return {
        "candidate_share_over_community":
            cell("candidate_facility_share") - cell("candidate_community_facility_share"),
        "candidate_is_unseen": (cell("candidate_facility_count") <= 0).cast("double"),
        **{
            f"candidate_is_{c}": (F.col(c) == cell(CANDIDATE)).cast("double")
            for c in text_features(p)[1:]
        },
    }


def build_candidates(table: DataFrame, p: Params) -> DataFrame:
    """Long form of the feature table, computed inside each row.

    Ranks and gaps only compare a sample's own columns, so they are array
    expressions before the rows are expanded: no shuffle at all.
    """
    wide = table.select(
        "sample_id", F.substring("sample_id", 2, 30).cast("long").alias("candidate_group"),
        *shared_columns(p), *family_arrays(p),
    )
    long = wide.select("sample_id", "candidate_group", *shared_columns(p), F.inline(candidate_structs(p)))
    return long.select("*", *(v.alias(k) for k, v in candidate_flags(p).items()))


def candidate_labels(long: DataFrame, targets: DataFrame) -> DataFrame:
    """Relevance 1 for the booked facility, else 0.

    Behind the expansion the candidates look small to Spark, so the join is told to sort.
    """
    return long.select("sample_id", CANDIDATE).hint("merge").join(
        targets.select("sample_id", "target_facility_id"), "sample_id"
    ).select(
        "sample_id", CANDIDATE,
        (F.col(CANDIDATE) == F.col("target_facility_id")).cast("int").alias("relevance"),
    )


def rank_candidates(scored: DataFrame, p: Params) -> DataFrame:
    """Highest-scoring candidate per sample, first in catalog order on a tie."""
    place = F.array_position(F.array(*map(F.lit, p.names)), F.col(CANDIDATE))
    return scored.groupBy("sample_id").agg(
        F.max_by(CANDIDATE, F.struct("score", (-place).alias("o"))).alias("picked")
    )


def candidate_softmax(scored: DataFrame) -> DataFrame:
    """Softmax of the scores within each sample, the maximum subtracted."""
    w = Window.partitionBy("sample_id")
    raised = scored.select(
        "sample_id", CANDIDATE, F.exp(F.col("score") - F.max("score").over(w)).alias("_e")
    )
    return raised.select(
        "sample_id", CANDIDATE, (F.col("_e") / F.sum("_e").over(w)).alias("probability")
    )
