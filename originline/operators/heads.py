"""Inputs, labels and classes of the four heads, and the shuffled-label control.

The heads themselves are fitted in :mod:`originline.operators.framings`; the control
fits the same boosted trees.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from originline.functions.ordered import global_rank
from originline.functions.scalar import draw_key
from originline.operators import boosting as B
from originline.operators import candidates as K
from originline.operators.delays import fixed_bucket
from originline.operators.features import numeric_features, text_features
from originline.params import MISSING, Params, bucket_edges


@dataclasses.dataclass(frozen=True)
class Settings:
    """Size of one fit, a part of the features to leave out, and numbers to add."""

    trees: int = 20
    depth: int = 6
    without: tuple[str, ...] = ()
    extra: tuple[str, ...] = ()


def classes(head: str, p: Params) -> tuple[str, ...]:
    return {
        "facility": p.names,
        "usage_weekday": tuple(map(str, range(7))),
        "usage_hour": tuple(map(str, range(24))),
        "notification": tuple(map(str, range(len(bucket_edges(p)) + 1))),
    }[head]


def label(head: str, p: Params) -> Column:
    """Class index of a row's target."""
    if head == "facility":
        names = F.array(*map(F.lit, p.names))
        return (F.array_position(names, F.col("target_facility_id")) - 1).cast("double")
    if head == "notification":
        return fixed_bucket(F.col("notification_delay_minutes"), p).cast("double")
    return F.col(f"target_{head}").cast("double")


def model_inputs(p: Params, settings: Settings) -> list[str]:
    """Feature columns a head reads.

    The resident's own id is left out: its history features already describe the
    resident, and an index over all residents would grow with the table.
    """
    names = [*text_features(p)[1:], *numeric_features(p), *settings.extra]
    return [n for n in names if not n.startswith(settings.without or ("\0",))]


def matrix(table: DataFrame, p: Params, settings: Settings) -> DataFrame:
    """Feature table with text as catalog positions and gaps as -1."""
    levels = F.array(*map(F.lit, (MISSING, *p.names)))
    text = set(text_features(p))
    cells = [
        F.array_position(levels, F.col(n)).cast("double").alias(n)
        if n in text
        else F.coalesce(F.col(n), F.lit(-1.0)).alias(n)
        for n in model_inputs(p, settings)
    ]
    rest = [c for c in table.columns if c not in model_inputs(p, settings)]
    return table.select(*rest, *cells)


def argmax_class(array: Column, names: Sequence[str]) -> Column:
    """Likeliest class, the first one on a tie."""
    at = F.array_position(array, F.array_max(array)) - 1
    return F.get(F.array(*map(F.lit, names)), at.cast("int"))


def candidate_inputs(p: Params) -> list[str]:
    families = K.families(p)
    return [
        "candidate_position",
        *(f"candidate_{f}" for f in families),
        *(f"candidate_{k}_{f}" for k in ("rank", "gap_to_top") for f in K.RANKED),
        "candidate_share_over_community", "candidate_is_unseen",
        *(f"candidate_is_{c}" for c in text_features(p)[1:]),
    ]


def candidate_matrix(long: DataFrame, p: Params) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, p.names)), F.col(K.CANDIDATE)).cast("double")
    rows = long.withColumn("candidate_position", place)
    keep = [c for c in ("sample_id", K.CANDIDATE, "relevance") if c in rows.columns]
    return rows.select(
        *keep, *(F.coalesce(F.col(c), F.lit(-1.0)).alias(c) for c in candidate_inputs(p))
    )


def shuffled_control(train: DataFrame, held: DataFrame, p: Params, settings: Settings) -> DataFrame:
    """Whether a head scores above chance where it must not, and where it must.

    One row per control. ``shuffled``: fitted on permuted labels, so on unseen rows
    it may not pass the majority prior by more than the tolerance, the larger of
    0.02 and two standard errors. ``planted``: the permuted label itself is among
    the inputs, as a leak would be, so the score must pass that bound.
    """
    prior = held.groupBy("target_facility_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.max("n").alias("top"), F.sum("n").alias("rows"))
    row = prior.first()
    share = row["top"] / row["rows"]
    bound = max(0.02, 2.0 * (share * (1.0 - share) / row["rows"]) ** 0.5)
    borders = B.find_borders(matrix(train, p, settings), model_inputs(p, settings), B.Boost().borders)
    n = len(classes("facility", p))
    leak = [k + 0.5 for k in range(n - 1)]
    blocks = B.Matrix(control_rows(train, held, p, settings, borders), F.col("x"), {"facility": F.col("y")}, F.col("late"), [*borders, leak])
    # Every round is fitted; the rows held out are the unseen ones.
    size = B.Boost(rounds=settings.trees, depth=settings.depth, patience=settings.trees + 1, seed=p.seed)
    out = []
    try:
        for control, without in (("shuffled", (len(borders),)), ("planted", ())):
            _, _, curve = B.boost(blocks, "facility", n, size, curve=True, without=without)
            score = curve[-1].accuracy if curve else 0.0
            out.append((control, row["rows"], share, bound, score, score > share + bound))
    finally:
        blocks.close()
    return train.sparkSession.createDataFrame(
        out, "control string, rows bigint, prior double, tolerance double, accuracy double, tripped boolean"
    )


def control_rows(train: DataFrame, held: DataFrame, p: Params, settings: Settings, borders: list[list[float]]) -> DataFrame:
    """Bins ``x``, label ``y`` and whether a row is ``late``, of both parts; the labels of ``train`` are permuted.

    The last bin is the label's, a leak. A row meets its permuted label as one byte a feature.
    """
    inputs = model_inputs(p, settings)

    def packed(rows: DataFrame) -> DataFrame:
        cells = F.array(*[F.col(c).cast("double") for c in inputs])
        return matrix(rows, p, settings).select("sample_id", "target_facility_id", B.packed(cells, borders).alias("x"))

    mixed = shuffled_labels(train.select("sample_id", "target_facility_id"), "target_facility_id", p.seed)
    mixed = mixed.select("sample_id", F.col("permuted").alias("target_facility_id"))
    early = packed(train).drop("target_facility_id").join(mixed, "sample_id")
    both = early.withColumn("late", F.lit(False)).unionByName(packed(held).withColumn("late", F.lit(True)))
    y = label("facility", p).cast("int")
    return both.select(F.concat("x", F.unhex(F.lpad(F.hex(y + 1), 2, "0"))).alias("x"), y.alias("y"), "late")


def shuffled_labels(rows: DataFrame, label_column: str, seed: int) -> DataFrame:
    """Seeded permutation of a label column: every row gets another row's label.

    Two parallel ranks, by id and by seeded hash, are joined position by position.
    """
    ids = global_rank(rows.select("sample_id", label_column), ["sample_id"], "_rank")
    hashed = rows.select(
        "sample_id", F.col(label_column).alias("permuted"),
        draw_key(seed, F.col("sample_id")).alias("_key"),
    )
    mixed = global_rank(hashed, ["_key", "sample_id"], "_rank").select("_rank", "permuted")
    return ids.join(mixed, "_rank").drop("_rank")
