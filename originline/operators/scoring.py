"""Scoring: component matches, per-class metrics, comparisons and bootstraps."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from originline.functions.ordered import exact_quantiles, global_rank
from originline.functions.scalar import ratio
from originline.params import HEADS, Params
from originline.session import freeze, width

MODEL = ("track", "model", "split")
MATCHES = tuple(f"match_{h}" for h in HEADS)
CLASS_HEADS = HEADS[:3]


def submitted(predicted: Column) -> Column:
    """The delay that is acted on: negatives become zero."""
    return F.greatest(predicted, F.lit(0.0))


def log_ratio(predicted: Column, actual: Column) -> Column:
    return F.log((submitted(predicted) + 1.0) / (actual + 1.0))


def circular_hours(predicted: Column, actual: Column) -> Column:
    """Hour error the short way round the clock."""
    ahead = F.pmod(predicted - actual, F.lit(24))
    return F.least(ahead, 24 - ahead)


def score(joined: DataFrame, p: Params) -> DataFrame:
    """Predictions joined to their targets, with the four matches and the score."""
    if p.match_ratio <= 1:
        raise ValueError("the match ratio must exceed 1")
    actual = F.when(
        F.col("notification_delay_minutes") < 0,
        F.raise_error(F.lit("an actual delay is negative")).cast("double"),
    ).otherwise(F.col("notification_delay_minutes"))
    near = F.abs(log_ratio(F.col("predicted_delay_minutes"), actual)) <= p.tolerance

    def hit(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    marked = joined.select(
        "*",
        hit(F.col("predicted_facility_id") == F.col("target_facility_id")).alias(MATCHES[0]),
        hit(F.col("predicted_usage_weekday") == F.col("target_usage_weekday")).alias(MATCHES[1]),
        hit(F.col("predicted_usage_hour") == F.col("target_usage_hour")).alias(MATCHES[2]),
        hit(near).alias(MATCHES[3]),
    )
    return marked.withColumn("score", sum((F.col(m).cast("int") for m in MATCHES), F.lit(0)))


def summary_columns() -> list[Column]:
    """Aggregates of the match summary."""
    rate = [F.avg(F.col(m).cast("int")).alias(h) for m, h in zip(MATCHES, HEADS, strict=True)]
    return [
        *rate, F.avg("score").alias("score_mean"), (F.avg("score") / 4).alias("overall"),
        F.avg((F.col("score") == 4).cast("int")).alias("strict"),
        F.avg((F.col("score") >= 3).cast("int")).alias("at_least_three"),
    ]


SUMMARY = (*HEADS, "score_mean", "overall", "strict", "at_least_three")


def match_summary(scored: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *summary_columns())


def class_pairs(scored: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """Counts of (head, actual, predicted): every class metric follows from these."""
    cells = F.array(*(
        F.struct(
            F.lit(h).alias("head"), F.col(f"target_{c}").cast("string").alias("actual"),
            F.col(f"predicted_{c}").cast("string").alias("predicted"),
        )
        for h, c in zip(CLASS_HEADS, ("facility_id", "usage_weekday", "usage_hour"), strict=True)
    ))
    return scored.select(*by, F.inline(cells)).groupBy(*by, "head", "actual", "predicted").agg(
        F.count(F.lit(1)).alias("n")
    )


def class_accuracy(pairs: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    return pairs.groupBy(*by, "head").agg((hit / F.sum("n")).alias("accuracy"))


def per_class_recall(pairs: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    return pairs.groupBy(*by, "head", "actual").agg(
        F.sum("n").alias("support"), (hit / F.sum("n")).alias("recall")
    )


def macro_f1(pairs: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """Unweighted mean F1 over the labels seen on either side."""
    sides = F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("a"),
                 F.lit(0).cast("long").alias("p")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("a"),
                 F.col("n").alias("p")),
    )
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    # A hit is listed from both sides; it is counted on its actual side only.
    per = (
        pairs.withColumn("tp", hit).select(*by, "head", "tp", F.inline(sides))
        .groupBy(*by, "head", "label").agg(
            F.sum(F.when((F.col("a") > 0) & (F.col("tp") > 0), F.col("tp"))
                  .otherwise(0)).alias("tp"),
            (F.sum("a") + F.sum("p")).alias("both"),
        )
    )
    f1 = F.coalesce(ratio(2 * F.col("tp"), F.col("both")), F.lit(0.0))
    return per.groupBy(*by, "head").agg(F.avg(f1).alias("macro_f1"))


def confusion_matrix(pairs: DataFrame, by: Sequence[str] = (*MODEL, "head")) -> DataFrame:
    """Dense counts of every head over the labels seen on either side.

    The label list of one head is bounded by its catalog (8, 7 or 24 classes).
    """
    labels = pairs.groupBy(*by).agg(
        F.array_distinct(
            F.flatten(F.array(F.collect_set("actual"), F.collect_set("predicted")))
        ).alias("_labels")
    )
    grid = labels.select(*by, F.explode("_labels").alias("actual"), "_labels").select(
        *by, "actual", F.explode("_labels").alias("predicted")
    )
    return grid.join(pairs, [*by, "actual", "predicted"], "left").select(
        *by, "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n")
    )


def top_k(actual: Column, classes: Sequence[tuple[str, Column]], k: int) -> Column:
    """Whether a label is among the k likeliest, ties by class order."""
    known = F.array(*(F.lit(name) for name, _ in classes))
    entries = F.array(*(
        F.struct(prob.alias("p"), F.lit(-i).alias("o"), F.lit(name).alias("c"))
        for i, (name, prob) in enumerate(classes)
    ))
    best = F.slice(F.sort_array(entries, asc=False), 1, k)
    hit = F.exists(best, lambda e: e["c"] == actual)
    return F.when(F.array_contains(known, actual), hit).otherwise(
        F.raise_error(F.lit("an observed label has no probability")).cast("boolean")
    )


def hour_metrics(scored: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    gap = circular_hours(F.col("predicted_usage_hour"), F.col("target_usage_hour"))
    return scored.groupBy(*by).agg(
        F.avg(gap).alias("hour_mae"), F.avg((gap <= 1).cast("int")).alias("within_1_hour")
    )


def delay_metrics(scored: DataFrame, p: Params, by: Sequence[str] = MODEL) -> DataFrame:
    """Absolute, relative and tolerance errors of the submitted delay."""
    error = submitted(F.col("predicted_delay_minutes")) - F.col("notification_delay_minutes")
    rows = scored.select(
        *by, error.alias("error"), F.abs(error).alias("ae"),
        F.abs(log_ratio(F.col("predicted_delay_minutes"), F.col("notification_delay_minutes")))
        .alias("alr"),
        (F.col("predicted_delay_minutes") < 0).cast("int").alias("clamped"),
    )
    plain = rows.groupBy(*by).agg(
        F.avg("ae").alias("mae_minutes"), F.avg("error").alias("signed_bias_minutes"),
        F.avg("clamped").alias("clamp_rate"),
        *(F.avg((F.col("ae") <= m).cast("int")).alias(f"within_{m}_minutes")
          for m in p.support_minutes),
    )
    spread = exact_quantiles(rows, by, "ae", {"median_ae_minutes": 0.5, "p90_ae_minutes": 0.9})
    logs = exact_quantiles(rows, by, "alr", {"median_abs_log_ratio": 0.5})
    return plain.join(spread.drop("n"), list(by)).join(logs.drop("n"), list(by))


def evaluation_report(scored: DataFrame, p: Params, by: Sequence[str] = MODEL, likely: DataFrame | None = None) -> DataFrame:
    """Every metric as (track, model, split, metric, value).

    Class recalls are included, and the delay both as submitted and raw, that is
    before negative delays become zero. ``likely`` has ``head`` and ``hit``, whether a
    row's label is among the three likeliest of the head, for models that give
    probabilities; the report then holds the heads' top-3 accuracy.
    """
    by = list(by)
    pairs = freeze(class_pairs(scored, by))
    heads = class_accuracy(pairs, by).join(macro_f1(pairs, by), [*by, "head"])
    wide = heads.groupBy(*by).agg(*(
        F.max(F.when(F.col("head") == h, F.col(m))).alias(f"{h}_{m}")
        for h in CLASS_HEADS for m in ("accuracy", "macro_f1")
    ))
    error = F.col("predicted_delay_minutes") - F.col("notification_delay_minutes")
    raw = scored.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("raw_mae_minutes"), F.avg(error).alias("raw_signed_bias_minutes")
    )
    full = (
        match_summary(scored, by).join(wide, by).join(hour_metrics(scored, by), by)
        .join(delay_metrics(scored, p, by), by).join(raw, by)
    )
    recall = per_class_recall(pairs, by).select(
        *by, F.concat_ws("_", F.lit("recall"), "head", "actual").alias("metric"),
        F.col("recall").alias("value"),
    )
    report = unpivot(full, by).unionByName(recall)
    if likely is None:
        return report
    top = likely.groupBy(*by, "head").agg(F.avg(F.col("hit").cast("int")).alias("value"))
    return report.unionByName(top.select(*by, F.concat(F.col("head"), F.lit("_top_3_accuracy")).alias("metric"), "value"))


def unpivot(wide: DataFrame, by: Sequence[str]) -> DataFrame:
    names = [c for c in wide.columns if c not in by]
    cells = F.array(*(
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names
    ))
    return wide.select(*by, F.inline(cells))


def compare_reports(report: DataFrame, model: str, baseline: str) -> DataFrame:
    """Lift of one model over another per component, and the verdict."""
    a = report.filter(F.col("model") == model).select("metric", F.col("value").alias("model"))
    b = report.filter(F.col("model") == baseline).select(
        "metric", F.col("value").alias("baseline")
    )
    keep = [*HEADS, "overall", "strict", "mae_minutes"]
    both = a.join(b, "metric").filter(F.col("metric").isin(keep))
    less = F.col("metric") == "mae_minutes"
    gain = F.when(less, F.col("baseline") - F.col("model")).otherwise(
        F.col("model") - F.col("baseline")
    )
    relative = F.when(less, 1 - ratio(F.col("model"), F.col("baseline"))).otherwise(
        ratio(F.col("model") - F.col("baseline"), F.col("baseline"))
    )
    verdict = F.when(gain > 0, "beats").when(gain < 0, "loses").otherwise("ties")
    return both.select(
        "metric", "model", "baseline", gain.alias("absolute"), relative.alias("relative"),
        F.when(F.col("metric") == "overall", verdict).alias("verdict"),
    )


def leaderboard(predictions: DataFrame, scored: DataFrame, ids: DataFrame) -> DataFrame:
    """Every model on the shared ids; one without rows there is still listed."""
    listed = predictions.select("track", "model").distinct()
    on_ids = scored.join(ids.select("sample_id"), "sample_id", "left_semi")
    summary = match_summary(on_ids, ["track", "model"])
    return listed.join(summary, ["track", "model"], "left").withColumn(
        "rows", F.coalesce("rows", F.lit(0))
    ).orderBy(F.desc_nulls_last("overall"), "track", "model")


def comparator(scored: DataFrame, model: str, split: str) -> DataFrame:
    """One model's headline row on one split; none is an error."""
    rows = scored.filter((F.col("model") == model) & (F.col("split") == split))
    one = rows.agg(F.count(F.lit(1)).alias("rows"), *summary_columns())
    return one.withColumn(
        "rows",
        F.when(F.col("rows") > 0, F.col("rows")).otherwise(
            F.raise_error(F.lit("the comparator has no scored row")).cast("long")
        ),
    )


def metric_drift(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metrics whose stored and recomputed values differ by more than 1e-9."""
    a = stored.select(*keys, F.col("value").alias("stored"))
    b = recomputed.select(*keys, F.col("value").alias("recomputed"))
    return a.join(b, list(keys)).filter(F.abs(F.col("stored") - F.col("recomputed")) > 1e-9)


def select_sources(scored: DataFrame, order: Sequence[str]) -> DataFrame:
    """Best model per head by match rate, the first declared one on a tie."""
    cells = F.array(*(
        F.struct(F.lit(h).alias("head"), F.col(m).cast("int").alias("hit"))
        for h, m in zip(HEADS, MATCHES, strict=True)
    ))
    rates = scored.select("model", F.inline(cells)).groupBy("head", "model").agg(
        F.avg("hit").alias("rate")
    )
    place = F.array_position(F.array(*map(F.lit, order)), F.col("model"))
    best = F.struct("rate", (-place).alias("o"))
    return rates.groupBy("head").agg(
        F.max_by("model", best).alias("source"), F.max("rate").alias("rate")
    )


def compose(predictions: DataFrame, sources: DataFrame, models: Sequence[str]) -> DataFrame:
    """Each head's answer whole from its source; the models must cover equal ids."""
    picks = sources.agg(*(
        F.max(F.when(F.col("head") == h, F.col("source"))).alias(f"_src_{h}") for h in HEADS
    )).select(F.struct("*").alias("_s")).scalar()
    rows = predictions.filter(F.col("model").isin(*models)).withColumn("_s", picks)

    def taken(head: str, column: str) -> Column:
        return F.max(F.when(F.col("model") == F.col(f"_s._src_{head}"), F.col(column))).alias(
            column
        )

    return rows.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("_n"),
        taken("facility", "predicted_facility_id"),
        taken("usage_weekday", "predicted_usage_weekday"),
        taken("usage_hour", "predicted_usage_hour"),
        taken("notification", "predicted_delay_minutes"),
    ).select(
        F.when(F.col("_n") == len(models), F.col("sample_id")).otherwise(
            F.raise_error(F.lit("the candidates cover different samples"))
        ).alias("sample_id"),
        "predicted_facility_id", "predicted_usage_weekday", "predicted_usage_hour",
        "predicted_delay_minutes",
    )


def paired_bootstrap(diffs: DataFrame, p: Params) -> DataFrame:
    """Mean paired difference with a percentile interval, for any number of pairs.

    ``diffs`` holds (sample_id, diff), one row per pair.
    """
    return bootstrap_mean(diffs, "sample_id", "diff", p).withColumnRenamed("mean", "mean_difference")


def paired_differences(scored: DataFrame, base: str, trained: str, ids: DataFrame) -> DataFrame:
    """Score difference per shared id; differing row sets are an error."""
    rows = scored.join(ids.select("sample_id"), "sample_id", "left_semi").filter(
        F.col("model").isin(base, trained)
    )
    both = rows.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("_n"),
        (
            F.max(F.when(F.col("model") == trained, F.col("score")))
            - F.max(F.when(F.col("model") == base, F.col("score")))
        ).alias("_d"),
    )
    return both.select(
        "sample_id",
        F.when(F.col("_n") == 2, F.col("_d") / 4.0).otherwise(
            F.raise_error(F.lit("the two models cover different rows")).cast("double")
        ).alias("diff"),
    )


# Fixed value: the largest prime below 2^32.
PRIME = 4_294_967_291


#: How many standard deviations the first share of the draws stays under the number of rows.
SHORT = 6.0

#: Rows whose counts one task draws; it sends one row per resample and category.
ROWS_PER_DRAW = 200_000


def poisson_rate(n: int) -> float:
    """Expected count of a row in the first share of a resample of ``n`` draws."""
    return max(0.0, 1.0 - SHORT / math.sqrt(n)) if n else 0.0


def poisson_limits(rate: float, terms: int = 12) -> list[int]:
    """Where a uniform number below 2^32 passes to the next Poisson count."""
    shares = np.cumsum([math.pow(rate, k) / math.factorial(k) for k in range(terms)]) * math.exp(-rate)
    return [math.ceil(x * 2**32) for x in shares.tolist()]


def _resampled(rows: DataFrame, row_id: str, category: str | None, values: dict[str, Column], p: Params) -> DataFrame:
    """Sums of ``values`` for every resample (and category); each is exactly n draws of n rows with replacement.

    Counts of rows that are independent and Poisson are, given their total m, the
    counts of m draws. So a first share of each resample, a few standard deviations
    short of n, gives every row a Poisson count by itself: from two hashes of the row,
    as (h1 + b * h2) modulo a prime is uniform and independent between rows. All
    resamples of a block of rows are one matrix product inside the task; a task sends
    one row per resample and category, whatever the number of its rows. The n - m
    draws that are left, of the order of sqrt(n), pick places in the order of the ids
    and are joined with the rows there. There are about 6 sqrt(n) of them a resample, which
    Spark cannot foresee behind an explode, so the resamples are dealt over the tasks
    and the join is told to sort: neither side may be sent to the driver. Should a first
    share exceed n, all n draws of that resample are picked so. Nothing depends on how the
    rows are partitioned.

    ``drawn`` is the number of draws in a row's sums.
    """
    n = rows.count()
    # Its own salt: seeded draws order rows by an MD5 of seed and id, too.
    key = F.md5(F.concat_ws("|", F.lit(f"{p.seed}|bootstrap"), F.col(row_id).cast("string")))
    named = rows.select(
        F.col(row_id), (F.lit("") if category is None else F.col(category)).alias("category"),
        *(F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in values.items()), F.lit(1.0).alias("drawn"))
    hashed = named.select(
        *(F.conv(F.substring(key, at, 8), 16, 10).cast("long").alias(name) for name, at in (("h1", 1), ("h2", 9))),
        "category", *values, "drawn")
    names, resamples, limits = [*values, "drawn"], p.resamples, np.array(poisson_limits(poisson_rate(n)), np.uint64)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}
        b = np.arange(resamples, dtype=np.uint64)
        for batch in batches:
            frame = batch.to_pandas()
            for name, part in frame.groupby("category", dropna=False, sort=False):
                name = None if pd.isna(name) else name
                total = sums.setdefault(name, np.zeros((len(names), resamples)))
                for low in range(0, len(part), 512):
                    block = part.iloc[low : low + 512]
                    h1, h2 = (block[c].to_numpy(np.uint64)[:, None] for c in ("h1", "h2"))
                    # h2 < 2^32 and b < 2^31: the product fits 64 bits.
                    counts = np.searchsorted(limits, (h1 + b * h2) % np.uint64(PRIME), side="right")
                    total += block[names].to_numpy(float).T @ counts.astype(float)
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * resamples, pa.string()), pa.array(b.astype(np.int64)), *map(pa.array, total)],
                ["category", "b", *names],
            )

    schema = "category string, b bigint, " + ", ".join(f"{k} double" for k in names)
    tasks = max(width(rows.sparkSession), -(-n // ROWS_PER_DRAW))
    first = freeze(hashed.repartition(tasks, "h1").mapInArrow(draw, schema).groupBy("category", "b").agg(*(F.sum(k).alias(k) for k in names)))
    # As many rows as resamples: a setting, not a property of the data.
    totals = first.groupBy("b").agg(F.sum("drawn").cast("long").alias("m")).select(
        "b", F.when(F.col("m") <= n, F.col("m")).otherwise(0).alias("m"))
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long") - F.col("m") - 1)).alias("i")
    left = totals.where(F.col("m") < n).repartition(tasks).select("b", i)
    pick = F.md5(F.concat_ws("|", F.lit(f"{p.seed}|draw"), F.col("b").cast("string"), F.col("i").cast("string")))
    places = left.select("b", (F.conv(F.substring(pick, 1, 13), 16, 10).cast("long") % n + 1).alias("_rank"))
    ranked = global_rank(named, [row_id, "category"], "_rank")
    second = places.hint("merge").join(ranked, "_rank").select("category", "b", *names)
    kept = first.join(totals.where(F.col("m") > 0).select("b"), "b", "left_semi").select("category", "b", *names)
    return kept.unionByName(second).groupBy("category", "b").agg(*(F.sum(k).alias(k) for k in names))


def resample_sizes(rows: DataFrame, row_id: str, p: Params) -> DataFrame:
    """``b`` and ``drawn``, the draws of each resample."""
    return _resampled(rows, row_id, None, {}, p).select("b", F.col("drawn").cast("long").alias("drawn"))


def bootstrap_mean(rows: DataFrame, row_id: str, value: str, p: Params) -> DataFrame:
    """Percentile interval of a mean from resamples of as many draws as rows."""
    x = F.col(value)
    drawn = _resampled(rows, row_id, None, {"x": x, "c": x.isNotNull()}, p)
    tail = (1 - p.level) / 2
    # As many values as resamples: a setting, not a property of the data.
    band = drawn.agg(F.percentile(ratio(F.col("x"), F.col("c")), [tail, 1 - tail]).alias("q"))
    one = rows.agg(F.count(value).alias("rows"), F.avg(value).alias("mean"))
    return one.withColumn("_q", band.scalar()).select(
        "rows", "mean", F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("upper")
    )


def bootstrap_shares(rows: DataFrame, row_id: str, category: str, p: Params) -> DataFrame:
    """Percentile interval of each category's share, from one set of weights."""
    drawn = _resampled(rows, row_id, category, {"c": F.lit(1)}, p)
    share = ratio(F.col("c"), F.sum("c").over(Window.partitionBy("b")))
    tail = (1 - p.level) / 2
    shares = drawn.select(F.col("category").alias(category), share.alias("m"))
    return shares.groupBy(category).agg(
        F.percentile("m", [tail, 1 - tail]).alias("q")
    ).select(category, F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))


def operational(records: DataFrame) -> DataFrame:
    """Validity, retries, latency and token counts of a set of answers."""
    counts = records.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("status") == "valid").alias("valid"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("attempts") > 1).alias("retried"),
        F.count_if(F.col("semantic_invalid_reason").isNotNull()).alias("semantic_invalid"),
        F.sum("seconds").alias("elapsed_seconds"),
        F.avg("prompt_tokens").alias("prompt_tokens_mean"),
        F.avg("completion_tokens").alias("completion_tokens_mean"),
    )
    latency = exact_quantiles(records, [], "seconds", {"p50": 0.5, "p95": 0.95})
    one = latency.select(F.struct("p50", "p95").alias("l")).scalar()
    return counts.withColumn("_l", one).select(
        "rows", "valid", "failed", "retried", "semantic_invalid",
        F.col("_l.p50").alias("latency_p50_seconds"),
        F.col("_l.p95").alias("latency_p95_seconds"),
        "elapsed_seconds", "prompt_tokens_mean", "completion_tokens_mean",
    )
