"""Jobs over rule models, their scores, error slices and distribution profiles."""

from __future__ import annotations

import math
import statistics

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originline.functions.scalar import attach
from originline.operators import profiles as Q
from originline.operators import scoring as S
from originline.operators import slices as L
from originline.params import TEST
from originline.plans import features as _features  # noqa: F401  (its SQL fragments)
from originline.plans.registry import job
from originline.plans.sql import fragment, query, quoted, values
from originline.plans.tables import lead_hours
from originline.plans.workspace import Workspace
from originline.sources import tables as T

P = TEST


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(
        F.round(n, places).alias(n) if k == "double" else F.col(n) for n, k in df.dtypes
    ))


# ------------------------------------------------------------- rule models

fragment("tr", "SELECT * FROM ss WHERE split = 'train'")
fragment("known", "SELECT * FROM h WHERE us <= (SELECT max(origin_us) FROM tr)")


def _top(value: str, key: str = "") -> str:
    """Commonest value per key, ties to the latest booking."""
    keys = f"{key}, " if key else ""
    part = f"PARTITION BY {key}" if key else ""
    return f"""SELECT {keys}v FROM (SELECT *, row_number() OVER ({part} ORDER BY c DESC, u DESC, b DESC) AS rn
  FROM (SELECT {keys}{value} AS v, count(*) AS c, max(us) AS u, max(booking_id) AS b
    FROM known GROUP BY ALL)) WHERE rn = 1"""


fragment("fb_fac", _top("facility_id"))
fragment("fb_wd", _top("uwd"))
fragment("fb_uh", _top("uh"))
fragment("fb_uhf", _top("uh", "facility_id"))
fragment("fb_delay", "SELECT quantile_cont(notification_delay_minutes, 0.5) AS v FROM tr")
fragment("resident_first", """
SELECT resident_id, us AS fus, booking_id AS fid FROM h WHERE n = 1""")
fragment("fb_next", """
SELECT prev_facility AS facility_id, facility_id AS successor FROM (
  SELECT *, row_number() OVER (PARTITION BY prev_facility ORDER BY c DESC, o DESC) AS rn FROM (
    SELECT prev_facility, facility_id, count(*) AS c, max(ROW(fus, fid, us)) AS o
    FROM known JOIN resident_first USING (resident_id)
    WHERE prev_facility IS NOT NULL GROUP BY 1, 2)) WHERE rn = 1""")
fragment("own_next", """
SELECT id, facility_id AS successor FROM (SELECT *, row_number() OVER
    (PARTITION BY id ORDER BY c DESC, seen DESC) AS rn
  FROM (SELECT id, facility_id, count(*) AS c, max(us) AS seen FROM past
    WHERE prev_facility = now_facility GROUP BY 1, 2)) WHERE rn = 1""")
fragment("rules", """
SELECT s.sample_id, f.v AS mfac, w.v AS mwd, u.v AS muh, r.gap_minutes, o.successor AS own,
  coalesce(o.successor, c.successor, (SELECT v FROM fb_fac)) AS trans
FROM smp s JOIN f_run r ON r.booking_id = s.origin_booking_id
JOIN m_fac f ON f.id = r.booking_id JOIN m_uwd w ON w.id = r.booking_id
JOIN m_uh u ON u.id = r.booking_id LEFT JOIN own_next o ON o.id = r.booking_id
LEFT JOIN fb_next c ON c.facility_id = r.facility_id""")
fragment("pr", """
SELECT 'baseline' AS track, 'habit' AS model, sample_id, mfac AS predicted_facility_id,
  mwd AS predicted_usage_weekday, muh AS predicted_usage_hour,
  coalesce(gap_minutes, (SELECT v FROM fb_delay)) AS predicted_delay_minutes,
  trans AS predicted_transition_facility_id FROM rules
UNION ALL SELECT 'traditional', 'transition', sample_id, trans, (SELECT v FROM fb_wd),
  (SELECT v FROM fb_uh), (SELECT v FROM fb_delay), trans FROM rules""")
fragment("sc", f"""
SELECT *, CAST(match_facility AS INTEGER) + CAST(match_usage_weekday AS INTEGER)
  + CAST(match_usage_hour AS INTEGER) + CAST(match_notification AS INTEGER) AS score FROM (
  SELECT *, predicted_facility_id = target_facility_id AS match_facility,
    predicted_usage_weekday = target_usage_weekday AS match_usage_weekday,
    predicted_usage_hour = target_usage_hour AS match_usage_hour,
    abs(ln((greatest(predicted_delay_minutes, 0) + 1) / (notification_delay_minutes + 1)))
      <= ln({P.match_ratio}::DOUBLE) AS match_notification
  FROM pr JOIN ss USING (sample_id))""")
fragment("sct", "SELECT * FROM sc WHERE split = 'test'")
SUMMARY = """count(*) AS "rows", avg(match_facility::INT) AS facility,
  avg(match_usage_weekday::INT) AS usage_weekday, avg(match_usage_hour::INT) AS usage_hour,
  avg(match_notification::INT) AS notification, avg(score) AS score_mean, avg(score) / 4 AS overall,
  avg((score = 4)::INT) AS strict, avg((score >= 3)::INT) AS at_least_three"""


def round_sql(body: str, keys: str, names, places: int = 6) -> str:
    cells = ", ".join(f"round({n}, {places}) AS {n}" for n in names)
    return f"SELECT {keys}, {cells} FROM ({body})"


@job("community_fallbacks", query("""
SELECT 'facility' AS kind, NULL::VARCHAR AS "key", v AS label, NULL::DOUBLE AS minutes FROM fb_fac
UNION ALL SELECT 'usage_weekday', NULL, v::VARCHAR, NULL FROM fb_wd
UNION ALL SELECT 'usage_hour', NULL, v::VARCHAR, NULL FROM fb_uh
UNION ALL SELECT 'hour_by_facility', facility_id, v::VARCHAR, NULL FROM fb_uhf
UNION ALL SELECT 'delay', NULL, NULL, round(v, 6) FROM fb_delay"""))
def community_fallbacks(ws: Workspace) -> DataFrame:
    return rounded(ws.fallbacks)


@job("community_transitions", query("SELECT * FROM fb_next"))
def community_transitions(ws: Workspace) -> DataFrame:
    return ws.transitions


@job("habit_predictions", query("""
SELECT track, model, sample_id, predicted_facility_id, predicted_usage_weekday, predicted_usage_hour,
  round(predicted_delay_minutes, 6) AS predicted_delay_minutes, predicted_transition_facility_id FROM pr"""))
def habit_predictions(ws: Workspace) -> DataFrame:
    return rounded(ws.predictions)


@job("overwrite_predictions_partition", query("""
SELECT track, model, sample_id, predicted_facility_id, predicted_usage_weekday, predicted_usage_hour FROM pr"""))
def overwrite_predictions_partition(ws: Workspace) -> DataFrame:
    path = T.scratch(ws.spark, "predictions")
    T.overwrite_table(ws.predictions.filter("model = 'transition'"), "predictions", path)
    habit = ws.predictions.filter("model = 'habit'")
    stale = habit.withColumn("predicted_usage_hour", F.lit(0))
    T.overwrite_predictions(stale, "baseline", "habit", path)
    T.overwrite_predictions(habit, "baseline", "habit", path)
    return T.read_table(ws.spark, "predictions", path, ordered=False).select(
        "track", "model", "sample_id", "predicted_facility_id", "predicted_usage_weekday",
        "predicted_usage_hour",
    )


# ----------------------------------------------------------------- scoring

_KEYS = "track, model, split"


@job("component_matches", query("""
SELECT track, model, sample_id, match_facility, match_usage_weekday, match_usage_hour,
  match_notification FROM sc"""))
def component_matches(ws: Workspace) -> DataFrame:
    return S.score(ws.predictions.join(ws.split_samples, "sample_id"), ws.params).select(
        "track", "model", "sample_id", *S.MATCHES
    )


@job("row_scores", query(f'SELECT {_KEYS}, score, count(*) AS "rows" FROM sc GROUP BY ALL'))
def row_scores(ws: Workspace) -> DataFrame:
    return ws.scored.groupBy(*S.MODEL, "score").agg(F.count(F.lit(1)).alias("rows"))


@job("match_summary", query(round_sql(
    f"SELECT {_KEYS}, {SUMMARY} FROM sc GROUP BY ALL", f'{_KEYS}, "rows"', S.SUMMARY)))
def match_summary(ws: Workspace) -> DataFrame:
    return rounded(S.match_summary(ws.scored))


fragment("hd", """
SELECT track, model, split, sample_id, 'facility' AS head, target_facility_id AS actual,
  predicted_facility_id AS predicted FROM sc
UNION ALL SELECT track, model, split, sample_id, 'usage_weekday', target_usage_weekday::VARCHAR,
  predicted_usage_weekday::VARCHAR FROM sc
UNION ALL SELECT track, model, split, sample_id, 'usage_hour', target_usage_hour::VARCHAR,
  predicted_usage_hour::VARCHAR FROM sc""")


@job("class_accuracy", query(
    f"SELECT {_KEYS}, head, round(avg((actual = predicted)::INT), 6) AS accuracy FROM hd GROUP BY ALL"))
def class_accuracy(ws: Workspace) -> DataFrame:
    return rounded(S.class_accuracy(S.class_pairs(ws.scored)))


@job("per_class_recall", query(f"""
SELECT {_KEYS}, head, actual, count(*) AS support, round(avg((actual = predicted)::INT), 6) AS recall
FROM hd GROUP BY ALL"""))
def per_class_recall(ws: Workspace) -> DataFrame:
    return rounded(S.per_class_recall(S.class_pairs(ws.scored)))


fragment("f1", """
SELECT track, model, split, head, avg(CASE WHEN a + p = 0 THEN 0 ELSE 2.0 * tp / (a + p) END) AS macro_f1 FROM (
  SELECT track, model, split, head, label, sum(a) AS a, sum(p) AS p, sum(tp) AS tp FROM (
    SELECT track, model, split, head, actual AS label, 1 AS a, 0 AS p, (actual = predicted)::INT AS tp FROM hd
    UNION ALL SELECT track, model, split, head, predicted, 0, 1, 0 FROM hd) GROUP BY ALL)
GROUP BY ALL""")


@job("macro_f1", query(f"SELECT {_KEYS}, head, round(macro_f1, 6) AS macro_f1 FROM f1"))
def macro_f1(ws: Workspace) -> DataFrame:
    return rounded(S.macro_f1(S.class_pairs(ws.scored)))


@job("confusion_matrix", query("""
SELECT x.track, x.model, x.split, x.head, x.label AS actual, y.label AS predicted, count(hd.sample_id) AS n
FROM (SELECT track, model, split, head, actual AS label FROM hd UNION SELECT track, model, split, head, predicted FROM hd) x
JOIN (SELECT track, model, split, head, actual AS label FROM hd UNION SELECT track, model, split, head, predicted FROM hd) y
  USING (track, model, split, head)
LEFT JOIN hd ON hd.head = x.head AND hd.track = x.track AND hd.model = x.model
  AND hd.split = x.split AND hd.actual = x.label AND hd.predicted = y.label
GROUP BY ALL"""))
def confusion_matrix(ws: Workspace) -> DataFrame:
    return S.confusion_matrix(S.class_pairs(ws.scored))


fragment("probs", " UNION ALL ".join(
    [f"SELECT booking_id AS id, 'facility' AS head, '{f.name}' AS c, {i} AS o, f_{f.slug} / n::DOUBLE AS p FROM f_run"
     for i, f in enumerate(P.facilities)]
    + [f"SELECT booking_id, 'usage_weekday', '{d}', {d}, d_{d} / n::DOUBLE FROM f_run"
       for d in range(7)]))


fragment("top3", """
SELECT track, model, split, head, count(DISTINCT sample_id) AS "rows", sum((c = actual)::INT) / count(DISTINCT sample_id) AS top_3_accuracy
FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, head ORDER BY p DESC, o) AS rn
  FROM (SELECT track, model, sample_id, split, head, actual, origin_booking_id AS id FROM hd
        JOIN (SELECT sample_id, origin_booking_id FROM smp) USING (sample_id) WHERE model = 'habit')
  JOIN probs USING (id, head)) WHERE rn <= 3 GROUP BY ALL""")


@job("top_k_accuracy", query('SELECT split, head, "rows", round(top_3_accuracy, 6) AS top_3_accuracy FROM top3'))
def top_k_accuracy(ws: Workspace) -> DataFrame:
    return rounded(share_hits(ws).groupBy("split", "head").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.col("hit").cast("int")).alias("top_3_accuracy")))


def share_hits(ws: Workspace) -> DataFrame:
    """Whether each sample's label is among the three largest shares of its history: the habit rule's probabilities."""
    # The row of an origin knows its next booking: only the hits leave the resident.
    facility = S.top_k(
        F.col("next_facility"),
        [(f.name, F.col(f"facility_share_{f.slug}")) for f in P.facilities], 3,
    )
    weekday = S.top_k(
        F.col("next_used_weekday").cast("string"),
        [(str(d), F.col(f"usage_weekday_share_{d}")) for d in range(7)], 3,
    )
    hits = ws.origin_rows().select(
        F.col("booking_id").alias("origin_booking_id"), facility.alias("_facility"), weekday.alias("_weekday")
    )
    cells = F.array(
        F.struct(F.lit("facility").alias("head"), F.col("_facility").alias("hit")),
        F.struct(F.lit("usage_weekday").alias("head"), F.col("_weekday").alias("hit")),
    )
    rows = ws.split_samples.select("split", "origin_booking_id").join(hits, "origin_booking_id")
    return rows.select("split", F.inline(cells))


_CIRC = """least((predicted_usage_hour - target_usage_hour + 24) % 24,
  24 - (predicted_usage_hour - target_usage_hour + 24) % 24)"""


@job("circular_hour_metrics", query(f"""
SELECT {_KEYS}, round(avg({_CIRC}), 6) AS hour_mae, round(avg(({_CIRC} <= 1)::INT), 6) AS within_1_hour
FROM sc GROUP BY ALL"""))
def circular_hour_metrics(ws: Workspace) -> DataFrame:
    return rounded(S.hour_metrics(ws.scored))


# A raw delay announced ten hours ahead of the prediction: some turn negative.
AHEAD = 600.0


@job("clamp_rate", query(f"""
SELECT {_KEYS}, round(avg(greatest(predicted_delay_minutes - {AHEAD}, 0)), 4) AS submitted_mean,
  round(avg((predicted_delay_minutes - {AHEAD} < 0)::INT), 6) AS clamp_rate FROM sc GROUP BY ALL"""))
def clamp_rate(ws: Workspace) -> DataFrame:
    raw = F.col("predicted_delay_minutes") - AHEAD
    return ws.scored.groupBy(*S.MODEL).agg(
        F.round(F.avg(S.submitted(raw)), 4).alias("submitted_mean"),
        F.round(F.avg((raw < 0).cast("int")), 6).alias("clamp_rate"),
    )


_AE = "abs(greatest(predicted_delay_minutes, 0) - notification_delay_minutes)"
_LR = "abs(ln((greatest(predicted_delay_minutes, 0) + 1) / (notification_delay_minutes + 1)))"
fragment("dm", f"""
SELECT track, model, split, avg({_AE}) AS mae_minutes,
  avg(greatest(predicted_delay_minutes, 0) - notification_delay_minutes) AS signed_bias_minutes,
  avg((predicted_delay_minutes < 0)::INT) AS clamp_rate,
  {', '.join(f"avg(({_AE} <= {m})::INT) AS within_{m}_minutes" for m in P.support_minutes)},
  quantile_cont({_AE}, 0.5) AS median_ae_minutes, quantile_cont({_AE}, 0.9) AS p90_ae_minutes,
  quantile_cont({_LR}, 0.5) AS median_abs_log_ratio FROM sc GROUP BY ALL""")
_DM = ["mae_minutes", "signed_bias_minutes", "clamp_rate",
       *(f"within_{m}_minutes" for m in P.support_minutes),
       "median_ae_minutes", "p90_ae_minutes", "median_abs_log_ratio"]


@job("delay_error_metrics", query(round_sql("SELECT * FROM dm", _KEYS, _DM, 5)))
def delay_error_metrics(ws: Workspace) -> DataFrame:
    return rounded(S.delay_metrics(ws.scored, ws.params), 5)


fragment("rep_sum", f"SELECT track, model, split, {SUMMARY} FROM sc GROUP BY ALL")
fragment("rep", f"""
{' UNION ALL '.join(f'SELECT track, model, split, {chr(39)}{n}{chr(39)} AS metric, "{n}"::DOUBLE AS value FROM rep_sum' for n in ("rows", *S.SUMMARY))}
UNION ALL SELECT track, model, split, head || '_accuracy', avg((actual = predicted)::INT) FROM hd
  GROUP BY track, model, split, head
UNION ALL SELECT track, model, split, head || '_macro_f1', macro_f1 FROM f1
UNION ALL SELECT track, model, split, 'hour_mae', avg({_CIRC}) FROM sc GROUP BY track, model, split
UNION ALL SELECT track, model, split, 'within_1_hour', avg(({_CIRC} <= 1)::INT) FROM sc
  GROUP BY track, model, split
UNION ALL SELECT track, model, split, 'raw_mae_minutes', avg(abs(predicted_delay_minutes - notification_delay_minutes))
  FROM sc GROUP BY track, model, split
UNION ALL SELECT track, model, split, 'raw_signed_bias_minutes', avg(predicted_delay_minutes - notification_delay_minutes)
  FROM sc GROUP BY track, model, split
UNION ALL SELECT track, model, split, 'recall_' || head || '_' || actual, avg((actual = predicted)::INT) FROM hd
  GROUP BY track, model, split, head, actual
UNION ALL SELECT track, model, split, head || '_top_3_accuracy', top_3_accuracy FROM top3
{' '.join(f"UNION ALL SELECT track, model, split, '{n}', {n} FROM dm" for n in _DM)}""")


def test_report(ws: Workspace) -> DataFrame:
    return S.evaluation_report(ws.scored_holdout, ws.params)


@job("evaluation_report", query(
    f"SELECT {_KEYS}, metric, round(value, 5) AS value FROM rep"))
def evaluation_report(ws: Workspace) -> DataFrame:
    who = ws.scored.filter("model = 'habit'").agg(F.min("track").alias("track"), F.min("model").alias("model"))
    likely = attach(share_hits(ws), who, "track", "model")
    return rounded(S.evaluation_report(ws.scored, ws.params, likely=likely), 5)


@job("compare_reports", query(f"""
SELECT metric, round(m, 5) AS model, round(b, 5) AS baseline, round(gain, 5) AS absolute,
  round(CASE WHEN metric = 'mae_minutes' THEN 1 - m / nullif(b, 0) ELSE (m - b) / nullif(b, 0) END, 5) AS relative,
  CASE WHEN metric = 'overall' THEN CASE WHEN gain > 0 THEN 'beats' WHEN gain < 0 THEN 'loses' ELSE 'ties' END
  END AS verdict
FROM (SELECT metric, m, b, CASE WHEN metric = 'mae_minutes' THEN b - m ELSE m - b END AS gain
  FROM (SELECT metric, max(value) FILTER (model = 'transition') AS m, max(value) FILTER (model = 'habit') AS b
    FROM rep WHERE split = 'test' AND metric IN ({quoted((*S.HEADS, 'overall', 'strict', 'mae_minutes'))}) GROUP BY metric))"""))
def compare_reports(ws: Workspace) -> DataFrame:
    return rounded(S.compare_reports(test_report(ws), "transition", "habit"), 5)


@job("leaderboard", query(round_sql(f"""
SELECT d.track, d.model, coalesce(s."rows", 0) AS "rows", s.* EXCLUDE (track, model, "rows")
FROM (SELECT DISTINCT track, model FROM pr UNION ALL SELECT 'llm', 'adapter') d LEFT JOIN (
  SELECT track, model, {SUMMARY} FROM sc WHERE sample_id IN (SELECT sample_id FROM cmp_ids)
  GROUP BY 1, 2) s USING (track, model)""", 'track, model, "rows"', S.SUMMARY)))
def leaderboard(ws: Workspace) -> DataFrame:
    # A third model that answered only training rows: listed, with no shared row.
    stray = ws.predictions.filter("model = 'habit'").join(
        ws.train.select("sample_id"), "sample_id", "left_semi"
    ).withColumns({"track": F.lit("llm"), "model": F.lit("adapter")})
    return rounded(
        S.leaderboard(ws.predictions.unionByName(stray), ws.scored, ws.comparison)
    )


@job("comparator_score", query(round_sql(
    f"SELECT {SUMMARY} FROM sc WHERE model = 'habit' AND split = 'validation'", '"rows"', S.SUMMARY)))
def comparator_score(ws: Workspace) -> DataFrame:
    return rounded(S.comparator(ws.scored, "habit", "validation"))


@job("metric_drift", query(f"""
SELECT {_KEYS}, metric, round(stored, 6) AS stored, round(value, 6) AS recomputed FROM (
  SELECT *, round(value, 3) AS stored FROM (SELECT {_KEYS}, metric, value FROM rep WHERE metric IN
    ({quoted(('rows', *S.SUMMARY))})))
WHERE abs(stored - value) > 1e-9"""))
def metric_drift(ws: Workspace) -> DataFrame:
    """A report published at three places against the recomputed one."""
    live = S.unpivot(S.match_summary(ws.scored), S.MODEL)
    path = T.scratch(ws.spark, "metrics")
    live.withColumn("value", F.round("value", 3)).write.json(path)
    stored = ws.spark.read.schema(live.schema).json(path)
    return rounded(S.metric_drift(stored, live, [*S.MODEL, "metric"]))


_RATES = " UNION ALL ".join(
    f"SELECT '{h}' AS head, model, avg(match_{h}::INT) AS rate, {i} AS ho FROM sc "
    f"WHERE split = 'validation' GROUP BY model" for i, h in enumerate(S.HEADS))
fragment("chosen", f"""
SELECT head, model AS source, rate FROM (SELECT *, row_number() OVER (PARTITION BY head
  ORDER BY rate DESC, CASE model WHEN 'habit' THEN 0 ELSE 1 END) AS rn FROM ({_RATES})) WHERE rn = 1""")
ORDER = ("habit", "transition")


def head_sources(ws: Workspace) -> DataFrame:
    return S.select_sources(ws.scored.filter("split = 'validation'"), ORDER)


@job("select_head_sources", query("SELECT head, source, round(rate, 6) AS rate FROM chosen"))
def select_head_sources(ws: Workspace) -> DataFrame:
    return rounded(head_sources(ws))


def _take(head: str, column: str) -> str:
    return (f"max({column}) FILTER (model = (SELECT source FROM chosen WHERE head = '{head}')) "
            f"AS {column}")


@job("compose_predictions", query(f"""
SELECT sample_id, {_take('facility', 'predicted_facility_id')},
  {_take('usage_weekday', 'predicted_usage_weekday')}, {_take('usage_hour', 'predicted_usage_hour')},
  round(max(predicted_delay_minutes) FILTER (model =
    (SELECT source FROM chosen WHERE head = 'notification')), 6) AS predicted_delay_minutes
FROM pr GROUP BY 1"""))
def compose_predictions(ws: Workspace) -> DataFrame:
    return rounded(S.compose(ws.predictions, head_sources(ws), ORDER))


def resampled(name: str, rows: str, row: str) -> None:
    """Fragment ``name``: the rows of a table with their weight ``w`` in every resample ``b``.

    First a Poisson count of a rate a little under one, from the definition of its
    distribution; then draws of single places up to the number of rows.
    """
    def word(at: int) -> str:
        return f"('0x' || substr(key, {at}, 8))::UBIGINT"

    terms = [f"pow(rate, {k}) / {math.factorial(k)}::DOUBLE" for k in range(12)]
    count = " + ".join(f"(u >= ceil(({' + '.join(terms[:k + 1])}) * exp(-rate) * 4294967296))::INT" for k in range(12))
    fragment(f"{name}_rows", f"""
SELECT *, {word(1)} AS h1, {word(9)} AS h2, greatest(0, 1 - {S.SHORT}::DOUBLE / sqrt(n)) AS rate FROM (
  SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY {row}) AS place, md5('{P.seed}|bootstrap|' || {row}) AS key FROM {rows})""")
    fragment(f"{name}_first", f"""
SELECT place, b, {count} AS w FROM (
  SELECT place, rate, b, (h1 + b::UBIGINT * h2) % {S.PRIME} AS u FROM {name}_rows, range({P.resamples}) r(b))""")
    fragment(f"{name}_totals", f"""
SELECT b, CASE WHEN m <= n THEN m ELSE 0 END AS m, n
FROM (SELECT b, sum(w)::BIGINT AS m FROM {name}_first GROUP BY 1), (SELECT count(*) AS n FROM {name}_rows)""")
    fragment(f"{name}_second", f"""
SELECT ('0x' || substr(md5('{P.seed}|draw|' || b || '|' || i), 1, 13))::BIGINT % n + 1 AS place, b, 1 AS w
FROM (SELECT b, n, unnest(range(n - m)) AS i FROM {name}_totals)""")
    fragment(name, f"""
SELECT r.*, b, w FROM {name}_rows r JOIN (
  SELECT place, b, w FROM {name}_first SEMI JOIN (SELECT b FROM {name}_totals WHERE m > 0) USING (b) WHERE w > 0
  UNION ALL SELECT * FROM {name}_second) USING (place)""")


fragment("diffs", """
SELECT sample_id, (max(score) FILTER (model = 'transition') - max(score) FILTER (model = 'habit')) / 4.0::DOUBLE AS diff
FROM sc WHERE sample_id IN (SELECT sample_id FROM cmp_ids) GROUP BY 1""")
resampled("pairs", "diffs", "sample_id")


@job("paired_bootstrap", query(f"""
SELECT (SELECT count(*) FROM diffs) AS "rows", round((SELECT avg(diff) FROM diffs), 6) AS mean_difference,
  round(quantile_cont(m, {(1 - P.level) / 2!r}::DOUBLE), 6) AS lower,
  round(quantile_cont(m, {1 - (1 - P.level) / 2!r}::DOUBLE), 6) AS upper
FROM (SELECT sum(w * diff) / sum(w) AS m FROM pairs GROUP BY b)"""))
def paired_bootstrap(ws: Workspace) -> DataFrame:
    diffs = S.paired_differences(ws.scored, "habit", "transition", ws.comparison)
    return rounded(S.paired_bootstrap(diffs, ws.params))


def answer_records(ws: Workspace) -> DataFrame:
    """Events as answer records: the value is the latency in seconds."""
    k = F.get_json_object("props", "$.k").cast("int")
    return ws.table("events").select(
        F.col("event_id").cast("string").alias("sample_id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("valid").alias("status"),
        F.when(k > 75, 2).otherwise(1).alias("attempts"),
        F.when(F.col("event_type") == "signup", "closed").alias("semantic_invalid_reason"),
        F.col("value").alias("seconds"), k.alias("prompt_tokens"),
        F.length("event_type").alias("completion_tokens"),
    )


@job("operational_metrics", """
SELECT count(*) AS "rows", count(*) FILTER (event_type <> 'error') AS valid,
  count(*) FILTER (event_type = 'error') AS failed,
  count(*) FILTER (CAST(props->>'$.k' AS INTEGER) > 75) AS retried,
  count(*) FILTER (event_type = 'signup') AS semantic_invalid,
  quantile_cont(value, 0.5) AS latency_p50_seconds,
  round(quantile_cont(value, 0.95), 6) AS latency_p95_seconds, round(sum(value), 4) AS elapsed_seconds,
  round(avg(CAST(props->>'$.k' AS INTEGER)), 6) AS prompt_tokens_mean,
  round(avg(length(event_type)), 6) AS completion_tokens_mean FROM events""")
def operational_metrics(ws: Workspace) -> DataFrame:
    out = S.operational(answer_records(ws))
    return out.select(*(
        F.round(n, 4 if n == "elapsed_seconds" else 6).alias(n) if k == "double" else F.col(n)
        for n, k in out.dtypes
    ))


# ------------------------------------------------------------------ slices

_CUT = statistics.median(f.popularity for f in P.facilities)
_HEAD = quoted(f.name for f in P.facilities if f.popularity >= _CUT)
fragment("habit_test", "SELECT * FROM sct WHERE model = 'habit'")
fragment("sl", f"""
SELECT h.*, CASE WHEN pct <= 0.25 THEN 'q1' WHEN pct <= 0.5 THEN 'q2' WHEN pct <= 0.75 THEN 'q3' ELSE 'q4' END
    AS activity_quartile,
  CASE WHEN n_prior_bookings < 5 THEN 'under_5_prior' ELSE '5_or_more' END AS sparse_history,
  CASE WHEN target_facility_id IN ({_HEAD}) THEN 'head' ELSE 'tail' END AS facility_band,
  CASE WHEN n_prior_bookings >= (SELECT quantile_cont(n_prior_bookings, 0.5) FROM habit_test)
    THEN 'long' ELSE 'short' END AS history_length,
  CASE WHEN target_usage_weekday >= 5 THEN 'weekend' ELSE 'weekday' END AS day_type,
  CASE WHEN notification_delay_minutes < 360 THEN 'under_6h' WHEN notification_delay_minutes < 1440 THEN '6h_to_1d'
    WHEN notification_delay_minutes < 4320 THEN '1d_to_3d' ELSE 'over_3d' END AS lead_bucket,
  CASE WHEN resident_id IN (SELECT resident_id FROM tr) THEN 'seen_in_training'
    ELSE 'unseen_in_training' END AS cold_start_resident
FROM (SELECT *, (rank() OVER (ORDER BY n_prior_bookings) - 1
    + (count(*) OVER (PARTITION BY n_prior_bookings) + 1) / 2.0::DOUBLE) / count(*) OVER () AS pct
  FROM habit_test) h""")
_DIMS = ", ".join(L.DIMENSIONS)


def sliced(ws: Workspace) -> DataFrame:
    rows = ws.scored_holdout.filter("model = 'habit'")
    return L.slice_columns(rows, ws.train, ws.params)


@job("slice_columns", query(f"SELECT sample_id, {_DIMS} FROM sl"))
def slice_columns(ws: Workspace) -> DataFrame:
    return sliced(ws).select("sample_id", *L.DIMENSIONS)


_SLICE = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS slice, {SUMMARY} FROM sl GROUP BY {d}" for d in L.DIMENSIONS)
_SLICE_ROUND = ", ".join(f"round({m}, 4) AS {m}" for m in S.SUMMARY)


@job("slice_report", query(f"""
SELECT dimension, slice, "rows", round("rows" / (SELECT count(*) FROM sl), 4) AS share_of_split, {_SLICE_ROUND}
FROM ({_SLICE})"""))
def slice_report(ws: Workspace) -> DataFrame:
    return L.slice_report(sliced(ws))


@job("slice_partition_check", query(f"""
SELECT dimension, CAST(sum("rows") AS BIGINT) AS "rows", count(*) FILTER (overall < 0 OR overall > 1) AS out_of_range,
  (SELECT count(*) FROM sl) AS split_rows,
  sum("rows") = (SELECT count(*) FROM sl) AND count(*) FILTER (overall < 0 OR overall > 1) = 0 AS passed
FROM ({_SLICE}) GROUP BY 1"""))
def slice_partition_check(ws: Workspace) -> DataFrame:
    rows = sliced(ws)
    return L.partition_check(L.slice_report(rows), rows)


@job("top_confusions", query("""
SELECT head, actual, predicted, n, CAST(rn AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY head ORDER BY n DESC, actual, predicted) AS rn FROM (
    SELECT head, actual, predicted, count(*) AS n FROM hd
    WHERE model = 'habit' AND split = 'test' AND actual <> predicted GROUP BY ALL)) WHERE rn <= 10"""))
def top_confusions(ws: Workspace) -> DataFrame:
    return L.top_confusions(S.class_pairs(ws.scored_holdout.filter("model = 'habit'"), []))


@job("largest_delay_errors", query(f"""
SELECT sample_id, round(notification_delay_minutes, 6) AS actual_minutes,
  round(greatest(predicted_delay_minutes, 0), 6) AS submitted_minutes, round({_AE}, 6) AS error_minutes
FROM habit_test ORDER BY {_AE} DESC, sample_id LIMIT 20"""))
def largest_delay_errors(ws: Workspace) -> DataFrame:
    return rounded(L.largest_delay_errors(ws.scored_holdout.filter("model = 'habit'")))


# ---------------------------------------------------------------- profiles

fragment("ld", "SELECT booking_id, facility_id, (usage_us - us) / 3.6e9::DOUBLE AS lh FROM bk")
_QS = ", ".join(f"round(quantile_cont(lh, {q}), 6) AS {n}" for n, q in Q.QUANTILES.items())


@job("lead_quantiles", query(f"""
SELECT facility_id, count(*) AS n, {_QS}, round(avg(lh), 6) AS mean,
  round(avg(lh) / nullif(quantile_cont(lh, 0.5), 0), 6) AS mean_over_median
FROM (SELECT facility_id, lh FROM ld UNION ALL SELECT '(all)', lh FROM ld) GROUP BY 1"""))
def lead_quantiles(ws: Workspace) -> DataFrame:
    return rounded(Q.lead_quantiles(lead_hours(ws)))


resampled("leads", "ld", "booking_id")
_TAILS = (repr((1 - P.level) / 2), repr(1 - (1 - P.level) / 2))


@job("resample_sizes", query(f"SELECT range AS b, (SELECT count(*) FROM ld) AS drawn FROM range({P.resamples})"))
def resample_sizes(ws: Workspace) -> DataFrame:
    """Draws of every resample: as many as there are rows."""
    return S.resample_sizes(lead_hours(ws), "booking_id", ws.params)


@job("bootstrap_mean_ci", query(f"""
SELECT (SELECT count(*) FROM ld) AS "rows", round((SELECT avg(lh) FROM ld), 6) AS mean,
  round(quantile_cont(m, {_TAILS[0]}::DOUBLE), 6) AS lower, round(quantile_cont(m, {_TAILS[1]}::DOUBLE), 6) AS upper
FROM (SELECT sum(w * lh) / sum(w) AS m FROM leads GROUP BY b)"""))
def bootstrap_mean_ci(ws: Workspace) -> DataFrame:
    return rounded(S.bootstrap_mean(lead_hours(ws), "booking_id", "lead_hours", ws.params))


_POP = f"""
SELECT d.facility_id, d.popularity AS configured, coalesce(n, 0) / sum(coalesce(n, 0)) OVER () AS realised,
  coalesce(n, 0) / sum(coalesce(n, 0)) OVER () - d.popularity AS deviation, lower, upper, coalesce(n, 0) AS bookings
FROM ({values((f"'{f.name}'", f"{f.popularity}::DOUBLE") for f in P.facilities)}) d(facility_id, popularity)
LEFT JOIN (SELECT facility_id, count(*) AS n FROM bk GROUP BY 1) USING (facility_id)
LEFT JOIN (SELECT facility_id, quantile_cont(m, {_TAILS[0]}::DOUBLE) AS lower,
    quantile_cont(m, {_TAILS[1]}::DOUBLE) AS upper FROM (
  SELECT facility_id, c / sum(c) OVER (PARTITION BY b) AS m FROM (
    SELECT b, facility_id, sum(w) AS c FROM leads GROUP BY 1, 2))
  GROUP BY 1) USING (facility_id)"""


@job("popularity_profile", query(round_sql(
    _POP, "facility_id, bookings", ["configured", "realised", "deviation", "lower", "upper"])))
def popularity_profile(ws: Workspace) -> DataFrame:
    return rounded(Q.popularity(ws.bookings, ws.params))


@job("activity_profile", query(f"""
SELECT count(*) AS residents_configured, count(*) FILTER (n > 0) AS residents_with_bookings,
  round(avg((n < 5)::INT), 6) AS sparse_share,
  {', '.join(f"round(quantile_cont(n::DOUBLE, {q}), 6) AS {k}" for k, q in Q.QUANTILES.items())}
FROM (SELECT coalesce(n, 0) AS n FROM (SELECT CAST(c_custkey AS VARCHAR) AS resident_id FROM customer)
  LEFT JOIN (SELECT resident_id, count(*) AS n FROM bk GROUP BY 1) USING (resident_id))"""))
def activity_profile(ws: Workspace) -> DataFrame:
    return rounded(Q.activity(ws.bookings, ws.roster, ws.params))


_PERIODS = """
SELECT 'day' AS unit, CAST(date_trunc('day', usage_timestamp) AS TIMESTAMP) AS period, facility_id, count(*) AS bookings
FROM bk GROUP BY ALL UNION ALL
SELECT 'month', CAST(date_trunc('month', usage_timestamp) AS TIMESTAMP), facility_id, count(*) FROM ob GROUP BY ALL"""


@job("monthly_shares", query(f"""
SELECT unit, period, facility_id, bookings,
  round(bookings / sum(bookings) OVER (PARTITION BY unit, period), 6) AS share FROM ({_PERIODS})"""))
def monthly_shares(ws: Workspace) -> DataFrame:
    """Days on the 30-day events, months on the seven years of orders."""
    days = Q.period_shares(ws.bookings, "day").select(F.lit("day").alias("unit"), "*")
    months = Q.period_shares(ws.orders, "month").select(F.lit("month").alias("unit"), "*")
    return rounded(days.unionByName(months))


@job("profile_checks", query(f"""
SELECT "check", violations, violations = 0 AS passed FROM (
  SELECT 'popularity_sums_to_one' AS "check", (abs(sum(realised) - 1) > 0.01)::BIGINT AS violations FROM ({_POP})
  UNION ALL SELECT 'realised_inside_interval', count(*) FILTER (NOT (realised BETWEEN lower AND upper)) FROM ({_POP})
  UNION ALL SELECT 'lead_quantiles_monotone', count(*) FILTER (p05 > p25 OR p25 > p50 OR p50 > p75 OR p75 > p95)
    FROM (SELECT facility_id, {', '.join(f"quantile_cont(lh, {q}) AS {k}" for k, q in Q.QUANTILES.items())}
      FROM ld GROUP BY 1)
  UNION ALL SELECT 'lead_right_skewed', (avg(lh) <= quantile_cont(lh, 0.5))::BIGINT FROM ld
  UNION ALL SELECT 'residents_within_roster', ((SELECT count(DISTINCT resident_id) FROM bk
    WHERE resident_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)) > (SELECT count(*) FROM customer))::BIGINT
  UNION ALL SELECT 'period_shares_sum_to_one', 0::BIGINT)"""))
def profile_checks(ws: Workspace) -> DataFrame:
    return Q.profile_checks(
        Q.popularity(ws.bookings, ws.params), Q.lead_quantiles(lead_hours(ws)),
        Q.activity(ws.bookings, ws.roster, ws.params), Q.period_shares(ws.bookings, "day"),
    )
