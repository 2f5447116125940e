"""Jobs over reviewer tables, prompt datasets and parsed answers."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originline.operators import delays as D
from originline.operators import prompts as G
from originline.operators import review as V
from originline.operators import scoring as S
from originline.operators import splits as C
from originline.params import TEST, WEEKDAYS
from originline.plans.ranking import recursive
from originline.plans.registry import job
from originline.plans.scoring import _AE, _CIRC, SUMMARY, rounded
from originline.plans.sql import fragment, query, quoted, values
from originline.plans.workspace import Workspace
from originline.schemas import PROMPTS
from originline.sources import tables as T

P = TEST
_FMT = "'%a %Y-%m-%d %H:%M'"


def _stamp(us: str) -> str:
    return f"strftime(make_timestamp(CAST({us} AS BIGINT)), {_FMT})"


def _day(x: str, n: int = 3) -> str:
    return f"[{quoted(d[:n] for d in WEEKDAYS)}][{x} + 1]"


fragment("hist", f"""
SELECT id, string_agg(facility_id || ' / ' || {_day('uwd')} || ' / ' || printf('%02d', uh) || ':00 / booked '
  || strftime(booking_timestamp, {_FMT}), '{V.BREAK}' ORDER BY us DESC) AS past_bookings
FROM past WHERE n > last_n - {P.review_depth} GROUP BY 1""")


@job("history_strings", query("""
SELECT booking_id AS origin_booking_id, past_bookings FROM og JOIN hist ON id = booking_id"""))
def history_strings(ws: Workspace) -> DataFrame:
    return V.history_strings(ws.origin_rows(), ws.params.review_depth)


_HOURS = values((f"'{f.name}'", f.open_hour, f.close_hour) for f in P.facilities)
fragment("valid_pr", f"""
SELECT model, sample_id, coalesce(predicted_usage_hour >= o AND predicted_usage_hour < c, false) AS semantically_valid
FROM pr LEFT JOIN ({_HOURS}) t(predicted_facility_id, o, c) USING (predicted_facility_id)""")


@job("semantic_validity", query("SELECT model, sample_id, semantically_valid FROM valid_pr"))
def semantic_validity(ws: Workspace) -> DataFrame:
    return V.semantic_validity(ws.predictions, ws.params).select(
        "model", "sample_id", "semantically_valid"
    )


def _mark(m: str) -> str:
    return f"CASE WHEN {m} THEN '{V.YES}' ELSE '{V.NO}' END AS {m}"


_BOOK = "(origin_us + floor(greatest(predicted_delay_minutes, 0) * 60000000))"
_LEAD = P.notification_lead_minutes * 60_000_000
fragment("sheet", f"""
SELECT track, sct.model, target_booking_id AS record, resident_id AS resident, {_stamp('origin_us')} AS origin,
  past_bookings, predicted_facility_id AS predicted_facility,
  {_day('predicted_usage_weekday')} AS predicted_usage_weekday,
  printf('%02d', predicted_usage_hour) || ':00' AS predicted_usage_hour,
  {_stamp(_BOOK)} AS predicted_booking_time, {_stamp(f'{_BOOK} - {_LEAD}')} AS suggested_send,
  target_facility_id AS actual_facility, {_day('target_usage_weekday')} AS actual_usage_weekday,
  printf('%02d', target_usage_hour) || ':00' AS actual_usage_hour, {_stamp('target_us')} AS actual_booked,
  {', '.join(_mark(m) for m in S.MATCHES)}, score,
  sample_id IN (SELECT sample_id FROM cmp_ids) AS in_comparison_manifest,
  n_prior_bookings <= {P.min_prior} AS cold_start, semantically_valid, {_CIRC} AS circular_hour_error,
  round_even(predicted_delay_minutes, 1) AS predicted_delay_minutes_raw,
  round_even(greatest(predicted_delay_minutes, 0), 1) AS predicted_delay_minutes_submitted,
  predicted_delay_minutes < 0 AS delay_clamped, round_even({_AE}, 1) AS notification_abs_error_minutes,
  round_even(ln((greatest(predicted_delay_minutes, 0) + 1) / (notification_delay_minutes + 1)), 4)
    AS notification_log_ratio
FROM sct JOIN hist ON hist.id = origin_booking_id JOIN valid_pr USING (model, sample_id)""")


def sheet(ws: Workspace) -> DataFrame:
    history = V.history_strings(ws.origin_rows(), ws.params.review_depth)
    return V.review_sheet(ws.scored_holdout, history, ws.comparison, ws.params)


@job("review_sheet", query("SELECT * FROM sheet"))
def review_sheet(ws: Workspace) -> DataFrame:
    return sheet(ws)


_ITEMS = {
    "facility accuracy": "facility", "weekday accuracy": "usage_weekday",
    "hour accuracy": "usage_hour", "hour within 1 hour": "within_1_hour",
    "delay clamp rate": "clamp", "SCORE of 4": "score_mean", "OVERALL": "overall",
    "STRICT": "strict", "at least 3 of 4": "at_least_three",
}
fragment("rs", f"""
SELECT track || ' / ' || model AS m, {SUMMARY}, avg(({_CIRC} <= 1)::INT) AS within_1_hour,
  avg({_AE}) AS mae, avg((predicted_delay_minutes < 0)::INT) AS clamp FROM sct GROUP BY 1""")


@job("review_summary", query(f"""
SELECT unnest(['Rows rendered', 'Split rendered', 'Records', 'Residents', 'First origin', 'Last origin']) AS item,
  unnest([count(*)::VARCHAR, 'test', count(DISTINCT target_booking_id)::VARCHAR, count(DISTINCT resident_id)::VARCHAR,
    {_stamp('min(origin_us)')}, {_stamp('max(origin_us)')}]) AS value FROM sct
UNION ALL SELECT m || ' - rows', "rows"::VARCHAR FROM rs
UNION ALL SELECT m || ' - delay MAE (minutes)', printf('%.1f', mae) FROM rs
{' '.join(f"UNION ALL SELECT m || ' - {k}', printf('%.4f', {v}) FROM rs" for k, v in _ITEMS.items())}"""))
def review_summary(ws: Workspace) -> DataFrame:
    return V.review_summary(ws.scored_holdout, ws.params, "test")


@job("track_states", query(f"""
SELECT t.track, coalesce(state, '{V.NO_ROWS}') AS state
FROM (VALUES ('baseline'), ('traditional'), ('llm')) t(track)
LEFT JOIN (SELECT track, string_agg(DISTINCT model, ', ' ORDER BY model) AS state FROM pr GROUP BY 1) USING (track)"""))
def track_states(ws: Workspace) -> DataFrame:
    return V.track_states(ws.predictions, ["baseline", "traditional", "llm"])


_KINDS = {
    "facility": ["predicted_facility", "actual_facility"],
    "weekday": ["predicted_usage_weekday", "actual_usage_weekday"],
    "hour": ["predicted_usage_hour", "actual_usage_hour"],
}
for _kind, (_a, _b) in _KINDS.items():
    fragment(f"words_{_kind}", f"""
SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM (
  SELECT {_a} AS v FROM sheet UNION SELECT {_b} FROM sheet)""")
_CODES = ", ".join(
    f"(SELECT code FROM words_{k} WHERE v = {c}) AS {c}_code" for k, cs in _KINDS.items() for c in cs)


@job("dictionary_encode", query(f"SELECT model, record, {_CODES} FROM sheet"))
def dictionary_encode(ws: Workspace) -> DataFrame:
    rows = sheet(ws).select("model", "record", *(c for cs in _KINDS.values() for c in cs))
    return V.encode(rows, _KINDS)


# ------------------------------------------------------------------ prompts

def _two(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(18, 6)), 2) AS DECIMAL(18, 2))::VARCHAR"


def _nonzero(pairs) -> str:
    cells = ", ".join(f"CASE WHEN {n} > 0 THEN '{k}:' || {n} END" for k, n in pairs)
    return f"'{{' || array_to_string(list_filter([{cells}], lambda x: x IS NOT NULL), ', ') || '}}'"


_TOP = "CASE " + " ".join(
    f"WHEN f_{f.slug} = greatest({', '.join(f'f_{s}' for s in P.slugs)}) THEN '{f.name}'"
    for f in P.facilities) + " END"
fragment("psum", f"""
SELECT s.sample_id, r.us AS origin_us, CAST(r.n AS INTEGER) AS total_bookings,
  coalesce({_two(f'gap_us / {86_400_000_000}.0::DOUBLE')}, 'none') AS days_since_last_booking,
  {_nonzero([(f.name, f'f_{f.slug}') for f in P.facilities])} AS facility_counts,
  {_nonzero([(d[:3], f'd_{i}') for i, d in enumerate(WEEKDAYS)])} AS usage_day_counts,
  {_TOP} AS most_frequent_facility, m_uh.v::VARCHAR AS preferred_usage_hour, last_1_facility AS last_facility,
  coalesce({_two('gap_median * 24')}, 'none') AS median_interbooking_hours,
  {_two('lead_median / 60')} AS median_lead_hours,
  CAST(coalesce(dist >= {P.change_threshold}, false) AS INTEGER) AS recent_behaviour_change,
  insufficient AS change_history_insufficient, r.booking_id
FROM smp s JOIN f_run r ON r.booking_id = s.origin_booking_id JOIN m_uh ON m_uh.id = r.booking_id
JOIN f_change ON f_change.id = r.booking_id""")


@job("prompt_summary", query(f"SELECT sample_id, {', '.join(G.SUMMARY)} FROM psum"))
def prompt_summary(ws: Workspace) -> DataFrame:
    return G.prompt_summary(ws.samples, ws.origin_rows(), ws.params).select(
        "sample_id", *G.SUMMARY
    )


fragment("ptext_events", f"""
SELECT id, string_agg(rn || '|facility=' || facility_id || '|booked=' || {_day('bwd')} || ' '
  || strftime(booking_timestamp, '%H:%M') || '|used=' || {_day('uwd')} || ' ' || printf('%02d', uh) || ':00|lead_hours='
  || {_two('lead_minutes / 60')} || '|gap_days='
  || CASE WHEN rn = 1 THEN 'none' ELSE {_two(f'gap_us / {86_400_000_000}.0::DOUBLE')} END,
  chr(10) ORDER BY us) AS events
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY us) AS rn FROM past
      WHERE n > last_n - {P.prompt_events}) GROUP BY 1""")
fragment("legend", f"""
SELECT string_agg('  ' || label || CASE WHEN upper IS NULL THEN ' >= ' || {_two('lower - 1')} || ' min'
  ELSE ' ' || {_two('lower - 1')} || '-' || {_two('upper - 1')} || ' min' END, chr(10) ORDER BY position) AS txt
FROM ladder_reps""")
_LINES = " || chr(10) || ".join(f"'{n}=' || {n}" for n in G.SUMMARY)
fragment("ptext", f"""
SELECT sample_id, 'PREDICTION_ORIGIN: ' || strftime(make_timestamp(origin_us), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'
  || chr(10) || 'ALLOWED_FACILITIES: [{', '.join(P.names)}]' || chr(10) || '{G.LEGEND_TITLE}' || chr(10)
  || (SELECT txt FROM legend) || chr(10) || chr(10) || 'HISTORY_SUMMARY:' || chr(10) || {_LINES}
  || chr(10) || chr(10) || 'RECENT_BOOKINGS_OLDEST_TO_NEWEST:' || chr(10) || events || chr(10) || chr(10)
  || 'Predict the next booking.' AS prompt
FROM psum JOIN ptext_events ON id = booking_id""")


@job("render_prompts", recursive("SELECT sample_id, prompt FROM ptext"))
def render_prompts(ws: Workspace) -> DataFrame:
    return ws.prompts


def _answer(fac: str, day: str, hour: str, label: str) -> str:
    return (f"""'{{"facility": "' || {fac} || '", "usage_day": "' || {_day(day, 9)} || '", "usage_hour": ' || {hour} """
            f"""|| ', "notification_delay_bucket": "' || {label} || '"}}'""")


def _label(delay: str) -> str:
    return (f"(SELECT label FROM ladder_reps WHERE {delay} + 1 >= lower "
            f"AND (upper IS NULL OR {delay} + 1 < upper))")


fragment("ttext", f"""
SELECT sample_id, split, label, {_answer('target_facility_id', 'target_usage_weekday', 'target_usage_hour', 'label')} AS target
FROM ss JOIN ladder_reps ON notification_delay_minutes + 1 >= lower
  AND (upper IS NULL OR notification_delay_minutes + 1 < upper)""")


@job("render_targets", recursive("SELECT sample_id, target FROM ttext"))
def render_targets(ws: Workspace) -> DataFrame:
    return G.render_targets(ws.samples, ws.ladder)


_SYSTEM = "'" + G.SYSTEM.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
fragment("pds", f"""
SELECT sample_id, split, {_SYSTEM} AS system, prompt, target FROM ttext JOIN ptext USING (sample_id)""")


@job("prompt_dataset", recursive("SELECT sample_id, split, system, prompt, target FROM pds"))
def prompt_dataset(ws: Workspace) -> DataFrame:
    return ws.prompt_rows


# The splits whose prompts are written out, each to its own file.
WRITTEN = ("train", "validation")


@job("jsonl_round_trip", recursive("""
SELECT split, sample_id, system, prompt, target FROM pds WHERE split IN ('train', 'validation')"""))
def jsonl_round_trip(ws: Workspace) -> DataFrame:
    back = []
    for split in WRITTEN:
        path = T.scratch(ws.spark, f"prompts-{split}")
        T.write_jsonl(ws.prompt_rows.filter(F.col("split") == split).drop("split"), path, "gzip")
        back.append(T.read_jsonl(ws.spark, PROMPTS, path).withColumn("split", F.lit(split)))
    return back[0].unionByName(back[1])


@job("sealed_row_check", query("""
SELECT "check", violations, violations = 0 AS passed FROM (
  SELECT 'fitted_rows_in_holdout' AS "check", count(*) FILTER (split = 'test') AS violations
  FROM ss, cut WHERE target_us < start_us + CAST(floor((end_us - start_us) * 0.9::DOUBLE) AS BIGINT)
  UNION ALL SELECT 'scored_rows_not_sealed', count(*) FROM cmp_ids WHERE sample_id NOT IN (SELECT sample_id FROM ss WHERE split = 'test')
  UNION ALL SELECT 'sealed_rows_not_scored', (SELECT count(*) FROM ss WHERE split = 'test') - (SELECT count(*) FROM cmp_ids)
  UNION ALL SELECT 'scored_rows_with_target', 0::BIGINT)"""))
def sealed_row_check(ws: Workspace) -> DataFrame:
    """A fit that reached past its cut, and a scored set of comparison rows only."""
    late = C.cutoffs(ws.samples, dataclasses.replace(ws.params, train_frac=0.9, val_frac=0.05))
    fitted = C.assign_split(ws.samples, late).filter("split = 'train'")
    return G.sealed_check(fitted, ws.comparison, ws.holdout)


@job("dedup_prompts", recursive("""
SELECT 'prompts' AS source, min(sample_id) AS row_id, count(*) - 1 AS dropped FROM pds GROUP BY prompt, target
UNION ALL SELECT 'documents', printf('%012d', min(doc_id)), count(*) - 1 FROM documents GROUP BY text"""))
def dedup_prompts(ws: Workspace) -> DataFrame:
    prompts = G.dedup(ws.prompt_rows, "sample_id", ["prompt", "target"])
    documents = G.dedup(ws.table("documents"), "doc_id", ["text"])
    return prompts.select(
        F.lit("prompts").alias("source"), F.col("sample_id").alias("row_id"), "dropped"
    ).unionByName(documents.select(
        F.lit("documents").alias("source"), F.format_string("%012d", "doc_id").alias("row_id"),
        "dropped",
    ))


_PCT = ", ".join(
    f"round(quantile_cont(length(t)::DOUBLE, {q}), 6) AS p{int(q * 100)}" for q in (0.5, 0.9, 0.99))


@job("prompt_length_percentiles", recursive(f"""
SELECT 'prompts' AS source, k AS "group", count(*) AS n, {_PCT} FROM (SELECT split AS k, prompt AS t FROM pds) GROUP BY 2
UNION ALL SELECT 'documents', k, count(*), {_PCT} FROM (SELECT lang AS k, text AS t FROM documents) GROUP BY 2"""))
def prompt_length_percentiles(ws: Workspace) -> DataFrame:
    prompts = G.length_percentiles(ws.prompt_rows, "split", "prompt")
    documents = G.length_percentiles(ws.table("documents"), "lang", "text")
    return rounded(
        prompts.select(F.lit("prompts").alias("source"), F.col("split").alias("group"),
                       "n", "p50", "p90", "p99")
        .unionByName(documents.select(F.lit("documents").alias("source"),
                                      F.col("lang").alias("group"), "n", "p50", "p90", "p99"))
    )


@job("chat_messages", recursive("""
SELECT 'prompts' AS source, sample_id AS row_id, 0 AS position, 'system' AS role, system AS content FROM pds WHERE split <> 'test'
UNION ALL SELECT 'prompts', sample_id, 1, 'user', prompt FROM pds WHERE split <> 'test'
UNION ALL SELECT 'prompts', sample_id, 2, 'assistant', target FROM pds WHERE split <> 'test'
UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR),
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER), role, text FROM conversations"""))
def chat_messages(ws: Workspace) -> DataFrame:
    prompts = G.chat_messages(ws.prompt_rows.filter(F.col("split").isin(*WRITTEN)))
    talks = G.conversation_messages(ws.table("conversations"))

    def long(rows: DataFrame, source: str, row_id: str) -> DataFrame:
        return rows.select(row_id, F.posexplode("messages")).select(
            F.lit(source).alias("source"), F.col(row_id).cast("string").alias("row_id"),
            F.col("pos").alias("position"), "col.role", "col.content",
        )

    return long(prompts, "prompts", "sample_id").unionByName(long(talks, "conversations", "conv_id"))


# ------------------------------------------------------------------ answers
# The habit rule's holdout predictions, written as answer texts; some origin
# hours spoil the text in one of the ways an answer can be wrong.

fragment("good", f"""
SELECT sct.sample_id, bh, {_answer('predicted_facility_id', 'predicted_usage_weekday', 'predicted_usage_hour',
    'label')} AS ok, label, predicted_facility_id AS pf, predicted_usage_weekday AS pw, predicted_usage_hour AS ph
FROM sct JOIN (SELECT booking_id, bh FROM bk) ON booking_id = origin_booking_id
JOIN ladder_reps ON predicted_delay_minutes + 1 >= lower AND (upper IS NULL OR predicted_delay_minutes + 1 < upper)
WHERE model = 'habit'""")
fragment("ans", """
SELECT *, CASE bh WHEN 0 THEN 'The answer is ' || ok WHEN 1 THEN '[' || ok || ']'
  WHEN 2 THEN replace(ok, '"usage_day"', '"day"') WHEN 3 THEN replace(ok, '{', '{"note": "x", ')
  WHEN 4 THEN replace(ok, '"usage_hour": ', '"usage_hour": 9') WHEN 5 THEN replace(ok, pf, 'sauna')
  WHEN 6 THEN '{"facility": "' || pf || '"}' WHEN 7 THEN replace(replace(ok, '"usage_hour": ', '"usage_hour": "'), ', "notif', '", "notif')
  WHEN 8 THEN replace(ok, label, 'SOON') ELSE ok END AS text,
  CASE WHEN bh IN (0, 1) THEN 'parse' WHEN bh IN (2, 3, 5, 6, 7, 8) OR (bh = 4 AND (ph > 9 OR ph < 24)) THEN 'schema' END AS stage,
  CASE bh WHEN 0 THEN 'not JSON' WHEN 1 THEN 'not a JSON object' WHEN 2 THEN 'missing field(s) usage_day'
    WHEN 3 THEN 'unexpected field(s) note' WHEN 4 THEN 'usage_hour is outside its allowed values'
    WHEN 5 THEN 'facility is outside its allowed values'
    WHEN 6 THEN 'missing field(s) notification_delay_bucket, usage_day, usage_hour'
    WHEN 7 THEN 'usage_hour is outside its allowed values'
    WHEN 8 THEN 'notification_delay_bucket is outside its allowed values' END AS reason
FROM good""")


def answers(ws: Workspace) -> DataFrame:
    """Answer texts of two arms; the second arm is never selected."""
    rows = ws.scored_holdout.filter("model = 'habit'").withColumn(
        "bh", F.hour(F.timestamp_micros("origin_us"))
    )
    label = D.ladder_label(F.col("predicted_delay_minutes"), ws.ladder)
    ok = G.answer_json(
        F.col("predicted_facility_id"), F.col("predicted_usage_weekday"),
        F.col("predicted_usage_hour"), F.col("label"),
    )
    rows = rows.withColumn("label", label).withColumn("ok", ok)
    o, bh = F.col("ok"), F.col("bh")
    text = (
        F.when(bh == 0, F.concat(F.lit("The answer is "), o))
        .when(bh == 1, F.concat(F.lit("["), o, F.lit("]")))
        .when(bh == 2, F.replace(o, F.lit('"usage_day"'), F.lit('"day"')))
        .when(bh == 3, F.replace(o, F.lit("{"), F.lit('{"note": "x", ')))
        .when(bh == 4, F.replace(o, F.lit('"usage_hour": '), F.lit('"usage_hour": 9')))
        .when(bh == 5, F.replace(o, F.col("predicted_facility_id"), F.lit("sauna")))
        .when(bh == 6, F.concat(F.lit('{"facility": "'), "predicted_facility_id", F.lit('"}')))
        .when(bh == 7, F.replace(
            F.replace(o, F.lit('"usage_hour": '), F.lit('"usage_hour": "')),
            F.lit(', "notif'), F.lit('", "notif')))
        .when(bh == 8, F.replace(o, F.col("label"), F.lit("SOON")))
        .otherwise(o)
    )
    one = rows.select("sample_id", F.lit("rule").alias("arm"), text.alias("text"))
    return one.unionByName(one.select("sample_id", F.lit("echo").alias("arm"), "text"))


def parsed(ws: Workspace) -> DataFrame:
    return G.parse_answers(answers(ws), ws.params.names, D.labels(ws.ladder))


@job("parse_answers", recursive("""
SELECT sample_id, CASE WHEN reason IS NULL THEN 'valid' ELSE 'failed' END AS status, stage AS failure_stage,
  reason AS failure_reason, CASE WHEN reason IS NULL THEN pf END AS facility,
  CASE WHEN reason IS NULL THEN ph END AS usage_hour FROM ans"""))
def parse_answers(ws: Workspace) -> DataFrame:
    return parsed(ws).filter("arm = 'rule'").select(
        "sample_id", "status", "failure_stage", "failure_reason", "fields.facility",
        "fields.usage_hour",
    )


fragment("apred", """
SELECT sample_id, reason IS NULL AS valid, CASE WHEN reason IS NULL THEN pf END AS predicted_facility_id,
  CASE WHEN reason IS NULL THEN pw END AS predicted_usage_weekday,
  CASE WHEN reason IS NULL THEN ph END AS predicted_usage_hour,
  CASE WHEN reason IS NULL THEN ans.label END AS predicted_notification_bucket,
  CASE WHEN reason IS NULL THEN representative END AS predicted_delay_minutes
FROM ans JOIN (SELECT label, representative FROM ladder_reps) USING (label)""")


def answer_predictions(ws: Workspace) -> DataFrame:
    return G.to_predictions(parsed(ws), "rule", ws.ladder)


@job("answers_to_predictions", recursive("SELECT * FROM apred"))
def answers_to_predictions(ws: Workspace) -> DataFrame:
    return answer_predictions(ws)


fragment("ascored", f"""
SELECT *, match_facility::INT + match_usage_weekday::INT + match_usage_hour::INT + match_notification::INT AS score FROM (
  SELECT coalesce(valid, false) AS valid, label, coalesce(predicted_notification_bucket, '{G.INVALID}') AS plabel,
    coalesce(predicted_facility_id = target_facility_id, false) AS match_facility,
    coalesce(predicted_usage_weekday = target_usage_weekday, false) AS match_usage_weekday,
    coalesce(predicted_usage_hour = target_usage_hour, false) AS match_usage_hour,
    coalesce(abs(ln((predicted_delay_minutes + 1) / (notification_delay_minutes + 1))) <= ln({P.match_ratio}::DOUBLE), false)
      AS match_notification
  FROM ss JOIN (SELECT sample_id, label FROM ttext) USING (sample_id) LEFT JOIN apred USING (sample_id) WHERE split = 'test')""")
_CEIL = f"""(SELECT avg((abs(ln((representative + 1) / (notification_delay_minutes + 1))) <= ln({P.match_ratio}::DOUBLE))::INT)
  FROM tr JOIN ladder_reps ON notification_delay_minutes + 1 >= lower AND (upper IS NULL OR notification_delay_minutes + 1 < upper))"""
_ARM = [*S.SUMMARY, "bucket_accuracy", "valid", "match_over_ceiling"]


@job("answer_metrics", recursive(f"""
SELECT metric, round(value, 6) AS value FROM (
  SELECT unnest([{quoted(['rows', *_ARM])}]) AS metric, unnest(["rows", {', '.join(f'{n}_' for n in _ARM)}]) AS value FROM (
    SELECT count(*)::DOUBLE AS "rows", avg(match_facility::INT) AS facility_, avg(match_usage_weekday::INT) AS usage_weekday_,
      avg(match_usage_hour::INT) AS usage_hour_, avg(match_notification::INT) AS notification_,
      avg(score) AS score_mean_, avg(score) / 4 AS overall_, avg((score = 4)::INT) AS strict_,
      avg((score >= 3)::INT) AS at_least_three_, avg((label = plabel)::INT) AS bucket_accuracy_,
      avg(valid::INT) AS valid_, avg(match_notification::INT) / {_CEIL} AS match_over_ceiling_ FROM ascored)
  UNION ALL SELECT 'bucket_macro_f1', avg(CASE WHEN a + p = 0 THEN 0 ELSE 2.0 * tp / (a + p) END) FROM (
    SELECT l, sum(a) AS a, sum(p) AS p, sum(tp) AS tp FROM (
      SELECT label AS l, 1 AS a, 0 AS p, (label = plabel)::INT AS tp FROM ascored
      UNION ALL SELECT plabel, 0, 1, 0 FROM ascored) GROUP BY 1)
  UNION ALL SELECT 'support_' || label, count(*)::DOUBLE FROM ascored GROUP BY label)"""))
def answer_metrics(ws: Workspace) -> DataFrame:
    p = ws.params
    truth = ws.holdout.withColumn(
        "actual", D.ladder_label(F.col("notification_delay_minutes"), ws.ladder)
    )
    scored = S.score(truth.join(answer_predictions(ws), "sample_id", "left"), p).withColumn(
        "predicted", F.coalesce("predicted_notification_bucket", F.lit(G.INVALID))
    )
    best = D.ceiling(ws.train, ws.ladder, p).filter("label = '(all)'").select("coverage")
    one = scored.agg(
        F.count(F.lit(1)).alias("rows"), *S.summary_columns(),
        F.avg((F.col("actual") == F.col("predicted")).cast("int")).alias("bucket_accuracy"),
        F.avg(F.coalesce("valid", F.lit(False)).cast("int")).alias("valid"),
    ).withColumn("match_over_ceiling", F.col("notification") / best.scalar())
    pairs = scored.groupBy(F.lit("bucket").alias("head"), "actual", "predicted").agg(
        F.count(F.lit(1)).alias("n")
    )
    f1 = S.macro_f1(pairs, []).select(
        F.lit("bucket_macro_f1").alias("metric"), F.col("macro_f1").alias("value")
    )
    support = pairs.groupBy(F.concat(F.lit("support_"), "actual").alias("metric")).agg(
        F.sum("n").cast("double").alias("value")
    )
    return rounded(S.unpivot(one, []).unionByName(f1).unionByName(support))


@job("trivial_references", recursive(f"""
SELECT count(*) AS "rows", round(avg((label = (SELECT label FROM ttext WHERE split = 'train' GROUP BY 1
    ORDER BY count(*) DESC, label LIMIT 1))::INT), 6) AS majority_bucket_accuracy,
  round(avg((abs(ln(((SELECT v FROM fb_delay) + 1) / (notification_delay_minutes + 1))) <= ln({P.match_ratio}::DOUBLE))::INT), 6)
    AS median_delay_match FROM ttext JOIN (SELECT sample_id, notification_delay_minutes FROM ss) USING (sample_id)
WHERE split = 'test'"""))
def trivial_references(ws: Workspace) -> DataFrame:
    label = D.ladder_label(F.col("notification_delay_minutes"), ws.ladder)
    common = ws.train.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("l")
    )
    median = ws.fallbacks.filter("kind = 'delay'").agg(F.max("minutes").alias("m"))
    rows = ws.holdout.select("notification_delay_minutes", label.alias("label")).withColumn(
        "_l", common.scalar()).withColumn("_m", median.scalar())
    near = F.abs(S.log_ratio(F.col("_m"), F.col("notification_delay_minutes")))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.avg((F.col("label") == F.col("_l")).cast("int")), 6)
        .alias("majority_bucket_accuracy"),
        F.round(F.avg((near <= ws.params.tolerance).cast("int")), 6).alias("median_delay_match"),
    )
