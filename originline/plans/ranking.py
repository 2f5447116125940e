"""Jobs over candidates and over delay buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originline.operators import candidates as K
from originline.operators import delays as D
from originline.operators import features as X
from originline.params import TEST, bucket_edges
from originline.plans.features import SQL, select_sql
from originline.plans.registry import job
from originline.plans.scoring import rounded
from originline.plans.sql import fragment, query
from originline.plans.workspace import Workspace

P = TEST

# -------------------------------------------------------------- candidates

_ALL = [*X.text_features(P), *X.numeric_features(P)]
_plain = select_sql(_ALL, extra="sample_id, next_facility AS target_facility_id").replace(
    " FROM f_run o", " FROM f_run o JOIN (SELECT sample_id, origin_booking_id FROM smp) s "
    "ON s.origin_booking_id = o.booking_id")
for _n in _ALL:  # unrounded values
    _plain = _plain.replace(
        f"round(CAST({SQL[_n]} AS DOUBLE), {3 if _n.startswith('community_lead') else 6}) AS {_n}",
        f"CAST({SQL[_n]} AS DOUBLE) AS {_n}")
fragment("ftab", _plain)
fragment("cand", " UNION ALL ".join(
    "SELECT sample_id, CAST(substr(sample_id, 2) AS BIGINT) AS candidate_group, target_facility_id, "
    + ", ".join(K.shared_columns(P))
    + f", '{f.name}' AS candidate_facility, {i} AS pos, "
    + ", ".join(f"{fam}_{f.slug} AS candidate_{fam}" for fam in K.families(P))
    + " FROM ftab" for i, f in enumerate(P.facilities)))
_NUMBERS = [f"candidate_{f}" for f in K.families(P)]
_NUMERIC_SHARED = [c for c in K.shared_columns(P) if c not in X.text_features(P)]


def places(name: str) -> int:
    return 3 if "lead" in name else 6


@job("candidate_long", query(f"""
SELECT sample_id, candidate_group, candidate_facility, {', '.join(X.text_features(P))},
  {', '.join(f'round({c}, 6) AS {c}' for c in _NUMERIC_SHARED)},
  {', '.join(f'round({c}, {places(c)}) AS {c}' for c in _NUMBERS)} FROM cand"""))
def candidate_long(ws: Workspace) -> DataFrame:
    texts = X.text_features(P)
    return K.build_candidates(ws.feature_rows(), ws.params).select(
        "sample_id", "candidate_group", "candidate_facility", *texts,
        *(F.round(c, 6).alias(c) for c in _NUMERIC_SHARED),
        *(F.round(c, places(c)).alias(c) for c in _NUMBERS),
    )


_RANKS = ", ".join(
    f"CAST(row_number() OVER (PARTITION BY sample_id ORDER BY candidate_{f} DESC NULLS LAST, pos) - 1 AS DOUBLE) "
    f"AS candidate_rank_{f}, round(max(candidate_{f}) OVER (PARTITION BY sample_id) - candidate_{f}, 6) "
    f"AS candidate_gap_to_top_{f}" for f in K.RANKED)


fragment("cand_r", f"""
SELECT * REPLACE ({', '.join(f'round(candidate_{f}, 12) AS candidate_{f}' for f in K.RANKED)}) FROM cand""")


def ranked_input(ws: Workspace) -> DataFrame:
    """The feature table with the ranked families at 12 places."""
    noisy = {f"{f}_{s}" for f in K.RANKED for s in P.slugs}
    rows = ws.feature_rows()
    return rows.select(*(F.round(c, 12).alias(c) if c in noisy else F.col(c) for c in rows.columns))


@job("candidate_ranks", query(f"SELECT sample_id, candidate_facility, {_RANKS} FROM cand_r"))
def candidate_ranks(ws: Workspace) -> DataFrame:
    return rounded(
        K.build_candidates(ranked_input(ws), ws.params).select(
            "sample_id", "candidate_facility",
            *(f"candidate_{k}_{f}" for f in K.RANKED for k in ("rank", "gap_to_top")),
        )
    )


@job("candidate_flags", query(f"""
SELECT sample_id, candidate_facility,
  round(candidate_facility_share - candidate_community_facility_share, 6) AS candidate_share_over_community,
  CAST(candidate_facility_count <= 0 AS INT)::DOUBLE AS candidate_is_unseen,
  {', '.join(f"CAST({c} = candidate_facility AS INT)::DOUBLE AS candidate_is_{c}"
             for c in X.text_features(P)[1:])} FROM cand"""))
def candidate_flags(ws: Workspace) -> DataFrame:
    return rounded(
        K.build_candidates(ws.feature_rows(), ws.params).select(
            "sample_id", "candidate_facility", "candidate_share_over_community",
            "candidate_is_unseen", *(f"candidate_is_{c}" for c in X.text_features(P)[1:]),
        )
    )


@job("candidate_labels", query("""
SELECT sample_id, candidate_facility, CAST(candidate_facility = target_facility_id AS INTEGER) AS relevance
FROM cand"""))
def candidate_labels(ws: Workspace) -> DataFrame:
    return K.candidate_labels(K.build_candidates(ws.feature_rows(), ws.params), ws.samples)


fragment("cand_s", """
SELECT sample_id, candidate_facility, pos, round(candidate_ewma_facility_share
  + coalesce(candidate_transition_share_from_last, 0), 9) AS score FROM cand""")


def rule_scores(ws: Workspace) -> DataFrame:
    """A deterministic scorer: decayed share plus transition share."""
    return K.build_candidates(ws.feature_rows(), ws.params).select(
        "sample_id", "candidate_facility",
        F.round(
            F.col("candidate_ewma_facility_share")
            + F.coalesce("candidate_transition_share_from_last", F.lit(0.0)), 9,
        ).alias("score"),
    )


@job("rank_candidates", query("""
SELECT sample_id, candidate_facility AS picked FROM (SELECT *, row_number() OVER
  (PARTITION BY sample_id ORDER BY score DESC, pos) AS rn FROM cand_s) WHERE rn = 1"""))
def rank_candidates(ws: Workspace) -> DataFrame:
    return K.rank_candidates(rule_scores(ws), ws.params)


@job("candidate_softmax", query("""
SELECT sample_id, candidate_facility, round(e / sum(e) OVER (PARTITION BY sample_id), 6) AS probability
FROM (SELECT *, exp(score - max(score) OVER (PARTITION BY sample_id)) AS e FROM cand_s)"""))
def candidate_softmax(ws: Workspace) -> DataFrame:
    return rounded(K.candidate_softmax(rule_scores(ws)))


# ------------------------------------------------------------------ delays

_EDGES = bucket_edges(P)
_REPS = D.fixed_representatives(P)


def _fixed(delay: str) -> str:
    return "(" + " + ".join(f"({delay} >= {e!r}::DOUBLE)::INT" for e in _EDGES) + ")"


# The fixed buckets again, from the settings alone: floor * ratio^k below the ceiling, then the ceiling.
fragment("fixed_edges", f"""
SELECT CAST(row_number() OVER (ORDER BY e) AS INTEGER) AS b, e FROM (
  SELECT {P.bucket_floor_minutes} * pow({P.bucket_ratio}::DOUBLE, k) AS e FROM range(500) r(k)
  WHERE {P.bucket_floor_minutes} * pow({P.bucket_ratio}::DOUBLE, k) < {P.bucket_ceiling_days} * 1440
  UNION ALL SELECT {P.bucket_ceiling_days} * 1440::DOUBLE)""")
fragment("fixed_buckets", f"""
SELECT b, e AS lo, coalesce(sqrt(e * lead(e) OVER (ORDER BY b)), e * sqrt({P.bucket_ratio}::DOUBLE)) AS representative FROM fixed_edges
UNION ALL SELECT 0, -1::DOUBLE, min(e) / sqrt({P.bucket_ratio}::DOUBLE) FROM fixed_edges""")


@job("delay_bucket_fixed", query("""
SELECT sample_id, b AS bucket, round(representative, 6) AS representative
FROM smp ASOF JOIN fixed_buckets ON notification_delay_minutes >= lo"""))
def delay_bucket_fixed(ws: Workspace) -> DataFrame:
    bucket = D.fixed_bucket(F.col("notification_delay_minutes"), ws.params)
    reps = F.array(*(F.lit(r) for r in _REPS))
    return ws.samples.select("sample_id", bucket.alias("bucket")).select(
        "sample_id", "bucket", F.round(F.get(reps, F.col("bucket")), 6).alias("representative")
    )


# The cuts again, from the settings alone: n + 1 points from the floor to the ceiling.
_FLOOR, _CEILING = f"({P.bucket_floor_minutes} + 1)::DOUBLE", f"({P.bucket_ceiling_days} * 1440 + 1)::DOUBLE"
fragment("cuts", f"""
SELECT CAST(k AS INTEGER) AS k, CASE WHEN k = 0 THEN {_FLOOR} WHEN k = steps THEN {_CEILING}
  ELSE exp(ln({_FLOOR}) + k * (ln({_CEILING}) - ln({_FLOOR})) / steps) END AS cut
FROM (SELECT CAST(ceil(ln({_CEILING} / {_FLOOR}) / ln({P.bucket_ratio}::DOUBLE)) AS INTEGER) AS steps), range(steps + 1) r(k)""")
fragment("fine", """
SELECT i, lo, hi, CASE WHEN hi IS NULL THEN 'OVER_' || CAST(round_even(lo - 1, 0) AS BIGINT) || 'M'
    WHEN i = 0 THEN 'UNDER_' || CAST(round_even(hi - 1, 0) AS BIGINT) || 'M'
    ELSE 'M' || CAST(round_even(lo - 1, 0) AS BIGINT) || '_' || CAST(round_even(hi - 1, 0) AS BIGINT) END AS label
FROM (SELECT k + 1 AS i, cut AS lo, lead(cut) OVER (ORDER BY k) AS hi FROM cuts
  UNION ALL SELECT 0, 1.0::DOUBLE, min(cut) FROM cuts)""")


@job("delay_ladder_assign", query("""
SELECT sample_id, label FROM smp ASOF JOIN fine ON notification_delay_minutes + 1 >= lo"""))
def delay_ladder_assign(ws: Workspace) -> DataFrame:
    label = D.ladder_label(F.col("notification_delay_minutes"), D.fine_ladder(ws.params))
    return ws.samples.select("sample_id", label.alias("label"))


# The merge as a recursive statement over the list of counted buckets.
fragment("rungs", """
SELECT fine.i, lo, hi, coalesce(c, 0) AS c FROM fine LEFT JOIN (
  SELECT i, count(*) AS c FROM tr ASOF JOIN fine ON notification_delay_minutes + 1 >= lo GROUP BY 1) USING (i)""")
fragment("merging", f"""
SELECT 0 AS step, list({{'lo': lo, 'hi': hi, 'c': c}} ORDER BY i) AS lad,
  CAST(NULL AS STRUCT(lo DOUBLE, hi DOUBLE, c BIGINT)[]) AS pair FROM rungs
UNION ALL SELECT step + 1, lad[1:spot - 1] || [{{'lo': lad[spot].lo, 'hi': lad[spot + 1].hi,
    'c': lad[spot].c + lad[spot + 1].c}}] || lad[spot + 2:], lad[spot:spot + 1] FROM (
  SELECT step, lad, greatest(list_position(list_transform(lad, lambda x: x.c < {P.bucket_min_rows}), true) - 1, 1) AS spot
  FROM merging WHERE len(lad) > 1
    AND len(list_filter(lad, lambda x: x.c < {P.bucket_min_rows})) > 0)""")


def _named(lo: str, hi: str) -> str:
    return (f"CASE WHEN {hi} IS NULL THEN 'OVER_' || CAST(round_even({lo} - 1, 0) AS BIGINT) || 'M' "
            f"WHEN {lo} = 1 THEN 'UNDER_' || CAST(round_even({hi} - 1, 0) AS BIGINT) || 'M' "
            f"ELSE 'M' || CAST(round_even({lo} - 1, 0) AS BIGINT) || '_' || CAST(round_even({hi} - 1, 0) AS BIGINT) END")


fragment("ladder_rows", f"""
SELECT CAST(row_number() OVER (ORDER BY lo) - 1 AS INTEGER) AS position, CASE
    WHEN hi IS NULL THEN 'OVER_' || CAST(round_even(lo - 1, 0) AS BIGINT) || 'M'
    WHEN lo = 1 THEN 'UNDER_' || CAST(round_even(hi - 1, 0) AS BIGINT) || 'M'
    ELSE 'M' || CAST(round_even(lo - 1, 0) AS BIGINT) || '_' || CAST(round_even(hi - 1, 0) AS BIGINT) END AS label,
  lo AS lower, hi AS upper, c AS train_rows
FROM (SELECT unnest(lad, recursive := true) FROM (SELECT lad FROM merging ORDER BY step DESC LIMIT 1))""")
fragment("ladder_reps", f"""
SELECT position, label, lower, upper, train_rows,
  CASE WHEN narrow THEN round_even(sqrt(lower * upper) - 1, 0) ELSE round_even(med, 0) END AS representative,
  CASE WHEN narrow THEN 'geometric' ELSE 'empirical' END AS source
FROM (SELECT lr.*, coalesce(upper / lower <= {P.match_ratio**2!r}::DOUBLE, false) AS narrow, med FROM ladder_rows lr
  LEFT JOIN (SELECT position, quantile_cont(notification_delay_minutes, 0.5) AS med FROM tr JOIN ladder_rows
    ON notification_delay_minutes + 1 >= lower AND (upper IS NULL OR notification_delay_minutes + 1 < upper)
    GROUP BY 1) USING (position))""")


def recursive(body: str) -> str:
    return query(body).replace("WITH ", "WITH RECURSIVE ", 1)


@job("delay_ladder_merge", recursive(f"""
SELECT 'bucket' AS kind, position, label, CAST(NULL AS VARCHAR) AS upper_label, CAST(NULL AS VARCHAR) AS into_label,
  round(lower, 6) AS lower, round(upper, 6) AS upper, CAST(train_rows AS BIGINT) AS train_rows, CAST(NULL AS BIGINT) AS upper_rows
FROM ladder_rows
UNION ALL SELECT 'merge', step - 1, {_named('pair[1].lo', 'pair[1].hi')}, {_named('pair[2].lo', 'pair[2].hi')},
  {_named('pair[1].lo', 'pair[2].hi')}, NULL, NULL, pair[1].c, pair[2].c FROM merging WHERE step > 0"""))
def delay_ladder_merge(ws: Workspace) -> DataFrame:
    """The merged buckets, and one row per merge in order."""
    ladder, log = ws.merged_ladder
    none = F.lit(None)
    buckets = D.ladder_frame(ws.spark, ladder).select(
        F.lit("bucket").alias("kind"), "position", "label", none.cast("string").alias("upper_label"),
        none.cast("string").alias("into_label"), "lower", "upper", "train_rows", none.cast("bigint").alias("upper_rows"))
    merges = D.merge_frame(ws.spark, log).select(
        F.lit("merge").alias("kind"), F.col("step").alias("position"), F.col("lower_label").alias("label"), "upper_label",
        "into_label", none.cast("double").alias("lower"), none.cast("double").alias("upper"),
        F.col("lower_rows").alias("train_rows"), "upper_rows")
    return rounded(buckets.unionByName(merges))


@job("delay_ladder_representatives", recursive("""
SELECT position, label, representative, source, CAST(train_rows AS BIGINT) AS train_rows FROM ladder_reps"""))
def delay_ladder_representatives(ws: Workspace) -> DataFrame:
    return D.ladder_frame(ws.spark, ws.ladder).select(
        "position", "label", "representative", "source", "train_rows"
    )


@job("representation_ceiling", recursive(f"""
SELECT label, "rows", round(coverage, 6) AS coverage, coverage >= 0.95 AS passed
FROM (SELECT coalesce(label, '(all)') AS label, count(*) AS "rows", avg(hit) AS coverage FROM (
  SELECT label, (abs(ln((representative + 1) / (notification_delay_minutes + 1))) <= ln({P.match_ratio}::DOUBLE))::INT AS hit
  FROM tr JOIN ladder_reps ON notification_delay_minutes + 1 >= lower
    AND (upper IS NULL OR notification_delay_minutes + 1 < upper)) GROUP BY ROLLUP (label))"""))
def representation_ceiling(ws: Workspace) -> DataFrame:
    return rounded(D.ceiling(ws.train, ws.ladder, ws.params))


fragment("wm", f"""
SELECT (x + stop) / 2 AS mode, held FROM (
  SELECT x, count(*) OVER w AS held, max(x) OVER w AS stop
  FROM (SELECT ln(notification_delay_minutes) AS x FROM tr)
  WINDOW w AS (ORDER BY x RANGE BETWEEN CURRENT ROW AND {2 * P.tolerance!r} FOLLOWING))
ORDER BY held DESC, x LIMIT 1""")


@job("window_mode", query("SELECT round(mode, 9) AS mode, held FROM wm"))
def window_mode(ws: Workspace) -> DataFrame:
    return rounded(ws.delay_mode, 9)


fragment("offs", """
SELECT ss.*, coalesce(CASE WHEN gap_median > 0 THEN ln(gap_median * 1440) END, (SELECT mode FROM wm)) AS off_set
FROM ss JOIN (SELECT booking_id, gap_median FROM f_run) ON booking_id = origin_booking_id""")


def offsets(ws: Workspace) -> DataFrame:
    gaps = ws.feature_rows().select("sample_id", "inter_booking_interval_median_days")
    mode = ws.delay_mode.select("mode").scalar()
    rows = ws.split_samples.join(gaps, "sample_id").withColumn("_mode", mode)
    return rows.withColumn(
        "offset", D.cadence_offset(F.col("inter_booking_interval_median_days"), F.col("_mode"))
    )


@job("cadence_offset", query('SELECT sample_id, round(off_set, 6) AS "offset" FROM offs'))
def cadence_offset(ws: Workspace) -> DataFrame:
    return rounded(offsets(ws).select("sample_id", "offset"))


_N = D.residual_count(P)
_W = 2.0 * P.residual_span / _N
fragment("res", f"""
SELECT *, CAST(least(greatest(floor((ln(notification_delay_minutes) - off_set + {P.residual_span}::DOUBLE)
  / {_W!r}::DOUBLE), 0), {_N - 1}) AS INTEGER) AS bucket FROM offs""")
fragment("marg", f"""
SELECT bucket, coalesce(c, 0) AS "rows", (coalesce(c, 0) + 1) / ((SELECT count(*) FROM res WHERE split = 'train') + {_N})::DOUBLE
  AS probability FROM (SELECT CAST(range AS INTEGER) AS bucket FROM range({_N}))
LEFT JOIN (SELECT bucket, count(*) AS c FROM res WHERE split = 'train' GROUP BY 1) USING (bucket)""")


def residuals(ws: Workspace) -> DataFrame:
    residual = F.log("notification_delay_minutes") - F.col("offset")
    return offsets(ws).withColumn("bucket", D.residual_bucket(residual, ws.params))


@job("residual_buckets", query(
    'SELECT bucket, "rows", round(probability, 9) AS probability FROM marg'))
def residual_buckets(ws: Workspace) -> DataFrame:
    train = residuals(ws).filter("split = 'train'")
    return rounded(D.marginal(train, "bucket", _N), 9)


def _overlap(grid: D.Grid) -> str:
    return ", ".join(
        f"({i}, {g!r}::DOUBLE, {b}, {w!r}::DOUBLE)"
        for i, (g, cell) in enumerate(zip(grid.points, grid.cover, strict=True))
        for b, w in cell)


fragment("lastf", """
SELECT ss.*, facility_id AS last_facility, bwd AS origin_day FROM ss
JOIN (SELECT booking_id, facility_id, bwd FROM h) ON booking_id = origin_booking_id""")
fragment("dp", f"""
SELECT last_facility, origin_day, b, count(*) / sum(count(*)) OVER (PARTITION BY last_facility, origin_day) AS p
FROM (SELECT *, {_fixed('notification_delay_minutes')} AS b FROM lastf WHERE split = 'train') GROUP BY 1, 2, 3""")
fragment("dd", f"""
SELECT last_facility, origin_day, g FROM (SELECT *, row_number() OVER (PARTITION BY last_facility, origin_day
    ORDER BY mass DESC, i) AS rn FROM (
  SELECT last_facility, origin_day, i, g, round(sum(p * w), 12) AS mass FROM dp
  JOIN (VALUES {_overlap(D.delay_grid(P))}) o(i, g, b, w) USING (b) GROUP BY ALL)) WHERE rn = 1""")
fragment("rp", f"""
SELECT last_facility, bucket AS b, {P.residual_blend}::DOUBLE * coalesce(x.p, 0)
  + {1 - P.residual_blend}::DOUBLE * probability AS p
FROM (SELECT DISTINCT last_facility FROM lastf WHERE split = 'train') CROSS JOIN marg
LEFT JOIN (SELECT last_facility, bucket, count(*) / sum(count(*)) OVER (PARTITION BY last_facility) AS p
  FROM res JOIN (SELECT sample_id, last_facility FROM lastf) USING (sample_id) WHERE split = 'train' GROUP BY 1, 2) x
  USING (last_facility, bucket)""")
fragment("rd", f"""
SELECT last_facility, g FROM (SELECT *, row_number() OVER (PARTITION BY last_facility ORDER BY mass DESC, i) AS rn FROM (
  SELECT last_facility, i, g, round(sum(p * w), 12) AS mass FROM rp
  JOIN (VALUES {_overlap(D.residual_grid(P))}) o(i, g, b, w) USING (b) GROUP BY ALL)) WHERE rn = 1""")


@job("window_decode", query("""
SELECT sample_id, round(exp(dd.g), 4) AS delay_minutes, round(exp(rd.g + off_set), 4) AS residual_minutes
FROM lastf JOIN dd USING (last_facility, origin_day) JOIN rd USING (last_facility)
JOIN (SELECT sample_id, off_set FROM offs) USING (sample_id)"""))
def window_decode(ws: Workspace) -> DataFrame:
    """Delays decoded from bucket shares by (last facility, weekday), with and without offset."""
    p = ws.params
    context = ws.feature_rows().select(
        "sample_id", F.col("last_1_facility").alias("last_facility"),
        F.col("origin_weekday").cast("int").alias("origin_day"),
    )
    rows = residuals(ws).join(context, "sample_id")
    train = rows.filter("split = 'train'")
    n = len(_EDGES) + 1
    count = F.count(F.lit(1)).alias("rows")
    fixed = D.fixed_bucket(F.col("notification_delay_minutes"), p).alias("b")
    delay = D.dense_probabilities(
        train.groupBy("last_facility", "origin_day", fixed).agg(count),
        ["last_facility", "origin_day"], "b", n,
    ).select("last_facility", "origin_day",
             D.window_decode(F.col("p"), D.delay_grid(p)).alias("_delay"))
    shape = D.marginal(train, "bucket", _N).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("bucket", "probability"))),
            lambda x: x["probability"],
        ).alias("m")
    )
    blended = D.dense_probabilities(
        train.groupBy("last_facility", "bucket").agg(count), ["last_facility"], "bucket", _N
    ).withColumn("m", shape.scalar()).select(
        "last_facility",
        F.zip_with("p", "m", lambda a, b: p.residual_blend * a + (1 - p.residual_blend) * b)
        .alias("p"),
    )
    residual = blended.select(
        "last_facility", D.window_decode(F.col("p"), D.residual_grid(p)).alias("_residual")
    )
    # Both decoded tables have at most catalog size x 7 rows.
    joined = rows.join(F.broadcast(delay), ["last_facility", "origin_day"]).join(
        F.broadcast(residual), "last_facility"
    )
    return joined.select(
        "sample_id", F.round(F.exp("_delay"), 4).alias("delay_minutes"),
        F.round(F.exp(F.col("_residual") + F.col("offset")), 4).alias("residual_minutes"),
    )
