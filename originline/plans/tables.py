"""Jobs over tables: scans, sinks, contracts, samples, splits and identity."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originline.functions.scalar import instant, micros
from originline.operators import contracts as C
from originline.operators import identity as I
from originline.operators import samples as S
from originline.operators import splits as P
from originline.operators.history import KEY
from originline.params import TEST
from originline.plans.registry import job
from originline.plans.sql import query, quoted, values
from originline.plans.workspace import Workspace
from originline.sources import tables as T


def ntz(df: DataFrame) -> DataFrame:
    """Instants as zone-free UTC timestamps, the form the oracles return."""
    return df.select(*(
        F.col(n).cast("timestamp_ntz").alias(n) if k == "timestamp" else F.col(n)
        for n, k in df.dtypes
    ))


_BOOKING = "booking_id, resident_id, facility_id, booking_timestamp, usage_timestamp"
_SAMPLE = """sample_id, resident_id, make_timestamp(origin_us) AS origin, origin_booking_id,
  n_prior_bookings, target_booking_id, make_timestamp(target_us) AS target_booking_timestamp,
  make_timestamp(target_usage_us) AS target_usage_timestamp, target_facility_id,
  target_usage_weekday, target_usage_hour, notification_delay_minutes"""
_BOOKING_QUERY = query(f"SELECT {_BOOKING} FROM bk")
_SAMPLE_QUERY = query(f"SELECT {_SAMPLE} FROM smp")


@job("scan_bookings", _BOOKING_QUERY)
def scan_bookings(ws: Workspace) -> DataFrame:
    return ntz(ws.bookings)


@job("scan_samples", _SAMPLE_QUERY)
def scan_samples(ws: Workspace) -> DataFrame:
    path = T.scratch(ws.spark, "samples")
    T.export_csv(T.conform(S.sample_table(ws.samples), "samples"), path)
    return ntz(T.scan_csv(ws.spark, "samples", path))


@job("read_table_ordered", _SAMPLE_QUERY)
def read_table_ordered(ws: Workspace) -> DataFrame:
    path = T.scratch(ws.spark, "samples")
    T.overwrite_table(S.sample_table(ws.samples), "samples", path)
    return ntz(T.read_table(ws.spark, "samples", path))


@job("overwrite_table", _BOOKING_QUERY)
def overwrite_table(ws: Workspace) -> DataFrame:
    path = T.scratch(ws.spark, "bookings")
    T.overwrite_table(ws.bookings.filter("facility_id = 'view'"), "bookings", path)
    others = ws.bookings.filter("facility_id <> 'view'")
    # The table is read and replaced in one job.
    T.overwrite_table(T.read_table(ws.spark, "bookings", path, ordered=False).unionByName(others), "bookings", path)
    return ntz(T.read_table(ws.spark, "bookings", path, ordered=False))


@job("export_csv_iso", _BOOKING_QUERY)
def export_csv_iso(ws: Workspace) -> DataFrame:
    path = T.scratch(ws.spark, "bookings-csv")
    T.export_csv(ws.bookings, path)
    return ntz(T.scan_csv(ws.spark, "bookings", path))


# ---------------------------------------------------------------- contracts

_CONTRACT = query(f"""
SELECT u."check" AS "check", u.violations, u.violations = 0 AS passed FROM (
  SELECT unnest([
    {{'check': 'non_null_booking_id', 'violations': count(*) FILTER (booking_id IS NULL)}},
    {{'check': 'non_null_resident_id', 'violations': count(*) FILTER (resident_id IS NULL)}},
    {{'check': 'non_null_facility_id', 'violations': count(*) FILTER (facility_id IS NULL)}},
    {{'check': 'non_null_booking_timestamp',
      'violations': count(*) FILTER (booking_timestamp IS NULL)}},
    {{'check': 'non_null_usage_timestamp',
      'violations': count(*) FILTER (usage_timestamp IS NULL)}},
    {{'check': 'unique_booking_id', 'violations': count(*) - count(DISTINCT booking_id)}},
    {{'check': 'facility_in_catalog',
      'violations': count(*) FILTER (facility_id NOT IN ({quoted(TEST.names)}))}},
    {{'check': 'booked_before_used',
      'violations': count(*) FILTER (booking_timestamp >= usage_timestamp)}},
    {{'check': 'declared_columns', 'violations': 0}}]) AS u
  FROM bk)""")


@job("booking_row_contract", _CONTRACT)
def booking_row_contract(ws: Workspace) -> DataFrame:
    return C.booking_contract(ws.bookings, ws.params)


_QUARANTINE = query(f"""
SELECT {_BOOKING}, array_to_string(list_filter([
  CASE WHEN reps > 1 THEN 'repeated_booking_id' END,
  CASE WHEN facility_id NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'facility_outside_catalog' END,
  CASE WHEN booking_timestamp >= usage_timestamp THEN 'not_booked_before_used' END],
  lambda x: x IS NOT NULL), ',') AS reasons
FROM (SELECT *, count(*) OVER (PARTITION BY booking_id) AS reps FROM ob)
WHERE reasons <> ''""")


@job("booking_quarantine", _QUARANTINE)
def booking_quarantine(ws: Workspace) -> DataFrame:
    allowed = dataclasses.replace(
        ws.params,
        facilities=tuple(
            dataclasses.replace(ws.params.facilities[0], name=n)
            for n in ("1-URGENT", "2-HIGH", "3-MEDIUM")
        ),
    )
    return ntz(C.quarantine(ws.orders, allowed))


_TIES = query(f"""
SELECT {_BOOKING} FROM (
  SELECT *, lag(us) OVER (PARTITION BY resident_id ORDER BY us, booking_id) AS prev_us FROM ob)
WHERE us <= prev_us""")


@job("strict_order_ties", _TIES)
def strict_order_ties(ws: Workspace) -> DataFrame:
    return ntz(S.order_ties(ws.orders).select(*ws.orders.columns))


_INCREASING = query(f"""
SELECT {_BOOKING}, total - 1 AS dropped FROM (
  SELECT *, count(*) OVER (PARTITION BY resident_id, us) AS total,
    row_number() OVER (PARTITION BY resident_id, us ORDER BY usage_timestamp, booking_id) AS rn
  FROM ob) WHERE rn = 1""")


@job("keep_strictly_increasing", _INCREASING)
def keep_strictly_increasing(ws: Workspace) -> DataFrame:
    return ntz(S.keep_strictly_increasing(ws.orders))


_DIM = values((f"'{f.name}'", f"DATE '{f.opens_on}'") for f in TEST.facilities)


@job("availability_check", query(f"""
SELECT d.facility_id, CAST(d.opens AS TIMESTAMP) AS opens, coalesce(b.before_opening, 0) AS before_opening,
  coalesce(b.after_opening, 0) AS after_opening,
  coalesce(b.before_opening, 0) = 0 AND coalesce(b.after_opening, 0) > 0 AS passed
FROM ({_DIM}) d(facility_id, opens) LEFT JOIN (
  SELECT bk.facility_id, count(*) FILTER (usage_timestamp < opens) AS before_opening,
    count(*) FILTER (usage_timestamp >= opens) AS after_opening
  FROM bk JOIN ({_DIM}) e(facility_id, opens) USING (facility_id) GROUP BY 1) b USING (facility_id)"""))
def availability_check(ws: Workspace) -> DataFrame:
    return C.availability(ws.bookings, ws.params)


def lead_hours(ws: Workspace) -> DataFrame:
    lead = micros(F.col("usage_timestamp")) - micros(F.col("booking_timestamp"))
    return ws.bookings.select("booking_id", "facility_id", (lead / 3.6e9).alias("lead_hours"))


@job("lead_time_checks", query("""
SELECT u."check" AS "check", round(u.value, 6) AS value, u.passed FROM (
  SELECT unnest([
    {'check': 'median_in_band', 'value': m, 'passed': m >= 6 AND m <= 72},
    {'check': 'mean_above_median', 'value': a, 'passed': a > m},
    {'check': 'long_short_ratio', 'value': l / s, 'passed': l / s >= 2}]) AS u
  FROM (SELECT quantile_cont(lead_minutes / 60, 0.5) AS m, avg(lead_minutes / 60) AS a,
    quantile_cont(lead_minutes / 60, 0.5) FILTER (facility_id = 'purchase') AS l,
    quantile_cont(lead_minutes / 60, 0.5) FILTER (facility_id = 'click') AS s FROM bk))"""))
def lead_time_checks(ws: Workspace) -> DataFrame:
    return C.lead_checks(lead_hours(ws), "purchase", "click", (6.0, 72.0), 2.0)


@job("popularity_checks", query(f"""
SELECT facility_id, n, round(n / sum(n) OVER (), 6) AS share, realised_rank, configured_rank,
  max(n) OVER () >= 1.2::DOUBLE * min(n) OVER () AS imbalance_passed,
  configured_rank > 3 OR configured_rank = realised_rank AS order_passed
FROM (SELECT d.facility_id, coalesce(c.n, 0) AS n,
    CAST(row_number() OVER (ORDER BY coalesce(c.n, 0) DESC, d.facility_id) AS INTEGER) AS realised_rank,
    CAST(row_number() OVER (ORDER BY popularity DESC, d.facility_id) AS INTEGER) AS configured_rank
  FROM ({values((f"'{f.name}'", f"{f.popularity}::DOUBLE") for f in TEST.facilities)}) d(facility_id, popularity)
  LEFT JOIN (SELECT facility_id, count(*) AS n FROM bk
    WHERE booking_timestamp < TIMESTAMP '2024-01-15' GROUP BY 1) c USING (facility_id))"""))
def popularity_checks(ws: Workspace) -> DataFrame:
    return C.popularity_checks(ws.bookings, ws.params, "2024-01-15", 3, 1.2)


@job("sparsity_check", query("""
SELECT count(*) AS residents, round(avg(CAST(coalesce(n, 0) < 5 AS INTEGER)), 9) AS sparse_share,
  avg(CAST(coalesce(n, 0) < 5 AS INTEGER)) >= 0.15 AS passed
FROM (SELECT CAST(c_custkey AS VARCHAR) AS resident_id FROM customer)
LEFT JOIN (SELECT resident_id, count(*) AS n FROM bk GROUP BY 1) USING (resident_id)"""))
def sparsity_check(ws: Workspace) -> DataFrame:
    return C.sparsity(ws.bookings, ws.roster, ws.params.sparse_bookings, 0.15)


def js_sql(pairs: list[tuple[str, str]], left: str, right: str) -> str:
    """Jensen-Shannon distance of two count vectors as one SQL expression."""
    terms = []
    for a, b in pairs:
        p, q = f"(({a}) / ({left})::DOUBLE)", f"(({b}) / ({right})::DOUBLE)"
        terms += [
            f"CASE WHEN {x} > 0 THEN 0.5 * {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
            for x in (p, q)
        ]
    return (
        f"CASE WHEN ({left}) > 0 AND ({right}) > 0 "
        f"THEN sqrt(greatest({' + '.join(terms)}, 0)) ELSE 0.0::DOUBLE END"
    )


_JS = js_sql([(f"a_{s}", f"b_{s}") for s in TEST.slugs], "n_before", "n_after")
_MIX = ", ".join(
    f"count(*) FILTER (booking_timestamp {op} TIMESTAMP '2024-01-16' AND facility_id = '{f.name}') "
    f"AS {t}_{f.slug}"
    for t, op in (("a", "<"), ("b", ">="))
    for f in TEST.facilities
)


@job("category_drift_js", query(f"""
SELECT resident_id, n_before, n_after, round({_JS}, 9) AS distance,
  round(a_click / nullif(n_before, 0)::DOUBLE - b_click / nullif(n_after, 0)::DOUBLE, 9) AS share_drop
FROM (SELECT resident_id, count(*) FILTER (booking_timestamp < TIMESTAMP '2024-01-16') AS n_before,
  count(*) FILTER (booking_timestamp >= TIMESTAMP '2024-01-16') AS n_after, {_MIX}
  FROM bk GROUP BY 1)"""))
def category_drift_js(ws: Workspace) -> DataFrame:
    return C.category_drift(ws.bookings, ws.params, "2024-01-16", "click")


# ------------------------------------------------------------------ samples

@job("rolling_origin_samples", query("""
SELECT resident_id, make_timestamp(us) AS origin, booking_id AS origin_booking_id,
  CAST(n AS INTEGER) AS n_prior_bookings, next_id AS target_booking_id,
  make_timestamp(next_us) AS target_booking_timestamp FROM og"""))
def rolling_origin_samples(ws: Workspace) -> DataFrame:
    return S.rolling_origins(ws.history).select(
        KEY, instant(F.col("origin_us")).alias("origin"), "origin_booking_id",
        "n_prior_bookings", "target_booking_id",
        instant(F.col("target_us")).alias("target_booking_timestamp"),
    )


@job("sample_labels", query("""
SELECT next_id AS target_booking_id, next_facility AS target_facility_id,
  next_uwd AS target_usage_weekday, next_uh AS target_usage_hour,
  (next_us - us) / 60000000.0::DOUBLE AS notification_delay_minutes FROM og"""))
def sample_labels(ws: Workspace) -> DataFrame:
    return S.with_labels(S.rolling_origins(ws.history)).select(
        "target_booking_id", "target_facility_id", "target_usage_weekday", "target_usage_hour",
        "notification_delay_minutes",
    )


@job("assign_stable_ids", query("""
SELECT 'booking' AS kind, printf('B%07d', row_number() OVER
  (ORDER BY us, resident_id, facility_id, usage_us, booking_id)) AS stable_id, booking_id FROM bk
UNION ALL SELECT 'sample', sample_id, target_booking_id FROM smp"""))
def assign_stable_ids(ws: Workspace) -> DataFrame:
    bookings = S.booking_ids(ws.bookings).select(F.lit("booking").alias("kind"), "*")
    return bookings.unionByName(
        ws.samples.select(
            F.lit("sample").alias("kind"), F.col("sample_id").alias("stable_id"),
            F.col("target_booking_id").alias("booking_id"),
        )
    )


@job("sample_accounting", query("""
SELECT b.bookings, s.samples, r.*, x.*, b.observation_start, b.observation_end
FROM (SELECT count(*) AS bookings, min(booking_timestamp) AS observation_start,
    max(usage_timestamp) AS observation_end FROM bk) b,
  (SELECT count(*) AS samples FROM smp) s,
  (SELECT count(*) AS residents_configured, count(n) AS residents_with_bookings,
     count(*) - count(n) AS residents_without_bookings
   FROM (SELECT CAST(c_custkey AS VARCHAR) AS resident_id FROM customer)
   LEFT JOIN (SELECT resident_id, count(*) AS n FROM bk GROUP BY 1) USING (resident_id)) r,
  (SELECT count(*) FILTER (k = 0) AS excluded_no_history, count(*) FILTER (k > 0) AS residents_with_samples,
     count(*) FILTER (k > 0) AS censored_bookings
   FROM (SELECT bk.resident_id, count(sample_id) AS k FROM bk
     LEFT JOIN smp ON target_booking_id = booking_id GROUP BY 1)) x"""))
def sample_accounting(ws: Workspace) -> DataFrame:
    return S.sample_accounting(ws.bookings, ws.samples, ws.roster)


@job("chronological_cutoffs", query("""
SELECT make_timestamp(start_us) AS start_at, make_timestamp(end_us) AS end_at,
  make_timestamp(train_cut_us) AS train_cut, make_timestamp(validation_cut_us) AS validation_cut
FROM cut"""))
def chronological_cutoffs(ws: Workspace) -> DataFrame:
    return ws.cutoffs.select(
        instant(F.col("start_us")).alias("start_at"), instant(F.col("end_us")).alias("end_at"),
        instant(F.col("train_cut_us")).alias("train_cut"),
        instant(F.col("validation_cut_us")).alias("validation_cut"),
    )


@job("assign_split", query("SELECT sample_id, split FROM ss"))
def assign_split(ws: Workspace) -> DataFrame:
    return P.assign_split(ws.samples, ws.cutoffs).select("sample_id", "split")


@job("split_boundary_check", query("""
SELECT split, make_timestamp(b) AS last_target, make_timestamp(nxt) AS next_first_target,
  coalesce(b < nxt, true) AS passed FROM (
  SELECT *, lead(a) OVER (ORDER BY a) AS nxt FROM (
    SELECT split, min(target_us) AS a, max(target_us) AS b FROM ss GROUP BY 1))"""))
def split_boundary_check(ws: Workspace) -> DataFrame:
    return P.boundary_check(ws.splits)


@job("split_shape", query("""
SELECT d.split, coalesce(n, 0) AS "rows", round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 6) AS share,
  make_timestamp(a) AS first_target, make_timestamp(b) AS last_target
FROM (VALUES ('train'), ('validation'), ('test')) d(split) LEFT JOIN (
  SELECT split, count(*) AS n, min(target_us) AS a, max(target_us) AS b FROM ss GROUP BY 1) USING (split)"""))
def split_shape(ws: Workspace) -> DataFrame:
    return P.split_shape(ws.splits)


@job("split_moved_rows", query("""
SELECT sample_id, rebuilt, frozen FROM (
  SELECT sample_id, split AS frozen, CASE
    WHEN target_us < start_us + CAST(floor((end_us - start_us) * 0.65::DOUBLE) AS BIGINT) THEN 'train'
    WHEN target_us < start_us + CAST(floor((end_us - start_us) * 0.85::DOUBLE) AS BIGINT)
    THEN 'validation' ELSE 'test' END AS rebuilt
  FROM ss, cut) WHERE rebuilt IS DISTINCT FROM frozen"""))
def split_moved_rows(ws: Workspace) -> DataFrame:
    moved = dataclasses.replace(ws.params, train_frac=0.65, val_frac=0.20)
    rebuilt = P.assign_split(ws.samples, P.cutoffs(ws.samples, moved))
    return P.moved_rows(rebuilt, ws.splits)


@job("fit_membership_audit", query("""
SELECT count(*) AS audited, count(*) FILTER (split IS NULL) AS "unknown",
  count(*) FILTER (split <> 'train') AS intruders
FROM (SELECT sample_id FROM smp, cut
      WHERE target_us < start_us + CAST(floor((end_us - start_us) * 0.8::DOUBLE) AS BIGINT)
      UNION ALL SELECT booking_id FROM h WHERE next_id IS NULL)
LEFT JOIN (SELECT sample_id, split FROM ss) USING (sample_id)"""))
def fit_membership_audit(ws: Workspace) -> DataFrame:
    late = P.cutoffs(ws.samples, dataclasses.replace(ws.params, train_frac=0.8))
    handed = P.assign_split(ws.samples, late).filter("split = 'train'").select("sample_id")
    # Last bookings are nobody's origin: their ids are not sample ids.
    censored = ws.history.real(ws.history.frame).filter("next_booking_id is null").select(
        F.col("booking_id").alias("sample_id")
    )
    return P.membership_audit(handed.unionByName(censored), ws.splits, ("train",))


@job("tail_fraction_fold", query(f"""
SELECT sample_id, CASE WHEN row_number() OVER (ORDER BY target_us DESC, sample_id)
  <= round_even(count(*) OVER () * {TEST.inner_frac}::DOUBLE, 0) THEN 'held_out' ELSE 'fit' END AS fold
FROM ss WHERE split = 'train'"""))
def tail_fraction_fold(ws: Workspace) -> DataFrame:
    return P.tail_fold(ws.train.select("sample_id", "target_us"), ws.params.inner_frac).select(
        "sample_id", "fold"
    )


@job("seeded_holdout_sample", query("SELECT sample_id FROM cmp_ids"))
def seeded_holdout_sample(ws: Workspace) -> DataFrame:
    p = ws.params
    return P.seeded_draw(ws.holdout, p.comparison_rows, p.seed).orderBy("sample_id")


_BAND = """CASE WHEN n_prior_bookings < 1 THEN 'under_1' WHEN n_prior_bookings < 3 THEN '1_to_2'
  WHEN n_prior_bookings < 10 THEN '3_to_9' WHEN n_prior_bookings < 30 THEN '10_to_29'
  ELSE '30_plus' END"""


@job("history_band", query(
    f"SELECT sample_id, {_BAND} AS band, target_facility_id || ' | ' || {_BAND} AS stratum FROM smp"
))
def history_band(ws: Workspace) -> DataFrame:
    band = P.history_band(F.col("n_prior_bookings"), ws.params.history_bins)
    return ws.samples.select("sample_id", band.alias("band"), P.stratum(ws.params).alias("stratum"))


# The strata of the training rows; a draw of 200.
DRAW = 200
_ALLOCATION = f"""
strata AS (SELECT target_facility_id || ' | ' || {_BAND} AS stratum, count(*) AS size
  FROM ss WHERE split = 'train' GROUP BY 1),
shared AS (SELECT *, CAST((size - 1) * ({DRAW} - k) AS DOUBLE) / CAST(available - k AS DOUBLE) AS share
  FROM strata, (SELECT sum(size) AS available, count(*) AS k FROM strata)),
taken AS (SELECT *, least(CAST(floor(share) AS BIGINT), size - 1) AS take FROM shared),
leftover AS (SELECT *, {DRAW} - k - sum(take) OVER () AS spare, row_number() OVER
  (PARTITION BY take + 1 < size ORDER BY share DESC, stratum DESC) AS turn FROM taken),
plan AS (SELECT stratum, size, share, take + 1 + CASE WHEN take + 1 < size AND turn <= spare
  THEN 1 ELSE 0 END AS allocated FROM leftover)"""


def _strata(ws: Workspace) -> DataFrame:
    return ws.train.withColumn("stratum", P.stratum(ws.params))


@job("stratified_allocation", query("SELECT 1 FROM ss").replace("\nSELECT 1 FROM ss", f", {_ALLOCATION}\n"
    "SELECT stratum, size, round(share, 9) AS share, CAST(allocated AS BIGINT) AS allocated FROM plan"))
def stratified_allocation(ws: Workspace) -> DataFrame:
    return P.allocation(_strata(ws), DRAW).withColumn("share", F.round("share", 9))


@job("stratified_sample", query("SELECT 1 FROM ss").replace("\nSELECT 1 FROM ss", f", {_ALLOCATION}\n"
    f"""SELECT sample_id, stratum FROM (SELECT sample_id, stratum, allocated,
  row_number() OVER (PARTITION BY stratum ORDER BY md5('{TEST.seed}|' || sample_id), sample_id) AS rn
  FROM (SELECT *, target_facility_id || ' | ' || {_BAND} AS stratum FROM ss WHERE split = 'train')
  JOIN plan USING (stratum)) WHERE rn <= allocated"""))
def stratified_sample(ws: Workspace) -> DataFrame:
    return P.stratified_sample(_strata(ws), DRAW, ws.params.seed)


_FLOOR = f"""
floor_rows AS (SELECT sample_id, target_usage_hour FROM (SELECT *, row_number() OVER
  (PARTITION BY target_usage_hour ORDER BY md5('{TEST.seed}|' || sample_id), sample_id) AS rn
  FROM ss WHERE split = 'train') WHERE rn <= 5),
drawn AS (SELECT sample_id, target_usage_hour, 'floor' AS drawn_by FROM floor_rows UNION ALL
  SELECT sample_id, target_usage_hour, 'fill' FROM (SELECT *, row_number() OVER
  (ORDER BY md5('{TEST.seed}|' || sample_id), sample_id) AS rn FROM ss WHERE split = 'train'
  AND sample_id NOT IN (SELECT sample_id FROM floor_rows))
  WHERE rn <= {DRAW} - (SELECT count(*) FROM floor_rows))"""


def with_ss(body: str) -> str:
    """A statement with extra fragments on top of the split samples."""
    return query("SELECT 1 FROM ss").replace("\nSELECT 1 FROM ss", f", {body}")


@job("label_floor_sample", with_ss(_FLOOR + "\nSELECT * FROM drawn"))
def label_floor_sample(ws: Workspace) -> DataFrame:
    return P.label_floor_sample(ws.train, "target_usage_hour", DRAW, 5, ws.params.seed)


@job("sample_share_deviation", with_ss(_FLOOR + """
SELECT target_usage_hour, drawn, available, round(d, 9) AS drawn_share, round(a, 9) AS available_share,
  round(abs(d - a), 9) AS deviation, round(max(abs(d - a)) OVER (), 9) AS largest_deviation
FROM (SELECT target_usage_hour, coalesce(x.n, 0) AS drawn, coalesce(y.n, 0) AS available,
    coalesce(x.n, 0)::DOUBLE / sum(coalesce(x.n, 0)) OVER () AS d,
    coalesce(y.n, 0)::DOUBLE / sum(coalesce(y.n, 0)) OVER () AS a
  FROM (SELECT target_usage_hour, count(*) AS n FROM drawn GROUP BY 1) x FULL JOIN
    (SELECT target_usage_hour, count(*) AS n FROM ss WHERE split = 'train' GROUP BY 1) y
    USING (target_usage_hour))"""))
def sample_share_deviation(ws: Workspace) -> DataFrame:
    drawn = P.label_floor_sample(ws.train, "target_usage_hour", DRAW, 5, ws.params.seed)
    return P.share_deviation(drawn, ws.train, "target_usage_hour")


# ----------------------------------------------------------------- identity

_LINE = """concat_ws(chr(31), booking_id, resident_id, facility_id,
  strftime(booking_timestamp, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00',
  strftime(usage_timestamp, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00')"""


@job("row_digest", query(f"SELECT booking_id, sha256({_LINE}) AS digest FROM bk"))
def row_digest(ws: Workspace) -> DataFrame:
    return I.row_digests(ws.bookings, ["booking_id"])


def _print(name: str, line: str, source: str) -> str:
    return f"""SELECT '{name}' AS name, count(*) AS "rows",
  CAST(sum(('0x' || substr(sha256({line}), 1, 15))::BIGINT::HUGEINT) AS VARCHAR) || '-' ||
  CAST(sum(('0x' || substr(sha256({line}), 16, 15))::BIGINT::HUGEINT) AS VARCHAR) AS fingerprint FROM {source}"""


_SPLIT_LINE = "concat_ws(chr(31), sample_id, split)"


@job("table_fingerprint", query(
    _print("bookings", _LINE, "bk") + "\nUNION ALL " + _print("splits", _SPLIT_LINE, "ss")
))
def table_fingerprint(ws: Workspace) -> DataFrame:
    return I.fingerprint(ws.bookings, "bookings", ["booking_id"]).unionByName(
        I.fingerprint(ws.splits.select("sample_id", "split"), "splits", ["sample_id"])
    )


_OLD_LINE = """concat_ws(chr(31), sample_id, CASE
  WHEN target_us < start_us + CAST(floor((end_us - start_us) * 0.65::DOUBLE) AS BIGINT) THEN 'train'
  WHEN target_us < start_us + CAST(floor((end_us - start_us) * 0.85::DOUBLE) AS BIGINT)
  THEN 'validation' ELSE 'test' END)"""


@job("fingerprint_compare", query(f"""
SELECT name, a.fingerprint AS recorded, b.fingerprint AS recomputed,
  a.fingerprint IS NOT DISTINCT FROM b.fingerprint AS same
FROM ({_print("bookings", _LINE, "bk")} UNION ALL {_print("splits", _OLD_LINE, "ss, cut")}) a
FULL JOIN ({_print("bookings", _LINE, "bk")} UNION ALL {_print("splits", _SPLIT_LINE, "ss")}) b USING (name)"""))
def fingerprint_compare(ws: Workspace) -> DataFrame:
    """A record taken under another split against the live tables."""
    old = dataclasses.replace(ws.params, train_frac=0.65, val_frac=0.20)
    before = P.assign_split(ws.samples, P.cutoffs(ws.samples, old)).select("sample_id", "split")
    recorded = I.fingerprint(ws.bookings, "bookings", ["booking_id"]).unionByName(
        I.fingerprint(before, "splits", ["sample_id"])
    )
    return I.compare(recorded, table_fingerprint(ws))


@job("reconcile_tables", query("""
SELECT name, recorded, live, recorded IS NOT DISTINCT FROM live AS passed
FROM (SELECT 'bookings' AS name, count(*) AS recorded FROM bk
  UNION ALL SELECT 'samples', count(*) FROM smp
  UNION ALL SELECT 'split_' || d.split, CAST(floor(coalesce(n, 0)) AS BIGINT) FROM
    (VALUES ('train'), ('validation'), ('test')) d(split)
    LEFT JOIN (SELECT split, count(*) AS n FROM ss GROUP BY 1) USING (split)
  UNION ALL SELECT 'comparison', 500) a
FULL JOIN (SELECT 'bookings' AS name, count(*) AS live FROM bk
  UNION ALL SELECT 'samples', count(*) FROM smp
  UNION ALL SELECT 'split_' || split, count(*) FROM ss GROUP BY 1
  UNION ALL SELECT 'comparison', count(*) FROM cmp_ids) b USING (name)
UNION ALL SELECT 'comparison_outside_holdout', 0, count(*), count(*) = 0 FROM cmp_ids
  WHERE sample_id NOT IN (SELECT sample_id FROM ss WHERE split = 'test')"""))
def reconcile_tables(ws: Workspace) -> DataFrame:
    """Counts written next to the tables against the tables themselves."""
    shape = P.split_shape(ws.splits)
    one = F.count(F.lit(1)).alias("n")
    recorded = (
        ws.bookings.agg(one).select(F.lit("bookings").alias("name"), "n")
        .unionByName(ws.samples.agg(one).select(F.lit("samples").alias("name"), "n"))
        .unionByName(shape.select(F.concat(F.lit("split_"), "split").alias("name"),
                                  F.col("rows").alias("n")))
        .unionByName(ws.spark.createDataFrame(
            [("comparison", ws.params.comparison_rows)], "name string, n bigint"))
    ).withColumnRenamed("n", "recorded")
    path = T.scratch(ws.spark, "record")
    recorded.write.json(path)
    recorded = ws.spark.read.schema("name string, recorded bigint").json(path)
    live = (
        ws.bookings.agg(one).select(F.lit("bookings").alias("name"), "n")
        .unionByName(ws.samples.agg(one).select(F.lit("samples").alias("name"), "n"))
        .unionByName(ws.splits.groupBy(F.concat(F.lit("split_"), "split").alias("name")).agg(one))
        .unionByName(ws.comparison.agg(one).select(F.lit("comparison").alias("name"), "n"))
    ).withColumnRenamed("n", "live")
    strays = ws.comparison.join(ws.holdout.select("sample_id"), "sample_id", "left_anti")
    return C.reconcile(recorded, live, strays)


_TAMPERED = "concat_ws(chr(31), sample_id, CASE WHEN sample_id = 'S0000001' THEN 'tampered' ELSE split END)"


@job("reconcile_digests", query(f"""
SELECT name, a.fingerprint AS recorded, b.fingerprint AS recomputed,
  a.fingerprint IS NOT DISTINCT FROM b.fingerprint AS same
FROM ({_print("splits", _SPLIT_LINE, "ss")} UNION ALL {_print("splits_tampered", _SPLIT_LINE, "ss")}) a
FULL JOIN ({_print("splits", _SPLIT_LINE, "ss")} UNION ALL {_print("splits_tampered", _TAMPERED, "ss")}) b USING (name)"""))
def reconcile_digests(ws: Workspace) -> DataFrame:
    """Identities recorded when a table was written, against what is read back.

    The second case changes one row after the record was taken, and must differ.
    """
    rows = ws.splits.select("sample_id", "split")
    table, record = T.scratch(ws.spark, "splits"), T.scratch(ws.spark, "identities")
    rows.write.parquet(table)
    taken = I.fingerprint(rows, "splits", ["sample_id"])
    taken.unionByName(taken.withColumn("name", F.lit("splits_tampered"))).write.json(record)
    back = ws.spark.read.parquet(table)
    changed = back.withColumn("split", F.when(F.col("sample_id") == "S0000001", "tampered").otherwise(F.col("split")))
    live = I.fingerprint(back, "splits", ["sample_id"]).unionByName(
        I.fingerprint(changed, "splits_tampered", ["sample_id"]))
    recorded = ws.spark.read.schema("name string, rows bigint, fingerprint string").json(record)
    return I.compare(recorded, live)
