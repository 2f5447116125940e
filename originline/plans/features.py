"""Jobs over point-in-time features."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from originline.operators import contracts as C
from originline.operators import features as X
from originline.params import DAY_US, TEST
from originline.plans.registry import job
from originline.plans.sql import fragment, query, band_case
from originline.plans.tables import js_sql
from originline.plans.workspace import Workspace

P = TEST
TURN = 2.0 * math.pi

# ---- SQL statements of the features, each in its most literal form ----------

_counts = [
    *(f"count(*) FILTER (facility_id = '{f.name}') OVER w AS f_{f.slug}" for f in P.facilities),
    *(f"count(*) FILTER (uwd = {d}) OVER w AS d_{d}" for d in range(7)),
    *(f"count(*) FILTER (uband = '{b.name}') OVER w AS b_{b.slug}" for b in P.bands),
]
_windows = [
    f"count(*) OVER (PARTITION BY resident_id ORDER BY us "
    f"RANGE BETWEEN {d * DAY_US - 1} PRECEDING AND CURRENT ROW) AS in_{d}d"
    for d in sorted({*P.prior_windows_days, *P.trend_days})
]
_lags = [
    f"lag(facility_id, {k - 1}, '__MISSING__') OVER w AS last_{k}_facility"
    for k in range(1, P.recent_slots + 1)
]
fragment("f_run", f"""
SELECT *, {', '.join(_counts)}, {', '.join(_windows)}, {', '.join(_lags)},
  sum(CAST(usage_us - us AS DOUBLE)) OVER w / n / 60000000::DOUBLE AS lead_mean, quantile_cont(lead_minutes, 0.5) OVER w AS lead_median,
  avg(gap_us) OVER w / {DAY_US}.0 AS gap_mean,
  quantile_cont(gap_us::DOUBLE, 0.5) OVER w / {DAY_US}.0 AS gap_median,
  quantile_cont(gap_us::DOUBLE, 0.5) OVER w / 60000000::DOUBLE AS gap_minutes,
  stddev_samp(gap_us / {DAY_US}.0::DOUBLE) OVER w AS gap_std
FROM h WINDOW w AS (PARTITION BY resident_id ORDER BY us
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
# Every pair of an origin row and a row it may read.
fragment("past", """
SELECT a.booking_id AS id, a.us AS origin_at, a.n AS last_n, a.facility_id AS now_facility, b.*
FROM h a JOIN h b ON a.resident_id = b.resident_id AND b.us <= a.us""")


def mode_fragment(name: str, value: str, where: str = "TRUE") -> None:
    fragment(name, f"""
SELECT id, v, c FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, seen DESC) AS rn
  FROM (SELECT id, {value} AS v, count(*) AS c, max(us) AS seen FROM past WHERE {where} GROUP BY 1, 2))
WHERE rn = 1""")


mode_fragment("m_bwd", "bwd")
mode_fragment("m_uwd", "uwd")
mode_fragment("m_uh", "uh")
mode_fragment("m_fac", "facility_id")
for _d in P.rolling_depths:
    mode_fragment(f"m_roll{_d}", "facility_id", f"n > last_n - {_d}")
_half = P.halflife_days * DAY_US
fragment("f_ewma", f"""
SELECT id, {', '.join(
    [f"sum(w) FILTER (facility_id = '{f.name}') / sum(w) AS ef_{f.slug}" for f in P.facilities]
    + [f"sum(w) FILTER (uband = '{b.name}') / sum(w) AS eb_{b.slug}" for b in P.bands])}
FROM (SELECT *, pow(0.5::DOUBLE, (origin_at - us) / {_half}::DOUBLE) AS w FROM past) GROUP BY 1""")
fragment("f_trans", f"""
SELECT id, count(*) FILTER (prev_facility = now_facility) AS t_total, {', '.join(
    f"count(*) FILTER (prev_facility = now_facility AND facility_id = '{f.name}') AS t_{f.slug}"
    for f in P.facilities)}
FROM past GROUP BY 1""")
_before = "RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_comm = []
for _f in P.facilities:
    _is = f"count(*) FILTER (facility_id = '{_f.name}')"
    _comm += [
        f"{_is} OVER (ORDER BY us {_before}) AS c_{_f.slug}",
        f"{_is} OVER (PARTITION BY bwd ORDER BY us {_before}) AS cw_{_f.slug}",
        f"{_is} OVER (PARTITION BY bband ORDER BY us {_before}) AS cb_{_f.slug}",
        f"sum(CAST(usage_us - us AS DOUBLE)) FILTER (facility_id = '{_f.name}') OVER (ORDER BY us {_before}) AS cl_{_f.slug}",
    ]
    _comm += [
        f"{_is} OVER (ORDER BY us RANGE BETWEEN {d * DAY_US} PRECEDING AND 1 PRECEDING) AS c{d}_{_f.slug}"
        for d in P.community_days
    ]
fragment("f_comm", f"""
SELECT DISTINCT us, count(*) OVER (ORDER BY us {_before}) AS n_community,
  max(us) OVER (ORDER BY us {_before}) AS newest_us, {', '.join(_comm)} FROM bk""")

SQL: dict[str, str] = {
    "resident_profile_id": "resident_id",
    "n_prior_bookings": "n",
    "origin_weekday": "bwd",
    "origin_hour": "bh",
    "origin_month": "month(booking_timestamp)",
    "origin_week_of_year": "week(booking_timestamp)",
    "origin_hour_sin": f"sin(bh * {TURN / 24!r}::DOUBLE)",
    "origin_hour_cos": f"cos(bh * {TURN / 24!r}::DOUBLE)",
    "origin_weekday_sin": f"sin(bwd * {TURN / 7!r}::DOUBLE)",
    "origin_weekday_cos": f"cos(bwd * {TURN / 7!r}::DOUBLE)",
    "origin_month_sin": f"sin((month(booking_timestamp) - 1) * {TURN / 12!r}::DOUBLE)",
    "origin_month_cos": f"cos((month(booking_timestamp) - 1) * {TURN / 12!r}::DOUBLE)",
    "days_since_previous_booking": f"gap_us / {DAY_US}.0::DOUBLE",
    "days_since_first_booking": f"(us - first_us) / {DAY_US}.0::DOUBLE",
    **{f"bookings_prior_{d}d": f"in_{d}d" for d in P.prior_windows_days},
    f"booking_rate_ratio_{P.trend_days[0]}d_{P.trend_days[1]}d":
        f"(in_{P.trend_days[0]}d / {P.trend_days[0]}::DOUBLE)"
        f" / nullif(in_{P.trend_days[1]}d / {P.trend_days[1]}::DOUBLE, 0)",
    "inter_booking_interval_mean_days": "gap_mean",
    "inter_booking_interval_median_days": "gap_median",
    "inter_booking_interval_std_days": "gap_std",
    "last_booking_weekday": "bwd",
    "last_booking_hour": "bh",
    "booking_weekday_mode": "m_bwd.v",
    "days_until_booking_weekday_mode": "coalesce(nullif((m_bwd.v - bwd + 7) % 7, 0), 7)",
    "cadence_progress_ratio": f"gap_us / {DAY_US}.0::DOUBLE / nullif(gap_median, 0)",
    "last_usage_weekday": "uwd",
    "last_usage_hour": "uh",
    **{f"facility_count_{s}": f"f_{s}" for s in P.slugs},
    **{f"facility_share_{s}": f"f_{s} / n::DOUBLE" for s in P.slugs},
    **{f"usage_weekday_count_{d}": f"d_{d}" for d in range(7)},
    **{f"usage_weekday_share_{d}": f"d_{d} / n::DOUBLE" for d in range(7)},
    **{f"time_band_count_{b.slug}": f"b_{b.slug}" for b in P.bands},
    **{f"time_band_share_{b.slug}": f"b_{b.slug} / n::DOUBLE" for b in P.bands},
    **{f"last_{k}_facility": f"last_{k}_facility" for k in range(1, P.recent_slots + 1)},
    **{f"rolling_top_facility_last_{d}": f"m_roll{d}.v" for d in P.rolling_depths},
    **{f"rolling_top_facility_share_last_{d}": f"m_roll{d}.c / least({d}, n)::DOUBLE"
       for d in P.rolling_depths},
    "lead_minutes_mean": "lead_mean",
    "lead_minutes_median": "lead_median",
    "lead_minutes_recent": "lead_minutes",
    **{f"ewma_facility_share_{s}": f"coalesce(ef_{s}, 0)" for s in P.slugs},
    **{f"ewma_time_band_share_{b.slug}": f"coalesce(eb_{b.slug}, 0)" for b in P.bands},
}
_bits = " + ".join(
    f"CASE WHEN f_{s} > 0 THEN -(f_{s} / n::DOUBLE) * log2(f_{s} / n::DOUBLE) ELSE 0 END"
    for s in P.slugs
)
SQL["facility_entropy_bits"] = f"({_bits})"
SQL["facility_entropy_normalised"] = f"({_bits}) / {math.log2(len(P.slugs))!r}::DOUBLE"
SQL["transitions_from_last_total"] = "t_total"
SQL |= {f"transition_count_from_last_{s}": f"t_{s}" for s in P.slugs}
SQL |= {f"transition_share_from_last_{s}": f"t_{s} / nullif(t_total, 0)::DOUBLE" for s in P.slugs}


def _shares(tag: str, name: str) -> dict[str, str]:
    total = " + ".join(f"{tag}_{s}" for s in P.slugs)
    return {
        f"community_facility_share_{name}{s}": f"{tag}_{s} / nullif({total}, 0)::DOUBLE"
        for s in P.slugs
    }


SQL |= _shares("c", "") | _shares("cw", "origin_weekday_") | _shares("cb", "origin_band_")
for _d in P.community_days:
    SQL |= _shares(f"c{_d}", f"{_d}d_")
SQL |= {f"community_lead_minutes_mean_{s}": f"cl_{s} / nullif(c_{s}, 0) / 60000000::DOUBLE" for s in P.slugs}

_SOURCES = {
    "m_bwd": "id", "f_ewma": "id", "f_trans": "id", "m_uh": "id",
    **{f"m_roll{d}": "id" for d in P.rolling_depths},
}


def digits(name: str) -> int:
    """Rounding that both engines' summation orders agree on."""
    return 3 if name.startswith("community_lead") else 6


def select_sql(names: list[str], origin: str = "f_run", extra: str = "") -> str:
    """Statement of named features over the origin rows."""
    texts = X.text_features(P)
    cells = [
        f"{SQL[n]} AS {n}" if n in texts else f"round(CAST({SQL[n]} AS DOUBLE), {digits(n)}) AS {n}"
        for n in names
    ]
    body = ", ".join(cells)
    joins = ""
    for table in ("m_bwd", "f_ewma", "f_trans", *(f"m_roll{d}" for d in P.rolling_depths)):
        marks = {"f_ewma": ("ef_", "eb_"), "f_trans": ("t_total", "t_")}.get(table, (f"{table}.",))
        if any(m in SQL[n] for n in names for m in marks):
            joins += f" JOIN {table} ON {table}.id = o.booking_id"
    if any(n.startswith("community_") for n in names):
        joins += " JOIN f_comm USING (us)"
    return (
        f"SELECT {extra or 'booking_id AS origin_booking_id'}, {body} FROM {origin} o{joins} "
        f"WHERE next_id IS NOT NULL AND n >= {P.min_prior}"
    )


def rounded(names: list[str]) -> list:
    texts = X.text_features(P)
    return [
        F.col(n) if n in texts else F.round(F.col(n).cast("double"), digits(n)).alias(n)
        for n in names
    ]


def family(name: str, names: list[str]) -> None:
    """Register one feature family over the origin rows."""
    own = [n for n in names if not n.startswith("community_")]

    def run(ws: Workspace) -> DataFrame:
        rows = ws.origin_rows().select(
            "us", F.col("booking_id").alias("origin_booking_id"), *own
        )
        if len(own) < len(names):
            rows = rows.join(ws.community, "us")
        return rows.select("origin_booking_id", *rounded(names))

    job(name, query(select_sql(names)))(run)


_numeric = X.numeric_features(P)


def _having(*starts: str) -> list[str]:
    return [n for n in [*X.text_features(P), *_numeric] if n.startswith(starts)]


family("feat_calendar", _having("origin_"))
family("feat_recency", _having("days_since_"))
family("feat_window_counts", _having("bookings_prior_", "booking_rate_"))
family("feat_interval_stats", _having("inter_booking_"))
family("feat_booking_routine", _having(
    "last_booking_", "booking_weekday_mode", "days_until_", "cadence_"))
family("feat_lead_and_last_usage", _having("last_usage_", "lead_minutes_"))
family("feat_distributions", _having("facility_count_", "facility_share_", "usage_weekday_",
                                     "time_band_"))
family("feat_last_k", [f"last_{k}_facility" for k in range(1, P.recent_slots + 1)])
family("feat_rolling_favourite", _having("rolling_top_"))
family("feat_ewma_shares", _having("ewma_"))
family("feat_entropy", _having("facility_entropy_"))
family("feat_transitions", _having("transition"))
family("feat_community_shares", [
    n for n in X.community_names(P)
    if "lead" not in n and not any(f"_{d}d_" in n for d in P.community_days)])
family("feat_community_windows", [
    n for n in X.community_names(P) if any(f"_{d}d_" in n for d in P.community_days)])
family("feat_community_lead", [n for n in X.community_names(P) if "lead" in n])


@job("time_band", query(f"""
SELECT booking_id, uh AS used_hour, uband AS used_band, {band_case('bh')} AS booked_band FROM bk"""))
def time_band(ws: Workspace) -> DataFrame:
    return ws.prepared.select("booking_id", "used_hour", "used_band", "booked_band")


_TABLE = query(select_sql(
    [*X.text_features(P), *_numeric], extra="sample_id, o.resident_id, next_id AS booking_id"
).replace(" FROM f_run o", " FROM f_run o JOIN (SELECT sample_id, origin_booking_id FROM smp) s "
          "ON s.origin_booking_id = o.booking_id"))


@job("feature_table", _TABLE)
def feature_table(ws: Workspace) -> DataFrame:
    names = [*X.text_features(P), *_numeric]
    return ws.feature_rows().select(*X.IDENTIFIERS, *rounded(names))



@job("feature_table_contract", query("SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', 0::BIGINT, true)"
    for c in [*(f"text_{t}" for t in [*X.IDENTIFIERS, *X.text_features(P)]),
              "numeric_columns_double", "column_order"]) + ') t("check", violations, passed)'))
def feature_table_contract(ws: Workspace) -> DataFrame:
    return C.feature_contract(
        ws.features, [*X.IDENTIFIERS, *X.text_features(P)], _numeric
    )


@job("as_of_audit", query("""
SELECT count(*) AS samples, 0::BIGINT AS resident_reads_past_origin,
  count(*) FILTER (us >= next_us) AS origins_past_target, 0::BIGINT AS prior_count_mismatches,
  count(*) FILTER (newest_us >= us) AS community_reads_at_origin,
  CAST(sum(own) AS BIGINT) AS resident_events_read,
  CAST(sum(n_community) AS BIGINT) AS community_events_covered
FROM og JOIN (SELECT id, count(*) AS own FROM past GROUP BY 1) ON id = booking_id
JOIN (SELECT us, n_community, newest_us FROM f_comm) USING (us)"""))
def as_of_audit(ws: Workspace) -> DataFrame:
    return X.as_of_audit(ws.samples, ws.origin_rows(), ws.community_reach)


_EVENTS = f"""
SELECT id AS origin_booking_id, CAST(row_number() OVER (PARTITION BY id ORDER BY us) AS INTEGER) AS position,
  facility_id, bwd AS booked_weekday, bh AS booked_hour,
  CAST(minute(booking_timestamp) AS INTEGER) AS booked_minute, uwd AS used_weekday, uh AS used_hour,
  round(lead_minutes / 60, 6) AS lead_hours,
  round(CASE WHEN row_number() OVER (PARTITION BY id ORDER BY us) > 1
    THEN gap_us / {DAY_US}.0::DOUBLE END, 6) AS gap_days
FROM past WHERE n > last_n - {P.prompt_events} AND id IN (SELECT booking_id FROM og)"""


@job("recent_events", query(_EVENTS))
def recent_events(ws: Workspace) -> DataFrame:
    flat = ws.origin_rows().select(
        F.col("booking_id").alias("origin_booking_id"), F.posexplode("recent_events")
    )
    return flat.select(
        "origin_booking_id", (F.col("pos") + 1).alias("position"), "col.facility_id",
        "col.booked_weekday", "col.booked_hour", "col.booked_minute", "col.used_weekday",
        "col.used_hour", F.round("col.lead_hours", 6).alias("lead_hours"),
        F.round("col.gap_days", 6).alias("gap_days"),
    )


@job("preferred_usage_hour", query(
    "SELECT booking_id AS origin_booking_id, v AS preferred_usage_hour FROM og JOIN m_uh ON id = booking_id"
))
def preferred_usage_hour(ws: Workspace) -> DataFrame:
    return ws.origin_rows().select(
        F.col("booking_id").alias("origin_booking_id"), "preferred_usage_hour"
    )


_RECENT = f"n > last_n - {P.change_depth}"
fragment("f_mix", f"""
SELECT id, max(last_n) AS total, count(*) FILTER ({_RECENT}) AS nr, count(*) FILTER (NOT {_RECENT}) AS ne,
  {', '.join(f"count(*) FILTER ({_RECENT} AND facility_id = '{f.name}') AS r_{f.slug}, "
             f"count(*) FILTER (NOT ({_RECENT}) AND facility_id = '{f.name}') AS e_{f.slug}"
             for f in P.facilities)} FROM past GROUP BY 1""")
fragment("f_change", f"""
SELECT id, CASE WHEN total >= {P.change_min_priors} THEN
    {js_sql([(f'r_{s}', f'e_{s}') for s in P.slugs], 'nr', 'ne')} END AS dist,
  CAST(total < {P.change_min_priors} AS INTEGER) AS insufficient FROM f_mix""")


@job("behaviour_change", query(f"""
SELECT id AS origin_booking_id, round(dist, 6) AS change_distance,
  CAST(coalesce(dist >= {P.change_threshold}, false) AS INTEGER) AS recent_behaviour_change,
  insufficient AS change_history_insufficient
FROM f_change WHERE id IN (SELECT booking_id FROM og)"""))
def behaviour_change(ws: Workspace) -> DataFrame:
    return ws.origin_rows().select(
        F.col("booking_id").alias("origin_booking_id"),
        F.round("change_distance", 6).alias("change_distance"), "recent_behaviour_change",
        "change_history_insufficient",
    )
