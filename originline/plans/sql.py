"""Shared SQL fragments of the oracles, in DuckDB's dialect.

Each fragment is the plain, single-node statement of a stage table; ``query``
prefixes a statement with the fragments it needs.
"""

from __future__ import annotations

import re

from originline.params import DAY_US, TEST, Params, bucket_edges

FRAGMENTS: dict[str, str] = {}


def fragment(name: str, sql: str) -> None:
    FRAGMENTS[name] = sql


def query(body: str) -> str:
    """The statement with every fragment it mentions, in dependency order."""
    ordered: list[str] = []

    def visit(text: str, owner: str) -> None:
        for name in FRAGMENTS:
            if name == owner or name in ordered:
                continue
            if re.search(rf"\b{name}\b", text):
                visit(FRAGMENTS[name], name)
                ordered.append(name)

    visit(body, "")
    if not ordered:
        return body
    parts = ",\n".join(f"{name} AS ({FRAGMENTS[name]})" for name in ordered)
    return f"WITH {parts}\n{body}"


P: Params = TEST


def quoted(items) -> str:
    return ", ".join(f"'{i}'" for i in items)


def band_case(hour: str) -> str:
    whens = " ".join(
        f"WHEN {hour} >= {b.open_hour} AND {hour} < {b.close_hour} THEN '{b.name}'"
        for b in P.bands
    )
    return f"CASE {whens} END"


def values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows)


fragment("bk_raw", """
SELECT CAST(event_id AS VARCHAR) AS booking_id, CAST(user_id AS VARCHAR) AS resident_id,
  event_type AS facility_id, ts AS booking_timestamp, epoch_us(ts) AS us,
  epoch_us(ts) + CAST(greatest(round(value * 100), 50) AS BIGINT) * 36000000 AS usage_us
FROM events""")
fragment("bk", f"""
SELECT *, make_timestamp(usage_us) AS usage_timestamp,
  (usage_us - us) / 60000000.0::DOUBLE AS lead_minutes,
  CAST(isodow(booking_timestamp) - 1 AS INTEGER) AS bwd,
  CAST(hour(booking_timestamp) AS INTEGER) AS bh,
  CAST(isodow(make_timestamp(usage_us)) - 1 AS INTEGER) AS uwd,
  CAST(hour(make_timestamp(usage_us)) AS INTEGER) AS uh,
  {band_case('hour(make_timestamp(usage_us))')} AS uband,
  {band_case('hour(booking_timestamp)')} AS bband
FROM bk_raw""")
fragment("ob", """
SELECT CAST(o_orderkey AS VARCHAR) AS booking_id, CAST(o_custkey AS VARCHAR) AS resident_id,
  o_orderpriority AS facility_id, o_orderdate AS booking_timestamp, epoch_us(o_orderdate) AS us,
  make_timestamp(epoch_us(o_orderdate)
    + CAST(greatest(round(o_totalprice), 1) AS BIGINT) * 1000000) AS usage_timestamp
FROM orders""")
fragment("h", """
SELECT *, us - prev_us AS gap_us FROM (
  SELECT *, CAST(row_number() OVER w AS BIGINT) AS n, min(us) OVER w AS first_us,
    lag(us) OVER w AS prev_us, lag(facility_id) OVER w AS prev_facility,
    lead(us) OVER w AS next_us, lead(usage_us) OVER w AS next_usage_us,
    lead(booking_id) OVER w AS next_id, lead(facility_id) OVER w AS next_facility,
    lead(uwd) OVER w AS next_uwd, lead(uh) OVER w AS next_uh
  FROM bk WINDOW w AS (PARTITION BY resident_id ORDER BY us, booking_id))""")
# The rows that are an origin: one per sample.
fragment("og", f"SELECT * FROM h WHERE next_id IS NOT NULL AND n >= {P.min_prior}")
fragment("smp", """
SELECT printf('S%07d', row_number() OVER (ORDER BY us, next_id)) AS sample_id, resident_id,
  us AS origin_us, booking_id AS origin_booking_id, CAST(n AS INTEGER) AS n_prior_bookings,
  next_id AS target_booking_id, next_us AS target_us, next_usage_us AS target_usage_us,
  next_facility AS target_facility_id, next_uwd AS target_usage_weekday,
  next_uh AS target_usage_hour, (next_us - us) / 60000000.0::DOUBLE AS notification_delay_minutes
FROM og""")
fragment("cut", f"""
SELECT start_us, end_us,
  start_us + CAST(floor((end_us - start_us) * {P.train_frac}::DOUBLE) AS BIGINT) AS train_cut_us,
  start_us + CAST(floor((end_us - start_us)
    * {round(P.train_frac + P.val_frac, 9)}::DOUBLE) AS BIGINT) AS validation_cut_us
FROM (SELECT min(target_us) AS start_us, max(target_us) AS end_us FROM smp)""")
fragment("ss", """
SELECT smp.*, CASE WHEN target_us < train_cut_us THEN 'train'
  WHEN target_us < validation_cut_us THEN 'validation' ELSE 'test' END AS split
FROM smp, cut""")
fragment("cmp_ids", f"""
SELECT sample_id FROM ss WHERE split = 'test'
ORDER BY md5('{P.seed}|' || sample_id), sample_id LIMIT {P.comparison_rows}""")
