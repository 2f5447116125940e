"""Declared table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _TS, _I, _D, _L = (
    T.StringType(), T.TimestampType(), T.IntegerType(), T.DoubleType(), T.LongType(),
)


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


BOOKINGS = _table(
    ("booking_id", _S), ("resident_id", _S), ("facility_id", _S),
    ("booking_timestamp", _TS), ("usage_timestamp", _TS),
)
SAMPLES = _table(
    ("sample_id", _S), ("resident_id", _S), ("origin", _TS), ("origin_booking_id", _S),
    ("n_prior_bookings", _I), ("target_booking_id", _S), ("target_booking_timestamp", _TS),
    ("target_usage_timestamp", _TS), ("target_facility_id", _S), ("target_usage_weekday", _I),
    ("target_usage_hour", _I), ("notification_delay_minutes", _D),
)
SPLITS = _table(("sample_id", _S), ("split", _S))
PREDICTIONS = _table(
    ("track", _S), ("model", _S), ("sample_id", _S), ("predicted_facility_id", _S),
    ("predicted_usage_weekday", _I), ("predicted_usage_hour", _I),
    ("predicted_delay_minutes", _D), ("predicted_transition_facility_id", _S),
)
PROMPTS = _table(("sample_id", _S), ("system", _S), ("prompt", _S), ("target", _S))
ANSWERS = _table(
    ("sample_id", _S), ("arm", _S), ("status", _S),
    ("fields", _table(
        ("facility", _S), ("usage_day", _S), ("usage_hour", _I),
        ("notification_delay_bucket", _S),
    )),
    ("attempts", _I), ("failure_stage", _S), ("failure_reason", _S),
    ("semantic_invalid_reason", _S), ("seconds", _D), ("prompt_tokens", _I),
    ("completion_tokens", _I), ("identity_hash", _S),
)

# Table name to its schema and primary key.
TABLES: dict[str, tuple[T.StructType, tuple[str, ...]]] = {
    "bookings": (BOOKINGS, ("booking_id",)),
    "samples": (SAMPLES, ("sample_id",)),
    "splits": (SPLITS, ("sample_id",)),
    "predictions": (PREDICTIONS, ("track", "model", "sample_id")),
}
