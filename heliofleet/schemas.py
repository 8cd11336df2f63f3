"""Explicit schemas of the tables at rest and of the payloads read."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


S, D, I, B, TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.TimestampType()

UNITS = _struct(
    ("duid", S, False), ("facility_code", S, False), ("facility_name", S, False), ("region", S, False),
    ("latitude", D, False), ("longitude", D, False), ("capacity_mw", D, False), ("updated_at", TS, True),
)
READINGS = _struct(("duid", S, False), ("interval_end", TS, False), ("mw", D, False))
WEATHER = _struct(
    ("facility_code", S, False), ("observed_at", TS, False),
    ("ghi_wm2", D, True), ("temp_c", D, True), ("cloud_cover_pct", D, True),
)
LEDGER = _struct(
    ("file_name", S, False), ("interval_end", TS, False),
    ("rows_total", I, False), ("rows_solar", I, False), ("ingested_at", TS, True),
)
PRICES = _struct(("region", S, False), ("interval_end", TS, False), ("rrp", D, False))
DISPATCH = _struct(
    ("duid", S, False), ("interval_end", TS, False), ("total_cleared", D, False),
    ("availability", D, True), ("uigf", D, True), ("semidispatch_cap", B, False),
)
CHUNKS = _struct(
    ("id", S, False), ("doc", S, False), ("title", S, False), ("section", S, False),
    ("text", S, False), ("section_no", I, False), ("part_no", I, False),
)

# One raw row of a sectioned report: its place and its comma-separated fields.
REPORT_ROWS = _struct(
    ("file", S, False), ("member", S, False), ("line_no", T.LongType(), False),
    ("fields", T.ArrayType(S), False),
)

REGISTRY_PAYLOAD = _struct(
    ("data", T.ArrayType(_struct(
        ("code", S, True), ("name", S, True), ("network_id", S, True), ("network_region", S, True),
        ("location", _struct(("lat", D, True), ("lng", D, True)), True),
        ("units", T.ArrayType(_struct(
            ("code", S, True), ("fueltech_id", S, True), ("status_id", S, True),
            ("capacity_registered", D, True),
        )), True),
    )), True),
)
HOURLY_PAYLOAD = _struct(
    ("hourly", _struct(
        ("time", T.ArrayType(S), True), ("shortwave_radiation", T.ArrayType(D), True),
        ("temperature_2m", T.ArrayType(D), True), ("cloud_cover", T.ArrayType(D), True),
    ), True),
)
CURRENT_PAYLOAD = _struct(
    ("current", _struct(
        ("time", S, True), ("shortwave_radiation", D, True),
        ("temperature_2m", D, True), ("cloud_cover", D, True),
    ), True),
)
