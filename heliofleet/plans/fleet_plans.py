"""Registered queries over the scored view and the catalogue, each with its SQL twin."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from heliofleet import fixed
from heliofleet.functions.columns import as_naive, instant, rounded
from heliofleet.operators import catalogue, scoring
from heliofleet.operators.asof import nearest_in_time, observations_on_grid
from heliofleet.plans.bindings import GRAIN, TOLERANCE, events, fleet, fleet_sql, sql_round, table

AS_OF = datetime(2024, 1, 16, 13, 0)
AS_OF_SQL = "TIMESTAMP '2024-01-16 13:00:00'"
NOW = datetime(2024, 1, 31, 0, 20)
NOW_SQL = "TIMESTAMP '2024-01-31 00:20:00'"


def performance_rounded(perf):
    return perf.select(
        "facility_code", "facility_name", "region", "interval_end", rounded(F.col("actual_mw"), 4).alias("actual_mw"),
        "capacity_mw", "ghi_wm2", *[rounded(F.col(c), 4).alias(c) for c in (
            "expected_mw", "performance_index", "rrp", "curtailed_mw")], "status")


SQL_PERF_ROUNDED = f"""SELECT facility_code, facility_name, region, interval_end, {sql_round('actual_mw', 4)} AS actual_mw,
 capacity_mw, ghi_wm2, {sql_round('expected_mw', 4)} AS expected_mw, {sql_round('performance_index', 4)} AS performance_index,
 {sql_round('rrp', 4)} AS rrp, {sql_round('curtailed_mw', 4)} AS curtailed_mw, status FROM perf"""

UNDER_SQL = f"""facility_code, facility_name, region, interval_end, {sql_round('actual_mw', 1)} AS actual_mw,
 {sql_round('expected_mw', 1)} AS expected_mw, {sql_round('performance_index', 2)} AS performance_index,
 {sql_round('rrp', 2)} AS price_per_mwh"""
CUT_SQL = f"""facility_code, facility_name, region, interval_end, status, {sql_round('actual_mw', 1)} AS actual_mw,
 {sql_round('expected_mw', 1)} AS expected_mw, {sql_round('curtailed_mw', 1)} AS curtailed_mw,
 {sql_round('rrp', 2)} AS price_per_mwh"""


def sql_anchor(as_of: str | None) -> str:
    return as_of or "(SELECT max(interval_end) FROM readings)"


def sql_latest(as_of: str | None) -> str:
    bound = f"AND interval_end <= {as_of}" if as_of else ""
    return (f"(SELECT max(interval_end) FROM perf WHERE performance_index IS NOT NULL "
            f"AND interval_end > {sql_anchor(as_of)} - INTERVAL 24 HOUR {bound})")


def sql_window(n: int, as_of: str | None) -> str:
    bound = f" AND interval_end <= {as_of}" if as_of else ""
    return f"interval_end > {sql_anchor(as_of)} - INTERVAL {n} HOUR{bound}"


def sql_fleet_summary(n: int, as_of: str | None) -> str:
    return f"""SELECT t.region, t.facilities, t.energy_mwh, t.avg_performance_index,
  coalesce(l.n, 0) AS underperforming_latest, coalesce(l.c, 0) AS curtailed_latest, {sql_round('coalesce(c.mwh, 0)', 1)} AS curtailed_mwh
FROM (SELECT region, count(DISTINCT facility_code) AS facilities, {sql_round('sum(actual_mw)', 1)} AS energy_mwh,
             {sql_round('avg(performance_index)', 2)} AS avg_performance_index
      FROM perf WHERE {sql_window(n, as_of)} GROUP BY region) t
LEFT JOIN (SELECT region, count(*) FILTER (status = 'underperforming') AS n,
                  count(*) FILTER (status = 'curtailed' OR status = 'likely_curtailed') AS c
           FROM perf WHERE interval_end = {sql_latest(as_of)} GROUP BY region) l ON l.region = t.region
LEFT JOIN (SELECT u.region, sum(greatest(coalesce(d.uigf, d.availability, 0) - d.total_cleared, 0)) AS mwh
           FROM dispatch d JOIN units u ON u.duid = d.duid
           WHERE d.semidispatch_cap AND {sql_window(n, as_of)} GROUP BY u.region) c ON c.region = t.region"""


def nearest_weather(spark, sf):
    f = fleet(spark, sf)
    probes = f.readings.join(f.units.select("duid", "facility_code"), "duid").select(
        "facility_code", "interval_end").distinct()
    sun = observations_on_grid(f.weather, ["facility_code"], "observed_at", ["ghi_wm2"],
                               "interval_end", GRAIN, TOLERANCE)
    return probes.join(sun, ["facility_code", "interval_end"], "left")


def backward_weather(spark, sf):
    f = fleet(spark, sf)
    probes = f.readings.join(f.units.select("duid", "facility_code"), "duid").select(
        "facility_code", "interval_end").distinct()
    sun = observations_on_grid(f.weather, ["facility_code"], "observed_at", ["ghi_wm2"],
                               "interval_end", GRAIN, 60, "backward")
    return probes.join(sun, ["facility_code", "interval_end"], "left")


NAMED = ("F3", "F7", "NOWHERE")


def named_summaries(spark, sf):
    """Summaries of farms asked for by code, one of which has no readings."""
    f = fleet(spark, sf)
    one, two, none = (as_naive(catalogue.facility_summary(f, 168, code)) for code in NAMED)
    return one.union(two).union(none)


def any_second(direction):
    """Raw events cut to the second as probes, against the observations of their facility."""
    def build(spark, sf):
        f = fleet(spark, sf)
        probes = events(spark, sf).where(F.col("event_type").isin("click", "purchase")).select(
            "event_id", F.concat(F.lit("F"), F.col("user_id") % 10).alias("facility_code"),
            F.date_trunc("second", "ts").alias("at"))
        return nearest_in_time(probes, f.weather, ["facility_code"], "at", "observed_at", ["ghi_wm2"],
                               30, direction=direction)
    return build


def sql_any_second(condition, order):
    return fleet_sql(f"""SELECT p.event_id, p.facility_code, p.at, w.ghi_wm2, w.observed_at
FROM (SELECT event_id, concat('F', user_id % 10) AS facility_code, date_trunc('second', ts) AS at FROM events
      WHERE event_type IN ('click', 'purchase')) p
LEFT JOIN LATERAL (SELECT ghi_wm2, observed_at FROM weather o WHERE o.facility_code = p.facility_code AND {condition}
                   ORDER BY {order} LIMIT 1) w ON true""")


SQL_PROBES = """SELECT p.facility_code, p.interval_end, w.ghi_wm2, w.observed_at
FROM (SELECT DISTINCT u.facility_code, r.interval_end FROM readings r JOIN units u USING (duid)) p
LEFT JOIN LATERAL (SELECT ghi_wm2, observed_at FROM weather o WHERE o.facility_code = p.facility_code AND {0}
                   ORDER BY {1} LIMIT 1) w ON true"""


def facility_performance_backward(spark, sf):
    f = fleet(spark, sf)
    return scoring.facility_performance(
        f.readings, f.units, f.weather, f.prices, f.dispatch, GRAIN, fixed.BACKWARD_WEATHER_MINUTES,
        match="backward", min_ghi=None,
    ).select("facility_code", "interval_end", "ghi_wm2", rounded(F.col("expected_mw"), 4).alias("expected_mw"),
             rounded(F.col("performance_index"), 4).alias("performance_index"))


def expected_output_library(spark, sf):
    """The single-row scoring rules over every order line as (capacity, irradiance, actual)."""
    li = table(spark, sf, "lineitem")
    cap, ghi = F.col("l_quantity"), F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice") / 50 - 100)
    expected = scoring.expected_mw(cap, ghi, null_without_ghi=True)
    index = scoring.performance_index(F.col("l_quantity") * (F.col("l_discount") * 12 - F.lit(0.1)), cap, ghi, min_ghi=None)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", rounded(expected, 4).alias("expected_mw"),
                     rounded(index, 4).alias("performance_index"))


def usage_by_model(spark, sf):
    conv = table(spark, sf, "conversations")
    models = F.array(*[F.lit(m) for m in (
        "gpt-4o-mini", "apac.amazon.nova-lite-v1:0", "us.amazon.nova-pro-v1:0", "amazon.nova-lite-v1:0", "unlisted-model", "eu.gpt-4o")])
    usage = conv.select(
        F.element_at(models, (F.col("conv_id") % 6 + 1).cast("int")).alias("model"),
        F.when(F.col("role") != "assistant", F.length("text")).otherwise(0).alias("input_tokens"),
        F.when(F.col("role") == "assistant", F.length("text")).otherwise(0).alias("output_tokens"))
    prices = spark.createDataFrame(list(fixed.MODEL_PRICES), "model string, price_in double, price_out double")
    overrides = spark.createDataFrame([("gpt-4o", 3.0, 12.0)], prices.schema)
    return catalogue.usage_cost(usage, prices, overrides)


def freshness_by_unit(spark, sf):
    f = fleet(spark, sf)
    latest = f.readings.groupBy("duid").agg(F.max("interval_end").alias("latest_interval"))
    return catalogue.freshness(latest, instant(NOW))


def find_texts(spark, sf):
    """Search texts made from every part row: fragments, exact codes, wildcards and whole names."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.when(k % 5 == 0, F.concat(F.lit(" f"), k % 12))
        .when(k % 5 == 1, F.concat(F.lit("arm "), k % 12))
        .when(k % 5 == 2, F.concat(F.lit("F_r%"), k % 7))
        .when(k % 5 == 3, F.lit("%"))
        .otherwise(F.col("p_name")).alias("text"))


FIND_TEXTS_SQL = """SELECT DISTINCT trim(CASE p_partkey % 5 WHEN 0 THEN concat(' f', p_partkey % 12) WHEN 1 THEN concat('arm ', p_partkey % 12)
 WHEN 2 THEN concat('F_r%', p_partkey % 7) WHEN 3 THEN '%' ELSE p_name END) AS t FROM part"""


REGISTERED = {
    "facility_output": (
        lambda s, d: (lambda f: as_naive(scoring.facility_output(f.readings, f.units).withColumn(
            "actual_mw", rounded(F.col("actual_mw"), 4))))(fleet(s, d)),
        fleet_sql(f"SELECT facility_code, interval_end, facility_name, region, {sql_round('actual_mw', 4)} AS actual_mw, capacity_mw FROM perf_raw", True)),
    "facility_curtailed": (
        lambda s, d: (lambda f: as_naive(scoring.facility_curtailed(f.dispatch, f.units).withColumn(
            "curtailed_mw", rounded(F.col("curtailed_mw"), 4))))(fleet(s, d)),
        fleet_sql(f"SELECT facility_code, interval_end, {sql_round('curtailed_mw', 4)} AS curtailed_mw FROM perf_cut", True)),
    "expected_output_library": (expected_output_library, f"""
SELECT l_orderkey, l_linenumber, l_partkey, {sql_round('e', 4)} AS expected_mw,
       CASE WHEN e >= 0.05 * cap AND e > 0 THEN {sql_round('(CASE WHEN a > 0 THEN a ELSE 0 END) / e', 4)} END AS performance_index
FROM (SELECT *, CASE WHEN ghi IS NULL THEN NULL WHEN ghi <= 0 THEN 0 WHEN ghi / 1000.0 * 0.8 > 1 THEN cap ELSE cap * (ghi / 1000.0 * 0.8) END AS e
      FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS cap, l_quantity * (l_discount * 12 - 0.1::DOUBLE) AS a,
                   CASE WHEN l_linenumber <> 3 THEN l_extendedprice / 50 - 100 END AS ghi FROM lineitem))"""),
    "nearest_weather": (lambda s, d: as_naive(nearest_weather(s, d)), fleet_sql(SQL_PROBES.format(
        "o.observed_at BETWEEN p.interval_end - INTERVAL 30 MINUTE AND p.interval_end + INTERVAL 30 MINUTE",
        "abs(epoch_us(o.observed_at) - epoch_us(p.interval_end)), o.observed_at"))),
    "backward_weather": (lambda s, d: as_naive(backward_weather(s, d)), fleet_sql(SQL_PROBES.format(
        "o.observed_at <= p.interval_end AND o.observed_at > p.interval_end - INTERVAL 1 HOUR", "o.observed_at DESC"))),
    "nearest_weather_any_second": (lambda s, d: as_naive(any_second("nearest")(s, d)), sql_any_second(
        "o.observed_at BETWEEN p.at - INTERVAL 30 MINUTE AND p.at + INTERVAL 30 MINUTE",
        "abs(epoch_us(o.observed_at) - epoch_us(p.at)), o.observed_at")),
    "backward_weather_any_second": (lambda s, d: as_naive(any_second("backward")(s, d)), sql_any_second(
        "o.observed_at <= p.at AND o.observed_at > p.at - INTERVAL 30 MINUTE", "o.observed_at DESC")),
    "facility_performance": (
        lambda s, d: as_naive(performance_rounded(fleet(s, d).performance())), fleet_sql(SQL_PERF_ROUNDED, True)),
    "facility_performance_backward": (lambda s, d: as_naive(facility_performance_backward(s, d)), fleet_sql(f"""
SELECT facility_code, interval_end, ghi_wm2, {sql_round('e', 4)} AS expected_mw,
       CASE WHEN ghi_wm2 IS NOT NULL AND e >= capacity_mw * 0.05 THEN {sql_round('greatest(actual_mw, 0) / e', 4)} END AS performance_index
FROM (SELECT f.*, w.ghi_wm2, CASE WHEN w.ghi_wm2 > 0 THEN least(f.capacity_mw, f.capacity_mw * (w.ghi_wm2 / 1000.0 * 0.8)) ELSE 0 END AS e
      FROM perf_raw f ASOF LEFT JOIN weather w ON w.facility_code = f.facility_code AND w.observed_at <= f.interval_end
      WHERE w.observed_at > f.interval_end - INTERVAL 1 HOUR
      UNION ALL
      SELECT f.*, NULL, 0 FROM perf_raw f WHERE NOT EXISTS (
        SELECT 1 FROM weather w WHERE w.facility_code = f.facility_code AND w.observed_at <= f.interval_end
           AND w.observed_at > f.interval_end - INTERVAL 1 HOUR))""", True)),
    "latest_interval": (
        lambda s, d: as_naive(catalogue.latest_interval(fleet(s, d).readings)),
        fleet_sql("SELECT max(interval_end) AS latest_interval FROM readings")),
    "latest_scored": (
        lambda s, d: as_naive(catalogue.latest_scored(fleet(s, d))),
        fleet_sql(f"SELECT {sql_latest(None)} AS latest_scored", True)),
    "trailing_window": (
        lambda s, d: as_naive(performance_rounded(catalogue.trailing(fleet(s, d), 48))),
        fleet_sql(f"{SQL_PERF_ROUNDED} WHERE {sql_window(48, None)}", True)),
    "status_counts": (
        lambda s, d: as_naive(catalogue.status_counts(fleet(s, d))),
        fleet_sql("""SELECT count(*) AS units, count(DISTINCT facility_code) AS facilities, (SELECT count(*) FROM ledger) AS files,
 (SELECT count(*) FROM readings) AS readings, (SELECT max(interval_end) FROM readings) AS latest_interval,
 (SELECT max(observed_at) FROM weather) AS latest_weather FROM units""")),
    "facilities": (
        lambda s, d: catalogue.facilities(fleet(s, d).units),
        fleet_sql(f"""SELECT facility_code, max(facility_name) AS facility_name, max(region) AS region, {sql_round('sum(capacity_mw)', 1)} AS capacity_mw,
 count(*) AS units, {sql_round('avg(latitude)', 4)} AS latitude, {sql_round('avg(longitude)', 4)} AS longitude FROM units GROUP BY 1""")),
    "facilities_in_region": (
        lambda s, d: catalogue.find_facilities_report(fleet(s, d).units, "ASIA", 50),
        fleet_sql(f"""SELECT *, count(*) OVER () AS count FROM (SELECT facility_code, max(facility_name) AS facility_name, max(region) AS region,
 {sql_round('sum(capacity_mw)', 1)} AS capacity_mw, count(*) AS units, {sql_round('avg(latitude)', 4)} AS latitude, {sql_round('avg(longitude)', 4)} AS longitude
 FROM units WHERE region = 'ASIA' GROUP BY 1) ORDER BY facility_name, facility_code LIMIT 50""")),
    "facility_sites": (
        lambda s, d: catalogue.facility_sites(fleet(s, d).units),
        fleet_sql("SELECT facility_code, avg(latitude) AS latitude, avg(longitude) AS longitude FROM units GROUP BY 1")),
    "find_facility": (
        lambda s, d: catalogue.find_facility(fleet(s, d).units, " farm "),
        fleet_sql(f"""SELECT facility_code, max(facility_name) AS facility_name, max(region) AS region, {sql_round('sum(capacity_mw)', 1)} AS capacity_mw
 FROM units WHERE lower(facility_code) = 'farm' OR facility_name ILIKE '%farm%' GROUP BY 1
 ORDER BY bool_or(lower(facility_code) = 'farm') DESC, length(max(facility_name)), 1 LIMIT 1""")),
    "find_facility_batch": (
        lambda s, d: catalogue.find_facility_batch(fleet(s, d).units, find_texts(s, d)),
        fleet_sql(f"""SELECT searched_for, facility_code, facility_name, region, capacity_mw FROM (
 SELECT t AS searched_for, facility_code, max(facility_name) AS facility_name, max(region) AS region, {sql_round('sum(capacity_mw)', 1)} AS capacity_mw,
        row_number() OVER (PARTITION BY t ORDER BY bool_or(lower(facility_code) = lower(t)) DESC, length(max(facility_name)), facility_code) AS rn
 FROM units, ({FIND_TEXTS_SQL}) q WHERE lower(facility_code) = lower(t) OR facility_name ILIKE concat('%', t, '%') GROUP BY t, facility_code) WHERE rn = 1""")),
    "underperformers": (
        lambda s, d: as_naive(catalogue.underperformers(fleet(s, d), as_of=AS_OF)),
        fleet_sql(f"""SELECT * FROM (SELECT {UNDER_SQL} FROM perf WHERE interval_end = {sql_latest(AS_OF_SQL)} AND performance_index < 0.6
 AND (status IS NULL OR status = 'ok' OR status = 'underperforming')) ORDER BY performance_index, facility_code LIMIT 10""", True)),
    "underperformers_latest": (
        lambda s, d: as_naive(catalogue.underperformers(fleet(s, d), threshold=1.5)),
        fleet_sql(f"""SELECT * FROM (SELECT {UNDER_SQL} FROM perf WHERE interval_end = {sql_latest(None)} AND performance_index < 1.5
 AND (status IS NULL OR status = 'ok' OR status = 'underperforming')) ORDER BY performance_index, facility_code LIMIT 10""", True)),
    "underperformers_by_interval": (
        lambda s, d: as_naive(catalogue.underperformers_by_interval(fleet(s, d), limit=3)),
        fleet_sql(f"""SELECT *, row_number() OVER (PARTITION BY interval_end ORDER BY performance_index, facility_code) AS place
 FROM (SELECT {UNDER_SQL} FROM perf WHERE performance_index < 0.6 AND status NOT LIKE '%curtailed') QUALIFY place <= 3""", True)),
    "underperformers_report": (
        lambda s, d: as_naive(catalogue.underperformers_report(fleet(s, d), as_of=AS_OF)),
        fleet_sql(f"""SELECT *, (SELECT count(*) FROM (SELECT 1 FROM perf WHERE interval_end = {sql_latest(AS_OF_SQL)} AND status LIKE '%curtailed' LIMIT 25)) AS curtailed_excluded
 FROM (SELECT {UNDER_SQL} FROM perf WHERE interval_end = {sql_latest(AS_OF_SQL)} AND performance_index < 0.6
 AND (status IS NULL OR status = 'ok' OR status = 'underperforming')) ORDER BY performance_index, facility_code LIMIT 10""", True)),
    "curtailed_farms": (
        lambda s, d: as_naive(catalogue.curtailed_farms(fleet(s, d), as_of=AS_OF)),
        fleet_sql(f"""SELECT {CUT_SQL} FROM perf p WHERE interval_end = {sql_latest(AS_OF_SQL)} AND status LIKE '%curtailed'
 ORDER BY p.expected_mw - p.actual_mw DESC, facility_code LIMIT 10""", True)),
    "curtailed_by_interval": (
        lambda s, d: as_naive(catalogue.curtailed_by_interval(fleet(s, d), limit=3)),
        fleet_sql(f"""SELECT {CUT_SQL}, place FROM (SELECT *, row_number() OVER (PARTITION BY interval_end ORDER BY expected_mw - actual_mw DESC, facility_code) AS place
 FROM perf WHERE status LIKE '%curtailed') WHERE place <= 3""", True)),
    "facility_summary": (
        lambda s, d: as_naive(catalogue.facility_summary(fleet(s, d), 168, as_of=AS_OF)),
        fleet_sql(f"""SELECT facility_code, count(*) AS intervals, {sql_round('sum(actual_mw)', 1)} AS energy_mwh, {sql_round('max(actual_mw)', 1)} AS peak_mw,
 {sql_round('avg(performance_index)', 2)} AS avg_performance_index, {sql_round('min(performance_index)', 2)} AS min_performance_index,
 {sql_round('sum(curtailed_mw)', 1)} AS curtailed_mwh, sum(CASE WHEN status = 'curtailed' THEN 1 ELSE 0 END)::BIGINT AS curtailed_intervals,
 sum(CASE WHEN status = 'likely_curtailed' THEN 1 ELSE 0 END)::BIGINT AS likely_curtailed_intervals, max(interval_end) AS latest_interval
 FROM perf WHERE {sql_window(168, AS_OF_SQL)} GROUP BY 1""", True)),
    "facility_summary_named": (
        named_summaries,
        fleet_sql(" UNION ALL ".join(f"""SELECT '{code}' AS facility_code, count(*) AS intervals, {sql_round('sum(actual_mw)', 1)} AS energy_mwh,
 {sql_round('max(actual_mw)', 1)} AS peak_mw, {sql_round('avg(performance_index)', 2)} AS avg_performance_index,
 {sql_round('min(performance_index)', 2)} AS min_performance_index, {sql_round('sum(curtailed_mw)', 1)} AS curtailed_mwh,
 count(*) FILTER (WHERE status = 'curtailed') AS curtailed_intervals, count(*) FILTER (WHERE status = 'likely_curtailed') AS likely_curtailed_intervals,
 max(interval_end) AS latest_interval FROM perf WHERE facility_code = '{code}' AND {sql_window(168, None)}""" for code in NAMED), True)),
    "facility_hourly": (
        lambda s, d: as_naive(catalogue.facility_hourly(fleet(s, d), 168)),
        fleet_sql(f"""SELECT facility_code, date_trunc('hour', interval_end) AS hour, {sql_round('avg(actual_mw)', 1)} AS avg_mw,
 {sql_round('avg(expected_mw)', 1)} AS expected_mw, {sql_round('avg(performance_index)', 2)} AS performance_index
 FROM perf WHERE {sql_window(168, None)} GROUP BY 1, 2""", True)),
    "fleet_summary": (
        lambda s, d: catalogue.fleet_summary(fleet(s, d), 168), fleet_sql(sql_fleet_summary(168, None), True)),
    "fleet_summary_as_of": (
        lambda s, d: catalogue.fleet_summary(fleet(s, d), 72, as_of=AS_OF), fleet_sql(sql_fleet_summary(72, AS_OF_SQL), True)),
    "fleet_kpis": (
        lambda s, d: catalogue.fleet_kpis(catalogue.fleet_summary(fleet(s, d), 168, as_of=AS_OF)),
        fleet_sql(f"""SELECT {sql_round('sum(energy_mwh)', 1)} AS energy_mwh, sum(facilities)::BIGINT AS facilities,
 {sql_round('sum(CASE WHEN avg_performance_index IS NOT NULL THEN facilities * avg_performance_index END) / sum(CASE WHEN avg_performance_index IS NOT NULL THEN facilities END)', 4)} AS avg_performance_index,
 sum(underperforming_latest)::BIGINT AS underperforming, sum(curtailed_latest)::BIGINT AS curtailed, {sql_round('sum(curtailed_mwh)', 1)} AS curtailed_mwh
 FROM ({sql_fleet_summary(168, AS_OF_SQL)})""", True)),
    "freshness": (
        lambda s, d: as_naive(freshness_by_unit(s, d)),
        fleet_sql(f"""SELECT duid, latest_interval, CAST(round((epoch_us({NOW_SQL}) - epoch_us(latest_interval)) / 60e6) AS BIGINT) AS lag_minutes,
 CASE WHEN latest_interval >= {NOW_SQL} - INTERVAL 15 MINUTE THEN 'live' WHEN latest_interval >= {NOW_SQL} - INTERVAL 30 MINUTE THEN 'delayed' ELSE 'stale' END AS state
 FROM (SELECT duid, max(interval_end) AS latest_interval FROM readings GROUP BY 1)""")),
    "usage_cost": (usage_by_model, f"""
WITH u AS (SELECT CASE conv_id % 6 WHEN 0 THEN 'gpt-4o-mini' WHEN 2 THEN 'amazon.nova-pro-v1:0' WHEN 4 THEN 'unlisted-model' WHEN 5 THEN 'gpt-4o'
   ELSE 'amazon.nova-lite-v1:0' END AS model, role, length(text) AS n FROM conversations),
 t AS (SELECT model, sum(CASE WHEN role <> 'assistant' THEN n ELSE 0 END)::BIGINT AS input_tokens, sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END)::BIGINT AS output_tokens FROM u GROUP BY 1)
SELECT model, input_tokens, output_tokens, {sql_round('''(input_tokens * CASE model WHEN 'gpt-4o-mini' THEN 0.15 WHEN 'amazon.nova-pro-v1:0' THEN 0.8 WHEN 'gpt-4o' THEN 3.0 WHEN 'amazon.nova-lite-v1:0' THEN 0.06 ELSE 0 END
  + output_tokens * CASE model WHEN 'gpt-4o-mini' THEN 0.6 WHEN 'amazon.nova-pro-v1:0' THEN 3.2 WHEN 'gpt-4o' THEN 12.0 WHEN 'amazon.nova-lite-v1:0' THEN 0.24 ELSE 0 END)::DOUBLE / 1e6''', 8)} AS cost_usd FROM t"""),
}
