"""Registered queries that run streams to completion over the given tables, and batch forms of
alarms, roll-ups and re-scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from heliofleet import fixed
from heliofleet.functions.columns import as_naive, rounded
from heliofleet.plans.bindings import events, fleet, fleet_sql, sql_round, table, SQL_PERFORMANCE
from heliofleet.plans.ingest_plans import _stamp, with_strangers
from heliofleet.session import configure, shared_dir
from heliofleet.streaming import ingest as stream_ingest, metrics, scores

NOW_TRIGGER = {"availableNow": True}


def _finish(query) -> None:
    query.awaitTermination()


def daily_reports(f, path: str) -> None:
    """Readings as one plain report per market day under ``report=<name>/``."""
    day = F.date_format(F.from_utc_timestamp("interval_end", fixed.NEM_OFFSET), "yyyyMMdd")
    rows = with_strangers(f).withColumn("report", F.concat(F.lit("PUBLIC_DISPATCHSCADA_"), day, F.lit("0000_1.zip")))
    head = rows.select("report").distinct().select(
        "report", F.lit("").alias("k"), F.lit("I,DISPATCH,UNIT_SCADA,1,SETTLEMENTDATE,DUID,SCADAVALUE").alias("value"))
    data = rows.select("report", F.concat(F.date_format("interval_end", "yyyyMMddHH"), "duid").alias("k"), F.concat(
        F.lit('D,DISPATCH,UNIT_SCADA,1,"'), _stamp(F.col("interval_end")), F.lit('",'), "duid", F.lit(","), F.col("mw").cast("string")).alias("value"))
    (head.unionByName(data).repartition("report").sortWithinPartitions("report", "k").drop("k")
     .write.partitionBy("report").text(path))


def stream_ingest_readings(spark, sf) -> DataFrame:
    f = fleet(spark, sf)
    root = shared_dir(spark, "stream-ingest")
    store = stream_ingest.Store(f"{root}/store")
    daily_reports(f, f"{root}/reports")
    _finish(stream_ingest.start_text_ingest(spark, f"{root}/reports", f.units, store, 20, NOW_TRIGGER))
    return spark.read.parquet(store.readings).select("duid", "interval_end", "mw", F.col("date").cast("string").alias("date"))


def stream_ingest_ledger(spark, sf) -> DataFrame:
    f = fleet(spark, sf)
    root = shared_dir(spark, "stream-ledger")
    store = stream_ingest.Store(f"{root}/store")
    daily_reports(f, f"{root}/reports")
    _finish(stream_ingest.start_text_ingest(spark, f"{root}/reports", f.units, store, 20, NOW_TRIGGER))
    return stream_ingest.ledger(spark, store).drop("batch", "ingested_at", "date")


def event_stream(spark, sf) -> DataFrame:
    configure(spark)
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_first_sightings(spark, sf) -> DataFrame:
    root = shared_dir(spark, "stream-dedup")
    keyed = event_stream(spark, sf).select(
        F.concat(F.lit("U"), "user_id").alias("duid"), F.date_trunc("hour", "ts").alias("interval_end"))
    once = stream_ingest.first_sightings(keyed, "40 days")
    _finish(once.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint")
            .trigger(**NOW_TRIGGER).start(f"{root}/out"))
    return spark.read.parquet(f"{root}/out")


def stream_hourly_profile(spark, sf) -> DataFrame:
    f = fleet(spark, sf)
    root = shared_dir(spark, "stream-profile")
    readings = event_stream(spark, sf).select(
        F.concat(F.lit("U"), "user_id").alias("duid"),
        F.timestamp_micros(F.unix_micros("ts") - F.pmod(F.unix_micros("ts"), F.lit(300_000_000))).alias("interval_end"), F.col("value").alias("mw"))
    profile = scores.hourly_profile(readings, f.units, "2 days")
    _finish(scores.start_updates(profile, f"{root}/updates", f"{root}/checkpoint", NOW_TRIGGER))
    return scores.current_state(spark.read.parquet(f"{root}/updates"), ["facility_code", "hour"])


def stream_scored_hours(spark, sf) -> DataFrame:
    """Readings and weather as two streams of files. The last row of each is far ahead and belongs to no farm:
    it moves the watermarks past every hour, so that all of them come out."""
    f = fleet(spark, sf)
    root = shared_dir(spark, "stream-scored")
    end = F.expr("INTERVAL 30 DAYS")
    readings, weather = f.readings.select("duid", "interval_end", "mw"), f.weather.select("facility_code", "observed_at", "ghi_wm2")
    readings.unionByName(readings.agg((F.max("interval_end") + end).alias("interval_end")).select(
        F.lit("").alias("duid"), "interval_end", F.lit(0.0).alias("mw"))).write.parquet(f"{root}/readings")
    weather.unionByName(weather.agg((F.max("observed_at") + end).alias("observed_at")).select(
        F.lit("").alias("facility_code"), "observed_at", F.lit(0.0).alias("ghi_wm2"))).write.parquet(f"{root}/weather")
    streams = [spark.readStream.schema(df.schema).parquet(f"{root}/{part}") for part, df in (("readings", readings), ("weather", weather))]
    hours = scores.scored_hours(*streams, f.units, "10 days", f.interval_minutes, f.tolerance_minutes)
    _finish(hours.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(**NOW_TRIGGER).start(f"{root}/out"))
    return spark.read.schema(hours.schema).parquet(f"{root}/out")


def stream_metric_totals(spark, sf) -> DataFrame:
    configure(spark)
    root = shared_dir(spark, "stream-metrics")
    rolled = metrics.stream_rollups(event_stream(spark, sf).select(F.col("event_type").alias("series"), "ts", "value"), 60, "2 days")
    _finish(scores.start_updates(rolled, f"{root}/updates", f"{root}/checkpoint", NOW_TRIGGER))
    return scores.current_state(spark.read.parquet(f"{root}/updates"), ["series", "period"]).select(
        "series", "period", "n", rounded(F.col("total"), 4).alias("total"), "highest")


def rescored_changes(spark, sf) -> DataFrame:
    """Scores before any dispatch rows, then re-scored where the dispatch rows landed."""
    from dataclasses import replace
    f = fleet(spark, sf)
    before = replace(f, dispatch=f.dispatch.limit(0)).performance()
    after = scores.rescore(f, scores.touched_pairs(f.dispatch, f.units))
    return scores.score_changes(before, after)


def user_lags(spark, sf) -> DataFrame:
    """Each farm's events as reported lags."""
    return events(spark, sf).select(F.concat(F.lit("F"), F.col("user_id") % 10).alias("series"), "ts", "value")


def silent_lags(spark, sf) -> DataFrame:
    """The farms' lags two hours after the last event, when all feeds have stopped, with a farm that never reported."""
    lags = user_lags(spark, sf)
    first = lags.groupBy("series").agg(F.min("ts").alias("start")).unionByName(lags.agg(F.min("ts").alias("start")).select(F.lit("F10").alias("series"), "start"))
    starts = first.select("series", F.timestamp_micros(F.unix_micros("start") - F.pmod(F.unix_micros("start"), F.lit(900_000_000))).alias("start"))
    return metrics.stale_data_alarm(lags, lags.agg(F.max("ts")).scalar() + F.expr("INTERVAL 2 HOURS"), starts)


def rolled(spark, sf) -> DataFrame:
    configure(spark)
    out = metrics.rollups(events(spark, sf).select(F.col("event_type").alias("series"), "ts", "value"), 60)
    return out.select("series", "period", "n", rounded(F.col("total"), 4).alias("total"), "highest", rounded(F.col("p50"), 4).alias("p50"), "p95")


def reasons(spark, sf) -> DataFrame:
    configure(spark)
    ev = events(spark, sf).select("ts", F.when(F.col("event_type").isin("error", "signup"), F.concat("event_type", F.col("user_id") % 3)).alias("reason"))
    return metrics.counts_by_reason(ev, 60)


def sql_alarms(minutes, stat, condition, periods, missing):
    return f"""WITH s AS (SELECT concat('F', user_id % 10) AS series, time_bucket(INTERVAL {minutes} MINUTE, ts) AS period, {stat}(value) AS value FROM events GROUP BY 1, 2),
spine AS (SELECT series, unnest(generate_series(min(period), (SELECT max(period) FROM s), INTERVAL {minutes} MINUTE)) AS period FROM s GROUP BY series),
b AS (SELECT series, period, value, CASE WHEN value IS NULL THEN {missing} ELSE {condition} END AS breaching FROM spine LEFT JOIN s USING (series, period))
SELECT series, period, {sql_round('value', 4)} AS value, breaching,
 count(*) FILTER (breaching) OVER (PARTITION BY series ORDER BY period ROWS BETWEEN {periods - 1} PRECEDING AND CURRENT ROW) = {periods} AS alarm FROM b"""


SQL_BEFORE = SQL_PERFORMANCE.replace("perf_cut AS", "real_cut AS").replace("LEFT JOIN perf_cut c", "LEFT JOIN (SELECT * FROM real_cut WHERE false) c")

REGISTERED = {
    "stream_ingest_readings": (
        lambda s, d: as_naive(stream_ingest_readings(s, d)),
        fleet_sql("SELECT duid, interval_end, mw, strftime(interval_end + INTERVAL 10 HOUR, '%Y-%m-%d') AS date FROM readings WHERE uid % 4 <> 0")),
    "stream_ingest_ledger": (
        lambda s, d: as_naive(stream_ingest_ledger(s, d)),
        fleet_sql("""SELECT 'PUBLIC_DISPATCHSCADA_' || strftime(day, '%Y%m%d') || '0000_1.zip' AS file_name, day - INTERVAL 10 HOUR AS interval_end,
 CAST(count(*) AS INTEGER) AS rows_total, CAST(count(*) FILTER (uid % 4 <> 0) AS INTEGER) AS rows_solar
 FROM (SELECT *, date_trunc('day', interval_end + INTERVAL 10 HOUR)::TIMESTAMP AS day FROM readings) GROUP BY day""")),
    "stream_first_sightings": (
        lambda s, d: as_naive(stream_first_sightings(s, d)),
        "SELECT DISTINCT concat('U', user_id) AS duid, date_trunc('hour', ts) AS interval_end FROM events"),
    "stream_hourly_profile": (
        lambda s, d: as_naive(stream_hourly_profile(s, d)),
        f"""SELECT facility_code, hour, CAST(count(DISTINCT i) AS INTEGER) AS intervals, {sql_round('sum(value) / count(DISTINCT i)', 1)} AS avg_mw
FROM (SELECT concat('F', user_id % 10) AS facility_code, date_trunc('hour', ts) AS hour, time_bucket(INTERVAL 5 MINUTE, ts) AS i, value FROM events) GROUP BY 1, 2"""),
    "stream_scored_hours": (
        lambda s, d: as_naive(stream_scored_hours(s, d)),
        fleet_sql(f"""SELECT facility_code, date_trunc('hour', interval_end) AS hour, {sql_round('avg(actual_mw)', 1)} AS avg_mw,
 {sql_round('avg(expected_mw)', 1)} AS expected_mw, {sql_round('avg(performance_index)', 2)} AS performance_index FROM perf GROUP BY 1, 2""", True)),
    "stream_metric_totals": (
        lambda s, d: as_naive(stream_metric_totals(s, d)),
        f"SELECT event_type AS series, date_trunc('hour', ts) AS period, count(value) AS n, {sql_round('sum(value)', 4)} AS total, max(value) AS highest FROM events GROUP BY 1, 2"),
    "rescored_changes": (
        lambda s, d: as_naive(rescored_changes(s, d)),
        fleet_sql(f""", {SQL_PERFORMANCE.strip()}, {SQL_BEFORE.strip().replace('perf_raw', 'b_raw').replace('perf_sun', 'b_sun').replace('perf_scored', 'b_scored').replace('perf AS', 'b AS')}
SELECT p.facility_code, p.interval_end, b.status AS was, p.status AS now, {sql_round('p.curtailed_mw', 4)} AS curtailed_mw
FROM perf p JOIN b USING (facility_code, interval_end) WHERE p.curtailed_mw IS NOT NULL""")),
    "stale_data_alarm": (
        lambda s, d: as_naive(metrics.stale_data_alarm(user_lags(s, d)).withColumn("value", rounded(F.col("value"), 4))),
        sql_alarms(15, "max", "value > 45", 2, "true")),
    "stale_data_alarm_silence": (
        lambda s, d: as_naive(silent_lags(s, d).withColumn("value", rounded(F.col("value"), 4))),
        f"""WITH s AS (SELECT concat('F', user_id % 10) AS series, time_bucket(INTERVAL 15 MINUTE, ts) AS period, max(value) AS value FROM events GROUP BY 1, 2),
known AS (SELECT series, min(period) AS start FROM s GROUP BY 1 UNION ALL SELECT 'F10', min(period) FROM s),
spine AS (SELECT series, unnest(generate_series(start, (SELECT time_bucket(INTERVAL 15 MINUTE, max(ts) + INTERVAL 2 HOUR) - INTERVAL 15 MINUTE FROM events), INTERVAL 15 MINUTE)) AS period FROM known),
b AS (SELECT series, period, value, coalesce(value > 45, true) AS breaching FROM spine LEFT JOIN s USING (series, period))
SELECT series, period, {sql_round('value', 4)} AS value, breaching, breaching AND coalesce(lag(breaching) OVER (PARTITION BY series ORDER BY period), false) AS alarm FROM b"""),
    "threshold_alarm_backlog": (
        lambda s, d: as_naive(metrics.alarms(user_lags(s, d), 60, 20.0, periods=3).withColumn("value", rounded(F.col("value"), 4))),
        sql_alarms(60, "max", "value > 20", 3, "false")),
    "threshold_alarm_errors": (
        lambda s, d: as_naive(metrics.alarms(user_lags(s, d), 30, 5.0, stat="sum", inclusive=True).withColumn("value", rounded(F.col("value"), 4))),
        sql_alarms(30, "sum", "value >= 5", 1, "false")),
    "metric_rollups": (
        lambda s, d: as_naive(rolled(s, d)),
        f"""SELECT event_type AS series, date_trunc('hour', ts) AS period, count(value) AS n, {sql_round('sum(value)', 4)} AS total, max(value) AS highest,
 {sql_round('median(value)', 4)} AS p50, list_sort(list(value))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1] AS p95 FROM events GROUP BY 1, 2"""),
    "fallbacks_by_reason": (
        lambda s, d: as_naive(reasons(s, d)),
        "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS period, concat(event_type, user_id % 3) AS reason, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1, 2"),
}
