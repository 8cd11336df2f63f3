import datetime as dt
import time

from pyspark.sql import functions as F

from heliofleet.operators import catalogue
from heliofleet.streaming import metrics, scores
from helpers import AT, FULL_SUN, LOW, UNITS, fleet, rows

T0 = dt.datetime(2026, 9, 25, 0, 0)


def lag(minutes, value, series="s"):
    return (series, T0 + dt.timedelta(minutes=minutes), float(value))


def test_stale_alarm_counts_missing_periods(spark):
    lags = spark.createDataFrame([lag(0, 50), lag(16, 10), lag(31, 46), lag(75, 5), lag(95, 60), lag(100, 3)], "series string, ts timestamp, value double")
    got = metrics.stale_data_alarm(lags).orderBy("period").collect()
    assert [r["breaching"] for r in got] == [True, False, True, True, True, False, True]
    assert [r["alarm"] for r in got] == [False, False, False, True, True, False, False]


def test_threshold_alarm_ignores_missing_periods(spark):
    df = spark.createDataFrame([lag(0, 5), lag(1, 4), lag(11, 9)], "series string, ts timestamp, value double")
    got = metrics.alarms(df, 5, 9.0, stat="sum", inclusive=True).orderBy("period").collect()
    assert [(r["value"], r["alarm"]) for r in got] == [(9.0, True), (None, False), (9.0, True)]


def test_late_dispatch_rescores_only_what_it_touched(spark):
    later = AT + dt.timedelta(minutes=5)
    f = fleet(spark, [*LOW, ("HAZLSF1", later, 1.0)], FULL_SUN, [("VIC1", AT, -35.0)])
    before = f.performance()
    from dataclasses import replace
    from heliofleet import schemas
    batch = spark.createDataFrame([("HAZLSF1", AT, 16.0, 64.0, 64.0, False), ("BRKNSF1", AT, 50.0, 200.0, 200.0, True)], schemas.DISPATCH)
    after = scores.rescore(replace(f, dispatch=batch), scores.touched_pairs(batch, f.units))
    assert after.count() == 2
    assert rows(scores.score_changes(before, after), "facility_code", "was", "now", "curtailed_mw") == [
        ("BRKNSF", "underperforming", "curtailed", 150.0), ("HAZLSF", "likely_curtailed", "underperforming", 0.0)]


def test_streamed_profile_equals_batch(spark, tmp_path):
    readings = [(u[0], T0 + dt.timedelta(minutes=5 * i), float(i + n)) for n, u in enumerate(UNITS) for i in range(30)]
    f = fleet(spark, readings, FULL_SUN)
    for i, part in enumerate(f.readings.randomSplit([0.3, 0.3, 0.4], 1)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f.readings.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    profile = scores.hourly_profile(stream, f.units, "1 day")
    scores.start_updates(profile, str(tmp_path / "out"), str(tmp_path / "cp"), {"availableNow": True}).awaitTermination()
    final = scores.current_state(spark.read.parquet(str(tmp_path / "out")), ["facility_code", "hour"])
    assert rows(final, "facility_code", "hour", "avg_mw") == rows(catalogue.facility_hourly(f, 24), "facility_code", "hour", "avg_mw")


def test_rollups(spark):
    df = spark.createDataFrame([lag(0, 1), lag(1, 3), lag(2, 10), lag(61, 4)], "series string, ts timestamp, value double")
    got = [(r["n"], r["total"], r["highest"], r["p50"], r["p95"]) for r in metrics.rollups(df, 60).orderBy("period").collect()]
    assert got == [(3, 14.0, 10.0, 3.0, 3.0), (1, 4.0, 4.0, 4.0, 4.0)]
    why = spark.createDataFrame([(T0, "Timeout"), (T0, "Timeout"), (T0, None)], "ts timestamp, reason string")
    assert rows(metrics.counts_by_reason(why, 5), "reason", "n") == [("Timeout", 2)]


def test_streamed_alarms_equal_batch(spark, tmp_path):
    rows_ = [lag(15 * i + j, 30 + (i * 7 + j) % 31, series) for series in ("a", "b") for i in range(150) for j in (0, 4) if i % 11 and not (series == "b" and i > 60)]
    df = spark.createDataFrame(rows_, "series string, ts timestamp, value double").orderBy("ts")
    for i in range(3):
        df.where(F.expr(f"hour(ts) % 3 = {i}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    metrics.start_alarms(stream, str(tmp_path / "out"), str(tmp_path / "cp"), {"availableNow": True}, 15, 45, periods=2,
                         watermark="10 days", missing_breaches=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "alarms"))
    assert rows(got, "series", "period", "breaching", "alarm") == rows(metrics.stale_data_alarm(df), "series", "period", "breaching", "alarm")


def test_a_silent_series_keeps_alarming_in_the_batch_form(spark):
    rows_ = [("a", dt.datetime(2026, 3, 12, 0, 5), 10.0), ("b", dt.datetime(2026, 3, 12, 0, 5), 10.0), ("b", dt.datetime(2026, 3, 12, 0, 50), 50.0)]
    lags = spark.createDataFrame(rows_, "series string, ts timestamp, value double")
    until = F.lit(dt.datetime(2026, 3, 12, 1, 40))
    got = rows(metrics.stale_data_alarm(lags, until).where("alarm"), "series", F.date_format("period", "HH:mm").alias("p"))
    assert got == [("a", p) for p in ("00:30", "00:45", "01:00", "01:15")] + [("b", p) for p in ("00:30", "00:45", "01:00", "01:15")]
    late = metrics.stale_data_alarm(lags, F.lit(dt.datetime(2026, 3, 11)))  # rows newer than the clock still count
    assert late.agg(F.max("period")).first()[0] == dt.datetime(2026, 3, 12, 0, 45)
    expected = spark.createDataFrame([("c", dt.datetime(2026, 3, 12, 0, 30))], "series string, start timestamp")
    never = metrics.stale_data_alarm(lags, until, expected).where("series = 'c'").orderBy("period").collect()
    assert [r["alarm"] for r in never] == [False, True, True, True] and all(r["breaching"] for r in never)


def test_a_feed_that_stops_alarms(spark, tmp_path):
    schema = "series string, ts timestamp"

    def send(*series):
        spark.createDataFrame([(s, dt.datetime.now()) for s in series] + [(None, dt.datetime.now())], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def until(test, seconds=60):
        end = time.time() + seconds
        while time.time() < end:
            if (tmp_path / "out").exists() and any((tmp_path / "out").glob("batch=*/*.parquet")):
                log = spark.read.schema("series string, alarm boolean, last_seen timestamp_ntz, at timestamp_ntz, batch long").parquet(str(tmp_path / "out"))
                now = {r["series"]: r["alarm"] for r in scores.current_state(log, ["series"]).collect()}
                if test(now):
                    return now
            time.sleep(0.5)
        raise AssertionError("not in time")

    send("a", "b")
    feed = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = metrics.start_silence_alarms(feed, str(tmp_path / "out"), str(tmp_path / "checkpoint"), {"processingTime": "300 milliseconds"}, quiet_seconds=6)
    try:
        until(lambda now: now == {"a": False, "b": False})

        def only_b(now):
            send("b")
            return now.get("a") is True
        assert until(only_b)["b"] is False  # b reports on, a is missed
        assert until(lambda now: now["b"] is True) == {"a": True, "b": True}  # nothing comes in any more
        send("a")
        assert until(lambda now: now["a"] is False)["b"] is True
    finally:
        query.stop()


def test_scored_hours_of_a_table_match_the_catalogue(spark):
    at = [AT + dt.timedelta(minutes=5 * i) for i in range(-20, 20)]
    readings = [(unit[0], t, float(i % 7) * unit[6] / 9) for i, t in enumerate(at) for unit in UNITS]
    weather = [("HAZLSF", t + dt.timedelta(minutes=m), ghi, 20.0, 0.0) for t, m, ghi in
               [(at[0], -31, 400.0), (at[3], 2, 900.0), (at[9], -2, 100.0), (at[9], 3, 700.0), (at[30], 0, 0.0)]]
    f = fleet(spark, readings, weather)
    got = scores.scored_hours(f.readings, f.weather, f.units, None, f.interval_minutes, f.tolerance_minutes)
    want = catalogue.facility_hourly(f, 1000)
    columns = ["facility_code", F.date_format("hour", "HH").alias("h"), "avg_mw", "expected_mw", "performance_index"]
    assert rows(got.na.fill(-1.0), *columns) == rows(want.na.fill(-1.0), *columns) and got.count() == 8
