import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from heliofleet.operators import catalogue, scoring
from helpers import AT, FULL_SUN, LOW, fleet, rows


def statuses(f):
    return {r["facility_code"]: r["status"] for r in f.performance().collect()}


def test_worked_index(spark):
    f = fleet(spark, [("HAZLSF1", AT, 30.0), ("HAZLSF2", AT, 12.0), ("BRKNSF1", AT, 170.0)], FULL_SUN)
    got = {r["facility_code"]: r for r in f.performance().collect()}
    assert got["HAZLSF"]["expected_mw"] == pytest.approx(96.0) and got["HAZLSF"]["performance_index"] == pytest.approx(0.4375)
    assert got["BRKNSF"]["expected_mw"] == pytest.approx(200.0) and round(got["BRKNSF"]["performance_index"], 2) == 0.85
    under = catalogue.underperformers(f).collect()
    assert [r["facility_code"] for r in under] == ["HAZLSF"]
    assert catalogue.underperformers(f, region="SA1").count() == 0


def test_only_reporting_units_add_capacity(spark):
    f = fleet(spark, [("HAZLSF1", AT, 40.0)], FULL_SUN)
    assert rows(f.performance(), "facility_code", "capacity_mw") == [("HAZLSF", 80.0)]


def test_nearest_observation_decides_and_may_leave_no_score(spark):
    weather = [("HAZLSF", AT - dt.timedelta(minutes=50), 1000.0, None, None), ("HAZLSF", AT + dt.timedelta(minutes=10), 150.0, None, None)]
    got = fleet(spark, LOW[:2], weather).performance().first()
    assert got["ghi_wm2"] == 150.0 and got["performance_index"] is None and got["status"] is None


def test_missing_weather_expects_zero(spark):
    got = fleet(spark, LOW[:2]).performance().first()
    assert got["ghi_wm2"] is None and got["expected_mw"] == 0.0 and got["performance_index"] is None


def test_status_without_prices_or_dispatch(spark):
    assert statuses(fleet(spark, LOW, FULL_SUN)) == {"HAZLSF": "underperforming", "BRKNSF": "underperforming"}


def test_negative_price_is_provisional(spark):
    f = fleet(spark, LOW, FULL_SUN, [("VIC1", AT, -35.0), ("SA1", AT, 60.0)])
    assert statuses(f) == {"HAZLSF": "likely_curtailed", "BRKNSF": "underperforming"}
    assert [r["facility_code"] for r in catalogue.underperformers(f).collect()] == ["BRKNSF"]


def test_dispatch_confirms_or_overrules(spark):
    dispatch = [("HAZLSF1", AT, 16.0, 64.0, 64.0, False), ("HAZLSF2", AT, 8.0, 32.0, 32.0, False), ("BRKNSF1", AT, 50.0, 200.0, 200.0, True)]
    f = fleet(spark, LOW, FULL_SUN, [("VIC1", AT, -35.0)], dispatch)
    assert statuses(f) == {"HAZLSF": "underperforming", "BRKNSF": "curtailed"}
    assert [(r["facility_code"], r["curtailed_mw"]) for r in catalogue.curtailed_farms(f).collect()] == [("BRKNSF", 150.0)]
    report = catalogue.underperformers_report(f).collect()
    assert [(r["facility_code"], r["curtailed_excluded"]) for r in report] == [("HAZLSF", 1)]


def test_energy_of_one_interval(spark):
    f = fleet(spark, [("BRKNSF1", AT, 210.0), ("HAZLSF1", AT, 30.0)], FULL_SUN)
    assert rows(catalogue.facility_summary(f), "facility_code", "energy_mwh") == [("BRKNSF", 17.5), ("HAZLSF", 2.5)]
    assert catalogue.fleet_kpis(catalogue.fleet_summary(f)).first()["energy_mwh"] == 20.0


def test_latest_scored_stays_in_daylight(spark):
    night = AT + dt.timedelta(hours=7)
    f = fleet(spark, [*LOW, ("HAZLSF1", night, 0.0)], FULL_SUN)
    assert catalogue.latest_interval(f.readings).first()[0] == night
    assert catalogue.latest_scored(f).first()[0] == AT


def test_no_readings_gives_no_rows(spark):
    f = fleet(spark)
    assert catalogue.latest_scored(f).first()[0] is None
    assert catalogue.underperformers(f).count() == 0 and catalogue.fleet_summary(f).count() == 0


@pytest.mark.parametrize("capacity, ghi, want", [(100.0, 1000.0, 80.0), (100.0, 500.0, 40.0), (100.0, -5.0, 0.0), (100.0, 2000.0, 100.0)])
def test_expected(spark, capacity, ghi, want):
    df = spark.createDataFrame([(capacity, ghi)], "c double, g double")
    assert df.select(scoring.expected_mw(F.col("c"), F.col("g"))).first()[0] == pytest.approx(want)


def test_off_grid_interval_is_refused(spark):
    f = fleet(spark, [("HAZLSF1", AT + dt.timedelta(minutes=1), 1.0)], FULL_SUN)
    with pytest.raises(Exception, match="off the interval grid"):
        f.performance().collect()


def test_find_facility(spark):
    f = fleet(spark)
    assert catalogue.find_facility(f.units, "brknsf").first()["facility_code"] == "BRKNSF"
    assert catalogue.find_facility(f.units, "solar").first()["facility_code"] == "HAZLSF"  # shorter name
    assert catalogue.find_facility(f.units, "nowhere").count() == 0
    texts = spark.createDataFrame([("brknsf",), ("Solar",), ("H_ze",), ("%",), ("nowhere",)], "text string")
    assert rows(catalogue.find_facility_batch(f.units, texts), "searched_for", "facility_code") == [
        ("%", "HAZLSF"), ("H_ze", "HAZLSF"), ("Solar", "HAZLSF"), ("brknsf", "BRKNSF")]


def test_freshness(spark):
    df = spark.createDataFrame([(AT,), (AT - dt.timedelta(minutes=20),), (AT - dt.timedelta(hours=2),), (None,)], "latest_interval timestamp")
    assert [r["state"] for r in catalogue.freshness(df, F.lit(AT + dt.timedelta(minutes=5))).collect()] == ["live", "delayed", "stale", "no data"]


def test_scored_view_plan(spark, tmp_path):
    """Files are scanned with few columns, unused joins vanish, and nothing is joined by loop."""
    f = fleet(spark, LOW, FULL_SUN, [("VIC1", AT, -35.0)], [("HAZLSF1", AT, 16.0, 64.0, 64.0, False)])
    from dataclasses import replace
    stored = {}
    for name in ("units", "readings", "weather", "prices", "dispatch"):
        getattr(f, name).write.parquet(str(tmp_path / name))
        stored[name] = spark.read.parquet(str(tmp_path / name))
    g = replace(f, **stored)
    full = g.performance()._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in full and "Cartesian" not in full
    assert not re.search(r"SortAggregate\(key=\[facility_code#\d+, interval_end", full)
    slim = g.performance().select("facility_code", "interval_end", "performance_index")._jdf.queryExecution().executedPlan().toString()
    assert "semidispatch_cap" not in slim and "rrp" not in slim and "temp_c" not in slim
