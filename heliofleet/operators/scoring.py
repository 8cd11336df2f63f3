"""Facility scoring: output, expected output, index, curtailed MW and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from heliofleet import fixed
from heliofleet.operators.asof import observations_on_grid, on_grid

PERFORMANCE_COLUMNS = (
    "facility_code", "facility_name", "region", "interval_end", "actual_mw", "capacity_mw",
    "ghi_wm2", "expected_mw", "performance_index", "rrp", "curtailed_mw", "status",
)


def _ranked(units: DataFrame) -> DataFrame:
    """Units with the rank of their name and region among those of their facility."""
    def rank(label):
        return F.dense_rank().over(Window.partitionBy("facility_code").orderBy(label))
    return units.select(
        "duid", "facility_code", "facility_name", "region", "capacity_mw",
        rank("facility_name").alias("_name"), rank("region").alias("_region"))


def _summed(readings: DataFrame, ranked: DataFrame) -> DataFrame:
    """MW and capacity per facility and interval. A facility's name and region are the greatest
    among the units that reported; they travel as small ranks, because a maximum of texts would
    make Spark sort every reading to aggregate."""
    return (
        readings.select("duid", "interval_end", "mw")
        .join(ranked.drop("facility_name", "region"), "duid")
        .groupBy("facility_code", "interval_end")
        .agg(
            F.max("_name").alias("_name"),
            F.max("_region").alias("_region"),
            F.sum("mw").alias("actual_mw"),
            F.sum("capacity_mw").alias("capacity_mw"),
        )
    )


def _labelled(df: DataFrame, ranked: DataFrame) -> DataFrame:
    names = ranked.groupBy("facility_code", "_name").agg(F.max("facility_name").alias("facility_name"))
    regions = ranked.groupBy("facility_code", "_region").agg(F.max("region").alias("region"))
    return (
        df.join(names, ["facility_code", "_name"], "left")
        .join(regions, ["facility_code", "_region"], "left")
        .drop("_name", "_region")
    )


def facility_output(readings: DataFrame, units: DataFrame) -> DataFrame:
    """Units summed per facility and interval. Only units that reported add capacity."""
    ranked = _ranked(units)
    return _labelled(_summed(readings, ranked), ranked).select(
        "facility_code", "interval_end", "facility_name", "region", "actual_mw", "capacity_mw")


def expected_mw(capacity: Column, ghi: Column, null_without_ghi: bool = False) -> Column:
    """Weather-expected MW. A missing irradiance counts as 0 here, because ``greatest`` skips
    NULLs; ``null_without_ghi`` gives NULL instead (the library rule)."""
    sunlit = F.greatest(ghi, F.lit(0.0)) / fixed.STC_IRRADIANCE_WM2 * fixed.PERFORMANCE_RATIO
    capped = F.least(capacity, capacity * sunlit)
    return F.when(ghi.isNotNull(), capped) if null_without_ghi else capped


def performance_index(
    actual: Column, capacity: Column, ghi: Column, min_ghi: float | None = fixed.MIN_GHI_WM2
) -> Column:
    """Actual over expected, or NULL where the sun is too low to judge."""
    expected = expected_mw(capacity, ghi)
    judged = ghi.isNotNull() & (expected >= capacity * fixed.MIN_EXPECTED_SHARE) & (expected > 0)
    if min_ghi is not None:
        judged = judged & (ghi >= min_ghi)
    return F.when(judged, F.greatest(actual, F.lit(0.0)) / expected)


def held_back_mw() -> Column:
    """MW one unit was held back: forecast (else offer) minus target, never negative."""
    potential = F.coalesce("uigf", "availability", F.lit(0.0))
    return F.greatest(potential - F.col("total_cleared"), F.lit(0.0))


def facility_curtailed(dispatch: DataFrame, units: DataFrame) -> DataFrame:
    """Curtailed MW per facility and interval, for every interval with dispatch rows.

    No row means unknown, 0 means known and uncapped. Unique on (facility, interval), so a
    left join to it can be dropped when its column is unused.
    """
    return (
        dispatch.select("duid", "interval_end", "total_cleared", "availability", "uigf", "semidispatch_cap")
        .join(units.select("duid", "facility_code"), "duid")
        .groupBy("facility_code", "interval_end")
        .agg(F.sum(F.when(F.col("semidispatch_cap"), held_back_mw()).otherwise(0.0)).alias("curtailed_mw"))
    )


def status(index: Column, curtailed: Column, capacity: Column, price: Column) -> Column:
    known_fault = F.when(curtailed.isNotNull(), "underperforming")
    cause = (
        F.when(curtailed > capacity * fixed.CURTAILED_SHARE, "curtailed")
        .otherwise(F.coalesce(known_fault, F.when(price < 0, "likely_curtailed"), F.lit("underperforming")))
    )
    return F.when(index >= fixed.UNDERPERFORMING_BELOW, "ok").when(index.isNotNull(), cause)


def facility_performance(
    readings: DataFrame,
    units: DataFrame,
    weather: DataFrame,
    prices: DataFrame,
    dispatch: DataFrame,
    interval_minutes: int = fixed.INTERVAL_MINUTES,
    tolerance_minutes: int = fixed.WEATHER_TOLERANCE_MINUTES,
    match: str = "nearest",
    min_ghi: float | None = fixed.MIN_GHI_WM2,
) -> DataFrame:
    """The scored view, one row per facility and interval, 12 columns.

    Output, weather and dispatch are each aggregated to (facility, interval), so the two
    big joins reuse that partitioning and add no exchange. The registry and the prices of five
    regions are small next to the readings and are left to Spark's size-checked broadcast.
    """
    ranked = _ranked(units)
    sun = observations_on_grid(
        weather, ["facility_code"], "observed_at", ["ghi_wm2"],
        "interval_end", interval_minutes, tolerance_minutes, match,
    ).drop("observed_at")
    curtailed = facility_curtailed(dispatch, units)
    price = prices.select("region", "interval_end", "rrp").dropDuplicates(["region", "interval_end"])
    keys = ["facility_code", "interval_end"]
    ghi = F.when(
        on_grid(F.col("interval_end"), interval_minutes), F.col("ghi_wm2")
    ).otherwise(F.raise_error(F.lit("interval_end is off the interval grid: pass interval_minutes")).cast("double"))
    index = performance_index(F.col("actual_mw"), F.col("capacity_mw"), F.col("ghi_wm2"), min_ghi)
    joined = _summed(readings, ranked).join(sun, keys, "left").join(curtailed, keys, "left")
    return (
        _labelled(joined, ranked)
        .join(price, ["region", "interval_end"], "left")
        .withColumn("ghi_wm2", ghi)
        .withColumn("expected_mw", expected_mw(F.col("capacity_mw"), F.col("ghi_wm2")))
        .withColumn("performance_index", index)
        .withColumn("status", status(F.col("performance_index"), F.col("curtailed_mw"),
                                     F.col("capacity_mw"), F.col("rrp")))
        .select(*PERFORMANCE_COLUMNS)
    )
