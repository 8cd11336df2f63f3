"""Late truth and running profiles: re-score what a batch touched, hourly profiles, change lists."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from heliofleet import fixed
from heliofleet.functions.columns import rounded
from heliofleet.operators.fleet import Fleet, minutes
from heliofleet.operators.ingest import latest_per_key
from heliofleet.operators.scoring import expected_mw, performance_index


def touched_pairs(dispatch_batch: DataFrame, units: DataFrame) -> DataFrame:
    """(facility_code, interval_end) pairs a dispatch batch says something about."""
    return dispatch_batch.join(units.select("duid", "facility_code"), "duid").select("facility_code", "interval_end").distinct()


def rescore(fleet: Fleet, touched: DataFrame) -> DataFrame:
    """The scored view of the touched pairs only. Rows a day late are normal, so nothing is dropped
    by a watermark. The tables are first cut to the touched time range, which prunes their dates."""
    first, last = touched.agg(F.min("interval_end")).scalar(), touched.agg(F.max("interval_end")).scalar()
    fleet = fleet.slice(first - minutes(1), last)
    duids = fleet.units.select("duid", "facility_code")
    units_touched = touched.join(duids, "facility_code").select("duid", "interval_end")
    times = touched.select("interval_end").distinct()
    return replace(
        fleet,
        readings=fleet.readings.join(units_touched, ["duid", "interval_end"], "left_semi"),
        dispatch=fleet.dispatch.join(units_touched, ["duid", "interval_end"], "left_semi"),
        prices=fleet.prices.join(times, "interval_end", "left_semi"),
    ).performance()


def score_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pairs whose status or curtailed MW differ: (facility_code, interval_end, was, now, ...)."""
    keys = ["facility_code", "interval_end"]
    old = before.select(*keys, F.col("status").alias("was"), F.col("curtailed_mw").alias("_was_mw"))
    new = after.select(*keys, F.col("status").alias("now"), "curtailed_mw")
    changed = ~F.col("was").eqNullSafe(F.col("now")) | ~F.col("_was_mw").eqNullSafe(F.col("curtailed_mw"))
    return new.join(old, keys, "left").where(changed).select(*keys, "was", "now", rounded(F.col("curtailed_mw"), 4).alias("curtailed_mw"))


def hourly_profile(readings: DataFrame, units: DataFrame, watermark: str | None = None) -> DataFrame:
    """Mean facility output per UTC hour, for a stream (with a watermark) or a table.

    The mean is over facility totals: the hour's MW over the number of its intervals, which the
    interval length bounds. An interval ending on the hour belongs to the hour it starts.
    """
    rows = readings if watermark is None else readings.withWatermark("interval_end", watermark)
    return (
        rows.join(units.select("duid", "facility_code"), "duid")
        .groupBy("facility_code", F.window("interval_end", "1 hour").alias("w"))
        .agg(F.sum("mw").alias("_mw"), F.size(F.collect_set("interval_end")).alias("intervals"))
        .select("facility_code", F.col("w.start").alias("hour"), "intervals", rounded(F.col("_mw") / F.col("intervals"), 1).alias("avg_mw"))
    )


def _nearest_on_grid(weather: DataFrame, step: int, tolerance: int, watermark: str | None) -> DataFrame:
    """The observation nearest each grid time of a facility, within ``tolerance`` minutes (the earlier of two)."""
    grain, reach, at = step * 60_000_000, tolerance * 60_000_000, F.unix_micros("observed_at")

    def below(micros_: Column) -> Column:
        return ((micros_ - F.pmod(micros_, F.lit(grain))) / grain).cast("bigint")
    ticks = F.sequence(below(at - reach + grain - 1), below(at + reach))
    rows = weather.select("facility_code", "ghi_wm2", at.alias("_at"), F.explode(F.when(below(at - reach + grain - 1) <= below(at + reach), ticks)).alias("_tick"))
    rows = rows.select("facility_code", "ghi_wm2", "_at", F.timestamp_micros(F.col("_tick") * grain).alias("interval_end"))
    if watermark is not None:
        rows = rows.withWatermark("interval_end", watermark)
    gap = F.abs(F.col("_at") - F.unix_micros("interval_end"))
    return rows.groupBy("facility_code", "interval_end").agg(F.min_by("ghi_wm2", F.struct(gap.alias("g"), F.col("_at").alias("a"))).alias("ghi_wm2"))


def scored_hours(
    readings: DataFrame, weather: DataFrame, units: DataFrame, watermark: str | None = None,
    interval_minutes: int = fixed.INTERVAL_MINUTES, tolerance_minutes: int = fixed.WEATHER_TOLERANCE_MINUTES,
) -> DataFrame:
    """Mean output, expected output and index per facility and hour, for two streams (with a watermark) or two tables.

    Units are summed per interval, each grid time gets its nearest observation, the two streams are joined on
    facility and time (an interval without weather stays, once the watermark has passed it), and the scored
    intervals are averaged per hour. Each step keeps state only for times that the watermark has not passed, so an
    hour is final when it comes out.
    """
    rows = readings if watermark is None else readings.withWatermark("interval_end", watermark)
    output = (
        rows.join(units.select("duid", "facility_code", "capacity_mw"), "duid")
        .groupBy("facility_code", "interval_end").agg(F.sum("mw").alias("actual_mw"), F.sum("capacity_mw").alias("capacity_mw")))
    sun = _nearest_on_grid(weather, interval_minutes, tolerance_minutes, watermark)
    scored = output.join(sun, ["facility_code", "interval_end"], "left").select(
        "facility_code", "interval_end", "actual_mw", expected_mw(F.col("capacity_mw"), F.col("ghi_wm2")).alias("expected_mw"),
        performance_index(F.col("actual_mw"), F.col("capacity_mw"), F.col("ghi_wm2")).alias("performance_index"))
    return (
        scored.groupBy("facility_code", F.window("interval_end", "1 hour").alias("w"))
        .agg(F.avg("actual_mw").alias("mw"), F.avg("expected_mw").alias("expected"), F.avg("performance_index").alias("ix"))
        .select("facility_code", F.col("w.start").alias("hour"), rounded(F.col("mw"), 1).alias("avg_mw"),
                rounded(F.col("expected"), 1).alias("expected_mw"), rounded(F.col("ix"), 2).alias("performance_index")))


def start_updates(df: DataFrame, path: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Write each batch's updated rows under its batch id; a repeated batch replaces itself."""
    def each(rows: DataFrame, batch_id: int) -> None:
        (rows.withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path))
    return df.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def current_state(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key of an update log."""
    return latest_per_key(updates, keys, ["batch"]).drop("batch")
