"""Metric roll-ups per period and threshold alarms over consecutive periods."""

from __future__ import annotations

from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from heliofleet import fixed
from heliofleet.operators.evaluation import rank_percentiles
from heliofleet.operators.ingest import latest_per_key
from heliofleet.streaming.scores import start_updates

STALE_PERIOD, STALE_PERIODS = 15, 2  # minutes of a period, and periods in a row


def _period(minutes: int):
    return F.window("ts", f"{minutes} minutes")["start"]


def rollups(metrics: DataFrame, minutes: int) -> DataFrame:
    """Per series and period of (series, ts, value): count, sum, max and exact p50 / p95."""
    timed = metrics.withColumn("period", _period(minutes))
    sums = timed.groupBy("series", "period").agg(
        F.count("value").alias("n"), F.sum("value").alias("total"), F.max("value").alias("highest"))
    ranks = rank_percentiles(timed, "value", ["series", "period"]).drop("n")
    return sums.join(ranks, ["series", "period"], "left")


def stream_rollups(metrics: DataFrame, minutes: int, watermark: str) -> DataFrame:
    """The streaming form; its percentiles are approximate, its state a fixed-size sketch."""
    return (
        metrics.withWatermark("ts", watermark)
        .groupBy("series", F.window("ts", f"{minutes} minutes").alias("w"))
        .agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.max("value").alias("highest"),
             F.percentile_approx("value", F.array(F.lit(0.5), F.lit(0.95))).alias("p"))
        .select("series", F.col("w.start").alias("period"), "n", "total", "highest",
                F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"))
    )


def counts_by_reason(events: DataFrame, minutes: int) -> DataFrame:
    """Occurrences per period and reason of (ts, reason); rows without a reason do not count."""
    return (
        events.where("reason is not null")
        .groupBy(_period(minutes).alias("period"), "reason").agg(F.count(F.lit(1)).alias("n")))


def alarms(
    metrics: DataFrame, minutes: int, threshold: float, periods: int = 1, stat: str = "max",
    inclusive: bool = False, missing_breaches: bool = False, starts: DataFrame | None = None, until: Column | None = None,
) -> DataFrame:
    """State per series and period of (series, ts, value).

    A period breaches when its statistic is above the threshold (at or above it if ``inclusive``);
    an empty period breaches only if ``missing_breaches``. The alarm holds once ``periods`` in a row
    breach. Rows are reduced to one per period before any ordering, and the spine runs from a
    series' first period (or from ``starts`` (series, start), which may name series that never
    reported) to the newest period of all, or with ``until`` to the last period over by then: a feed
    that has stopped altogether goes on having empty periods.
    """
    aggregate = {"max": F.max, "sum": F.sum}[stat]("value")
    sums = metrics.groupBy("series", _period(minutes).alias("period")).agg(aggregate.alias("value"))
    newest = sums.agg(F.max("period")).scalar()
    if until is not None:
        step = minutes * 60_000_000
        over = F.unix_micros(until) - F.pmod(F.unix_micros(until), F.lit(step)) - step
        newest = F.greatest(newest, F.timestamp_micros(over))
    if starts is None:
        starts = sums.groupBy("series").agg(F.min("period").alias("start"))
    spine = starts.where(F.col("start") <= newest).select(
        "series", F.explode(F.sequence("start", newest, F.make_dt_interval(mins=F.lit(minutes)))).alias("period"))
    breach = F.col("value") >= threshold if inclusive else F.col("value") > threshold
    recent = Window.partitionBy("series").orderBy("period").rowsBetween(1 - periods, 0)
    return (
        spine.join(sums, ["series", "period"], "left")
        .withColumn("breaching", F.coalesce(breach, F.lit(missing_breaches)))
        .withColumn("alarm", F.sum(F.col("breaching").cast("int")).over(recent) == periods)
    )


def start_alarms(
    metrics: DataFrame, path: str, checkpoint: str, trigger: dict, minutes: int, threshold: float,
    periods: int = 1, stat: str = "max", watermark: str = "1 day", **rule,
) -> StreamingQuery:
    """Alarms kept current over a stream of (series, ts, value).

    The stream keeps one statistic per series and period; each batch logs the periods it changed
    under their day and re-evaluates ``<path>/alarms`` from the first day it touched to the day
    after the last, looking back as many days as the rule's periods span. A repeated batch replaces
    what it wrote.
    """
    reach = timedelta(days=max(1, -(-minutes * periods // 1440)))
    aggregate = {"max": F.max, "sum": F.sum}[stat]("value")
    stats = (
        metrics.withWatermark("ts", watermark)
        .groupBy("series", F.window("ts", f"{minutes} minutes").alias("w")).agg(aggregate.alias("value"))
        .select("series", F.col("w.start").alias("ts"), "value", F.to_date("w.start").alias("day")))

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        (batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(f"{path}/stats"))
        days = sorted(row["day"] for row in batch.select("day").distinct().toLocalIterator())  # calendar days
        if not days:
            return
        first, last = days[0], days[-1] + reach
        log = spark.read.schema("series string, ts timestamp, value double, batch int, day date").parquet(f"{path}/stats")
        # A series that has gone quiet keeps its place in the spine.
        lookback = F.lit(first - reach)
        latest = latest_per_key(log.where(F.col("day").between(lookback, F.lit(last))), ["series", "ts"], ["batch"])
        starts = log.groupBy("series").agg(F.greatest(F.min("ts"), lookback.cast("timestamp")).alias("start"))
        state = alarms(latest.select("series", "ts", "value"), minutes, threshold, periods, "max", starts=starts, **rule)
        (state.withColumn("day", F.to_date("period")).where(F.col("day") >= F.lit(first))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/alarms"))

    return stats.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def stale_data_alarm(lags: DataFrame, until: Column | None = None, starts: DataFrame | None = None) -> DataFrame:
    """Lag above 45 minutes, or none reported, in two 15-minute periods running."""
    return alarms(lags, STALE_PERIOD, fixed.STALE_MINUTES, periods=STALE_PERIODS, missing_breaches=True, starts=starts, until=until)


def _watch(quiet_ms: int):
    def run(key, frames, state):
        now = pd.Timestamp(state.getCurrentProcessingTimeMs(), unit="ms")
        seen, silent = state.get if state.exists else (None, True)
        if state.hasTimedOut:
            state.update((seen, True))
            yield pd.DataFrame({"series": key, "alarm": [True], "last_seen": [pd.Timestamp(seen, unit="us")], "at": [now]})
            return
        newest = max(int(f["at_us"].max()) for f in frames)
        seen = newest if seen is None else max(seen, newest)
        state.update((seen, False))
        state.setTimeoutDuration(quiet_ms)
        if silent:
            yield pd.DataFrame({"series": key, "alarm": [False], "last_seen": [pd.Timestamp(seen, unit="us")], "at": [now]})
    return run


def silence(metrics: DataFrame, quiet_seconds: int) -> DataFrame:
    """Changes (series, alarm, last_seen, at) of a stream (series, ts): a series that sends nothing for ``quiet_seconds``
    of the clock alarms, and is well again with its next row.

    A timer per series, kept in keyed state, fires without any input, so a feed that stops alarms too. Run it with a
    processing-time trigger. A series that must report but has not yet is armed by a row of its own in the stream.
    """
    rows = metrics.select("series", F.unix_micros("ts").alias("at_us")).where("series is not null and at_us is not null")
    return rows.groupBy("series").applyInPandasWithState(
        _watch(quiet_seconds * 1000), "series string, alarm boolean, last_seen timestamp_ntz, at timestamp_ntz",
        "seen long, silent boolean", "update", GroupStateTimeout.ProcessingTimeTimeout)


def start_silence_alarms(
    metrics: DataFrame, path: str, checkpoint: str, trigger: dict, quiet_seconds: int = 60 * STALE_PERIOD * STALE_PERIODS,
) -> StreamingQuery:
    """The silence alarms of a stream, as an update log under ``path``; ``scores.current_state`` reads it by series."""
    return start_updates(silence(metrics, quiet_seconds), path, checkpoint, trigger)
