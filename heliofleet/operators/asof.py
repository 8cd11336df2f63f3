"""As-of joins: for each probe, the observation nearest in time within a tolerance.

Neither form pairs every probe with every observation of its key.

``observations_on_grid`` serves probes that sit on a fixed time grid (market intervals).
Each observation is sent to the few grid ticks it can serve and the best one per
(key, tick) is kept by a map-side combined aggregate, so copies and bursts collapse
before the shuffle. The result is unique on (key, tick): the caller left-joins it on the
key it is already partitioned by, and Catalyst drops the join when its columns are unused.

``nearest_in_time`` serves probes at any whole step of ``resolution_seconds``. Observations
are thinned to the first and last of each step (no other can be nearest to a probe that sits
on a step), placed in time buckets of the tolerance width, and merged with the distinct times that
probes ask for by one window per (key, bucket). The number of steps in a bucket bounds that window
for any skew of either side; the probes' own columns travel only in the left join that follows, whose
right side is unique on its keys, so a crowded key can be split there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from heliofleet.functions.columns import micros

SECOND = 1_000_000
MINUTE = 60 * SECOND


def observations_on_grid(
    observations: DataFrame,
    on: Sequence[str],
    observed: str,
    values: Sequence[str],
    tick: str,
    tick_minutes: int,
    tolerance_minutes: int,
    direction: str = "nearest",
) -> DataFrame:
    """Best observation per (on, tick).

    ``nearest``: smallest distance within +/- tolerance, both ends included; of two equally
    near ones the earlier wins. ``backward``: latest one in (tick - tolerance, tick].
    """
    step, reach = tick_minutes * MINUTE, tolerance_minutes * MINUTE
    at = micros(F.col(observed))
    if direction == "nearest":
        low, high = at - reach, at + reach
    elif direction == "backward":
        low, high = at, at + (reach - 1)
    else:
        raise ValueError(f"unknown direction {direction!r}")
    first = low + F.pmod(-low, F.lit(step))
    last = high - F.pmod(high, F.lit(step))
    ticks = (
        observations.select(*on, *values, at.alias("_at"), first.alias("_first"), last.alias("_last"))
        .where("_first <= _last")
        .withColumn("_tick", F.explode(F.sequence("_first", "_last", F.lit(step))))
    )
    # One bigint orders candidates: distance first, then the earlier observation.
    gap = F.abs(F.col("_at") - F.col("_tick")) * 2 + (F.col("_at") > F.col("_tick")).cast("bigint")
    return (
        ticks.select(*on, *values, "_at", F.timestamp_micros("_tick").alias(tick), gap.alias("_gap"))
        .groupBy(*on, tick)
        .agg(
            *[F.min_by(v, "_gap").alias(v) for v in values],
            F.timestamp_micros(F.min_by("_at", "_gap")).alias(observed),
        )
    )


def on_grid(at, tick_minutes: int):
    """True where a timestamp sits on the tick grid."""
    return micros(at) % (tick_minutes * MINUTE) == 0


def nearest_in_time(
    probes: DataFrame,
    observations: DataFrame,
    on: Sequence[str],
    probe_time: str,
    observed: str,
    values: Sequence[str],
    tolerance_minutes: int,
    resolution_seconds: int = 1,
    direction: str = "nearest",
) -> DataFrame:
    """All probe rows with ``values`` and ``observed`` of the matching observation, else NULLs.

    A probe off the resolution raises an error rather than risk a wrong match; pass a finer
    resolution (a divisor, in seconds) for such data.
    """
    if direction not in ("nearest", "backward"):
        raise ValueError(f"unknown direction {direction!r}")
    step, reach = resolution_seconds * SECOND, tolerance_minutes * MINUTE
    kept = ["_at", *values]

    def end(side: str):
        return F.struct(*[F.col(f"_{side}_{c}").alias(c) for c in kept])

    thinned = (
        observations.select(*on, *values, micros(F.col(observed)).alias("_at"))
        .withColumn("_step", F.col("_at") - F.pmod("_at", F.lit(step)))
        .groupBy(*on, "_step")
        .agg(*[F.min_by(c, "_at").alias(f"_lo_{c}") for c in kept], *[F.max_by(c, "_at").alias(f"_hi_{c}") for c in kept])
        .select(*on, F.explode(F.array_distinct(F.array(end("lo"), end("hi")))).alias("_obs"))
    )
    width = max(reach, step)
    home = F.expr(f"(_t - pmod(_t, {width})) div {width}")
    spread = (
        thinned.withColumn("_t", F.col("_obs._at"))
        .withColumn("_home", home)
        .withColumn("_bucket", F.explode(F.array(F.col("_home") - 1, F.col("_home"), F.col("_home") + 1)))
        .select(*on, "_t", "_bucket", "_obs", F.lit(False).alias("_is_probe"))
    )
    t = micros(F.col(probe_time))
    checked = F.when(
        t % step != 0,
        F.raise_error(F.lit(f"probe time is finer than {resolution_seconds} s: pass a finer resolution")),
    ).otherwise(t)
    # Many probes of one key and time ask once; the rows get their answer by an equi join afterwards.
    sided = (
        probes.select(*on, checked.alias("_t")).distinct()
        .withColumn("_bucket", home)
        .withColumn("_is_probe", F.lit(True))
    )
    merged = sided.unionByName(spread, allowMissingColumns=True)
    frame = Window.partitionBy(*on, "_bucket").orderBy("_t", "_is_probe")
    before = F.last("_obs", ignorenulls=True).over(frame.rowsBetween(Window.unboundedPreceding, 0))
    found = merged.withColumn("_prev", before)
    if direction == "nearest":
        # Backwards, the next observation is the last one met: one running value, where a frame that ends at the
        # bucket's end would be read again for every row.
        back = Window.partitionBy(*on, "_bucket").orderBy(F.desc("_t"), F.desc("_is_probe"))
        after = F.last("_obs", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
        found = found.withColumn("_next", after)
    found = found.where("_is_probe")
    gap_prev = F.col("_t") - F.col("_prev._at")
    if direction == "backward":
        match = F.when(gap_prev < reach, F.col("_prev"))
    else:
        gap_next = F.col("_next._at") - F.col("_t")
        take_next = F.col("_next").isNotNull() & (F.col("_prev").isNull() | (gap_next < gap_prev))
        best = F.when(take_next, F.col("_next")).otherwise(F.col("_prev"))
        match = F.when(F.least(gap_prev, gap_next) <= reach, best)
    answers = found.select(*on, "_t", match.alias("_match"))
    return probes.withColumn("_t", checked).join(answers, [*on, "_t"], "left").select(
        *[F.col(c) for c in probes.columns],
        *[F.col(f"_match.{v}").alias(v) for v in values],
        F.timestamp_micros(F.col("_match._at")).alias(observed),
    )
