"""The five keyed tables plus the ledger, and the scored view over a time slice of them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from heliofleet import fixed
from heliofleet.functions.columns import nem_date
from heliofleet.operators import scoring


def minutes(n: int) -> Column:
    return F.make_dt_interval(mins=F.lit(n))


def hours(n: int) -> Column:
    return F.make_dt_interval(hours=F.lit(n))


def between(df: DataFrame, time: str, after: Column | None, upto: Column | None) -> DataFrame:
    """Rows with after < time <= upto. Tables laid out by market date are pruned by date too."""
    dated = "date" in df.columns
    if after is not None:
        df = df.where(F.col(time) > after)
        if dated:
            df = df.where(F.col("date") >= nem_date(after))
    if upto is not None:
        df = df.where(F.col(time) <= upto)
        if dated:
            df = df.where(F.col("date") <= nem_date(upto))
    return df


@dataclass(frozen=True)
class Fleet:
    units: DataFrame
    readings: DataFrame
    weather: DataFrame
    prices: DataFrame
    dispatch: DataFrame
    ledger: DataFrame | None = None
    interval_minutes: int = fixed.INTERVAL_MINUTES
    tolerance_minutes: int = fixed.WEATHER_TOLERANCE_MINUTES

    def slice(self, after: Column | None = None, upto: Column | None = None) -> "Fleet":
        """The same fleet cut to a time range before anything is joined or aggregated."""
        reach = minutes(self.tolerance_minutes)
        return replace(
            self,
            readings=between(self.readings, "interval_end", after, upto),
            dispatch=between(self.dispatch, "interval_end", after, upto),
            prices=between(self.prices, "interval_end", after, upto),
            weather=between(
                self.weather, "observed_at",
                None if after is None else after - reach - minutes(1),
                None if upto is None else upto + reach,
            ),
        )

    def performance(self, after: Column | None = None, upto: Column | None = None) -> DataFrame:
        cut = self.slice(after, upto)
        return scoring.facility_performance(
            cut.readings, cut.units, cut.weather, cut.prices, cut.dispatch,
            self.interval_minutes, self.tolerance_minutes,
        )
