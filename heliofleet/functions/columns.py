"""Small column expressions shared by the operators. All of them stay inside Catalyst."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F, types as T

from heliofleet import fixed


def rounded(value: Column, digits: int) -> Column:
    """Round half away from zero on the decimal image of a double, as a double.

    Six guard digits absorb the last-bit noise of sums taken in shuffle order, so the
    result does not depend on how the rows were partitioned.
    """
    return F.round(value.cast(T.DecimalType(38, digits + 6)), digits).cast("double")


def nem_to_utc(text: Column, pattern: str = fixed.REPORT_TIME_FORMAT) -> Column:
    """Market time (fixed UTC+10) text to a UTC timestamp; NULL when it does not parse."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.trim(text), F.lit(pattern)), fixed.NEM_OFFSET)


def nem_date(at: Column) -> Column:
    """Market-local calendar date of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(at, fixed.NEM_OFFSET))


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def energy_mwh(mw_total: Column, interval_minutes: int) -> Column:
    """MWh of a sum of instantaneous MW readings, each standing for one interval."""
    return mw_total * interval_minutes / 60


def instant(at: datetime) -> Column:
    """A literal instant; a datetime without a zone is UTC, whatever the driver's own zone."""
    return F.lit(at if at.tzinfo else at.replace(tzinfo=timezone.utc))


def scalar(df: DataFrame) -> Column:
    """A one-row, one-column aggregate as an uncorrelated scalar subquery."""
    return df.scalar()


def as_naive(df: DataFrame) -> DataFrame:
    """Timestamps as naive UTC, the form results are compared and displayed in."""
    return df.select(*[
        F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
        if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])
