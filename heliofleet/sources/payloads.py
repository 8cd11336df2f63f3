"""Nested JSON payloads (registry, weather), Markdown folders, and JSON/archive sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from heliofleet import fixed, schemas
from heliofleet.functions.columns import nem_date


def flatten_registry(payloads: DataFrame, column: str = "payload", min_capacity_mw: float = 1.0) -> DataFrame:
    """Operating utility-scale solar units of the market that have a location."""
    facility = payloads.select(F.explode(
        F.from_json(column, schemas.REGISTRY_PAYLOAD)["data"]).alias("f")).where(
        (F.col("f.network_id") == fixed.REGISTRY_NETWORK)
        & F.col("f.location.lat").isNotNull() & F.col("f.location.lng").isNotNull())
    unit = facility.select("f", F.explode("f.units").alias("u")).where(
        (F.col("u.fueltech_id") == fixed.REGISTRY_FUEL)
        & (F.col("u.status_id") == fixed.REGISTRY_STATUS)
        & (F.coalesce("u.capacity_registered", F.lit(0.0)) >= min_capacity_mw))
    return unit.select(
        F.col("u.code").alias("duid"),
        F.col("f.code").alias("facility_code"),
        F.col("f.name").alias("facility_name"),
        F.coalesce("f.network_region", F.lit("")).alias("region"),
        F.col("f.location.lat").alias("latitude"),
        F.col("f.location.lng").alias("longitude"),
        F.col("u.capacity_registered").alias("capacity_mw"),
    )


def flatten_hourly_weather(payloads: DataFrame, now: Column, column: str = "payload") -> DataFrame:
    """Hourly means, each stamped half an hour before its end; hours not over yet are dropped.

    The arrays are read up to the shortest of them, so a missing field leaves no rows.
    """
    hourly = F.from_json(column, schemas.HOURLY_PAYLOAD)["hourly"]
    names = ("time", "shortwave_radiation", "temperature_2m", "cloud_cover")
    arrays = payloads.select("facility_code", *[hourly[n].alias(n) for n in names])
    shortest = F.least(*[F.coalesce(F.array_size(n), F.lit(0)) for n in names])
    zipped = F.arrays_zip(*[F.slice(F.col(n), F.lit(1), shortest).alias(n) for n in names])
    end = F.to_timestamp("h.time")
    return (
        arrays.select("facility_code", F.explode(zipped).alias("h"))
        .where(end <= now)
        .select("facility_code", (end - F.expr("INTERVAL 30 MINUTES")).alias("observed_at"),
                F.col("h.shortwave_radiation").alias("ghi_wm2"),
                F.col("h.temperature_2m").alias("temp_c"),
                F.col("h.cloud_cover").alias("cloud_cover_pct"))
    )


def flatten_current_weather(payloads: DataFrame, sites: DataFrame) -> DataFrame:
    """Current conditions. ``payloads`` holds (request_id, payload): one object or a list, in the
    order of that request's ``sites`` (request_id, position, facility_code). A count that differs
    is an error."""
    results = F.from_json("payload", T.ArrayType(schemas.CURRENT_PAYLOAD))
    asked = sites.groupBy("request_id").agg(F.count(F.lit(1)).alias("_asked"))
    parsed = payloads.select("request_id", results.alias("_results"))
    counted = asked.join(parsed, "request_id", "left").withColumn(
        "_results",
        F.when(F.col("_asked") == F.array_size("_results"), F.col("_results")).otherwise(F.raise_error(
            F.concat(F.lit("expected "), "_asked", F.lit(" results, got "),
                     F.coalesce(F.array_size("_results"), F.lit(0)))).cast(T.ArrayType(schemas.CURRENT_PAYLOAD))))
    rows = counted.select("request_id", F.posexplode("_results").alias("position", "r"))
    return rows.join(sites, ["request_id", "position"]).select(
        "facility_code", F.to_timestamp("r.current.time").alias("observed_at"),
        F.col("r.current.shortwave_radiation").alias("ghi_wm2"),
        F.col("r.current.temperature_2m").alias("temp_c"),
        F.col("r.current.cloud_cover").alias("cloud_cover_pct"))


def read_markdown_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per Markdown file except readme: (doc, text)."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md")
    name = F.col("_metadata.file_name")
    return files.where(F.lower(name) != "readme.md").select(
        F.regexp_replace(name, r"\.md$", "").alias("doc"), F.col("value").alias("text"))


def with_market_date(df: DataFrame, time: str = "interval_end") -> DataFrame:
    return df.withColumn("date", nem_date(F.col(time)))


def archive_by_date(df: DataFrame, path: str, time: str = "interval_end", mode: str = "append") -> None:
    """Write under ``date=YYYY-MM-DD`` folders of the market-local date. The rebalance hint gathers
    small dates into few files and lets AQE split a heavy date over several tasks."""
    dated = with_market_date(df, time).hint("rebalance", "date")
    dated.write.mode(mode).partitionBy("date").parquet(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON text; timestamps ISO-8601 with their microseconds where they have any,
    decimals as floats, NULLs kept."""
    def instant(name: str) -> Column:
        whole = F.date_trunc("second", name) == F.col(name)
        return F.when(whole, F.date_format(name, "yyyy-MM-dd'T'HH:mm:ssXXX")).otherwise(
            F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))

    plain = [
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
        else instant(f.name).alias(f.name) if isinstance(f.dataType, T.TimestampType)
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}).alias("json"))
