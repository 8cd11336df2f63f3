"""The driver's tables seen as fleet tables, in Spark and as portable SQL for the check.

``user_id % 10`` gives ten farms in five regions; readings have a one-hour grain there, so the
registered queries pass ``interval_minutes=60``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from heliofleet.operators.fleet import Fleet
from heliofleet.session import configure

GRAIN = 60
TOLERANCE = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def fleet(spark: SparkSession, sf_dir: str) -> Fleet:
    ev = events(spark, sf_dir)
    region = table(spark, sf_dir, "region")
    farm = F.col("user_id") % 10
    units = (
        ev.select("user_id").distinct()
        .join(region, F.col("r_regionkey") == farm % 5)
        .select(
            F.concat(F.lit("U"), "user_id").alias("duid"),
            F.concat(F.lit("F"), farm).alias("facility_code"),
            F.concat(F.lit("Farm "), farm).alias("facility_name"),
            F.col("r_name").alias("region"),
            (-20 - farm).cast("double").alias("latitude"),
            (140 + farm).cast("double").alias("longitude"),
            (100 + 50 * (F.col("user_id") % 4)).cast("double").alias("capacity_mw"),
        )
    )
    readings = (
        ev.where(F.col("event_type").isin("click", "purchase"))
        .groupBy("user_id", (F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 HOUR")).alias("interval_end"))
        .agg(F.max("value").alias("mw"))
        .select(F.concat(F.lit("U"), "user_id").alias("duid"), F.col("user_id").alias("uid"), "interval_end", "mw")
    )
    farms = units.select("facility_code", "region").distinct()
    weather = (
        ev.where(F.col("event_type").isin("view", "signup", "error"))
        .join(region, F.col("r_regionkey") == farm % 5)
        .join(farms, F.col("region") == F.col("r_name"))
        .select("facility_code", F.col("ts").alias("observed_at"),
                F.least(F.col("value") * 10, F.lit(1100.0)).alias("ghi_wm2"))
    )
    prices = (
        readings.join(units.where("facility_code <> 'F3'").select("duid", "region"), "duid")
        .groupBy("region", "interval_end")
        .agg(F.round((F.avg("mw") - 30).cast("decimal(18,6)"), 2).cast("double").alias("rrp"))
    )
    dispatch = readings.where("uid % 2 = 0").select(
        "duid", "interval_end",
        (F.col("mw") * 0.9).alias("total_cleared"),
        (F.col("mw") + 10).alias("availability"),
        F.when(F.col("uid") % 5 != 0, F.col("mw") + F.col("uid") % 40).alias("uigf"),
        (F.col("uid") % 3 == 0).alias("semidispatch_cap"),
    )
    ledger = ledger_of(readings)
    return Fleet(
        units=units, readings=readings, weather=weather, prices=prices, dispatch=dispatch,
        ledger=ledger, interval_minutes=GRAIN, tolerance_minutes=TOLERANCE,
    )


def ledger_of(readings: DataFrame) -> DataFrame:
    """One ledger row per reading interval, named like the report that would carry it."""
    return (
        readings.groupBy("interval_end")
        .agg(F.count(F.lit(1)).cast("int").alias("rows_total"))
        .select(
            F.concat(F.lit("PUBLIC_DISPATCHSCADA_"), F.date_format("interval_end", "yyyyMMddHHmm"),
                     F.lit("_0000000000000001.zip")).alias("file_name"),
            "interval_end", "rows_total", F.col("rows_total").alias("rows_solar"),
        )
    )


SQL_VIEWS = """
units AS (
    SELECT DISTINCT concat('U', user_id) AS duid, concat('F', user_id % 10) AS facility_code,
           concat('Farm ', user_id % 10) AS facility_name, r_name AS region,
           CAST(-20 - user_id % 10 AS DOUBLE) AS latitude, CAST(140 + user_id % 10 AS DOUBLE) AS longitude,
           CAST(100 + 50 * (user_id % 4) AS DOUBLE) AS capacity_mw, user_id AS uid
    FROM events JOIN region ON r_regionkey = (user_id % 10) % 5
),
readings AS (
    SELECT concat('U', user_id) AS duid, user_id AS uid,
           date_trunc('hour', ts) + INTERVAL '1' HOUR AS interval_end, max(value) AS mw
    FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2, 3
),
weather AS (
    SELECT f.facility_code, e.ts AS observed_at, least(e.value * 10, 1100) AS ghi_wm2
    FROM events e JOIN region r ON r.r_regionkey = (e.user_id % 10) % 5
    JOIN (SELECT DISTINCT facility_code, region FROM units) f ON f.region = r.r_name
    WHERE e.event_type IN ('view', 'signup', 'error')
),
prices AS (
    SELECT u.region, d.interval_end, CAST(round(CAST(avg(d.mw) - 30 AS DECIMAL(18,6)), 2) AS DOUBLE) AS rrp
    FROM readings d JOIN units u ON u.duid = d.duid WHERE u.facility_code <> 'F3' GROUP BY 1, 2
),
dispatch AS (
    SELECT duid, interval_end, mw * 0.9 AS total_cleared, mw + 10 AS availability,
           CASE WHEN uid % 5 = 0 THEN NULL ELSE mw + uid % 40 END AS uigf, uid % 3 = 0 AS semidispatch_cap
    FROM readings WHERE uid % 2 = 0
),
ledger AS (
    SELECT concat('PUBLIC_DISPATCHSCADA_', strftime(interval_end, '%Y%m%d%H%M'), '_0000000000000001.zip') AS file_name,
           interval_end, CAST(count(*) AS INTEGER) AS rows_total, CAST(count(*) AS INTEGER) AS rows_solar
    FROM readings GROUP BY interval_end
)"""

# The scored view in SQL, phrased with correlated lookups where Spark uses keyed aggregates.
SQL_PERFORMANCE = """
perf_raw AS (
    SELECT u.facility_code, min(u.facility_name) AS facility_name, min(u.region) AS region, r.interval_end,
           sum(r.mw) AS actual_mw, sum(u.capacity_mw) AS capacity_mw
    FROM readings r, units u WHERE r.duid = u.duid GROUP BY u.facility_code, r.interval_end
),
perf_sun AS (
    SELECT f.*, w.ghi_wm2, p.rrp,
           CASE WHEN w.ghi_wm2 > 0 THEN
                    CASE WHEN w.ghi_wm2 >= 1250 THEN f.capacity_mw ELSE f.capacity_mw * (w.ghi_wm2 / 1000.0 * 0.8) END
                ELSE 0 END AS expected_mw
    FROM perf_raw f
    LEFT JOIN LATERAL (
        SELECT o.ghi_wm2 FROM weather o
        WHERE o.facility_code = f.facility_code
          AND o.observed_at >= f.interval_end - INTERVAL 30 MINUTE AND o.observed_at <= f.interval_end + INTERVAL 30 MINUTE
        ORDER BY abs(epoch_us(o.observed_at) - epoch_us(f.interval_end)), o.observed_at LIMIT 1
    ) w ON true
    LEFT JOIN prices p ON p.region = f.region AND p.interval_end = f.interval_end
),
perf_cut AS (
    SELECT u.facility_code, d.interval_end,
           sum(CASE WHEN d.semidispatch_cap AND coalesce(d.uigf, d.availability, 0) > d.total_cleared
                    THEN coalesce(d.uigf, d.availability, 0) - d.total_cleared ELSE 0 END) AS curtailed_mw
    FROM dispatch d, units u WHERE u.duid = d.duid GROUP BY ALL
),
perf_scored AS (
    SELECT s.*, c.curtailed_mw,
           CASE WHEN s.ghi_wm2 >= 200 AND s.expected_mw >= 0.05 * s.capacity_mw
                THEN (CASE WHEN s.actual_mw > 0 THEN s.actual_mw ELSE 0 END) / s.expected_mw END AS performance_index
    FROM perf_sun s LEFT JOIN perf_cut c USING (facility_code, interval_end)
),
perf AS (
    SELECT *, CASE WHEN performance_index IS NULL THEN NULL
                   WHEN performance_index >= 0.6 THEN 'ok'
                   WHEN curtailed_mw IS NULL AND rrp < 0 THEN 'likely_curtailed'
                   WHEN curtailed_mw IS NOT NULL AND curtailed_mw > 0.05 * capacity_mw THEN 'curtailed'
                   ELSE 'underperforming' END AS status
    FROM perf_scored
)"""


def fleet_sql(body: str, performance: bool = False) -> str:
    parts = SQL_VIEWS + ("," + SQL_PERFORMANCE if performance else "")
    return f"WITH {parts.strip()}\n{body}"


def sql_round(expression: str, digits: int) -> str:
    return f"CAST(round(CAST({expression} AS DECIMAL(38,{digits + 6})), {digits}) AS DOUBLE)"
