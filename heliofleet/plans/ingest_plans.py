"""Registered queries for sources, ingest and quality. Report text and nested payloads are
derived by Spark from the given tables, row for row."""

from __future__ import annotations

import functools
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from heliofleet import fixed
from heliofleet.functions.columns import as_naive, instant, nem_date
from heliofleet.operators import ingest, quality
from heliofleet.plans.bindings import events, fleet, fleet_sql, ledger_of, table
from heliofleet.session import shared_dir
from heliofleet.sources import golden, payloads, reports
from heliofleet.streaming import ingest as stream_ingest

NOW = datetime(2024, 1, 31, 0, 0)
NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


# ---------- report text made from readings ----------

def _stamp(at):
    return F.date_format(F.from_utc_timestamp(at, fixed.NEM_OFFSET), fixed.REPORT_TIME_FORMAT)


def _file(kind: str):
    return F.concat(F.lit(f"PUBLIC_{kind}_"), F.date_format("interval_end", "yyyyMMddHHmm"), F.lit("_0000000000000001.zip"))


def scada_rows(f) -> DataFrame:
    """One report per interval. Units below 75 follow the first header, the others a second one
    with its columns in another order; some cells are broken and other tables are interleaved."""
    first = F.lit("I,DISPATCH,UNIT_SCADA,1,SETTLEMENTDATE,DUID,SCADAVALUE,LASTCHANGED")
    second = F.lit("I,DISPATCH,UNIT_SCADA,1,DUID,SCADAVALUE,SETTLEMENTDATE")
    comment = F.lit('C,NEMP.WORLD,DISPATCHSCADA,AEMO,PUBLIC,"a, quoted ""comment"""')
    stray = F.lit('D,DISPATCH,UNIT_SCADA,1,"2024/01/01 00:00:00",EARLY,1.0')
    other = F.lit('D,DISPATCH,REGIONSUM,1,"2024/01/01 00:00:00",NSW1')
    frame = f.readings.select("interval_end").distinct().select(
        _file("DISPATCHSCADA").alias("file"),
        F.explode(F.array(
            F.struct(F.lit(0).alias("n"), comment.alias("line")), F.struct(F.lit(1).alias("n"), stray.alias("line")),
            F.struct(F.lit(2).alias("n"), first.alias("line")), F.struct(F.lit(3).alias("n"), other.alias("line")),
            F.struct(F.lit(78).alias("n"), second.alias("line")))).alias("l"))
    frame = frame.select("file", F.col("l.n").cast("bigint").alias("line_no"), F.col("l.line").alias("line"))
    stamp = F.when(F.col("uid") % 19 == 0, F.lit("2024/13/45 00:00:00")).otherwise(_stamp(F.col("interval_end")))
    value = F.when(F.col("uid") % 17 == 0, F.lit("n/a")).otherwise(F.col("mw").cast("string"))
    quoted = F.concat(F.lit('"'), stamp, F.lit('"'))
    early = F.concat(F.lit("D,DISPATCH,UNIT_SCADA,1,"), quoted, F.lit(", "), "duid", F.lit(" ,"), value, F.lit(","), quoted)
    late = F.concat(F.lit("D,DISPATCH,UNIT_SCADA,1,"), "duid", F.lit(","), value, F.lit(","), quoted, F.lit(",extra"))
    data = f.readings.select(
        _file("DISPATCHSCADA").alias("file"),
        F.when(F.col("uid") < 75, F.col("uid") + 3).otherwise(F.col("uid") + 4).alias("line_no"),
        F.when(F.col("uid") < 75, early).otherwise(late).alias("line"))
    return parsed(frame.unionByName(data))


def parsed(lines: DataFrame) -> DataFrame:
    return lines.select("file", F.lit("").alias("member"), "line_no", reports.split_fields(F.col("line")).alias("fields"),
                        F.lit(None).cast("string").alias("error"))


def scada(spark, sf):
    f = fleet(spark, sf)
    return reports.scada_readings(reports.report_records(scada_rows(f), fixed.SCADA_TABLE))


SCADA_SQL_WHERE = "uid % 17 <> 0 AND uid % 19 <> 0"
FILE_SQL = "concat('PUBLIC_DISPATCHSCADA_', strftime(interval_end, '%Y%m%d%H%M'), '_0000000000000001.zip')"


def prices_from_reports(spark, sf):
    f = fleet(spark, sf)
    header = F.lit("I,DISPATCH,PRICE,5,SETTLEMENTDATE,RUNNO,REGIONID,DISPATCHINTERVAL,INTERVENTION,RRP")
    rows = f.prices.withColumn("file", _file("DISPATCHIS"))
    heads = rows.select("file").distinct().select("file", F.lit(0).cast("bigint").alias("line_no"), header.alias("line"))
    flag = F.when(F.col("region") == "ASIA", "1").otherwise("0")
    price = F.when(F.col("rrp") > 60, F.lit("")).otherwise(F.col("rrp").cast("string"))
    data = rows.select("file", (F.length("region") + F.ascii("region") * 100).cast("bigint").alias("line_no"), F.concat(
        F.lit('D,DISPATCH,PRICE,5,"'), _stamp(F.col("interval_end")), F.lit('",1,'), "region", F.lit(" ,1,"), flag, F.lit(","), price).alias("line"))
    records = reports.report_records(parsed(heads.unionByName(data)), fixed.PRICE_TABLE)
    return reports.region_prices(records).select("file", "region", "interval_end", "rrp")


def dispatch_from_reports(spark, sf):
    """One next-day report per market date, all units; only units below 100 are registered."""
    f = fleet(spark, sf)
    day = F.date_format(F.from_utc_timestamp("interval_end", fixed.NEM_OFFSET), "yyyyMMdd")
    rows = f.dispatch.withColumn("file", F.concat(F.lit("PUBLIC_NEXT_DAY_DISPATCH_"), day, F.lit("_1.zip")))
    header = F.lit("I,DISPATCH,UNIT_SOLUTION,5,SETTLEMENTDATE,DUID,INTERVENTION,DISPATCHMODE,INITIALMW,TOTALCLEARED,AVAILABILITY,SEMIDISPATCHCAP,UIGF")
    heads = rows.select("file").distinct().select("file", F.lit(-1).cast("bigint").alias("line_no"), header.alias("line"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    data = rows.select("file", F.hour("interval_end").cast("bigint").alias("line_no"), F.concat(
        F.lit('D,DISPATCH,UNIT_SOLUTION,5,"'), _stamp(F.col("interval_end")), F.lit('",'), "duid", F.lit(",0,0,0,"),
        text("total_cleared"), F.lit(","), text("availability"), F.lit(","), F.col("semidispatch_cap").cast("int").cast("string"),
        F.lit(","), text("uigf")).alias("line"))
    records = reports.report_records(parsed(heads.unionByName(data)), fixed.UNIT_SOLUTION_TABLE)
    known = f.units.where("cast(substring(duid, 2) as int) < 100")
    return reports.unit_dispatch(records, known).drop("line_no", "member")


def listing_files(spark, sf):
    f = fleet(spark, sf)
    link = F.concat(F.lit('<a href="/Reports/'), _file("dispatchscada"), F.lit('">'), _file("dispatchscada"), F.lit("</a> readme.zip"))
    return reports.extract_listing(f.readings.select(link.alias("html")), "html", fixed.SCADA_FILE)


def file_intervals(spark, sf):
    names = ledger_of(fleet(spark, sf).readings).select(F.col("file_name").alias("name"))
    return reports.file_interval(names, fixed.SCADA_FILE)


def next_day_dates(spark, sf):
    orders = table(spark, sf, "orders").select(F.when(
        F.col("o_orderkey") % 7 == 0, F.concat(F.lit("notes_"), "o_orderkey", F.lit(".zip"))).otherwise(
        F.concat(F.lit("PUBLIC_NEXT_DAY_DISPATCH_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), "o_orderkey", F.lit(".zip"))).alias("name"))
    return reports.file_interval(orders, fixed.NEXT_DAY_FILE, on_bad_name="null")


# ---------- nested payloads made from orders and line items ----------

def registry(spark, sf):
    li, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    unit = F.struct(
        F.concat(F.lit("D"), "l_orderkey", F.lit("_"), "l_linenumber").alias("code"),
        F.when(F.col("l_returnflag") == "R", "wind").otherwise("solar_utility").alias("fueltech_id"),
        F.when(F.col("l_linestatus") == "F", "retired").otherwise("operating").alias("status_id"),
        F.when(F.col("l_linenumber") != 2, F.col("l_quantity") / 10).alias("capacity_registered"))
    per_order = li.groupBy("l_orderkey").agg(F.collect_list(unit).alias("units"))
    site = orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).select(F.struct(
        F.concat(F.lit("S"), "o_orderkey").alias("code"), F.concat(F.lit("Site "), "o_orderkey").alias("name"),
        F.when(F.col("o_orderkey") % 6 == 0, "WEM").otherwise("NEM").alias("network_id"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("network_region"),
        F.when(F.col("o_orderkey") % 5 != 0, F.struct(
            (F.col("o_custkey") / -10.0).alias("lat"),
            F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey") / 4.0).alias("lng"))).alias("location"),
        "units").alias("f"), "o_orderkey")
    payload = site.select(F.to_json(F.struct(F.array("f").alias("data"))).alias("payload"))
    return payloads.flatten_registry(payload)


def hourly_weather(spark, sf):
    """One payload per user and day: hours, and three measures of which one may run short."""
    ev = events(spark, sf)
    hour = F.struct(F.date_trunc("hour", "ts").alias("t"), "event_id", "value")
    rows = ev.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(hour)).alias("h"))
    n = F.size("h") - F.when(F.col("user_id") % 3 == 0, 1).otherwise(0)
    hourly = F.struct(
        F.transform("h", lambda x: F.date_format(x["t"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
        F.transform("h", lambda x: x["value"]).alias("shortwave_radiation"),
        F.when(F.col("user_id") % 7 != 0, F.transform("h", lambda x: x["value"] / 2)).alias("temperature_2m"),
        F.slice(F.transform("h", lambda x: F.when(x["event_id"] % 2 == 0, x["value"])), F.lit(1), n).alias("cloud_cover"))
    payload = rows.select(F.concat(F.lit("P"), "user_id").alias("facility_code"),
                          F.to_json(F.struct(hourly.alias("hourly")), {"ignoreNullFields": "false"}).alias("payload"))
    return payloads.flatten_hourly_weather(payload, instant(datetime(2024, 1, 20, 6, 30)))


def current_weather(spark, sf):
    """Ten customers per request as sites; a request for one nation's only customer is an object."""
    cust = table(spark, sf, "customer").select(
        (F.col("c_custkey") / 10).cast("bigint").alias("request_id"), (F.col("c_custkey") % 10).cast("int").alias("position"),
        F.concat(F.lit("C"), "c_custkey").alias("facility_code"), "c_acctbal", "c_custkey")
    one = F.struct(F.struct(
        F.lit("2024-01-10T03:15").alias("time"), F.col("c_acctbal").alias("shortwave_radiation"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal") / 100).alias("temperature_2m"),
        (F.col("c_custkey") % 100).cast("double").alias("cloud_cover")).alias("current"))
    body = cust.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("position", one.alias("r")))).alias("rs")).select(
        "request_id", F.to_json(F.transform("rs", lambda x: x["r"])).alias("payload"))
    return payloads.flatten_current_weather(body, cust.select("request_id", "position", "facility_code"))


def json_rows(spark, sf):
    return payloads.to_json_rows(table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(12,2)").alias("total"),
        F.col("o_orderdate").cast("timestamp").alias("at"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("cust")))


def golden_cases(spark, sf):
    """Every order as a golden set, its lines as cases: a number and a text that may be null as arguments."""
    line = F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("hours"), "l_returnflag")
    sets = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("set_id")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    case = F.transform("lines", lambda x: F.struct(
        F.concat(F.lit("part "), x["l_partkey"]).alias("question"),
        F.struct(F.lit("fleet_summary").alias("tool"), F.struct(
            x["hours"].alias("hours"), F.when(x["l_returnflag"] != "A", x["l_returnflag"]).alias("region")).alias("args")).alias("expect")))
    return golden.routing_cases(sets.select("set_id", F.to_json(F.struct(case.alias("cases")), {"ignoreNullFields": "false"}).alias("payload"))).select(
        "set_id", "case_id", "question", "tool", F.size("args").alias("n_args"), F.col("args")["hours"].alias("hours"), F.col("args")["region"].alias("region"))


# ---------- ingest ----------

def upsert_readings(spark, sf):
    """Every reading, written over by every event in event order; events of odd units count for the hour after."""
    f = fleet(spark, sf)
    batch = events(spark, sf).select(
        F.concat(F.lit("U"), "user_id").alias("duid"),
        (F.date_trunc("hour", "ts") + F.make_dt_interval(hours=(1 + F.col("user_id") % 2).cast("int"))).alias("interval_end"),
        (F.col("value") + 1000).alias("mw"), "event_id")
    return ingest.upsert(f.readings.select("duid", "interval_end", "mw"), batch, ["duid", "interval_end"], ["event_id"])


def weather_backfill(spark, sf):
    """Polled observations with hourly history written over them."""
    f = fleet(spark, sf)
    polls = f.weather.groupBy("facility_code", F.date_trunc("hour", "observed_at").alias("observed_at")).agg(F.max("ghi_wm2").alias("ghi_wm2"))
    history = f.weather.groupBy("facility_code", (F.date_trunc("hour", "observed_at") + F.expr("INTERVAL 3 HOURS")).alias("observed_at")).agg(
        F.min("ghi_wm2").alias("ghi_wm2")).withColumn("seq", F.lit(0))
    return ingest.upsert(polls, history, ["facility_code", "observed_at"], ["seq"])


def with_strangers(f) -> DataFrame:
    """The readings as reports carry them: every fourth unit is one that the registry does not know."""
    return f.readings.withColumn("duid", F.when(F.col("uid") % 4 == 0, F.concat(F.lit("X"), "uid")).otherwise(F.col("duid")))


def known_readings(spark, sf):
    f = fleet(spark, sf)
    return ingest.keep_known(with_strangers(f), f.units).select("duid", "interval_end", "mw")


def ledger_append(spark, sf):
    f = fleet(spark, sf)
    old = f.ledger.where("hour(interval_end) % 3 = 0").withColumn("ingested_at", F.lit(0).cast("bigint"))
    new = f.readings.select(
        F.concat(F.lit("PUBLIC_DISPATCHSCADA_"), F.date_format("interval_end", "yyyyMMddHHmm"), F.lit("_0000000000000001.zip")).alias("file_name"),
        "interval_end", F.lit(1).alias("rows_total"), F.lit(1).alias("rows_solar"), (F.col("uid") + 1).alias("ingested_at"))
    return ingest.append_if_absent(old, new)


def pending(spark, sf):
    f = fleet(spark, sf)
    return ingest.pending_files(f.ledger.select(F.col("file_name").alias("name")), f.ledger.where("hour(interval_end) % 3 = 0"))


def ingest_counts(spark, sf):
    """Counts of the files that the ledger lacks: two thirds of its entries are for other files of the same intervals."""
    f = fleet(spark, sf)
    strangers = replace(f, readings=with_strangers(f))
    rows = reports.scada_readings(reports.report_records(scada_rows(strangers), fixed.SCADA_TABLE))
    other = F.regexp_replace("file_name", "1.zip$", "2.zip")
    ledger = f.ledger.withColumn("file_name", F.when(F.expr("hour(interval_end) % 3 = 0"), F.col("file_name")).otherwise(other))
    return ingest.ingest_counts(rows, f.units, ledger)


def price_sync_counts(spark, sf):
    """Rows stored per file for the newest price files not in the ledger."""
    f = fleet(spark, sf)
    named = f.prices.withColumn("name", _file("DISPATCHIS"))
    done = f.ledger.where("hour(interval_end) % 4 = 0").select(
        F.regexp_replace("file_name", "DISPATCHSCADA", "DISPATCHIS").alias("file_name"))
    todo = ingest.pending_files(named.select("name"), done, fixed.MAX_PRICE_FILES)
    return named.join(todo, "name", "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("stored"))


def failures(spark, sf):
    """Every order as a file result; some already failed a few times."""
    orders = table(spark, sf, "orders")
    name = F.concat(F.lit("file_"), F.col("o_custkey"))
    results = orders.select(name.alias("file"), F.when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 450000), F.concat(F.lit("bad line "), F.col("o_orderkey"))).alias("error"))
    tried = table(spark, sf, "customer").select(F.concat(F.lit("file_"), "c_custkey").alias("file"), (F.col("c_custkey") % 5).cast("int").alias("attempts"))
    return ingest.split_failures(results, tried)


def constraints(spark, sf):
    li, orders, cust = table(spark, sf, "lineitem"), table(spark, sf, "orders"), table(spark, sf, "customer")
    return quality.check_constraints(
        quality.row_rules(li, {"quantity_above_25": F.col("l_quantity") > 25, "shipdate_present": F.col("l_shipdate").isNotNull()}),
        quality.key_rule(li, "line_key_unique", ["l_orderkey", "l_linenumber"]),
        quality.key_rule(orders, "order_key_unique", ["o_orderkey"]),
        quality.reference_rule(li, "line_has_order", orders.where("o_orderstatus <> 'P'"), "l_orderkey", "o_orderkey"),
        quality.reference_rule(orders, "order_has_customer", cust, "o_custkey", "c_custkey"),
        quality.not_empty_rule(cust, "customers_loaded"))


def written_store(spark, sf) -> stream_ingest.Store:
    """All five tables as ingest lays them out; the ledger as if each hour of the day had been a batch."""
    f = fleet(spark, sf)
    store = stream_ingest.Store(f"{shared_dir(spark, 'pruned')}/store")
    tables = ((f.readings.drop("uid"), store.readings), (f.prices, store.table(stream_ingest.PRICES)), (f.dispatch, store.table(stream_ingest.NEXT_DAY)))
    for df, path in tables:
        df.withColumn("date", nem_date(F.col("interval_end"))).write.partitionBy("date").parquet(path)
    sky = f.weather.groupBy("facility_code", "observed_at").agg(F.max("ghi_wm2").alias("ghi_wm2"))
    stream_ingest.store_weather(sky, store)
    (f.ledger.withColumn("ingested_at", F.col("interval_end")).withColumn("date", nem_date(F.col("interval_end")))
     .withColumn("batch", F.format_string("%012d", F.expr("hour(interval_end) div 6")))
     .write.partitionBy(*stream_ingest.LEDGER_LEAF).parquet(store.ledger))
    return store


def pruned_ledger(spark, sf):
    store = written_store(spark, sf)
    stream_ingest.prune_store(spark, store, 20, NOW)
    return stream_ingest.ledger(spark, store).select("file_name", "interval_end", "rows_total", "rows_solar", F.col("date").cast("string").alias("date"), "batch")


def pruned_store(spark, sf):
    """Rows that retention took from each table, and rows that are left."""
    store = written_store(spark, sf)
    gone = stream_ingest.prune_store(spark, store, 20, NOW)
    left = [spark.read.parquet(path).agg(F.count(F.lit(1)).alias("left")).select(F.lit(name).alias("table"), "left") for name, path in (
        ("readings", store.readings), ("weather", store.weather), ("prices", store.table(stream_ingest.PRICES)),
        ("dispatch", store.table(stream_ingest.NEXT_DAY)), ("ledger", store.ledger))]
    return gone.join(functools.reduce(DataFrame.unionByName, left), "table")


def prune_counts(spark, sf):
    f = fleet(spark, sf)
    return ingest.prune_counts({
        "readings": (f.readings, "interval_end"), "weather": (f.weather, "observed_at"), "prices": (f.prices, "interval_end"),
        "dispatch": (f.dispatch, "interval_end"), "ledger": (f.ledger, "interval_end")}, 20, instant(NOW))


def calls(spark, sf):
    """A tool call per order, with arguments inside and outside the bounds."""
    k = F.col("o_orderkey")
    tools = F.array(*[F.lit(t) for t in ("underperformers", "facility_performance", "fleet_summary", "curtailed_farms", "search_docs", "drop_table")])
    args = (
        F.when(k % 6 == 0, F.create_map(F.lit("threshold"), (F.col("o_custkey") % 200 / 100.0).cast("string"), F.lit("region"), F.when(k % 4 == 0, "SA1").when(k % 4 == 1, "XX")))
        .when(k % 6 == 1, F.create_map(F.lit("facility"), F.repeat(F.lit("x"), (k % 90).cast("int")), F.lit("hours"), (F.col("o_custkey") % 200).cast("string")))
        .when(k % 6 == 2, F.create_map(F.lit("hours"), F.lit("soon")))
        .when(k % 6 == 3, F.create_map(F.lit("limit"), (k % 30).cast("string"), F.lit("color"), F.lit("red")))
        .when(k % 6 == 4, F.create_map(F.lit("k"), (k % 10).cast("string"))))
    return table(spark, sf, "orders").select(k.alias("call_id"), F.element_at(tools, (k % 6 + 1).cast("int")).alias("tool"), args.alias("args"))


def validated(spark, sf):
    checked = quality.validate_calls(calls(spark, sf), quality.argument_rules(spark))
    return checked.select("call_id", "tool", "valid", F.concat_ws("; ", "reasons").alias("reasons"),
                          F.col("args")["hours"].alias("hours"), F.col("args")["limit"].alias("limit"), F.col("args")["threshold"].alias("threshold"))


VALIDATED_SQL = """
WITH c AS (SELECT o_orderkey AS call_id, o_orderkey % 6 AS kind, o_orderkey % 4 AS reg, o_custkey % 200 / 100.0 AS th, o_orderkey % 90 AS len,
                  o_custkey % 200 AS hrs, o_orderkey % 30 AS lim, o_orderkey % 10 AS kk FROM orders),
r AS (SELECT *, CASE kind
   WHEN 0 THEN concat_ws('; ', CASE WHEN reg = 1 THEN 'invalid region' END, CASE WHEN th < 0.05 OR th > 1.5 THEN 'invalid threshold' END)
   WHEN 1 THEN concat_ws('; ', CASE WHEN len < 2 OR len > 80 THEN 'invalid facility' END, CASE WHEN hrs < 1 OR hrs > 168 THEN 'invalid hours' END)
   WHEN 2 THEN 'invalid hours'
   WHEN 3 THEN concat_ws('; ', CASE WHEN lim < 1 OR lim > 25 THEN 'invalid limit' END, 'unknown argument color')
   WHEN 4 THEN concat_ws('; ', CASE WHEN kk < 1 OR kk > 8 THEN 'invalid k' END, 'invalid query')
   ELSE 'unknown tool' END AS reasons FROM c)
SELECT call_id, ['underperformers','facility_performance','fleet_summary','curtailed_farms','search_docs','drop_table'][kind + 1] AS tool,
 reasons = '' AS valid, reasons,
 CASE kind WHEN 1 THEN CAST(hrs AS VARCHAR) WHEN 2 THEN 'soon' END AS hours,
 CASE WHEN kind = 3 THEN CAST(lim AS VARCHAR) WHEN kind = 0 AND reasons = '' THEN '10' END AS limit,
 CASE WHEN kind = 0 THEN th_text END AS threshold
FROM (SELECT *, CAST(CAST(th AS DOUBLE) AS VARCHAR) AS th_text FROM r)"""


REGISTERED = {
    "golden_cases": (
        golden_cases,
        """SELECT l_orderkey::VARCHAR AS set_id, concat(l_orderkey, '#', row_number() OVER (PARTITION BY l_orderkey
 ORDER BY l_linenumber, l_partkey, l_quantity::INT, l_returnflag) - 1) AS case_id, concat('part ', l_partkey) AS question, 'fleet_summary' AS tool,
 2 AS n_args, l_quantity::INT::VARCHAR AS hours, CASE WHEN l_returnflag <> 'A' THEN l_returnflag END AS region FROM lineitem"""),
    "scada_from_reports": (
        lambda s, d: as_naive(scada(s, d)),
        fleet_sql(f"""SELECT {FILE_SQL} AS file, '' AS member, CASE WHEN uid < 75 THEN uid + 3 ELSE uid + 4 END AS line_no, duid, interval_end, mw
 FROM readings WHERE {SCADA_SQL_WHERE}""")),
    "prices_from_reports": (
        lambda s, d: as_naive(prices_from_reports(s, d)),
        fleet_sql("""SELECT concat('PUBLIC_DISPATCHIS_', strftime(interval_end, '%Y%m%d%H%M'), '_0000000000000001.zip') AS file, region, interval_end, rrp
 FROM prices WHERE region <> 'ASIA' AND rrp <= 60""")),
    "dispatch_from_reports": (
        lambda s, d: as_naive(dispatch_from_reports(s, d)),
        fleet_sql("""SELECT concat('PUBLIC_NEXT_DAY_DISPATCH_', strftime(interval_end + INTERVAL 10 HOUR, '%Y%m%d'), '_1.zip') AS file, duid, interval_end,
 total_cleared, availability, uigf, semidispatch_cap FROM dispatch WHERE CAST(substr(duid, 2) AS INT) < 100""")),
    "listing_of_pages": (
        lambda s, d: reports.extract_listing(table(s, d, "pages"), "html", r'href="/[a-z]+"'),
        """SELECT DISTINCT unnest(regexp_extract_all(html, '(?i)href="/[a-z]+"')) AS name FROM pages"""),
    "listing_of_files": (
        lambda s, d: listing_files(s, d),
        fleet_sql("SELECT DISTINCT replace(file_name, 'DISPATCHSCADA', 'dispatchscada') AS name FROM ledger")),
    "file_interval": (
        lambda s, d: as_naive(file_intervals(s, d)),
        fleet_sql("SELECT file_name AS name, interval_end - INTERVAL 10 HOUR AS interval_end FROM ledger")),
    "file_date": (
        lambda s, d: as_naive(next_day_dates(s, d)),
        """SELECT CASE WHEN o_orderkey % 7 = 0 THEN concat('notes_', o_orderkey, '.zip')
 ELSE concat('PUBLIC_NEXT_DAY_DISPATCH_', strftime(o_orderdate, '%Y%m%d'), '_', o_orderkey, '.zip') END AS name,
 CASE WHEN o_orderkey % 7 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) - INTERVAL 10 HOUR END AS interval_end FROM orders"""),
    "registry_units": (registry, """
SELECT concat('D', l_orderkey, '_', l_linenumber) AS duid, concat('S', o_orderkey) AS facility_code, concat('Site ', o_orderkey) AS facility_name,
 CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS region, o_custkey / -10.0::DOUBLE AS latitude, o_custkey / 4.0::DOUBLE AS longitude,
 l_quantity / 10 AS capacity_mw
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderkey % 6 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0 AND l_returnflag <> 'R' AND l_linestatus <> 'F'
  AND l_linenumber <> 2 AND l_quantity >= 10"""),
    "hourly_weather": (lambda s, d: as_naive(hourly_weather(s, d)), """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY date_trunc('hour', ts), event_id) AS i,
                  count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS n FROM events)
SELECT concat('P', user_id) AS facility_code, date_trunc('hour', ts) - INTERVAL 30 MINUTE AS observed_at, value AS ghi_wm2, value / 2 AS temp_c,
 CASE WHEN event_id % 2 = 0 THEN value END AS cloud_cover_pct
FROM r WHERE user_id % 7 <> 0 AND (user_id % 3 <> 0 OR i < n) AND date_trunc('hour', ts) <= TIMESTAMP '2024-01-20 06:30:00'"""),
    "current_weather": (lambda s, d: as_naive(current_weather(s, d)), """
SELECT concat('C', c_custkey) AS facility_code, TIMESTAMP '2024-01-10 03:15:00' AS observed_at, c_acctbal AS ghi_wm2,
 CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal / 100 END AS temp_c, CAST(c_custkey % 100 AS DOUBLE) AS cloud_cover_pct FROM customer"""),
    "archive_dates": (
        lambda s, d: payloads.with_market_date(fleet(s, d).readings).groupBy("date").agg(F.count(F.lit(1)).alias("n")).select(F.col("date").cast("string").alias("date"), "n"),
        fleet_sql("SELECT strftime(interval_end + INTERVAL 10 HOUR, '%Y-%m-%d') AS date, count(*) AS n FROM readings GROUP BY 1")),
    "json_rows": (json_rows, """
SELECT concat('{"o_orderkey":', o_orderkey, ',"o_orderstatus":"', o_orderstatus, '","total":', CAST(o_totalprice AS DOUBLE), ',"at":"', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'),
 'Z","cust":', CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'null' END, '}') AS json FROM orders"""),
    "upsert_readings": (lambda s, d: as_naive(upsert_readings(s, d)), fleet_sql("""
SELECT coalesce(c.duid, t.duid) AS duid, coalesce(c.interval_end, t.interval_end) AS interval_end, coalesce(c.mw, t.mw) AS mw
FROM readings t
FULL JOIN (SELECT concat('U', user_id) AS duid, date_trunc('hour', ts) + to_hours(1 + user_id % 2) AS interval_end, arg_max(value + 1000, event_id) AS mw
           FROM events GROUP BY 1, 2) c ON c.duid = t.duid AND c.interval_end = t.interval_end""")),
    "weather_backfill": (lambda s, d: as_naive(weather_backfill(s, d)), fleet_sql("""
, p AS (SELECT facility_code, date_trunc('hour', observed_at) AS observed_at, max(ghi_wm2) AS ghi_wm2 FROM weather GROUP BY 1, 2),
 h AS (SELECT facility_code, date_trunc('hour', observed_at) + INTERVAL 3 HOUR AS observed_at, min(ghi_wm2) AS ghi_wm2 FROM weather GROUP BY 1, 2)
SELECT * FROM h UNION ALL SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.facility_code = p.facility_code AND h.observed_at = p.observed_at)""")),
    "known_readings": (
        lambda s, d: as_naive(known_readings(s, d)),
        fleet_sql("SELECT duid, interval_end, mw FROM readings WHERE uid % 4 <> 0")),
    "ledger_append": (lambda s, d: as_naive(ledger_append(s, d)), fleet_sql(f"""
SELECT file_name, interval_end, rows_total, rows_solar, 0::BIGINT AS ingested_at FROM ledger WHERE hour(interval_end) % 3 = 0
UNION ALL SELECT {FILE_SQL}, interval_end, 1, 1, min(uid) + 1 FROM readings WHERE hour(interval_end) % 3 <> 0 GROUP BY interval_end""")),
    "pending_files": (lambda s, d: pending(s, d), fleet_sql("""
SELECT file_name AS name FROM (SELECT *, row_number() OVER (ORDER BY file_name DESC) AS k FROM ledger) WHERE k <= 36 AND hour(interval_end) % 3 <> 0""")),
    "ingest_counts": (lambda s, d: ingest_counts(s, d), fleet_sql(f"""
SELECT {FILE_SQL} AS file, CAST(count(*) AS INTEGER) AS rows_total, CAST(count(*) FILTER (uid % 4 <> 0) AS INTEGER) AS rows_solar
FROM readings WHERE {SCADA_SQL_WHERE} AND hour(interval_end) % 3 <> 0 GROUP BY interval_end""")),
    "price_sync_counts": (lambda s, d: price_sync_counts(s, d), fleet_sql("""
SELECT concat('PUBLIC_DISPATCHIS_', strftime(interval_end, '%Y%m%d%H%M'), '_0000000000000001.zip') AS name, count(*) AS stored FROM prices
WHERE interval_end IN (SELECT DISTINCT interval_end FROM prices ORDER BY 1 DESC LIMIT 12)
  AND NOT (hour(interval_end) % 4 = 0 AND interval_end IN (SELECT interval_end FROM ledger)) GROUP BY interval_end""")),
    "split_failures": (failures, """
SELECT file, error, CAST(tried AS INTEGER) AS attempts, CASE WHEN error IS NULL THEN 'done' WHEN tried < 5 THEN 'retry' ELSE 'dead' END AS outcome
FROM (SELECT concat('file_', o_custkey) AS file, min(CASE WHEN o_orderstatus = 'P' AND o_totalprice > 450000 THEN concat('bad line ', o_orderkey) END) AS error,
             any_value(coalesce(c_custkey % 5, 0)) + CASE WHEN count(*) FILTER (o_orderstatus = 'P' AND o_totalprice > 450000) > 0 THEN 1 ELSE 0 END AS tried
      FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey)"""),
    "check_constraints": (constraints, """
SELECT 'quantity_above_25' AS rule, count(*) AS violations FROM lineitem WHERE l_quantity <= 25 OR l_quantity IS NULL
UNION ALL SELECT 'shipdate_present', count(*) FROM lineitem WHERE l_shipdate IS NULL
UNION ALL SELECT 'line_key_unique', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'order_key_unique', count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'line_has_order', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')
UNION ALL SELECT 'order_has_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'customers_loaded', CASE WHEN (SELECT count(*) FROM customer) = 0 THEN 1 ELSE 0 END"""),
    "prune_counts": (prune_counts, fleet_sql(f"""
SELECT 'readings' AS "table", count(*) FILTER (interval_end < {NOW_SQL} - INTERVAL 20 DAY) AS deleted FROM readings
UNION ALL SELECT 'weather', count(*) FILTER (observed_at < {NOW_SQL} - INTERVAL 20 DAY) FROM weather
UNION ALL SELECT 'prices', count(*) FILTER (interval_end < {NOW_SQL} - INTERVAL 20 DAY) FROM prices
UNION ALL SELECT 'dispatch', count(*) FILTER (interval_end < {NOW_SQL} - INTERVAL 20 DAY) FROM dispatch
UNION ALL SELECT 'ledger', count(*) FILTER (interval_end < {NOW_SQL} - INTERVAL 20 DAY) FROM ledger""")),
    "pruned_ledger": (
        lambda s, d: as_naive(pruned_ledger(s, d)),
        fleet_sql(f"""SELECT file_name, interval_end, rows_total, rows_solar, strftime(interval_end + INTERVAL 10 HOUR, '%Y-%m-%d') AS date,
 printf('%012d', hour(interval_end) // 6) AS batch FROM ledger WHERE interval_end >= {NOW_SQL} - INTERVAL 20 DAY""")),
    "pruned_store": (pruned_store, fleet_sql(", sky AS (SELECT DISTINCT facility_code, observed_at FROM weather)" + " UNION ALL ".join(
        f"""SELECT '{name}' AS "table", count(*) FILTER ({at} < {NOW_SQL} - INTERVAL 20 DAY) AS deleted, count(*) FILTER ({at} >= {NOW_SQL} - INTERVAL 20 DAY) AS "left" FROM {view}"""
        for name, view, at in (("readings", "readings", "interval_end"), ("weather", "sky", "observed_at"), ("prices", "prices", "interval_end"),
                               ("dispatch", "dispatch", "interval_end"), ("ledger", "ledger", "interval_end"))))),
    "pruned_readings": (
        lambda s, d: as_naive(ingest.prune(fleet(s, d).readings, "interval_end", 20, instant(NOW)).select("duid", "interval_end", "mw")),
        fleet_sql(f"SELECT duid, interval_end, mw FROM readings WHERE NOT interval_end < {NOW_SQL} - INTERVAL 20 DAY")),
    "validate_calls": (validated, VALIDATED_SQL),
}
