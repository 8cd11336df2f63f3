import datetime as dt

import pytest
from pyspark.sql import functions as F

from heliofleet import fixed, schemas
from heliofleet import schemas
from heliofleet.functions.columns import nem_date
from heliofleet.operators import ingest, quality
from heliofleet.sources import payloads, reports
from heliofleet.streaming import ingest as stream
from helpers import AT, STAMP, UNITS, archive, files, rows, scada_lines, section

SCADA = "PUBLIC_DISPATCHSCADA_202603121200_0000000000000001.zip"
NEXT = "PUBLIC_DISPATCHSCADA_202603121205_0000000000000002.zip"


def parse(spark, named, table=fixed.SCADA_TABLE):
    return reports.report_records(reports.zipped_report_rows(files(spark, named), (table,)), table)


def units(spark):
    return spark.createDataFrame(UNITS, schemas.UNITS)


def test_scada_rows(spark):
    lines = scada_lines([(STAMP, " HAZLSF1 ", 40.5), (STAMP, "BOILER3", 500), ("bad date", "HAZLSF2", 1), (STAMP, "HAZLSF2", "n/a")],
                        ["I,DISPATCH,OTHER,1,DUID", "D,DISPATCH,OTHER,1,X", "D,DISPATCH"])
    got = reports.scada_readings(parse(spark, {SCADA: archive(lines)}))
    assert rows(got, "duid", "interval_end", "mw") == [("BOILER3", AT, 500.0), ("HAZLSF1", AT, 40.5)]


def test_rows_before_a_header_and_second_headers(spark):
    lines = [f'D,DISPATCH,UNIT_SCADA,1,"{STAMP}",EARLY,1', "I,DISPATCH,UNIT_SCADA,1,SETTLEMENTDATE,DUID,SCADAVALUE",
             f'D,DISPATCH,UNIT_SCADA,1,"{STAMP}",A,2', "I,DISPATCH,UNIT_SCADA,1,DUID,SCADAVALUE,SETTLEMENTDATE",
             f'D,DISPATCH,UNIT_SCADA,1,B,3,"{STAMP}",more', 'D,DISPATCH,UNIT_SCADA,1,C']
    got = reports.scada_readings(parse(spark, {SCADA: archive(lines, "lower.csv")}))
    assert rows(got, "duid", "mw") == [("A", 2.0), ("B", 3.0)]


def test_text_form_gives_the_same_rows(spark, tmp_path):
    lines = scada_lines([(STAMP, f"U{i}", i) for i in range(50)])
    (tmp_path / "one.csv").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # several blocks of one file
    try:
        got = reports.scada_readings(reports.report_records(reports.read_text_reports(spark, str(tmp_path)), fixed.SCADA_TABLE))
        assert rows(got, "duid", "mw") == rows(reports.scada_readings(parse(spark, {SCADA: archive(lines)})), "duid", "mw")
        order = [r["duid"] for r in got.orderBy("line_no").collect()]
        assert order == [f"U{i}" for i in range(50)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")


def price_lines(price, intervention="0", stamp=STAMP):
    return [*section("PRICE,5", "SETTLEMENTDATE RUNNO REGIONID DISPATCHINTERVAL INTERVENTION RRP", (stamp, 1, " VIC1 ", 1, intervention, price)),
            *section("CONSTRAINT,2", "SETTLEMENTDATE CONSTRAINTID RHS", (STAMP, "LINE_7", 310.5))]


def test_prices(spark):
    named = {"a.zip": archive(price_lines(-40.5)), "b.zip": archive(price_lines(10, "1")), "c.zip": archive(price_lines(""))}
    got = reports.region_prices(parse(spark, named, fixed.PRICE_TABLE))
    assert rows(got, "file", "region", "interval_end", "rrp") == [("a.zip", "VIC1", AT, -40.5)]
    broken = parse(spark, {"d.zip": archive(price_lines(1, stamp="soon"))}, fixed.PRICE_TABLE)
    with pytest.raises(Exception, match="bad settlement date"):
        reports.region_prices(broken).collect()
    assert reports.region_prices(broken, "report").first()["error"] == "bad settlement date in d.zip"


def test_unit_dispatch(spark):
    lines = section(
        "UNIT_SOLUTION,5", "SETTLEMENTDATE DUID INTERVENTION INITIALMW UIGF AVAILABILITY SEMIDISPATCHCAP TOTALCLEARED",
        (STAMP, "HAZLSF1", 0, 31, 74.25, 71.5, 1, 33.75), (STAMP, "HAZLSF2", 0, 6, None, None, 0, 6.5),
        (STAMP, "BRKNSF1", 0, 12, 15, 15, 1, None), (STAMP, "HYDRO9", 0, 88, None, 120, 0, 91))
    got = reports.unit_dispatch(parse(spark, {"n.zip": archive(lines)}, fixed.UNIT_SOLUTION_TABLE), units(spark))
    assert rows(got, "duid", "total_cleared", "availability", "uigf", "semidispatch_cap") == [
        ("HAZLSF1", 33.75, 71.5, 74.25, True), ("HAZLSF2", 6.5, None, None, False)]


def test_listing_and_names(spark):
    html = spark.createDataFrame([(f'<a href="/x/{NEXT}">{NEXT}</a><a href="{SCADA}">', ), (f"{SCADA} other.zip",)], "html string")
    assert [r["name"] for r in reports.extract_listing(html, "html", fixed.SCADA_FILE).collect()] == [SCADA, NEXT]
    names = spark.createDataFrame([(SCADA,)], "name string")
    assert reports.file_interval(names, fixed.SCADA_FILE).first()["interval_end"] == AT
    with pytest.raises(Exception, match="not a report file name"):
        reports.file_interval(spark.createDataFrame([("x" + SCADA,)], "name string"), fixed.SCADA_FILE).collect()


def test_registry(spark):
    payload = """{"data":[
      {"code":"F1","name":"One","network_id":"NEM","location":{"lat":-33,"lng":147},"units":[
        {"code":"A","fueltech_id":"solar_utility","status_id":"operating","capacity_registered":50},
        {"code":"B","fueltech_id":"wind","status_id":"operating","capacity_registered":50},
        {"code":"C","fueltech_id":"solar_utility","status_id":"retired","capacity_registered":50},
        {"code":"D","fueltech_id":"solar_utility","status_id":"operating"}]},
      {"code":"F2","name":"Two","network_id":"WEM","network_region":"WEM","location":{"lat":1,"lng":2},"units":[{"code":"E","fueltech_id":"solar_utility","status_id":"operating","capacity_registered":9}]},
      {"code":"F3","name":"Three","network_id":"NEM","network_region":"SA1","units":[{"code":"G","fueltech_id":"solar_utility","status_id":"operating","capacity_registered":9}]}]}"""
    got = payloads.flatten_registry(spark.createDataFrame([(payload,)], "payload string"))
    assert rows(got) == [("A", "F1", "One", "", -33.0, 147.0, 50.0)]


def test_weather_payloads(spark):
    body = '{"hourly":{"time":["2026-09-25T01:00","2026-09-25T02:00","2026-09-25T03:00"],"shortwave_radiation":[1,null,3],"temperature_2m":[4,5,6],"cloud_cover":[7,8,9]}}'
    got = payloads.flatten_hourly_weather(spark.createDataFrame([("F", body), ("G", '{"hourly":{"time":["2026-09-25T01:00"]}}')], "facility_code string, payload string"),
                                          F.lit(dt.datetime(2026, 9, 25, 2, 30)))
    assert rows(got, "observed_at", "ghi_wm2") == [(dt.datetime(2026, 9, 25, 0, 30), 1.0), (dt.datetime(2026, 9, 25, 1, 30), None)]
    one = '{"current":{"time":"2026-09-25T02:15","shortwave_radiation":812,"temperature_2m":21.5}}'
    sites = spark.createDataFrame([(1, 0, "F"), (2, 0, "G"), (2, 1, "H")], "request_id int, position int, facility_code string")
    pages = spark.createDataFrame([(1, one), (2, f"[{one},{one}]")], "request_id int, payload string")
    assert [r[0] for r in rows(payloads.flatten_current_weather(pages, sites), "facility_code")] == ["F", "G", "H"]
    with pytest.raises(Exception, match="expected 2 results, got 1"):
        payloads.flatten_current_weather(spark.createDataFrame([(1, one), (2, one)], "request_id int, payload string"), sites).collect()


def test_upsert_last_wins_and_repeats_change_nothing(spark):
    target = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "duid string, t int, mw double")
    batch = spark.createDataFrame([("b", 1, 3.0, 1), ("b", 1, 4.0, 2), ("c", 1, None, 3)], "duid string, t int, mw double, seq int")
    once = ingest.upsert(target, batch, ["duid", "t"], ["seq"])
    twice = ingest.upsert(once, batch.repartition(3), ["duid", "t"], ["seq"])
    assert rows(once) == rows(twice) == [("a", 1, 1.0), ("b", 1, 4.0), ("c", 1, None)]


def test_pending_takes_the_newest_before_excluding(spark):
    listing = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "name string")
    done = spark.createDataFrame([("f1",)], "file_name string")
    assert [r[0] for r in ingest.pending_files(listing, done, 3).collect()] == ["f2", "f3"]
    assert [r[0] for r in ingest.pending_files(listing, done, 1).collect()] == ["f3"]
    assert ingest.pending_files(listing, listing.select(F.col("name").alias("file_name")), 3).count() == 0


def test_failures_retry_then_die(spark):
    results = spark.createDataFrame([("a", None), ("a", "boom"), ("b", None), ("c", "boom")], "file string, error string")
    tried = spark.createDataFrame([("a", 3), ("c", 4)], "file string, attempts int")
    assert rows(ingest.split_failures(results, tried), "file", "attempts", "outcome") == [("a", 4, "retry"), ("b", 0, "done"), ("c", 5, "dead")]


def test_stream_ingest_of_archives(spark, tmp_path):
    source, store = tmp_path / "in", stream.Store(str(tmp_path / "store"))
    source.mkdir()
    four = [(STAMP, "HAZLSF1", 40.0), (STAMP, "HAZLSF2", 20.0), (STAMP, "BRKNSF1", 150.0), (STAMP, "BOILER3", 500.0)]
    (source / SCADA).write_bytes(archive(scada_lines(four)))
    (source / NEXT).write_bytes(b"not a zip")
    (source / NEXT.replace("1205", "1210")).write_bytes(archive(["I,DISPATCH,OTHER,1,DUID"]))
    (source / "odd.zip").write_bytes(archive(scada_lines(four)))

    def run():
        stream.start_zip_ingest(spark, str(source), units(spark), store, trigger={"availableNow": True}).awaitTermination()

    run()
    want = [("BRKNSF1", AT, 150.0), ("HAZLSF1", AT, 40.0), ("HAZLSF2", AT, 20.0)]
    assert rows(spark.read.parquet(store.readings), "duid", "interval_end", "mw") == want
    assert rows(stream.ledger(spark, store), "file_name", "interval_end", "rows_total", "rows_solar") == [
        (SCADA, AT, 4, 3), (NEXT.replace("1205", "1210"), AT + dt.timedelta(minutes=10), 0, 0)]
    assert [(r["file"], r["attempts"], r["outcome"]) for r in stream.outcomes(spark, store).orderBy("file").collect()] == [
        (NEXT, 1, "retry"), ("odd.zip", 1, "retry")]
    # The same batch again, under its own and under another id: nothing changes.
    again = reports.zipped_report_rows(files(spark, {SCADA: archive(scada_lines([(STAMP, "HAZLSF1", 99.0)]))}), (fixed.SCADA_TABLE,))
    stream.ingest_batch(again, "later", units(spark), store)
    assert rows(spark.read.parquet(store.readings), "duid", "interval_end", "mw") == want and stream.ledger(spark, store).count() == 2
    # The broken file is published again in good shape and a retry takes it.
    (source / NEXT).write_bytes(archive(scada_lines([("2026/03/12 12:05:00", "HAZLSF1", 41.0)])))
    stream.retry_failed(spark, str(source), units(spark), store, "1")
    assert spark.read.parquet(store.readings).count() == 4
    assert {r["file"]: r["outcome"] for r in stream.outcomes(spark, store).collect()} == {NEXT: "done", "odd.zip": "retry"}
    ingest.prune_table(spark, store.readings, 1, AT + dt.timedelta(days=1, minutes=5))
    assert rows(spark.read.parquet(store.readings), "duid", "mw") == [("HAZLSF1", 41.0)]


def test_retention_of_every_table(spark, tmp_path):
    store = stream.Store(str(tmp_path / "store"))
    now = AT + dt.timedelta(days=10)
    cut = now - dt.timedelta(days=3)
    times = [cut - dt.timedelta(days=4), cut - dt.timedelta(microseconds=1), cut, cut + dt.timedelta(days=1), cut - dt.timedelta(hours=1)]
    def dated(df, column):
        return df.withColumn("date", nem_date(F.col(column)))
    dated(spark.createDataFrame([("U", t, 1.0) for t in times], schemas.READINGS), "interval_end").write.partitionBy("date").parquet(store.readings)
    stream.store_weather(spark.createDataFrame([("F", t, 1.0, None, None) for t in times], schemas.WEATHER), store)
    dated(spark.createDataFrame([("VIC1", t, 1.0) for t in times[:2]], schemas.PRICES), "interval_end").write.partitionBy("date").parquet(store.table(stream.PRICES))
    entries = spark.createDataFrame([(f"f{i}", t, 1, 1, t) for i, t in enumerate(times)], schemas.LEDGER)
    dated(entries, "interval_end").withColumn("batch", F.substring("file_name", 2, 1)).write.partitionBy("date", "batch").parquet(store.ledger)
    for again in (True, False):
        assert rows(stream.prune_store(spark, store, 3, now)) == sorted([
            ("readings", 3 * again), ("weather", 3 * again), ("prices", 2 * again), ("dispatch", 0), ("ledger", 3 * again)])
        assert rows(spark.read.parquet(store.readings), "interval_end") == [(cut,), (cut + dt.timedelta(days=1),)]
        assert rows(spark.read.parquet(store.weather), "observed_at") == [(cut,), (cut + dt.timedelta(days=1),)]
        assert rows(stream.ledger(spark, store), "file_name", "batch") == [("f2", "2"), ("f3", "3")]
        assert spark.read.parquet(store.table(stream.PRICES)).count() == 0
    stream.store_weather(spark.createDataFrame([("F", cut, 5.0, None, None)], schemas.WEATHER), store)
    assert rows(spark.read.parquet(store.weather), "ghi_wm2") == [(1.0,), (5.0,)]


def test_price_reports_are_followed_as_a_stream(spark, tmp_path):
    source, store = tmp_path / "in", stream.Store(str(tmp_path / "store"))
    source.mkdir()
    for i in range(2):
        (source / f"PUBLIC_DISPATCHIS_20260312120{i}_000000000000000{i}.zip").write_bytes(archive(price_lines(-40.5 + i)))
    query = stream.start_zip_ingest(spark, str(source), units(spark), store, max_files=1, trigger={"availableNow": True}, kind=stream.PRICES)
    query.awaitTermination()
    assert rows(spark.read.parquet(store.table(stream.PRICES)), "region", "rrp") == [("VIC1", -39.5)]
    assert [b for _, b in rows(stream.ledger(spark, store), "file_name", "batch")] == ["prices-000000000000", "prices-000000000001"]


def test_price_and_dispatch_sync(spark, tmp_path):
    source, store = tmp_path / "in", stream.Store(str(tmp_path / "store"))
    source.mkdir()
    names = [f"PUBLIC_DISPATCHIS_20260312120{i}_000000000000000{i}.zip" for i in range(3)]
    for i, name in enumerate(names):
        (source / name).write_bytes(archive(price_lines(-40.5 + i, stamp=STAMP if i != 1 else "soon")))
    listing = spark.createDataFrame([(n,) for n in names], "name string")
    got = stream.sync_files(spark, str(source), listing, units(spark).limit(0), store, "1", stream.PRICES)
    assert rows(got) == [(names[0], 1), (names[2], 1)]
    assert rows(spark.read.parquet(store.table(stream.PRICES)), "region", "interval_end", "rrp") == [("VIC1", AT, -38.5)]  # last file wins
    assert rows(stream.outcomes(spark, store), "file", "error", "outcome") == [(names[1], f"bad settlement date in {names[1]}", "retry")]
    day = "PUBLIC_NEXT_DAY_DISPATCH_20260312_0000000000000003.zip"
    (source / day).write_bytes(archive([
        "I,DISPATCH,UNIT_SOLUTION,5,SETTLEMENTDATE,DUID,INTERVENTION,TOTALCLEARED,AVAILABILITY,SEMIDISPATCHCAP,UIGF",
        f'D,DISPATCH,UNIT_SOLUTION,5,"{STAMP}",BRKNSF1,0,50,200,1,200', f'D,DISPATCH,UNIT_SOLUTION,5,"{STAMP}",BOILER3,0,500,500,0,']))
    days = spark.createDataFrame([(day,)], "name string")
    for again in ("1", "2"):
        loaded = stream.sync_files(spark, str(source), days, units(spark), store, again, stream.NEXT_DAY)
        assert rows(loaded) == ([(day, 1)] if again == "1" else [])
    assert spark.read.parquet(store.table(stream.NEXT_DAY)).count() == 1
    with pytest.raises(RuntimeError, match="registry is empty"):
        stream.sync_files(spark, str(source), days, units(spark).limit(0), stream.Store(str(tmp_path / "other")), "1", stream.NEXT_DAY)


def test_empty_registry_is_refused(spark, tmp_path):
    empty = reports.zipped_report_rows(files(spark, {SCADA: archive(scada_lines([]))}), (fixed.SCADA_TABLE,))
    with pytest.raises(RuntimeError, match="registry is empty"):
        stream.ingest_batch(empty, "0", units(spark).limit(0), stream.Store(str(tmp_path)))


def test_registry_sync(spark):
    fetched = units(spark).where("duid = 'HAZLSF1'").drop("updated_at").withColumn("capacity_mw", F.lit(101.0))
    got = ingest.sync_registry(units(spark), fetched, AT)
    assert rows(got, "duid", "capacity_mw", "updated_at") == [("BRKNSF1", 250.0, None), ("HAZLSF1", 101.0, AT), ("HAZLSF2", 40.0, None)]
    with pytest.raises(RuntimeError, match="no units"):
        ingest.sync_registry(units(spark), fetched.limit(0), AT)


def test_archive_uses_market_dates(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.datetime(2026, 9, 25, 13, 55)), ("b", dt.datetime(2026, 9, 25, 14, 0))], "duid string, interval_end timestamp")
    payloads.archive_by_date(df, str(tmp_path / "raw"))
    assert sorted(p.name for p in (tmp_path / "raw").iterdir() if p.name.startswith("date")) == ["date=2026-09-25", "date=2026-09-26"]


def test_validate_calls(spark):
    calls = spark.createDataFrame([
        (1, "underperformers", {}), (2, "underperformers", {"threshold": "0.01"}), (3, "fleet_summary", {"hours": "24", "region": None}),
        (4, "fleet_summary", {"region": "NZ"}), (5, "nope", None), (6, "facility_performance", None), (7, "search_docs", {"query": "ab"}),
        (8, "curtailed_farms", {"limit": "2.5"}), (9, "find_facilities", {"hours": "3"})], "call_id int, tool string, args map<string,string>")
    got = {r["call_id"]: r for r in quality.validate_calls(calls, quality.argument_rules(spark)).collect()}
    assert [k for k, r in got.items() if r["valid"]] == [1, 3]
    assert got[1]["args"] == {"threshold": "0.6", "limit": "10", "region": None}
    assert got[5]["reasons"] == ["unknown tool"] and got[9]["reasons"] == ["unknown argument hours"]


def test_require_unique(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "id string")
    assert quality.require_unique(df.distinct(), "id").count() == 2
    with pytest.raises(Exception, match="duplicate id: a"):
        quality.require_unique(df, "id").collect()
