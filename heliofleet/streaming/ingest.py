"""Continuous report ingest: file stream -> parse -> idempotent tables.

Every table a batch writes is keyed by the batch id or by a dynamic partition overwrite, so a
batch that is delivered again, after a lost executor or a restart, leaves the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from heliofleet import fixed
from heliofleet.functions.columns import nem_date
from heliofleet.operators import ingest
from heliofleet.sources import reports


@dataclass(frozen=True)
class ReportKind:
    """One of the three reports: its section, file names, target table and how rows are read.

    ``read(records, units)`` gives (all parsed rows, rows to keep); a row may carry an ``error``
    that fails its file.
    """

    name: str
    section: tuple[str, str]
    files: str
    max_files: int
    keys: tuple[str, ...]
    read: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def _scada(records: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = reports.scada_readings(records)
    return rows, ingest.keep_known(rows, units)


def _prices(records: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = reports.region_prices(records, on_bad_date="report")
    return rows, rows


def _dispatch(records: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = reports.unit_dispatch(records, units, on_bad_date="report")
    return rows, rows


SCADA = ReportKind("readings", fixed.SCADA_TABLE, fixed.SCADA_FILE, fixed.MAX_SCADA_FILES, ("duid", "interval_end"), _scada)
PRICES = ReportKind("prices", fixed.PRICE_TABLE, fixed.PRICE_FILE, fixed.MAX_PRICE_FILES, ("region", "interval_end"), _prices)
NEXT_DAY = ReportKind("dispatch", fixed.UNIT_SOLUTION_TABLE, fixed.NEXT_DAY_FILE, fixed.MAX_NEXT_DAY_FILES, ("duid", "interval_end"), _dispatch)


@dataclass(frozen=True)
class Store:
    """Folders of the ingest tables under one shared root. The ledger serves all report kinds."""

    root: str

    def table(self, kind: ReportKind) -> str:
        return f"{self.root}/{kind.name}"

    def staging(self, kind: ReportKind, batch: str) -> str:
        return f"{self.root}/staging/{kind.name}/{batch}"

    @property
    def readings(self) -> str:
        return self.table(SCADA)

    @property
    def weather(self) -> str:
        return f"{self.root}/weather"

    @property
    def ledger(self) -> str:
        return f"{self.root}/ledger"

    @property
    def failures(self) -> str:
        return f"{self.root}/failures"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"


LEDGER_SCHEMA = "file_name string, interval_end timestamp, rows_total int, rows_solar int, ingested_at timestamp, date date, batch string"
LEDGER_LEAF = ("date", "batch")  # by market date, so retention and look-ups read few folders; by batch, so a repeated one replaces itself
FAILURE_SCHEMA = "file string, error string, batch string"


def ledger(spark: SparkSession, store: Store) -> DataFrame:
    return ingest.table_or_empty(spark, store.ledger, LEDGER_SCHEMA)


def failures(spark: SparkSession, store: Store) -> DataFrame:
    return ingest.table_or_empty(spark, store.failures, FAILURE_SCHEMA)


def outcomes(spark: SparkSession, store: Store, max_attempts: int = fixed.MAX_INGEST_ATTEMPTS) -> DataFrame:
    """Failed files and what happens to them: ``done`` after all, ``retry`` or ``dead``."""
    tried = failures(spark, store).groupBy("file").agg(
        F.count_distinct("batch").cast("int").alias("attempts"), F.max_by("error", "batch").alias("error"))
    done = ledger(spark, store).select(F.col("file_name").alias("file"), F.lit(True).alias("_done")).distinct()
    state = F.when(F.col("_done"), "done").when(F.col("attempts") < max_attempts, "retry").otherwise("dead")
    return tried.join(done, "file", "left").select("file", "attempts", "error", state.alias("outcome"))


def ingest_batch(rows: DataFrame, batch: str, units: DataFrame, store: Store, kind: ReportKind = SCADA) -> None:
    """One batch of report rows (see ``ROWS_SCHEMA``) into the kind's table, ledger and failures.

    A file with an error is reported alone; the other files of the batch commit. Files in the
    ledger under another batch are skipped.
    """
    spark = rows.sparkSession
    if kind is not PRICES:
        ingest.require_units(units)
    # Parsed once, then read back by every step below.
    staging = store.staging(kind, batch)  # a batch's own: a retry may run beside a stream
    rows.write.mode("overwrite").parquet(staging)
    staged = spark.read.schema(rows.schema).parquet(staging)
    parsed, kept = kind.read(reports.report_records(staged, kind.section), units)

    broken = staged.where("error is not null").select("file", "error")
    if "error" in parsed.columns:
        broken = broken.unionByName(parsed.where("error is not null").select("file", "error"))
    named = reports.file_interval(staged.select("file").distinct(), kind.files, "file", on_bad_name="null")
    misnamed = named.where("interval_end is null").select("file", F.lit("not a report file name").alias("error"))
    failed = broken.unionByName(misnamed).groupBy("file").agg(F.min("error").alias("error"))
    before = ledger(spark, store).where(F.col("batch") != batch).select(F.col("file_name").alias("file"))
    good = named.join(failed, "file", "left_anti").join(before, "file", "left_anti")

    new = kept.join(good.select("file"), "file", "left_semi").drop("error")
    ingest.upsert_table(
        spark, store.table(kind), new.withColumn("date", nem_date(F.col("interval_end"))),
        [*kind.keys, "date"], ["file", "member", "line_no"])

    def per_file(df, name):
        return df.groupBy("file").agg(F.count(F.lit(1)).cast("int").alias(name))
    entry = (
        good.join(per_file(parsed, "rows_total"), "file", "left").join(per_file(kept, "rows_solar"), "file", "left")
        .select(F.col("file").alias("file_name"), "interval_end", F.coalesce("rows_total", F.lit(0)).alias("rows_total"),
                F.coalesce("rows_solar", F.lit(0)).alias("rows_solar"), F.current_timestamp().alias("ingested_at"),
                nem_date(F.col("interval_end")).alias("date"), F.lit(batch).alias("batch")))
    for out, path, layout in ((entry, store.ledger, LEDGER_LEAF), (failed.withColumn("batch", F.lit(batch)), store.failures, ("batch",))):
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*layout).parquet(path))
    spark.createDataFrame([], rows.schema).coalesce(1).write.mode("overwrite").parquet(staging)  # read no more


def store_weather(rows: DataFrame, store: Store, order: str | None = None) -> None:
    """Observations (facility_code, observed_at, ...) written over the store's weather: a poll or a backfill. Of
    several rows of a key the last by ``order`` stays."""
    if order is None:
        rows, order = rows.withColumn("_seq", F.lit(0)), "_seq"
    ingest.upsert_table(
        rows.sparkSession, store.weather, rows.withColumn("date", nem_date(F.col("observed_at"))), ["facility_code", "observed_at", "date"], [order])


def prune_store(spark: SparkSession, store: Store, days: int, now: datetime) -> DataFrame:
    """Retention of all five tables: (table, deleted). A table that was never written loses nothing."""
    tables = [
        ("readings", store.readings, "interval_end", None, ("date",)), ("weather", store.weather, "observed_at", None, ("date",)),
        ("prices", store.table(PRICES), "interval_end", None, ("date",)), ("dispatch", store.table(NEXT_DAY), "interval_end", None, ("date",)),
        ("ledger", store.ledger, "interval_end", LEDGER_SCHEMA, LEDGER_LEAF)]
    counts = []
    for name, path, time, schema, leaf in tables:
        there = not ingest.table_or_empty(spark, path, "date date").isEmpty()
        counts.append((name, ingest.prune_table(spark, path, days, now, time, schema, leaf) if there else 0))
    return spark.createDataFrame(counts, "table string, deleted long")


def sync_files(
    spark: SparkSession, source: str, listing: DataFrame, units: DataFrame, store: Store, batch: str, kind: ReportKind
) -> DataFrame:
    """Load the newest listed files (name) of a kind that the ledger lacks; rows stored per file.

    At most ``kind.max_files`` names, a fixed small number, pass through the driver.
    """
    todo = ingest.pending_files(listing, ledger(spark, store), kind.max_files)
    names = [row["name"] for row in todo.toLocalIterator()]
    label = f"{kind.name}-{batch}"
    if names:
        files = spark.read.format("binaryFile").load([f"{source}/{name}" for name in names])
        ingest_batch(reports.zipped_report_rows(files, (kind.section,)), label, units, store, kind)
    return ledger(spark, store).where(F.col("batch") == label).select(F.col("file_name").alias("file"), F.col("rows_solar").alias("stored"))


def start_zip_ingest(
    spark: SparkSession, source: str, units: DataFrame, store: Store,
    max_files: int | None = None, trigger: dict | None = None, kind: ReportKind = SCADA,
) -> StreamingQuery:
    """Follow a folder of zipped reports of a kind, at most ``max_files`` (the kind's own number) per batch."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.[zZ][iI][pP]").option("maxFilesPerTrigger", max_files or kind.max_files).load(source))
    return _start(reports.zipped_report_rows(files, (kind.section,)), units, store, trigger, kind)


def start_text_ingest(
    spark: SparkSession, source: str, units: DataFrame, store: Store,
    max_files: int | None = None, trigger: dict | None = None, kind: ReportKind = SCADA,
) -> StreamingQuery:
    """Follow a folder of plain reports of a kind laid out as ``report=<file name>/``."""
    lines = spark.readStream.schema("value string, report string").option("maxFilesPerTrigger", max_files or kind.max_files).text(source)
    return _start(reports.text_report_lines(lines, F.col("report")), units, store, trigger, kind, reports.numbered_rows)


def _start(stream: DataFrame, units: DataFrame, store: Store, trigger: dict | None, kind: ReportKind, to_rows=lambda df: df) -> StreamingQuery:
    # Readings keep the plain numbers and folder that a running stream has; other kinds get their own.
    label, checkpoint = ("", store.checkpoint) if kind is SCADA else (f"{kind.name}-", f"{store.checkpoint}-{kind.name}")

    def each(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(to_rows(batch), f"{label}{batch_id:012d}", units, store, kind)

    return (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "15 minutes"})).start())


def retry_failed(
    spark: SparkSession, source: str, units: DataFrame, store: Store, batch: str, max_files: int = fixed.MAX_SCADA_FILES
) -> None:
    """Read files again that failed fewer than five times; at most one batch of names."""
    todo = outcomes(spark, store).where("outcome = 'retry'").orderBy("file").limit(max_files)
    names = [row["file"] for row in todo.select("file").toLocalIterator()]
    if names:
        files = spark.read.format("binaryFile").load([f"{source}/{name}" for name in names])
        ingest_batch(reports.zipped_report_rows(files, (SCADA.section,)), f"retry-{batch}", units, store)


def first_sightings(readings: DataFrame, delay: str = "1 day", keys: tuple[str, ...] = ("duid", "interval_end"), time: str = "interval_end") -> DataFrame:
    """Stream with repeats of a key suppressed within the watermark. The first sighting passes;
    corrections still reach the tables through the last-wins upsert."""
    return readings.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
