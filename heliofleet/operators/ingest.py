"""Idempotent ingest: last-wins upsert, ledger, pending files, failures, retention."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from heliofleet import fixed
from heliofleet.functions.columns import instant


EMPTIED_AT_ONCE = 8  # partitions that retention empties side by side


def latest_per_key(batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``. A map-side combined aggregate, so a key that holds
    a large share of the batch collapses before the shuffle. All columns follow the same order
    column by column, hence the same row; with one numeric order it is a hash aggregate."""
    values = [c for c in batch.columns if c not in keys]
    if not values:
        return batch.distinct()
    sequence = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return batch.groupBy(*keys).agg(*[F.max_by(v, sequence).alias(v) for v in values])


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Target with the batch written over it. ``order`` columns say which batch row came last and
    are dropped if the target has no such column. The target itself is neither shuffled nor sorted
    when the batch is small enough to broadcast."""
    fresh = latest_per_key(batch, keys, order).select(*target.columns)
    return target.join(fresh.select(*keys), list(keys), "left_anti").select(*target.columns).unionByName(fresh)


def upsert_table(
    spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], order: Sequence[str], partition: str = "date"
) -> None:
    """Upsert a batch into a Parquet table, rewriting only the partitions it touches.

    Dynamic partition overwrite stages its files and swaps them at commit, so a lost executor or
    a repeated batch leaves the same table.
    """
    columns = [f.name for f in batch.schema.fields if f.name not in order or f.name in keys]
    fresh = latest_per_key(batch, keys, order).select(*columns)
    # The dates a batch touches are few (days of the calendar). Listing them turns the read of the
    # target into a static partition filter; no other date is opened.
    touched = [row[0] for row in batch.select(partition).distinct().toLocalIterator()]
    kept = table_or_empty(spark, path, fresh.schema).where(F.col(partition).isin(touched))
    out = kept.join(fresh.select(*keys), list(keys), "left_anti").select(*columns).unionByName(fresh)
    (out.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition).parquet(path))


def table_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table, or no rows of its schema where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def keep_known(readings: DataFrame, units: DataFrame) -> DataFrame:
    return readings.join(units.select("duid"), "duid", "left_semi")


def append_if_absent(ledger: DataFrame, rows: DataFrame, key: str = "file_name", order: str = "ingested_at") -> DataFrame:
    """Ledger plus the rows whose key is new; of several new ones the first written stays."""
    values = [c for c in ledger.columns if c != key]
    first = (
        rows.groupBy(key).agg(F.min_by(F.struct(*values), order).alias("_row"))
        .select(key, *[F.col(f"_row.{v}").alias(v) for v in values])
    )
    return ledger.unionByName(first.join(ledger.select(key), key, "left_anti").select(*ledger.columns))


def pending_files(listing: DataFrame, ledger: DataFrame, max_files: int = fixed.MAX_SCADA_FILES) -> DataFrame:
    """The newest ``max_files`` names that are not in the ledger, oldest first. The cut comes
    before the exclusion."""
    recent = listing.select("name").distinct().orderBy(F.desc("name")).limit(max_files)
    done = ledger.select(F.col("file_name").alias("name"))
    return recent.join(done, "name", "left_anti").orderBy("name")


def require_units(units: DataFrame) -> None:
    """Refuse to ingest against an empty registry: every reading would be dropped silently."""
    if units.isEmpty():
        raise RuntimeError("the unit registry is empty: load it before ingesting")


def sync_registry(units: DataFrame, fetched: DataFrame, now: datetime) -> DataFrame:
    """The registry with freshly fetched units written over it and stamped. An empty fetch is
    refused: it means the source failed, not that every farm closed."""
    if fetched.isEmpty():
        raise RuntimeError("the registry source returned no units")
    stamped = fetched.withColumn("updated_at", instant(now)).withColumn("_seq", F.lit(0))
    return upsert(units, stamped, ["duid"], ["_seq"])


def ingest_counts(readings: DataFrame, units: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per new file: rows parsed and rows of known units. Files in the ledger are skipped."""
    new = readings.join(ledger.select(F.col("file_name").alias("file")), "file", "left_anti")
    known = units.select("duid", F.lit(True).alias("_known"))
    return new.join(known, "duid", "left").groupBy("file").agg(
        F.count(F.lit(1)).cast("int").alias("rows_total"),
        F.count_if("_known").cast("int").alias("rows_solar"))


def split_failures(
    results: DataFrame, attempts: DataFrame, max_attempts: int = fixed.MAX_INGEST_ATTEMPTS
) -> DataFrame:
    """Outcome per file of one batch. ``results`` holds (file, error), several rows per file
    allowed; ``attempts`` holds (file, attempts) so far. A failed file is retried until it has
    failed ``max_attempts`` times; the others are done."""
    per_file = results.groupBy("file").agg(F.min("error").alias("error"))
    tried = F.coalesce("attempts", F.lit(0)) + F.col("error").isNotNull().cast("int")
    outcome = (
        F.when(F.col("error").isNull(), "done")
        .when(tried < max_attempts, "retry")
        .otherwise("dead")
    )
    return per_file.join(attempts, "file", "left").select(
        "file", "error", tried.cast("int").alias("attempts"), outcome.alias("outcome"))


def prune(df: DataFrame, time: str, days: int, now: Column) -> DataFrame:
    """Rows that stay: not strictly older than ``days`` before now."""
    return df.where(F.col(time) >= now - F.make_dt_interval(days=F.lit(days)))


def prune_counts(tables: dict[str, tuple[DataFrame, str]], days: int, now: Column) -> DataFrame:
    """Rows each table would lose: one row per table."""
    counts = [
        df.agg(F.count_if(F.col(time) < now - F.make_dt_interval(days=F.lit(days))).alias("deleted"))
        .select(F.lit(name).alias("table"), "deleted")
        for name, (df, time) in tables.items()
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def prune_table(
    spark: SparkSession, path: str, days: int, now: datetime, time: str = "interval_end", schema=None, leaf: Sequence[str] = ("date",),
) -> int:
    """Apply retention to a table laid out by market date (``leaf``: its partition columns, the date first) and
    say how many rows went.

    The cut date is rewritten with the rows it keeps, older partitions are overwritten with none, newer dates are
    not read. Each partition is replaced by one commit of its own and emptying is final, so a run that dies half-way
    is finished by the next; a partition emptied before has no rows and is not touched again.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    cut = instant(now) - F.make_dt_interval(days=F.lit(days))
    market_day = F.to_date(F.from_utc_timestamp(cut, fixed.NEM_OFFSET))
    old = reader.parquet(path).where(F.col("date") <= market_day)
    keep = old.where((F.col("date") == market_day) & (F.col(time) >= cut))
    deleted = old.where(F.col(time) < cut).count()
    if not deleted:
        return 0
    # Partitions older than the cut: calendar dates and what is laid out below them.
    emptied = [row.asDict() for row in old.select(*leaf).distinct().join(keep.select(*leaf).distinct(), list(leaf), "left_anti").toLocalIterator()]
    keep.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*leaf).parquet(path)
    nothing = spark.createDataFrame([], old.drop(*leaf).schema)

    def empty(part: dict) -> None:
        nothing.coalesce(1).write.mode("overwrite").parquet("/".join([path, *[f"{c}={part[c]}" for c in leaf]]))
    with ThreadPoolExecutor(EMPTIED_AT_ONCE) as pool:  # small jobs of their own
        list(pool.map(empty, emptied))
    return deleted
