"""Session settings and the shared working folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings every operator relies on. Sizes and partition counts are left
# to the cluster: AQE coalesces, splits skewed join partitions and picks broadcasts
# from measured sizes.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int = 8, app: str = "heliofleet", **extra: str) -> SparkSession:
    """A single-JVM session for tests and the bench; ``extra`` holds further settings."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


_LOCAL: dict[str, tempfile.TemporaryDirectory] = {}


def shared_base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which the cluster points at shared storage.

    Only a local master may fall back to a machine-local folder: one per application, removed at its end.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder first")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.TemporaryDirectory(prefix="heliofleet-", ignore_cleanup_errors=True)
    return _LOCAL[app].name


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written tables and stream checkpoints."""
    return os.path.join(shared_base(spark), f"{purpose}-{uuid.uuid4().hex}")


@contextlib.contextmanager
def joined_as_dealt(spark: SparkSession):
    """Within: two sides dealt by one of their join keys are joined as they lie, not dealt again by all of
    them. For plans that deal evenly by themselves; what is planned inside must also run inside."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextlib.contextmanager
def dealt_in(spark: SparkSession, parts: int):
    """Within: shuffles have at least ``parts`` partitions, for data that is known to need as many."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(int(before), parts)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged(df, purpose: str):
    """The same rows, written once to the shared folder and read back: later steps that use them
    several times neither recompute them nor carry their plan, and a lost executor rereads files."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
