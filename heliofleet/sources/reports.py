"""Sectioned market reports: zipped or plain text, C/I/D rows, one header row per table."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from heliofleet import fixed
from heliofleet.functions.columns import nem_to_utc

ROWS_SCHEMA = "file string, member string, line_no bigint, fields array<string>, error string"
_ROWS_PER_BATCH = 20_000


def _unzip(tables: tuple[tuple[str, str], ...]):
    """Stream the wanted tables' rows out of each archive; a broken archive is one error row."""

    def rows(content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for member in archive.namelist():
                if not member.upper().endswith(".CSV"):
                    continue
                with archive.open(member) as raw:
                    text = io.TextIOWrapper(raw, encoding="utf-8", errors="replace", newline="")
                    for line_no, fields in enumerate(csv.reader(text)):
                        if len(fields) >= 3 and (fields[1], fields[2]) in tables:
                            yield member, line_no, fields

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                name = path.rsplit("/", 1)[-1]
                # A file without wanted rows still shows up, to be recorded as read.
                held: list[tuple] = [(name, None, -1, [], None)]
                try:
                    for member, line_no, fields in rows(content):
                        held.append((name, member, line_no, fields, None))
                        if len(held) >= _ROWS_PER_BATCH:
                            yield pd.DataFrame(held, columns=["file", "member", "line_no", "fields", "error"])
                            held = []
                except (zipfile.BadZipFile, csv.Error, EOFError, OSError) as exc:
                    held.append((name, None, -1, [], f"{type(exc).__name__}: {exc}"))
                if held:
                    yield pd.DataFrame(held, columns=["file", "member", "line_no", "fields", "error"])

    return read


def zipped_report_rows(files: DataFrame, tables: tuple[tuple[str, str], ...]) -> DataFrame:
    """Rows of the wanted tables from a ``binaryFile`` frame (path, content)."""
    return files.select("path", "content").mapInPandas(_unzip(tuple(tables)), ROWS_SCHEMA)


def read_zipped_reports(spark: SparkSession, path: str, tables: tuple[tuple[str, str], ...]) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[zZ][iI][pP]").load(path)
    return zipped_report_rows(files, tables)


def split_fields(line: Column) -> Column:
    """Fields of one comma-separated line; quoted fields keep commas, doubled quotes are one."""
    pieces = F.regexp_extract_all(line, F.lit(r'(?:^|,)(?:"(?:[^"]|"")*"|[^,]*)'), F.lit(0))

    def clean(piece: Column, index: Column) -> Column:
        bare = F.when(index > 0, F.substring(piece, 2, 1_000_000_000)).otherwise(piece)
        inner = F.regexp_replace(F.regexp_replace(bare, '^"|"$', ""), '""', '"')
        return F.when(bare.startswith('"'), inner).otherwise(bare)

    return F.transform(pieces, clean)


def read_text_reports(spark: SparkSession, path: str) -> DataFrame:
    """Plain-text reports. Files are splittable: a row's place is its block start and its order
    inside the block, so no task needs a whole file."""
    return numbered_rows(text_report_lines(spark.read.text(path), F.col("_metadata.file_name")))


def text_report_lines(lines: DataFrame, file: Column) -> DataFrame:
    """Lines (value) with their report and the start of the block they were read from."""
    return lines.select(file.alias("file"), "value", F.col("_metadata.file_block_start").alias("block"))


def numbered_rows(lines: DataFrame) -> DataFrame:
    """Report rows of batch lines. A task reads fewer rows than a block has bytes, so twice the
    block start plus the row's order in its task rises through a file."""
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return lines.select(
        "file",
        F.lit("").alias("member"),
        (F.col("block") * 2 + in_task).alias("line_no"),
        split_fields(F.col("value")).alias("fields"),
        F.lit(None).cast("string").alias("error"),
    )


def report_records(rows: DataFrame, table: tuple[str, str]) -> DataFrame:
    """Data rows of one table as (file, member, line_no, record), record keyed by header name.

    Header rows are few. Each covers the lines up to the next header of its file, and data rows
    meet them by an equi join on the file, so no window ever holds a file's data rows.
    """
    kind, section = F.col("fields")[0], F.array(F.lit(table[0]), F.lit(table[1]))
    wanted = rows.where((F.size("fields") >= 3) & (F.slice("fields", 2, 2) == section))
    order = Window.partitionBy("file", "member").orderBy("line_no")
    headers = wanted.where(kind == "I").select(
        "file", "member", F.col("line_no").alias("_from"),
        F.lead("line_no").over(order).alias("_to"), F.col("fields").alias("_header"))
    data = wanted.where(kind == "D").select("file", "member", "line_no", "fields")
    covered = (F.col("line_no") > F.col("_from")) & (F.col("_to").isNull() | (F.col("line_no") < F.col("_to")))
    n = F.least(F.size("_header"), F.size("fields"))
    return (
        data.join(headers, ["file", "member"]).where(covered)
        .select("file", "member", "line_no",
                F.map_from_arrays(F.slice("_header", 1, n), F.slice("fields", 1, n)).alias("record"))
    )


def _cell(name: str) -> Column:
    return F.col("record")[name]


def _stripped(cell: Column) -> Column:
    return F.btrim(cell, F.lit(" \t\r\n\f\x0b"))


def _number(name: str) -> Column:
    return _stripped(_cell(name)).try_cast("double")


def _market_run() -> Column:
    """Intervention runs are not the market outcome; a missing column counts as 0."""
    return _stripped(F.coalesce(_cell("INTERVENTION"), F.lit("0"))) == "0"


_PLACE = ("file", "member", "line_no")


def scada_readings(records: DataFrame) -> DataFrame:
    """Unit output; malformed rows are dropped."""
    return records.select(
        *_PLACE,
        _stripped(_cell("DUID")).alias("duid"),
        nem_to_utc(_stripped(_cell("SETTLEMENTDATE"))).alias("interval_end"),
        _number("SCADAVALUE").alias("mw"),
    ).dropna(subset=["duid", "interval_end", "mw"])


def _dated(df: DataFrame, on_bad_date: str) -> DataFrame:
    """A bad date fails the whole file: raise at once, or mark the row for ``split_failures``."""
    message = F.concat(F.lit("bad settlement date in "), "file")
    if on_bad_date == "fail":
        checked = F.when(F.col("interval_end").isNotNull(), F.col("interval_end")).otherwise(
            F.raise_error(message).cast("timestamp"))
        return df.withColumn("interval_end", checked)
    if on_bad_date == "report":
        return df.withColumn("error", F.when(F.col("interval_end").isNull(), message))
    raise ValueError(f"unknown on_bad_date {on_bad_date!r}")


def region_prices(records: DataFrame, on_bad_date: str = "fail") -> DataFrame:
    rows = records.where(_market_run()).select(
        *_PLACE,
        _stripped(_cell("REGIONID")).alias("region"),
        nem_to_utc(_stripped(_cell("SETTLEMENTDATE"))).alias("interval_end"),
        _number("RRP").alias("rrp"),
    ).where("rrp is not null")
    return _dated(rows, on_bad_date)


def unit_dispatch(records: DataFrame, units: DataFrame, on_bad_date: str = "fail") -> DataFrame:
    """Dispatch outcome of known units. Target required; availability and forecast may be absent."""
    rows = records.where(_market_run()).select(
        *_PLACE,
        _stripped(_cell("DUID")).alias("duid"),
        nem_to_utc(_stripped(_cell("SETTLEMENTDATE"))).alias("interval_end"),
        _number("TOTALCLEARED").alias("total_cleared"),
        _number("AVAILABILITY").alias("availability"),
        _number("UIGF").alias("uigf"),
        F.coalesce(_stripped(_cell("SEMIDISPATCHCAP")) == "1", F.lit(False)).alias("semidispatch_cap"),
    ).where("total_cleared is not null")
    return _dated(rows.join(units.select("duid"), "duid", "left_semi"), on_bad_date)


# ---------- listings and file names ----------

def extract_listing(pages: DataFrame, text: str, pattern: str) -> DataFrame:
    """Every match of a pattern in listing text, case-insensitive, de-duplicated and sorted."""
    matches = F.regexp_extract_all(F.col(text), F.lit("(?i)" + pattern), F.lit(0))
    return pages.select(F.explode(F.array_distinct(matches)).alias("name")).distinct().orderBy("name")


def file_interval(names: DataFrame, pattern: str, name: str = "name", on_bad_name: str = "fail") -> DataFrame:
    """UTC timestamp of the market time (12 digits) or date (8 digits) in a file name."""
    stamp = F.regexp_extract(F.col(name), r"(?i)\A(?:" + pattern + r")\z", 1)
    at = F.to_utc_timestamp(
        F.try_to_timestamp(F.rpad(stamp, 12, "0"), F.lit("yyyyMMddHHmm")), fixed.NEM_OFFSET)
    if on_bad_name == "fail":
        at = F.when(stamp == "", F.raise_error(F.concat(F.lit("not a report file name: "), name)).cast("timestamp")).otherwise(at)
    else:
        at = F.when(stamp != "", at)
    return names.withColumn("interval_end", at)
