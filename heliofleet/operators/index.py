"""The keyword index: block postings in buckets of terms, stored under the version of its corpus.

Postings are kept as blocks: one row per (term, range of chunks) with the entries of that range, its
highest count and its shortest chunk. Blocks and terms are laid out by a hash bucket of the term, so a
search opens only its own buckets, and inside a bucket they are sorted by term. Ranges are hashes of the
chunk id and hold about ``RANGE_CHUNKS`` chunks, which bounds a block whatever its term.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from heliofleet import fixed
from heliofleet.functions.columns import scalar
from heliofleet.functions.text import kept_words, stem
from heliofleet.operators.chunking import corpus_fingerprint

RANGE_CHUNKS = 256
BUCKET_CHUNKS, MOST_BUCKETS = 50_000, 4096  # chunks per bucket of terms; folders of one index
DEAL_BYTES = 8 << 20  # text whose terms one task counts
PART_BYTES = 16 << 20  # text whose blocks one task sorts and writes, on average
TOP = fixed.CANDIDATES


@dataclass(frozen=True)
class Index:
    """blocks (bucket, term, range, top_tf, least_len, entries), terms (bucket, term, df, idf, kth: the weight
    of its ``TOP``-th best chunk, 0 if it has fewer), stats (chunks, avg_len)."""

    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame
    buckets: int

    def bucket_of(self, term: Column) -> Column:
        return bucket_of(term, self.buckets)

    def postings(self) -> DataFrame:
        """One row per (term, chunk): term, id, pos, tf, len."""
        return self.blocks.select("term", F.explode("entries").alias("e")).select("term", "e.id", "e.pos", "e.tf", "e.len")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def range_of(id_: Column, ranges: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(ranges)).cast("int")


def postings(chunks: DataFrame, ranges: int = 1, deals: int | None = None) -> DataFrame:
    """Term counts of chunks (id, pos, title, section, text); headings count twice. A chunk's
    length rides along, so no second pass gathers it. The texts are spread by range of chunks before they
    are taken apart, in ``deals`` parts of bounded size (by chunk without): that one shuffle of compact rows
    evens out uneven files, and neither the counts per (chunk, term) nor the blocks of a range need an exchange."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("section", F.lit("")),
                       F.coalesce("section", F.lit("")), "text")
    rows = chunks.select("id", "pos", text.alias("_text"), range_of(F.col("id"), ranges).alias("range"))
    dealt = rows.repartition("id") if deals is None else rows.repartition(deals, "range")
    return (
        dealt.select("id", "pos", "range", kept_words(F.col("_text")).alias("_words"))
        .select("id", "pos", "range", F.size("_words").alias("len"), F.explode("_words").alias("_word"))
        .select("id", "pos", "range", "len", stem(F.col("_word")).alias("term"))
        .groupBy("range", "term", "id", "pos")
        .agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))
    )


def weight(tf: Column, length: Column, avg_len: Column, k1: float, b: float) -> Column:
    """What a term found ``tf`` times adds to a chunk's score, before idf."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_len))


ENTRY = ("id", "pos", "tf", "len")


def _blocks(chunks: DataFrame, buckets: int, ranges: int, deals: int) -> DataFrame:
    """Blocks with one array per field of their entries."""
    rows = postings(chunks, ranges, deals)
    held = rows.groupBy("term", "range").agg(
        F.max("tf").alias("top_tf"), F.min("len").alias("least_len"), F.collect_list(F.struct(*ENTRY)).alias("entries"))
    return held.select("term", "range", "top_tf", "least_len", *[F.col(f"entries.{c}").alias(f"_{c}") for c in ENTRY],
                       bucket_of(F.col("term"), buckets).alias("bucket"))


def _with_entries(blocks: DataFrame) -> DataFrame:
    entries = F.arrays_zip(*[F.col(f"_{c}").alias(c) for c in ENTRY])
    return blocks.select("term", "range", "top_tf", "least_len", entries.alias("entries"), "bucket")


def _as_lists(batches):
    """Blocks of a batch as one row per term: the ranges and sizes of its blocks, and their entries end to end."""
    for batch in batches:
        coded = batch.column("term").dictionary_encode()
        code = coded.indices.to_numpy()
        batch = batch.take(pa.array(np.argsort(code, kind="stable")))
        ends = np.append(0, np.cumsum(np.bincount(code, minlength=len(coded.dictionary))))
        starts = batch.column("_id").offsets.to_numpy()
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary, batch.column("bucket").take(pa.array(ends[:-1])),
             *[pa.ListArray.from_arrays(ends.astype("int32"), lists) for lists in (batch.column("range"), pa.array(np.diff(starts)))],
             *[pa.ListArray.from_arrays(starts[ends], batch.column(f"_{c}").flatten()) for c in ENTRY]],
            names=["term", "bucket", "ranges", "sizes", *[f"_{c}" for c in ENTRY]])


def _as_blocks(batches):
    """The blocks of rows as ``_as_lists`` makes them, with their heads."""
    for batch in batches:
        ranges, sizes = batch.column("ranges"), batch.column("sizes").flatten().to_numpy()
        row = pa.array(np.repeat(np.arange(len(batch)), np.diff(ranges.offsets.to_numpy())))
        starts = np.append(0, np.cumsum(sizes)).astype("int32")
        id_, pos, tf, length = (batch.column(f"_{c}").flatten() for c in ENTRY)
        tf = tf.cast("int64")
        entries = pa.ListArray.from_arrays(starts, pa.StructArray.from_arrays([id_, pos, tf, length], names=ENTRY))
        yield pa.RecordBatch.from_arrays(
            [batch.column("term").take(row), ranges.flatten(), pa.array(np.maximum.reduceat(tf.to_numpy(), starts[:-1])),
             pa.array(np.minimum.reduceat(length.to_numpy(), starts[:-1])), entries, batch.column("bucket").take(row)],
            names=["term", "range", "top_tf", "least_len", "entries", "bucket"])


def _joined_by_term(blocks: DataFrame) -> DataFrame:
    """One row per term of a task's blocks, the form in which they are dealt by bucket: a row per block would mostly
    be its term and the heads of its arrays."""
    kinds = {c: blocks.schema[f"_{c}"].dataType.simpleString() for c in ENTRY} | {"tf": "array<int>"}
    rows = blocks.select("term", "bucket", "range", *[F.col(f"_{c}").cast(kinds[c]).alias(f"_{c}") for c in ENTRY])
    return rows.sortWithinPartitions("term").mapInArrow(
        _as_lists, "term string, bucket int, ranges array<int>, sizes array<int>, " + ", ".join(f"_{c} {kinds[c]}" for c in ENTRY))


def _taken_apart(rows: DataFrame) -> DataFrame:
    id_, pos = (rows.schema[f"_{c}"].dataType.elementType.simpleString() for c in ("id", "pos"))
    return rows.mapInArrow(_as_blocks, "term string, range int, top_tf bigint, least_len int, "
                           f"entries array<struct<id: {id_}, pos: {pos}, tf: bigint, len: int>>, bucket int")


def _best_here(batches):
    """How many weights each term has within a batch of blocks (bucket, term, weights), and the ``TOP`` greatest."""
    for batch in batches:
        weights = batch.column("weights")
        coded = batch.column("term").dictionary_encode()
        _, first = np.unique(coded.indices.to_numpy(), return_index=True)
        flat = weights.flatten().to_numpy(zero_copy_only=False)
        code = np.repeat(coded.indices.to_numpy(), np.diff(weights.offsets.to_numpy()))
        order = np.lexsort((-flat, code))
        code, flat = code[order], flat[order]
        kept = np.arange(len(code)) - np.searchsorted(code, code) < TOP
        n = np.bincount(code, minlength=len(first))
        best = pa.ListArray.from_arrays(np.append(0, np.cumsum(np.minimum(n, TOP))).astype("int32"), pa.array(flat[kept]))
        yield pa.RecordBatch.from_arrays([batch.column("bucket").take(pa.array(first)), coded.dictionary, pa.array(n), best],
                                         names=["bucket", "term", "n", "best"])


def _terms(blocks: DataFrame, chunks: Column, avg_len: Column) -> DataFrame:
    """Stored blocks of a term lie together, so most of its weights drop out inside a batch and only their number and
    the few best are dealt by term, once."""
    one = blocks.withColumn("_avg", avg_len).select("bucket", "term", F.transform("entries", lambda e: weight(
        e["tf"], e["len"], F.col("_avg"), fixed.BM25_K1, fixed.BM25_B)).alias("weights")).mapInArrow(
        _best_here, "bucket int, term string, n bigint, best array<double>")
    df = F.col("df")
    return one.groupBy("bucket", "term").agg(
        F.sum("n").alias("df"), F.sort_array(F.flatten(F.collect_list("best")), asc=False).alias("_best")).select(
        "term", "bucket", "df", F.log(1 + (chunks - df + 0.5) / (df + 0.5)).alias("idf"),
        F.coalesce(F.try_element_at("_best", F.lit(TOP)), F.lit(0.0)).alias("kth"))


def _stats(blocks: DataFrame, n: int) -> DataFrame:
    total = F.coalesce(F.sum(F.aggregate("entries", F.lit(0).cast("bigint"), lambda sum_, e: sum_ + e["tf"])), F.lit(0))
    return blocks.agg(total.alias("total")).select(
        F.lit(n).cast("bigint").alias("chunks"), (F.col("total") / F.lit(max(n, 1))).alias("avg_len"))


def build_index(chunks: DataFrame, path: str | None = None) -> Index:
    """A keyword index of chunks (id, pos, title, section, text), written to ``path`` and read back if one is given."""
    n, size = chunks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = max(16, min(MOST_BUCKETS, -(-n // BUCKET_CHUNKS)))
    blocks = _blocks(chunks, buckets, max(1, -(-n // RANGE_CHUNKS)), max(1, -(-size // DEAL_BYTES)))
    if path is None:
        blocks = _with_entries(blocks)
        stats = _stats(blocks, n)
        return Index(blocks, _terms(blocks, F.lit(n), scalar(stats.select("avg_len"))), stats, buckets)
    spark = chunks.sparkSession

    def write(df: DataFrame, part: str) -> DataFrame:
        (df.sortWithinPartitions("bucket", "term")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{part}"))
        return spark.read.schema(df.schema).parquet(f"{path}/{part}")

    # Parts of a bucket follow the bytes of the texts, not those of the shuffle, so a sort stays in memory.
    parts = max(1, -(-size // (buckets * PART_BYTES)))
    part = F.col("bucket") * parts + F.pmod(F.col("ranges")[0], F.lit(parts))
    blocks = write(_taken_apart(_joined_by_term(blocks).repartitionById(buckets * parts, part)), "blocks")
    stats = _stats(blocks, n)
    terms = write(_terms(blocks, F.lit(n), F.lit(stats.first()["avg_len"])).hint("rebalance", "bucket"), "terms")
    facts = stats.select("chunks", "avg_len", F.lit(buckets).alias("buckets"), F.lit(blocks.schema.json()).alias("blocks"),
                                     F.lit(terms.schema.json()).alias("terms"), F.lit(path).alias("path"))
    facts.coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")  # last: an index with facts is whole
    return load_index(spark, f"{path}/facts")


FACTS = "chunks long, avg_len double, buckets int, blocks string, terms string, path string"


def load_index(spark: SparkSession, facts_path: str) -> Index | None:
    """A written index, or None where there is none. Its facts are one row; blocks and terms are opened
    with the schemas kept there."""
    try:
        facts = spark.read.schema(FACTS).parquet(facts_path).first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if facts is None:
        return None
    blocks, terms = (spark.read.schema(T.StructType.fromJson(json.loads(facts[part]))).parquet(f"{facts['path']}/{part}") for part in ("blocks", "terms"))
    stats = spark.createDataFrame([(facts["chunks"], facts["avg_len"])], "chunks long, avg_len double")
    return Index(blocks, terms, stats, facts["buckets"])


def files_version(table: DataFrame) -> str:
    """A name for the files a table is read from: their paths, sizes, times and rows, without reading a column."""
    m = F.col("_metadata")
    file = F.xxhash64(m["file_path"], m["file_size"], m["file_modification_time"])
    row = table.agg(F.count(F.lit(1)).alias("n"), F.sum(file.cast("decimal(38,0)")).alias("h")).first()
    return f"{row['n']}-{int(row['h'] or 0) % (1 << 64):016x}"


def stored_index(chunks: DataFrame, base: str, version: str | None = None) -> Index:
    """The index of this version of a corpus under ``base``; it is built if it is not there.

    The version is the corpus fingerprint, or a cheaper name that changes with the corpus, such as
    ``files_version`` of the table it is read from. An index is written to a folder of its own and published
    by a last small write, so a build that dies or runs beside another is never read half-written.
    """
    spark = chunks.sparkSession
    path = os.path.join(base, f"keyword-index-k{TOP}-r{RANGE_CHUNKS}-{version or corpus_fingerprint(chunks).first()['fingerprint']}")
    found = load_index(spark, f"{path}/published")
    if found is None:
        build = f"{path}/build-{uuid.uuid4().hex}"
        found = build_index(chunks, build)
        spark.read.schema(FACTS).parquet(f"{build}/facts").coalesce(1).write.mode("ignore").parquet(f"{path}/published")
    return found
