"""Contiguous shards of nearly equal bytes, by global prefix sums from per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from heliofleet.llm.tables import staged


def shard_by_bytes(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    Rows are put in order of id by range partitions. Each partition's bytes and rows are totalled,
    the totals' running sums (one row per partition) give every partition its start, and a row whose
    middle byte lies in the k-th of ``shards`` equal stretches goes to shard k. So shards differ by
    at most the size of a document. ``size`` is the UTF-8 bytes of the text plus 1 (null: 1),
    ``text_crc32`` that of the text (null: 0), ``slot`` the gapless place in the shard; the law is
    ``bytes`` and ``grown_shard`` is null. Rows without an id come first; ties and repeated rows are
    ordered by checksum, then by place in the input. An empty table gives no rows; with fewer rows
    than shards some shards stay empty.
    """
    sizes = staged(docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie")), "sizes")
    order = ["doc_id", "text_crc32", "tie"]
    ranged = staged(sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")

    # one row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    starts = totals.select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(everything).alias("total"))

    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (ranged.withColumn("upto", F.sum("size").over(inside)).withColumn("nth", F.count("*").over(inside))
              .join(starts, "part")
              .withColumn("twice", 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size"))
              .withColumn("shard", F.expr(f"cast(twice * {int(shards)} div (2 * total) as int)"))
              .withColumn("row", F.col("rows_before") + F.col("nth") - 1))
    placed = staged(placed.select("doc_id", "size", "text_crc32", "shard", "row"), "placed")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row per shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
