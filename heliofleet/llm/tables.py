"""Sizes and groups the text operators share."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from heliofleet.session import shared_dir, staged

GROUP_BYTES = 6 << 20  # text of one group of documents


def crc_mod(doc_id, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def keyed(docs: DataFrame, purpose: str, codec: str = "snappy") -> tuple[DataFrame, str]:
    """The rows with a written number that tells them apart, and that column's name. Whole texts are worth a
    denser ``codec``: the copy stays on disk as long as the run."""
    name = "row_key"
    while name in docs.columns:
        name += "_"
    rows = docs.withColumn(name, F.monotonically_increasing_id())
    path = shared_dir(docs.sparkSession, purpose)
    rows.write.option("compression", codec).parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path), name


def total_bytes(docs: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def parts_for(size: int, each: int) -> int:
    return max(1, -(-size // each))


def group_column(doc_id: str, groups: int) -> Column:
    """An even group number; rows without an id are spread too."""
    key = F.coalesce(F.col(doc_id).cast("long"), F.monotonically_increasing_id())
    return (F.crc32(key.cast("string")) % groups).cast("int")


def groups_of(ids: np.ndarray, groups: int) -> np.ndarray:
    """`group_column` of ids, inside a task."""
    known, at = np.unique(ids, return_inverse=True)
    return np.array([zlib.crc32(b"%d" % i) % groups for i in known.tolist()], np.int64)[at]


__all__ = ["GROUP_BYTES", "crc_mod", "total_bytes", "parts_for", "group_column", "groups_of", "keyed", "staged"]
