"""Hard negatives by a secondary-sort shuffle.

Scores of (anchor, row) pairs travel as packed keys (anchor, descending score, positives first, id).
``repartitionAndSortWithinPartitions`` sends an anchor's keys to one partition and sorts them there, on
disk where needed; an iterator then runs over the keys, opens a window at each positive and emits
negatives while windows are open. It holds five positives and the negatives of one score, never an anchor.

Before the shuffle, blocks of anchors meet blocks of rows, one task per pair of blocks, and only keys
that can matter leave a task: the block's best positives of each anchor, then, with an anchor's overall
positives known, the block's best negatives of each window. What no block sends could not have been emitted.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from heliofleet.llm.tables import keyed, parts_for, staged

SCALE, RELABEL, LABELS, EVERY = 256, 7, 10, 100
POSITIVES, NEGATIVES, PERCENT = 5, 5, 80
ANCHOR_BLOCK, ROW_BLOCK, SLICE = 1024, 8192, 128
LONG = (1 << 63) - 1
KEY = struct.Struct(">QQQBQQ")  # anchor id, anchor row, descending score, negative or not, id, row
_SIGN = 1 << 63


def _parse(batches):
    """Whole numbers of each vector; null where a row takes no part."""
    for batch in batches:
        out = []
        for values in batch.column("embedding").to_pylist():
            x = np.array(values, np.float64) if values is not None and None not in values else np.array([np.nan])
            with np.errstate(over="ignore"):
                scaled = np.floor(SCALE * x)
            if not np.isfinite(x).all():
                out.append(None)
            elif (np.abs(scaled) < _SIGN).all():
                out.append(scaled.astype(np.int64).tobytes())
            else:  # beyond 64 bits: digits as text, of a length that no row of 64-bit numbers has
                text = b",".join(b"%d" % (int(v) if np.isfinite(v) else int(u) * SCALE) for v, u in zip(scaled, x))
                out.append(text + b" " * ((1 - len(text)) % 8))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()) if c == "ints" else batch.column(c) for c in ("row", "id", "label", "dim", "ints")],
                                         names=["row", "id", "label", "dim", "ints"])


def _whole(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """A matrix of whole numbers: 64-bit, or Python's where one does not fit."""
    data = column.to_pylist()
    if not any(len(v) % 8 for v in data):
        return np.frombuffer(b"".join(data), np.int64).reshape(len(data), dim)
    return np.array([[int(n) for n in (v.split(b",") if len(v) % 8 else np.frombuffer(v, np.int64))] for v in data], object).reshape(len(data), dim)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact whole inner products of all pairs of rows, as 64-bit numbers; what lies beyond is held at the ends."""
    if a.shape[1] == 0:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a.astype(object) if a.dtype == object else a.astype(np.float64)).max()) + 1
    most *= (int(np.abs(b.astype(object) if b.dtype == object else b.astype(np.float64)).max()) + 1) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 62 and a.dtype != object and b.dtype != object:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.array([[max(-LONG, min(LONG, int(v))) for v in row] for row in exact], np.int64).reshape(exact.shape)


def _best_positives(count: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = [[], [], []]
        if anchors.num_rows and rows.num_rows:
            dim = rows.column("dim")[0].as_py()
            rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])
            x, label, row = _whole(rows.column("ints"), dim), rows.column("label").to_numpy(), rows.column("row").to_numpy()
            y, own, who = _whole(anchors.column("ints"), dim), anchors.column("label").to_numpy(), anchors.column("row").to_numpy()
            for lo in range(0, len(y), SLICE):
                scores = inner(y[lo:lo + SLICE], x)
                for i, s in enumerate(scores, lo):
                    same = np.flatnonzero((label == own[i]) & (row != who[i]))
                    best = same[np.argsort(-s[same], kind="stable")[:count]]
                    out[0] += [who[i]] * len(best)
                    out[1] += best.tolist()
                    out[2] += s[best].tolist()
            at = pa.array(out[1], pa.int64())
            return pa.table({"anchor_row": pa.array(out[0], pa.int64()), "id": rows.column("id").take(at), "row": rows.column("row").take(at),
                             "score": pa.array(out[2], pa.int64())})
        return pa.table({c: pa.array([], pa.int64()) for c in ("anchor_row", "id", "row", "score")})
    return run


def _window_negatives(count: int, percent: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if anchors.num_rows and rows.num_rows:
            dim = rows.column("dim")[0].as_py()
            rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])
            x, label = _whole(rows.column("ints"), dim), rows.column("label").to_numpy()
            y, own = _whole(anchors.column("ints"), dim), anchors.column("label").to_numpy()
            who, ids, tops = anchors.column("row").to_numpy(), anchors.column("id").to_numpy(), anchors.column("tops").to_pylist()
            for lo in range(0, len(y), SLICE):
                scores = inner(y[lo:lo + SLICE], x)
                for i, s in enumerate(scores, lo):
                    least = -(-percent * min(tops[i]) // 100)
                    other = np.flatnonzero((label != own[i]) & (s >= least) & (s <= max(tops[i])))
                    other = other[np.argsort(-s[other], kind="stable")]
                    down, keep = -s[other], set()
                    for top in set(tops[i]):
                        start = np.searchsorted(down, -top)
                        keep.update(j for j in range(start, min(start + count, len(down))) if percent * top <= -100 * int(down[j]))
                    picked = other[sorted(keep)]
                    out[0] += [ids[i]] * len(picked)
                    out[1] += [who[i]] * len(picked)
                    out[2] += picked.tolist()
                    out[3] += s[picked].tolist()
            at = pa.array(out[2], pa.int64())
            return pa.table({"anchor_id": pa.array(out[0], pa.int64()), "anchor_row": pa.array(out[1], pa.int64()),
                             "id": rows.column("id").take(at), "row": rows.column("row").take(at), "score": pa.array(out[3], pa.int64())})
        return pa.table({c: pa.array([], pa.int64()) for c in ("anchor_id", "anchor_row", "id", "row", "score")})
    return run


def pack(anchor_id: int, anchor_row: int, score: int, negative: int, vec_id: int, row: int) -> bytes:
    """A key whose bytes sort as (anchor, descending score, positives first, id)."""
    return KEY.pack(anchor_id + _SIGN, anchor_row, _SIGN - 1 - score, negative, vec_id + _SIGN, row)


def mined(keys, positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = PERCENT):
    """Runs over sorted keys: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A positive opens a window; each negative is offered to the open windows, and a window closes when it
    is full or when scores fall below ``percent`` of its positive's. Positives sort before negatives of
    the same score, so a window also sees negatives that equal its positive.
    """
    anchor, windows, opened = None, [], 0
    for key in keys:
        a, a_row, down, negative, vec_id, _ = KEY.unpack(key)
        if (a, a_row) != anchor:
            anchor, windows, opened = (a, a_row), [], 0
        score = _SIGN - 1 - down
        if not negative:
            if opened < positives:
                opened += 1
                windows.append([vec_id - _SIGN, score, 0])
            continue
        windows = [w for w in windows if w[2] < negatives and percent * w[1] <= 100 * score]
        for window in windows:
            window[2] += 1
            yield a - _SIGN, window[0], window[2], vec_id - _SIGN, window[1], score


def hard_negatives(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Scores are whole inner products of floor(256 x). Rows whose id is divisible by 7 get the next label;
    anchors are rows whose id is divisible by 100; positives are an anchor's first 5 other rows of its
    label, negatives the first 5 rows of other labels with 80 % to 100 % of a positive's score. Higher
    scores come first, ties by smaller id. Rows without an id, label or vector, or with a null or
    non-finite component, take no part; zero vectors do. Vectors meet only those of their own width.
    Rows that repeat an id are rows of their own: each may be an anchor, positive or negative; ties
    between them are settled by their place in the table. Scores beyond 64 bits count as the greatest or
    least number of 64 bits. An empty table gives no rows. Further columns are ignored.
    """
    spark = vectors.sparkSession
    own = F.col(label).cast("long")
    rows, key = keyed(vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(embedding).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), F.when(F.col(vec_id) % RELABEL == 0, (own + 1) % LABELS).otherwise(own).alias("label"),
        F.size(embedding).alias("dim"), F.col(embedding).cast("array<double>").alias("embedding")), "negatives-rows")
    known = staged(rows.withColumnRenamed(key, "row").mapInArrow(_parse, "row long, id long, label long, dim int, ints binary").where("ints is not null"), "negatives-vectors")
    n = known.agg(F.count("*"), F.count(F.when(F.col("id") % EVERY == 0, 1))).first()
    row_blocks, anchor_blocks = parts_for(n[0], ROW_BLOCK), parts_for(n[1], ANCHOR_BLOCK)

    def blocks(df, own_block, own_count, other_block, other_count):
        return df.withColumn(own_block, F.pmod(F.xxhash64("row"), F.lit(own_count)).cast("int")).withColumn(
            other_block, F.explode(F.sequence(F.lit(0), F.lit(other_count - 1))))

    cell = ["dim", "ab", "rb"]
    anchors = known.where(F.col("id") % EVERY == 0)
    field = blocks(known, "rb", row_blocks, "ab", anchor_blocks)
    asked = blocks(anchors, "ab", anchor_blocks, "rb", row_blocks)
    near = asked.groupBy(*cell).cogroup(field.groupBy(*cell)).applyInArrow(_best_positives(POSITIVES), "anchor_row long, id long, row long, score long")
    order = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "id", "row")
    best = staged(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= POSITIVES).drop("place"), "negatives-positives")
    tops = best.groupBy(F.col("anchor_row").alias("row")).agg(F.collect_list("score").alias("tops"))  # at most five
    opened = staged(anchors.join(tops, "row"), "negatives-anchors")
    asked = blocks(opened, "ab", anchor_blocks, "rb", row_blocks)
    far = asked.groupBy(*cell).cogroup(field.groupBy(*cell)).applyInArrow(
        _window_negatives(NEGATIVES, PERCENT), "anchor_id long, anchor_row long, id long, row long, score long")
    named = best.join(opened.select(F.col("id").alias("anchor_id"), F.col("row").alias("anchor_row")), "anchor_row")
    columns = ["anchor_id", "anchor_row", "score", "negative", "id", "row"]
    pairs = staged(named.withColumn("negative", F.lit(0)).select(*columns).unionByName(far.withColumn("negative", F.lit(1)).select(*columns)), "negatives-pairs")
    parts = max(parts_for(pairs.count(), 200_000), spark.sparkContext.defaultParallelism)
    keys = pairs.rdd.map(lambda r: (pack(*r), None))
    dealt = keys.repartitionAndSortWithinPartitions(parts, lambda k: zlib.crc32(k[:16]))
    out = dealt.mapPartitions(lambda part: mined(k for k, _ in part))
    return spark.createDataFrame(out, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
