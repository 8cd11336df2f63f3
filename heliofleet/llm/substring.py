"""Substring deduplication by window matching across blocks of the corpus.

This replaces relative Lempel-Ziv parsing: there is no greedy longest match and no factor of source,
position and length. The rule removes every word of a window of ``window`` words that an earlier
document has, whichever document that is. A greedy parse cuts a text where its longest match ends, so
a window across two factors would have to be looked up by itself anyway, and those lookups alone
decide the rule.

Every slice of the corpus is indexed by the fingerprint of each of its windows with the smallest
document that has it. The slices' indexes meet by fingerprint, so each document is looked up in all
of them at once. The words of windows that start in some earlier document become spans and go.

Per block each fingerprint travels once, so a passage that a third of all documents share costs
one entry per block. Copies inside a block are settled in the block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from heliofleet.llm.tables import GROUP_BYTES, group_column, groups_of, parts_for, total_bytes
from heliofleet.llm.words import (
    blocks, bucket_of, fingerprints, gathered, grams, inside, mix, pack, split_words, unpack)

BUCKET_BYTES = 16 << 20  # text whose windows meet in one bucket
INDEX = "bucket int, keys binary, docs binary, ids binary, settled boolean"
FOUND = "grp int, ids binary, keys binary"
RESULT = ("doc_id long, n_words long, n_removed long, "
          "spans array<struct<start:long,end:long>>, kept_text string")


def _windows(texts, window):
    words = split_words(texts, lower=False)
    at = inside(words, window)
    keys = grams(fingerprints(words.vocab)[words.codes], window)[at]
    return words, at, keys


def _index_blocks(window: int, buckets: int):
    def run(batches):
        for batch in gathered(batches, "text"):
            for block in blocks(batch, "text"):
                ids = block.column("doc_id").to_numpy(zero_copy_only=False)
                words, at, keys = _windows(block.column("text"), window)
                owner = ids[words.rows[at]]
                order = np.lexsort((owner, keys))
                keys, owner = keys[order], owner[order]
                first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
                least = owner[first][np.cumsum(first) - 1] if len(keys) else owner
                out = {n: [] for n in ("bucket", "keys", "docs", "ids", "settled")}
                later = owner > least
                if later.any():  # copies inside the block
                    out["bucket"].append(int(ids[0]) % buckets)
                    out["keys"].append(pack(keys[later], sorted_=True))
                    out["docs"].append(b"")
                    out["ids"].append(pack(owner[later]))
                    out["settled"].append(True)
                keys, owner = keys[first], owner[first]
                to = bucket_of(keys, buckets)
                cuts = np.searchsorted(to, np.arange(buckets + 1))
                for b in range(buckets):
                    lo, hi = cuts[b], cuts[b + 1]
                    if lo == hi:
                        continue
                    known, local = np.unique(owner[lo:hi], return_inverse=True)
                    out["bucket"].append(b)
                    out["keys"].append(pack(keys[lo:hi], sorted_=True))
                    out["docs"].append(pack(local.astype(np.uint32)))
                    out["ids"].append(pack(known))
                    out["settled"].append(False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["bucket"], pa.int32()), *(pa.array(out[c], pa.binary()) for c in ("keys", "docs", "ids")),
                     pa.array(out["settled"], pa.bool_())], names=list(out))
    return run


def _meet(groups: int):
    def run(table: pa.Table) -> pa.Table:
        """One bucket of all blocks' indexes: windows that an earlier document has, by group of the later ones."""
        found_keys, found_ids, keys, owners = [], [], [], []
        for k, d, i, settled in zip(*(table.column(c).to_pylist() for c in ("keys", "docs", "ids", "settled"))):
            if settled:
                found_keys.append(unpack(k, np.uint64, sorted_=True))
                found_ids.append(unpack(i, np.int64))
            else:
                keys.append(unpack(k, np.uint64, sorted_=True))
                owners.append(unpack(i, np.int64)[unpack(d, np.uint32)])
        if keys:
            keys, owners = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(keys, kind="stable")
            keys, owners = keys[order], owners[order]
            heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            least = np.repeat(np.minimum.reduceat(owners, heads), np.diff(np.append(heads, len(keys))))
            found_keys.append(keys[owners > least])
            found_ids.append(owners[owners > least])
        keys, ids = np.concatenate(found_keys), np.concatenate(found_ids)
        to = groups_of(ids, groups)
        order = np.lexsort((keys, to))
        keys, ids, to = keys[order], ids[order], to[order]
        used, starts = np.unique(to, return_index=True)
        bounds = np.append(starts, len(to))
        parts = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        return pa.table({"grp": pa.array(used.astype(np.int32)), "ids": pa.array([pack(ids[lo:hi]) for lo, hi in parts], pa.binary()),
                         "keys": pa.array([pack(keys[lo:hi], sorted_=True) for lo, hi in parts], pa.binary())})
    return run


def _factor(window: int, carry: tuple):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        marks = [unpack(k, np.uint64, sorted_=True) ^ mix(unpack(i, np.int64).view(np.uint64))
                 for i, k in zip(found.column("ids").to_pylist(), found.column("keys").to_pylist())]
        marks = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.uint64)
        outs = []
        for batch in docs.combine_chunks().to_batches():
            for block in blocks(batch, "text"):
                done = _factor_block(block, marks, window)
                for name in carry:
                    done = done.append_column(name, block.column(name))
                outs.append(done)
        return pa.concat_tables(outs) if outs else _empty(docs, carry)
    return run


def _empty(docs: pa.Table, carry: tuple):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()),
                     "n_removed": pa.array([], pa.int64()), "spans": pa.array([], span),
                     "kept_text": pa.array([], pa.string()), **{c: pa.array([], docs.schema.field(c).type) for c in carry}})


def _factor_block(block: pa.RecordBatch, marks: np.ndarray, window: int) -> pa.Table:
    words, at, keys = _windows(block.column("text"), window)
    ids = pc.fill_null(block.column("doc_id"), 0).to_numpy(zero_copy_only=False)
    rows, n = words.rows, len(words.codes)
    own = keys ^ mix(ids.view(np.uint64))[rows[at]]
    place = np.searchsorted(marks, own)
    hit = np.zeros(len(own), bool)
    if len(marks):
        hit = marks[np.minimum(place, len(marks) - 1)] == own
    hit &= ~block.column("doc_id").is_null().to_numpy(zero_copy_only=False)[rows[at]] if len(at) else hit
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at[hit], 1)
    np.add.at(steps, at[hit] + window, -1)
    covered = np.cumsum(steps)[:n] > 0
    # spans: covered runs, cut at document bounds
    before = np.concatenate([[False], covered[:-1]]) if n else covered
    edge = np.zeros(n, bool)
    edge[words.starts[:-1][words.lengths > 0]] = True
    begins = np.flatnonzero(covered & (~before | edge))
    after = np.concatenate([covered[1:], [False]]) if n else covered
    last = np.zeros(n, bool)
    last[words.starts[1:][words.lengths > 0] - 1] = True
    ends = np.flatnonzero(covered & (~after | last))
    base = words.starts[rows[begins]]
    spans = pa.StructArray.from_arrays([pa.array(begins - base), pa.array(ends + 1 - base)], names=["start", "end"])
    per_row = np.searchsorted(rows[begins], np.arange(len(words.starts)))
    kept = words.flat.filter(pa.array(~covered))
    kept_starts = np.concatenate([[0], np.cumsum(~covered)])[words.starts]
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept_starts.astype(np.int32)), kept), " ")
    removed = words.lengths - np.diff(kept_starts)
    return pa.table({
        "doc_id": block.column("doc_id"), "n_words": pa.array(words.lengths), "n_removed": pa.array(removed),
        "spans": pa.ListArray.from_arrays(pa.array(per_row.astype(np.int32)), spans), "kept_text": text})


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 13,
                   carry: tuple = ()) -> DataFrame:
    """Words of every text that lie in a window which also starts in a document with a smaller id.

    One row per input row: ``doc_id, n_words, n_removed, spans`` (word positions of the removed
    runs) and ``kept_text`` (the other words, joined by one space), then the columns named in
    ``carry``; others are left out, and so may have any name.
    Null or empty texts have no words; texts under ``window`` words keep all of theirs. A row
    without an id keeps its words and is no reference. Rows that repeat an id are one document:
    they do not remove each other's words, and a window removed from one goes from all of them.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *(F.col(c).alias(f"c_{c}") for c in carry))
    size = total_bytes(rows, "text")
    buckets = parts_for(size, BUCKET_BYTES)
    groups = parts_for(size, GROUP_BYTES)
    kinds = "".join(f", `c_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    found = (rows.where("doc_id is not null and text is not null").select("doc_id", "text")
             .mapInArrow(_index_blocks(window, buckets), INDEX)
             .groupBy("bucket").applyInArrow(_meet(groups), FOUND))
    left = rows.withColumn("grp", group_column("doc_id", groups))
    cut = left.groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(
        _factor(window, tuple(f"c_{c}" for c in carry)), RESULT + kinds)
    return cut.select("doc_id", "n_words", "n_removed", "spans", "kept_text", *(F.col(f"c_{c}").alias(c) for c in carry))
