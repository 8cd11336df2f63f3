"""Packing of documents into fixed-length sequences: first-fit decreasing with a tournament tree.

Documents are cut into pieces of at most ``length`` tokens. Full pieces are sequences of their own.
The others are dealt into randomised groups of about ``GROUP_PIECES``; in each group the pieces,
longest first, go to the first sequence with room, which a tournament tree over the sequences'
free space finds in logarithmic time. Groups are independent, so their number grows with the data
and their size does not; a hot source or a group of copies spreads over all of them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from heliofleet.llm.tables import parts_for, staged
from heliofleet.llm.tokens import token_ids
from heliofleet.llm.words import ROW_BYTES, blocks

GROUP_PIECES = 8192
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cut(path: str, length: int, end_id: int, with_ids: bool):
    def run(batches):
        for batch in batches:
            for block in blocks(batch, "text", ROW_BYTES):
                ids, starts = token_ids(block.column("text"), path)
                out = {name: [] for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
                for doc, lo, hi in zip(block.column("doc_id").to_pylist(), starts[:-1].tolist(), starts[1:].tolist()):
                    own = np.append(ids[lo:hi], np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(own), length):
                        piece = own[at:at + length]
                        out["doc_id"].append(doc)
                        out["start"].append(at)
                        out["length"].append(len(piece))
                        out["ids_crc32"].append(zlib.crc32(piece.tobytes()))
                        out["doc_tokens"].append(len(own))
                        if with_ids:
                            out["ids"].append(piece.astype(np.int32))
                columns = [pa.array(out[n], pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array(out["ids"], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def first_fit(sizes, capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size, taken in the given order; each goes to the first bin with room."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    room = [capacity] * (2 * leaves)  # room[k]: the most free space below node k
    bins, offsets = [], []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins.append(node - leaves)
        offsets.append(capacity - room[node])
        room[node] -= size
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit(table.column("length").to_pylist(), capacity)
        group = table.column("grp")[0].as_py()
        at = table.column_names.index("grp")
        return (table.remove_column(at)
                .append_column("sequence_id", pa.array([(group << 32) + b for b in bins], pa.int64()))
                .append_column("offset", pa.array(offsets, pa.int64())))
    return run


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, doc_id: str = "doc_id",
                   text: str = "text", with_ids: bool = False, seed: int = 11) -> DataFrame:
    """Pieces of all documents with their place in a sequence of at most ``length`` tokens.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, with ``with_ids``,
    the piece's ``ids``. Every document ends with ``end_id``, so null and empty texts give one piece
    of one token. Rows without an id and rows that repeat one are packed like others. Sequence ids
    are unique, not gapless: the group's number in the high half, the sequence in the low one.
    Pieces within a sequence lie at offsets 0, then end to end. An empty table gives no rows.
    """
    shape = PIECES + (", ids array<int>" if with_ids else "")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pieces = staged(rows.mapInArrow(_cut(tokenizer, length, end_id, with_ids), shape), "pieces")
    groups = parts_for(pieces.count(), GROUP_PIECES)
    group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups))
    packed = pieces.withColumn("grp", group).groupBy("grp").applyInArrow(
        _pack(length), shape + ", sequence_id long, offset long")
    return packed
