"""Words and n-gram fingerprints of Arrow text batches, and compact binary columns for them.

Words are runs without ASCII white space (``[^\\x20\\x09-\\x0D]+``). A word's fingerprint is 64 bits;
an n-gram's mixes those of its words. Everything here works on one Arrow batch inside a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

BLOCK_BYTES = 8 << 20  # text handled at once inside a task
ROW_BYTES = 2 << 20  # the same where rows are worked on one by one and a larger block saves nothing
_FACTORS = np.random.default_rng(20260101).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Words:
    """The words of a block: ``codes`` index ``vocab``; row ``i`` has codes[starts[i]:starts[i+1]]."""

    starts: np.ndarray
    codes: np.ndarray
    vocab: pa.Array
    flat: pa.Array

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)

    @property
    def rows(self) -> np.ndarray:
        """The row each word belongs to."""
        return np.repeat(np.arange(len(self.starts) - 1), self.lengths)


def blocks(batch: pa.RecordBatch, text: str, limit: int = BLOCK_BYTES):
    """Slices of a batch whose texts hold about ``limit`` bytes (a single longer text stays whole)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def gathered(batches, text: str, least: int = 2 * BLOCK_BYTES):
    """Successive batches joined until their texts hold ``least`` bytes, where larger blocks save shuffle."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(text))).as_py() or 0
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def split_words(texts: pa.Array, lower: bool) -> Words:
    """Words of each text; ``lower`` turns A-Z (only those) into a-z. A null text has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(bool)
    edges = np.concatenate([[0], np.cumsum(filled)])
    starts = edges[lists.offsets.to_numpy() - lists.offsets[0].as_py()] if len(lists) else np.zeros(1, np.int64)
    flat = flat.filter(pa.array(filled))
    coded = flat.dictionary_encode()
    return Words(starts.astype(np.int64), coded.indices.to_numpy().astype(np.int64), coded.dictionary, flat)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (a fixed bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(vocab: pa.Array) -> np.ndarray:
    """64 bits per distinct word."""
    if not len(vocab):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(vocab.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of the n words from each position on, over a flat run of word fingerprints."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, n, np.uint64)
    for j in range(n):
        out += hashes[j:j + count] * _FACTORS[j]
    return mix(out)


def inside(words: Words, n: int) -> np.ndarray:
    """Positions in the flat run at which n words of one row begin."""
    count = len(words.codes) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    ends = np.repeat(words.starts[1:], words.lengths)[:count]
    return np.flatnonzero(np.arange(count) + n <= ends)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket number that never falls as the key grows."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def pack(values: np.ndarray, sorted_: bool = False) -> bytes:
    """A compressed byte form of integers; ``sorted_`` stores differences."""
    if sorted_ and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind, sorted_: bool = False) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    values = np.ascontiguousarray(raw.reshape(width, len(raw) // width).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if sorted_ else values


def small(values: np.ndarray) -> np.ndarray:
    """Counts in the narrowest width that `unpack_small` can tell apart by a leading byte."""
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 2**8 else np.uint16 if top < 2**16 else np.uint32 if top < 2**32 else np.uint64)


def pack_small(values: np.ndarray) -> bytes:
    narrow = small(values)
    return bytes([narrow.dtype.itemsize]) + pack(narrow)


def unpack_small(data: bytes) -> np.ndarray:
    return unpack(data[1:], f"u{data[0]}").astype(np.int64)
