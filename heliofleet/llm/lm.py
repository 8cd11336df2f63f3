"""Language-model scores by deleted interpolation of word bigrams.

    p(w | v) = l(v) * c(v, w) / c(v) + (1 - l(v)) * p(w)
    p(w)     = m * c(w) / N + (1 - m) / (V + 1)

``l`` depends on the bucket of the context's count (powers of two). The weights ``l`` and ``m`` are
learned by expectation-maximisation on held-out counts: one training document in ten is set apart,
the others give the counts, and the events of those set apart enter the EM. The final counts use
all training documents. A sentence starts with a start mark, whose count is that of the documents,
and ends with one end token, which is scored too.

The corpus is held as blocks of word numbers. Each block asks for the counts of its distinct words
and bigrams, the questions of all blocks meet by fingerprint (64 bits), are added up and answered in
the order asked. So frequent words cost one entry per block, and no table of n-grams is held whole
anywhere. Held-out events reach the driver as a histogram over bounded bins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from heliofleet.llm.memory import release
from heliofleet.llm.tables import crc_mod, parts_for, staged
from heliofleet.llm.words import (
    BLOCK_BYTES, blocks, bucket_of, fingerprints, gathered, mix, pack, pack_small, small, split_words, unpack, unpack_small)

BUCKET_TOKENS = 2_000_000
SLICE_KEYS = 250_000  # keys of a bucket that are added up at once
HELD_PARTS = 10  # one training document in so many is set apart for the weights
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
ROUNDS = 60
BLOCK = "block string, held int, n_tokens long, ids binary, trained binary, lengths binary, codes binary, vocab binary"
ASK = "bucket int, block string, held int, keys binary, counts binary"
ANSWER = "block string, bucket int, main binary, apart binary, tokens_main long, tokens long, types_main long, types long"
EVENTS = "level int, context int, x int, y int, n long"
SCORED = "doc_id long, row long, n_tokens long, n_known long, base_score double, score double"


def _blocks(batches):
    """Documents as numbers of a block's own words; documents set apart form blocks of their own."""
    for batch in gathered(batches, "text"):
        for held in (0, 1):
            some = batch.filter(pa.compute.equal(batch.column("held"), held))
            for block in blocks(some, "text"):
                words = split_words(block.column("text"), lower=True)
                ids, rows = block.column("doc_id").to_numpy(), block.column("row").to_numpy()
                yield pa.RecordBatch.from_arrays([
                    pa.array([f"{held}-{rows[0]}"]), pa.array([held], pa.int32()),
                    pa.array([len(words.codes) + len(ids)]),
                    pa.array([pack(np.concatenate([ids, rows]))]),
                    pa.array([pack(block.column("train").to_numpy(zero_copy_only=False).astype(np.uint8))]),
                    pa.array([pack_small(words.lengths)]), pa.array([pack_small(words.codes)]),
                    pa.array([pack(fingerprints(words.vocab))])], names=[f.split()[0] for f in BLOCK.split(", ")])
                del words
                release()


class _Block:
    """Tokens, bigrams and their sorted keys, as one block row holds them."""

    def __init__(self, row: dict):
        both = unpack(row["ids"], np.int64)
        self.ids, self.rows = both[:len(both) // 2], both[len(both) // 2:]
        lengths = unpack_small(row["lengths"])
        codes = unpack_small(row["codes"])
        vocab = unpack(row["vocab"], np.uint64)
        size = len(vocab)
        self.hashes = np.concatenate([vocab, [END, START]])
        self.lengths = lengths + 1
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        now = np.full(self.starts[-1], size, np.int64)  # ends
        now[np.arange(len(codes)) + np.repeat(np.arange(len(lengths)), lengths)] = codes
        before = np.concatenate([[size + 1], now[:-1]])
        before[self.starts[:-1]] = size + 1
        self.now, self.before = now, before
        self.doc = np.repeat(np.arange(len(lengths)), self.lengths)
        self.train = unpack(row["trained"], np.uint8).astype(bool)[self.doc]
        pairs, self.pair = np.unique(before * (size + 2) + now, return_inverse=True)
        first, second = self.hashes[pairs // (size + 2)], self.hashes[pairs % (size + 2)]
        single = mix(self.hashes[:-1])
        double = mix(first * np.uint64(3) + mix(second ^ np.uint64(5)))
        keys = np.concatenate([single, double])
        order = np.argsort(keys)
        self.keys = keys[order]
        self.place = np.empty(len(keys), np.int64)
        self.place[order] = np.arange(len(keys))
        self.size = size

    def counts(self) -> np.ndarray:
        word = np.bincount(self.now[self.train], minlength=self.size + 1)
        pair = np.bincount(self.pair[self.train], minlength=len(self.keys) - self.size - 1)
        out = np.empty(len(self.keys), np.int64)
        out[self.place] = np.concatenate([word, pair])
        return out

    def single(self) -> np.ndarray:
        """Which sorted keys are words."""
        out = np.zeros(len(self.keys), bool)
        out[self.place[:self.size + 1]] = True
        return out

    def spread(self, answered: np.ndarray):
        """Counts of word, context and bigram at each token."""
        word = answered[self.place[:self.size + 1]]
        context = np.append(word, word[self.size])  # the start mark is as frequent as the end
        return word[self.now], context[self.before], answered[self.place[self.size + 1:]][self.pair]


def _ask(buckets: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row)
                counts, single = block.counts() * 2 + block.single(), bucket_of(block.keys, buckets)
                cuts = np.searchsorted(single, np.arange(buckets + 1))
                used = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(used, pa.int32()), pa.array([row["block"]] * len(used)), pa.array([row["held"]] * len(used), pa.int32()),
                    pa.array([pack(block.keys[cuts[b]:cuts[b + 1]], sorted_=True) for b in used], pa.binary()),
                    pa.array([pack_small(counts[cuts[b]:cuts[b + 1]]) for b in used], pa.binary())],
                    names=["bucket", "block", "held", "keys", "counts"])
                del block, counts, single
                release()
    return run


def _added(keys: list, counts: list, held: np.ndarray):
    """Counts of a run of sorted keys, added up over all blocks: per block those of the main and the set-apart
    documents in its own order, and the four totals."""
    every, flags = np.concatenate(keys), np.concatenate(counts)
    _, group = np.unique(every, return_inverse=True)
    n = int(group.max()) + 1 if len(group) else 0
    apart = np.repeat(held, [len(k) for k in keys])
    amount = (flags >> 1).astype(np.int64)
    in_apart = np.zeros(n, np.int64)
    in_main = np.zeros(n, np.int64)
    np.add.at(in_apart, group[apart], amount[apart])
    np.add.at(in_main, group[~apart], amount[~apart])
    word = np.zeros(n, bool)
    word[group] = (flags & 1).astype(bool)
    both = in_main + in_apart
    totals = np.array([in_main[word].sum(), both[word].sum(), (in_main[word] > 0).sum(), (both[word] > 0).sum()], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    at = [group[x:y] for x, y in zip(starts[:-1], starts[1:])]
    return [small(in_main[g]) for g in at], [small(in_apart[g]) for g in at], totals


def _answer(table: pa.Table) -> pa.Table:
    """Adds up one bucket's counts over all blocks and answers each block in its own order. Keys are sorted, so the
    bucket is gone through in runs of keys, and only a run is held in full width."""
    held = table.column("held").to_numpy().astype(bool)
    keys = [unpack(k.as_py(), np.uint64, sorted_=True) for k in table.column("keys")]
    counts = [small(unpack_small(c.as_py())) for c in table.column("counts")]
    low, high = (int(f(k[i] for k in keys if len(k))) for f, i in ((min, 0), (max, -1)))
    runs = parts_for(sum(map(len, keys)), SLICE_KEYS)
    edges = np.array([low + (high - low) * i // runs for i in range(1, runs)], np.uint64)
    cuts = [np.concatenate([[0], np.searchsorted(k, edges), [len(k)]]).astype(np.int64) for k in keys]
    main, dev, totals = [[] for _ in keys], [[] for _ in keys], np.zeros(4, np.int64)
    for run in range(runs):
        part = [slice(c[run], c[run + 1]) for c in cuts]
        in_main, in_apart, added = _added([k[x] for k, x in zip(keys, part)], [c[x] for c, x in zip(counts, part)], held)
        totals += added
        for found, one in ((main, in_main), (dev, in_apart)):
            for pieces, piece in zip(found, one):
                pieces.append(piece)
    zeros = [0] * (len(keys) - 1)
    out = pa.table({
        "block": table.column("block"), "bucket": table.column("bucket"),
        "main": pa.array([pack_small(np.concatenate(p)) for p in main], pa.binary()),
        "apart": pa.array([pack_small(np.concatenate(p)) for p in dev], pa.binary()),
        **{name: pa.array([int(t), *zeros], pa.int64()) for name, t in zip(("tokens_main", "tokens", "types_main", "types"), totals)}})
    del keys, counts, main, dev
    release()
    return out


def _joined(answers: pa.Table):
    rows = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
    return (np.concatenate([unpack_small(r["main"]) for r in rows]), np.concatenate([unpack_small(r["apart"]) for r in rows]))


def _log_bin(x: np.ndarray, steps: int) -> np.ndarray:
    out = np.full(len(x), -(10**6), np.int64)
    some = x > 0
    out[some] = np.rint(np.log2(x[some]) * steps)
    return out


def context_bucket(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))) + 1, 0).astype(np.int64)


def _events(blocks_: pa.Table, answers: pa.Table) -> pa.Table:
    """Histogram of the held-out events of a block: context bucket, log c(v,w)/c(v), log c(w)."""
    frames = []
    for row in blocks_.to_pylist():
        block = _Block(row)
        word, context, pair = block.spread(_joined(answers)[0])
        frames.append(pd.DataFrame({
            "context": context_bucket(context), "x": _log_bin(pair / np.maximum(context, 1), 8), "y": _log_bin(word.astype(float), 4)}))
    counted = pd.concat(frames).value_counts().reset_index(name="n")
    del frames
    release()
    return pa.table({"level": pa.array(np.zeros(len(counted), np.int32)),
                     **{c: pa.array(counted[c].to_numpy(np.int32)) for c in ("context", "x", "y")}, "n": pa.array(counted["n"].to_numpy(np.int64))})


def _learn(events: pd.DataFrame, tokens: int, types: int):
    """EM for the weight of the word level, then for the bigram weight of each context bucket."""
    def value(column, steps):
        return np.where(column > -(10**6), 2.0 ** (column / steps), 0.0)

    if not len(events):
        return 0.5, {}
    n, c = events["n"].to_numpy(float), value(events["y"].to_numpy(), 4)
    flat, share = 1.0 / (types + 1), c / max(tokens, 1)
    m = 0.5
    for _ in range(ROUNDS):
        m = float(np.clip((n * (m * share / (m * share + (1 - m) * flat))).sum() / n.sum(), 1e-6, 1 - 1e-6))
    lower = m * share + (1 - m) * flat
    upper = value(events["x"].to_numpy(), 8)
    weights = {}
    for bucket in np.unique(events["context"]):
        at = (events["context"] == bucket).to_numpy()
        w = 0.5
        for _ in range(ROUNDS):
            w = float(np.clip((n[at] * (w * upper[at] / (w * upper[at] + (1 - w) * lower[at]))).sum() / n[at].sum(), 1e-6, 1 - 1e-6))
        weights[int(bucket)] = 0.0 if bucket == 0 else w
    return m, weights


def _score(m: float, weights: dict, tokens: int, types: int):
    table = np.zeros(80)
    known = sorted(k for k in weights if k > 0)
    for k in range(1, 80):  # a bucket without held-out events takes the nearest one's weight
        table[k] = weights[min(known, key=lambda x: abs(x - k))] if known else 0.0

    def run(blocks_: pa.Table, answers: pa.Table) -> pa.Table:
        outs = []
        for row in blocks_.to_pylist():
            block = _Block(row)
            main, apart = _joined(answers)
            word, context, pair = block.spread(main + apart)
            lower = m * word / max(tokens, 1) + (1 - m) / (types + 1)
            w = table[context_bucket(context)]
            p = w * pair / np.maximum(context, 1) + (1 - w) * lower
            base = np.log10((word + 1) / (tokens + types + 1))
            at = block.starts[:-1]
            outs.append(pa.table({
                "doc_id": block.ids, "row": block.rows, "n_tokens": block.lengths,
                "n_known": np.add.reduceat((word > 0).astype(np.int64), at),
                "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(np.log10(p), at)}))
            del block, main, apart, word, context, pair, lower, w, p, base
            release()
        return pa.concat_tables(outs)
    return run


def score_texts(docs: DataFrame, train, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Log10 probability of every text under a model of the rows for which ``train`` (a column) holds.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row per
    input row. Null and empty texts are the end token alone. Rows without an id are scored and
    returned without one; repeated rows count as often as they occur. Without training rows every
    token has probability 1, the share of the one unknown word. An empty table gives no rows.
    """
    marked = docs.select(
        F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"), F.monotonically_increasing_id().alias("row"))
    apart = F.col("train") & (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(HELD_PARTS)) == 0)
    # a missing id travels as a value no id takes
    marked = marked.select(F.coalesce("id", F.lit(-(2**63))).alias("doc_id"), "row", "text", "train", apart.cast("int").alias("held"))
    corpus = staged(marked.mapInArrow(_blocks, BLOCK), "lm-blocks")
    size = corpus.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    answers = staged(corpus.mapInArrow(_ask(parts_for(size, BUCKET_TOKENS)), ASK)
                     .groupBy("bucket").applyInArrow(_answer, ANSWER), "lm-counts")
    names = ("tokens_main", "tokens", "types_main", "types")
    tokens_main, tokens, types_main, types = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in names)).first()

    held = corpus.where("held = 1")
    asked = answers.where("block like '1-%'").select("block", "bucket", "main", "apart")
    events = (held.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_events, EVENTS)
              .groupBy("context", "x", "y").agg(F.sum("n").alias("n")).toPandas())
    m, weights = _learn(events, tokens_main, types_main)
    scored = (corpus.groupBy("block").cogroup(answers.select("block", "bucket", "main", "apart").groupBy("block"))
              .applyInArrow(_score(m, weights, tokens, types), SCORED))
    doc = F.when(F.col("doc_id") != -(2**63), F.col("doc_id"))
    return scored.select(doc.alias("doc_id"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
                         "base_score", "score")
