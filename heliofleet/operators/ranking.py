"""BM25 over a keyword index, dense cosine ranking, rank fusion and search.

Scores are rounded before they are ranked: sums of doubles differ in the last bits with the order
of the rows, and a rank must not depend on that. Ties go to the chunk that comes first (``pos``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from heliofleet import fixed
from heliofleet.functions.columns import scalar
from heliofleet.functions.text import tokens
from heliofleet.operators.index import ENTRY, RANGE_CHUNKS, TOP, Index, weight
from heliofleet.session import dealt_in, staged

SCORE_DIGITS = 9
QUERY_BLOCK, FEW_BLOCKS, MOST_QUERIES = 1024, 32, 8192  # queries of a block; blocks from which on they grow, and up to what
VECTOR_BLOCK = 32_768
SLACK = 1e-6  # sums of doubles in another order differ by less
SUM_CELLS = 1 << 22  # weights of (query term, chunk) in memory at once
TASK_RANGES, MOST_RANGES = 32, 256  # ranges of chunks per task, and up to what they grow with many queries
TASK_QUERIES = 1 << 18  # queries per task at most
QUERY_ROWS = 512  # queries whose sums are made at once
PACK_BYTES = 32 << 20  # blocks that are joined by range before they are dealt
RANGE_QUERIES = 256  # queries that cost about as much to move as a range of blocks
TERMS, ASKED = -2, -1  # in place of a range, the rows of a task that hold its terms and its queries


def query_terms(queries: DataFrame, query: str = "query") -> DataFrame:
    """Distinct expanded terms of queries (query_id, query)."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col(query), expand=True))).alias("term"))


def _matrix(sizes: np.ndarray, entries: list[pa.Array], avg, k1: float, b: float) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Weights (block, chunk) of a range's blocks of these ``sizes``, and the ids and places of its chunks in corpus order."""
    id_, pos, tf, length = entries
    ids, places = id_.dictionary_encode("encode"), pos.dictionary_encode("encode")  # either may be null
    _, first, chunk = np.unique(ids.indices.to_numpy() * np.int64(max(len(places.dictionary), 1)) + places.indices.to_numpy(),
                                return_index=True, return_inverse=True)
    order = pc.array_sort_indices(pos.take(pa.array(first)), null_placement="at_start").to_numpy().astype(int)
    first, chunk = first[order], np.argsort(order)[chunk]
    row = np.repeat(np.arange(len(sizes)), sizes)
    held = np.bincount(row * len(first) + chunk, weight(tf.to_numpy(), length.to_numpy(), avg, k1, b), len(sizes) * len(first))
    return held.reshape(len(sizes), len(first)), id_.take(pa.array(first)), pos.take(pa.array(first))


def _sums(k: int | None, k1: float, b: float):
    def scored(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        """Scores of a range's chunks for the queries that reach it. The blocks make a matrix (term, chunk) of weights,
        and a query adds up the rows of its terms; some queries at a time, so the sums in memory are bounded."""
        terms, listed = blocks.column("term").combine_chunks(), asked.column("terms").combine_chunks()
        entries = [blocks.column(c).combine_chunks() for c in ENTRY]
        held, id_, pos = _matrix(np.diff(entries[0].offsets.to_numpy()), [values.flatten() for values in entries], blocks.column("avg_len").to_numpy()[:1], k1, b)
        first = np.arange(len(id_))

        word, idf = listed.flatten().flatten()
        row = pc.index_in(word, value_set=terms)
        known = row.is_valid().to_numpy(zero_copy_only=False)
        row, idf = row.fill_null(0).to_numpy()[known], idf.to_numpy()[known]
        query = np.repeat(np.arange(len(listed)), np.diff(listed.offsets.to_numpy()))[known]
        starts = np.flatnonzero(np.diff(query, prepend=-1))
        ends, bars = np.append(starts[1:], len(query)), asked.column("bar").to_numpy()
        who, found, scores, lo = [], [], [], 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + SUM_CELLS // max(len(first), 1), side="right")))
            part, begins = slice(starts[lo], ends[hi - 1]), starts[lo:hi]
            sums = np.round(np.add.reduceat(held[row[part]] * idf[part, None], begins - starts[lo], axis=0), SCORE_DIGITS)
            keep = sums > 0
            if k is not None:  # everything at or above the k-th score and the bar; ties at the cut are settled by pos
                least = np.partition(sums, -k, axis=1)[:, -k] if sums.shape[1] > k else np.full(len(sums), -np.inf)
                keep &= sums >= np.fmax(least, bars[query[begins]] - SLACK)[:, None]
            at, col = np.nonzero(keep)
            if k is not None:
                order = np.lexsort((col, -sums[at, col], at))
                at, col = at[order], col[order]
                best = np.arange(len(at)) - np.searchsorted(at, at) < k
                at, col = at[best], col[best]
            who.append(query[begins][at]), found.append(first[col]), scores.append(sums[at, col])
            lo = hi
        who, found, scores = (np.concatenate([np.empty(0, kind), *parts]) for parts, kind in ((who, int), (found, int), (scores, float)))
        return pa.table({"query_id": asked.column("query_id").take(pa.array(who)), "id": id_.take(pa.array(found)), "pos": pos.take(pa.array(found)),
                         "score": scores})

    def cell(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        if blocks.num_rows and asked.num_rows:
            return scored(blocks, asked)
        id_, pos = (blocks.schema.field(c).type.value_type for c in ("id", "pos"))
        return pa.table({"query_id": pa.array([], asked.schema.field("query_id").type), "id": pa.array([], id_),
                         "pos": pa.array([], pos), "score": pa.array([], pa.float64())})

    return cell


def _scored(asked: DataFrame, index: Index, blocks: DataFrame, k: int | None, k1: float, b: float) -> DataFrame:
    """Scores of ``asked`` (query_id, range, terms, bar); with ``k``, those that can be among a query's k best. Blocks
    and queries are dealt by the range of chunks, so a chunk's sum is made where its blocks already are. Blocks travel
    with one array per field of their entries, which takes half of what an array of entries does."""
    fields = [F.col(f"entries.{c}").cast("array<int>").alias(c) if c == "tf" else F.col(f"entries.{c}").alias(c) for c in ENTRY]
    held = blocks.select("range", "term", *fields, scalar(index.stats.select("avg_len")).alias("avg_len")).repartition("range")
    entry = blocks.schema["entries"].dataType.elementType
    asked = asked.select("query_id", F.col("range").alias("range"), "terms", "bar")  # a column of its own beside that of the blocks
    kinds = [("query_id", asked.schema["query_id"].dataType), ("id", entry["id"].dataType), ("pos", entry["pos"].dataType)]
    return held.groupBy("range").cogroup(asked.repartition("range").groupBy("range")).applyInArrow(
        _sums(k, k1, b), ", ".join(f"{c} {kind.simpleString()}" for c, kind in kinds) + ", score double")


def ranges_in_reach(asked: DataFrame, index: Index, blocks: DataFrame, k: int | None, k1: float, b: float) -> DataFrame:
    """``query_id, range, terms, bar``: the ranges of chunks that hold terms of a query, each with all its terms; with
    ``k``, the ranges whose bound reaches the query's bar, else no bar.

    A block's highest count and shortest chunk bound what it can add, so a range has a bound per query. The bar
    is the most that one term alone gives the query's k-th best chunk, which the index keeps for each term."""
    heads = blocks.select("bucket", "term", "range", "top_tf", "least_len")
    pairs = heads.join(asked, ["bucket", "term"])
    queries = asked.groupBy("query_id").agg(
        F.collect_list(F.struct("term", "idf")).alias("terms"), F.max(F.col("idf") * F.col("kth")).alias("bar"))  # a query's terms at most
    if k is None or k > TOP or (k1, b) != (fixed.BM25_K1, fixed.BM25_B):
        held, queries = pairs.select("query_id", "range").distinct(), queries.withColumnRenamed("query_id", "_query")
        return held.join(queries, F.col("query_id").eqNullSafe(F.col("_query"))).select(
            "query_id", "range", "terms", F.lit(None).cast("double").alias("bar"))
    most = weight(F.col("top_tf"), F.col("least_len"), scalar(index.stats.select("avg_len")), k1, b)
    reach = pairs.groupBy("query_id", "range").agg(F.sum(F.col("idf") * most).alias("reach"))
    # Both sides are sums of doubles in their own order, hence the slack.
    return reach.join(queries, "query_id").where(F.col("reach") >= F.col("bar") - SLACK).select("query_id", "range", "terms", "bar")


def opened(queries: DataFrame, index: Index) -> tuple[DataFrame, DataFrame]:
    """The weighted terms of queries (query_id, bucket, term, idf, kth) and the blocks of their terms. The index is
    read only at the buckets of those terms; bucket numbers are all that reaches the driver."""
    words = query_terms(queries).withColumn("bucket", index.bucket_of(F.col("term")))
    used = sorted(r["bucket"] for r in words.select("bucket").distinct().collect())  # at most index.buckets
    here = F.col("bucket").isin(used)
    asked = staged(words.join(index.terms.where(here).select("term", "bucket", "idf", "kth"), ["bucket", "term"]), "search-terms")
    return asked, index.blocks.where(here).join(asked.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")


def bm25(
    queries: DataFrame, index: Index, k: int | None = None, k1: float = fixed.BM25_K1, b: float = fixed.BM25_B,
) -> DataFrame:
    """Scores (query_id, id, pos, score) of chunks sharing a term with a query; with ``k``, of all that
    can be among a query's k best: ranges of chunks that cannot hold one are skipped with their blocks.
    One plan for every size.
    """
    asked, blocks = opened(queries, index)
    return _scored(ranges_in_reach(asked, index, blocks, k, k1, b), index, blocks, k, k1, b)


def _by_pack(batches):
    """Blocks as one row per range of some ``PACK_BYTES`` of them: their terms, their sizes, and their entries end to end. A row
    per block would mostly be its own frame."""
    def packed(kept):
        rows = pa.Table.from_batches(kept)
        rows = rows.take(np.argsort(rows.column("range").to_numpy(), kind="stable"))
        ranges, starts = np.unique(rows.column("range").to_numpy(), return_index=True)
        ends = np.append(starts, len(rows)).astype("int32")
        entries = [rows.column(c).combine_chunks() for c in ENTRY]
        at = entries[0].offsets.to_numpy()
        lists = [pa.ListArray.from_arrays(ends, x) for x in (rows.column("term").combine_chunks(), pa.array(np.diff(at)))]
        lists += [pa.ListArray.from_arrays(at[ends] - at[0], values.flatten()) for values in entries]
        return pa.RecordBatch.from_arrays([pa.array(ranges), *lists], names=["range", "terms", "sizes", *ENTRY])

    kept, size = [], 0
    for batch in batches:
        if len(batch):
            kept.append(batch)
            size += batch.nbytes
        if size >= PACK_BYTES:
            yield packed(kept)
            kept, size = [], 0
    if kept:
        yield packed(kept)


def _by_range(batches):
    """The rows of each range, which lie together."""
    kept, last = [], None
    for batch in batches:
        ranges = batch.column("range").to_numpy()
        cuts = np.flatnonzero(np.diff(ranges, prepend=ranges[:1] - 1))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(ranges))):
            if ranges[lo] != last and kept:
                yield last, pa.Table.from_batches(kept)
                kept = []
            last = ranges[lo]
            kept.append(batch.slice(lo, hi - lo))
    if kept:
        yield last, pa.Table.from_batches(kept)


def _found(k: int, avg: float, k1: float, b: float):
    """The k best chunks of each query of a task. Its rows come by range: its terms, its queries, then one range of blocks
    after the other, of which only the best are kept; what a query has found raises the bar for later ranges."""
    def best(batches):
        words = idf = query_id = bars = None
        groups, who, score, chunk, ids, places, seen, new = [], *(np.empty(0, kind) for kind in (int, float, int)), [], [], 0, []
        def settle():
            nonlocal who, score, chunk, new
            who, score, chunk = (np.concatenate(parts) for parts in zip((who, score, chunk), *new))
            place = np.empty(seen, int)
            place[pc.array_sort_indices(pa.concat_arrays(places), null_placement="at_start").to_numpy()] = np.arange(seen)
            order = np.lexsort((place[chunk], -score, who))
            who = who[order]
            nth = np.arange(len(who)) - np.searchsorted(who, who)
            last = order[nth == k - 1]
            bars[who[nth == k - 1]] = np.fmax(bars[who[nth == k - 1]], score[last] - SLACK)
            who, score, chunk, new = who[nth < k], score[order[nth < k]], chunk[order[nth < k]], []

        for range_, rows in _by_range(batches):
            if range_ == TERMS:
                words, idf = rows.column("term").combine_chunks(), rows.column("value").to_numpy()
            elif range_ == ASKED:
                query_id, bars = rows.column("query_id").combine_chunks(), np.fmax(rows.column("value").to_numpy() - SLACK, 10.0 ** -(SCORE_DIGITS + 1))
                terms = rows.column("terms").combine_chunks()
                codes, ends = pc.index_in(terms.flatten(), value_set=words).to_numpy(), np.cumsum(np.diff(terms.offsets.to_numpy()))
                sizes = np.diff(ends, prepend=0)
                order = np.argsort(sizes, kind="stable")
                for lo in range(0, len(order), QUERY_ROWS):  # queries of about one length, filled up with no term
                    some = order[lo:lo + QUERY_ROWS]
                    nth = np.arange(sizes[some].max())
                    groups.append((some, np.where(nth < sizes[some, None], codes[np.minimum((ends - sizes)[some, None] + nth, len(codes) - 1)], len(words))))
            elif groups:
                known, sizes, *entries = (rows.column(c).combine_chunks().flatten() for c in ("terms", "sizes", *ENTRY))
                held, id_, pos = _matrix(sizes.to_numpy(), entries, avg, k1, b)
                known = pc.index_in(known, value_set=words).to_numpy()
                held = np.concatenate([held * idf[known, None], np.zeros((1, held.shape[1]))])
                at, most = np.full(len(words) + 1, len(known)), held.max(axis=1)
                at[known] = np.arange(len(known))
                for some, coded in groups:
                    listed = at[coded]
                    within = most[listed].sum(axis=1) >= bars[some]
                    some, listed = some[within], listed[within]
                    if not len(some):
                        continue
                    sums = held[listed[:, 0]]
                    for column in listed.T[1:]:
                        sums += held[column]
                    keep = sums >= bars[some, None]
                    if np.count_nonzero(keep) > k * len(some) and sums.shape[1] > k:
                        keep &= sums >= np.partition(sums, -k, axis=1)[:, -k, None] - SLACK
                    row, col = np.nonzero(keep)
                    value = np.round(sums[row, col], SCORE_DIGITS)
                    row, col, value = row[value > 0], col[value > 0], value[value > 0]
                    first = np.lexsort((col, -value, row))
                    first = first[np.arange(len(row)) - np.searchsorted(row, row) < k]
                    new.append((some[row[first]], value[first], seen + col[first]))
                ids.append(id_), places.append(pos)
                seen += len(id_)
                if sum(len(n[0]) for n in new) > max(len(who) // 2, QUERY_ROWS):
                    settle()
        if new:
            settle()
        if len(who):
            ids, places = pa.concat_arrays(ids), pa.concat_arrays(places)
        for lo in range(0, len(who), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [query_id.take(pa.array(who[part])), *[x.take(pa.array(chunk[part])) for x in (ids, places)], pa.array(score[part])],
                names=["query_id", "id", "pos", "score"])

    return best


def _best_in_cells(listed: DataFrame, asked: DataFrame, blocks: DataFrame, ranges: int, avg: float, k: int, k1: float, b: float) -> DataFrame:
    """Scores (query_id, id, pos, score) of the k best chunks per query and cell. A cell has a part of the queries
    ``listed`` (query_id, terms, value: the bar) and a part of the ranges: blocks travel once per part of the queries and queries once per part
    of the ranges, not once per range that holds one of their terms. Parts of ranges are few if queries are many."""
    n = listed.count()
    parts = max(1, -(-n // TASK_QUERIES))
    cores = listed.sparkSession.sparkContext.defaultParallelism
    few = max(-(-cores // parts), ranges * RANGE_QUERIES * parts // max(n, 1), -(-ranges // MOST_RANGES))
    spread = max(1, min(few, -(-ranges // TASK_RANGES)))
    of_part, of_range = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"), F.pmod("range", F.lit(spread)).cast("int")
    every = [F.lit(i) for i in range(parts)], [F.lit(i) for i in range(spread)]
    entry = blocks.schema["entries"].dataType.elementType
    kinds = {"query_id": listed.schema["query_id"].dataType, "id": entry["id"].dataType, "pos": entry["pos"].dataType}
    kinds = {c: kind.simpleString() for c, kind in kinds.items()}
    held = blocks.select("range", "term", *[F.col(f"entries.{c}").cast("array<int>").alias(c) if c == "tf" else F.col(f"entries.{c}").alias(c) for c in ENTRY])
    held = held.mapInArrow(_by_pack, f"range int, terms array<string>, sizes array<int>, id array<{kinds['id']}>, pos array<{kinds['pos']}>, tf array<int>, len array<int>")
    dealt = (
        asked.groupBy("term").agg(F.max("idf").alias("value")).select(
            F.lit(TERMS).alias("range"), "term", "value", F.explode(F.sequence(F.lit(0), F.lit(parts * spread - 1))).alias("cell"))
        .unionByName(listed.select(F.lit(ASKED).alias("range"), "query_id", "terms", "value", F.explode(F.array(*[
            of_part * spread + i for i in every[1]])).alias("cell")), allowMissingColumns=True)
        .unionByName(held.select("*", F.explode(F.array(*[i * spread + of_range for i in every[0]])).alias("cell")), allowMissingColumns=True)
        .repartitionById(parts * spread, F.col("cell")).drop("cell").sortWithinPartitions("range"))
    return dealt.mapInArrow(_found(k, avg, k1, b), ", ".join(f"{c} {kind}" for c, kind in kinds.items()) + ", score double")


def bm25_topk(queries: DataFrame, index: Index, k: int = fixed.CANDIDATES, k1: float = fixed.BM25_K1, b: float = fixed.BM25_B) -> DataFrame:
    """The k best chunks per query, written: k rows per query. Ranges are even and a task has a bounded number of
    them and of queries, so what it holds does not grow with the corpus."""
    spark, stats = queries.sparkSession, index.stats.first()
    ranges = -(-stats["chunks"] // RANGE_CHUNKS)
    asked, blocks = opened(queries, index)
    barred = k <= TOP and (k1, b) == (fixed.BM25_K1, fixed.BM25_B)  # else the index keeps no bar
    bar = F.max(F.col("idf") * F.col("kth")) if barred else F.lit(0.0)
    listed = asked.groupBy("query_id").agg(F.collect_list("term").alias("terms"), bar.alias("value"))  # a query's terms at most
    listed = staged(listed.where(F.col("query_id").isNotNull()) if barred else listed, "search-queries")
    with dealt_in(spark, -(-ranges // TASK_RANGES)):
        return staged(top_k(_best_in_cells(listed, asked, blocks, ranges, stats["avg_len"], k, k1, b), k), "search-best")


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best per query with their rank; ties in corpus order."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _cell(k: int):
    def matrix(column: pd.Series) -> np.ndarray:
        widths = {len(v) for v in column}
        if len(widths) > 1:
            raise ValueError(f"vectors of unequal length: {sorted(widths)}")
        m = np.stack(column.to_numpy()).astype("float64")
        norms = np.sqrt((m * m).sum(axis=1))
        return m / np.where(norms > 0, norms, 1.0)[:, None]

    def best(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or vectors.empty:
            return pd.DataFrame({c: [] for c in ("query_id", "id", "pos", "score")})
        q, v = matrix(queries["embedding"]), matrix(vectors["embedding"])
        if q.shape[1] != v.shape[1]:
            raise ValueError(f"vectors of unequal length: {q.shape[1]} and {v.shape[1]}")
        pos, who, found, scores = vectors["pos"].to_numpy(), [], [], []
        for start in range(0, len(q), 64):
            sims = np.round(q[start:start + 64] @ v.T, SCORE_DIGITS) + 0.0
            # Everything at or above the k-th score, so ties at the cut are settled by pos.
            bars = np.partition(sims, -k, axis=1)[:, -k] if len(v) > k else np.full(len(sims), -np.inf)
            row, col = np.nonzero(sims >= bars[:, None])
            order = np.lexsort((pos[col], -sims[row, col], row))
            row, col = row[order], col[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, col = row[place < k], col[place < k]
            who.append(start + row), found.append(col), scores.append(sims[row, col])
        who, found = np.concatenate(who), np.concatenate(found)
        return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[who], "id": vectors["id"].to_numpy()[found], "pos": pos[found],
                             "score": np.concatenate(scores)})

    return best


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int = fixed.CANDIDATES) -> DataFrame:
    """Exact k nearest vectors per query by cosine: (query_id, id, pos, score, rank).

    ``queries`` (query_id, embedding) and ``vectors`` (id, pos, embedding) are cut into blocks of
    bounded size by hash; each pair of blocks is one task that multiplies two matrices and emits
    only k rows per query. No side is broadcast and no pair of rows is materialised. The number of
    blocks follows the counts inside the plan: a vector travels once per block of queries, so blocks of
    queries grow before they become many.
    """
    def blocks(df, size, few=0, most=1):
        n = F.count(F.lit(1))
        return scalar(df.agg(F.greatest(F.ceil(n / max(size, most)), F.least(F.ceil(n / size), F.lit(few)), F.lit(1)).cast("int")))

    nq, nv = blocks(queries, QUERY_BLOCK, FEW_BLOCKS, MOST_QUERIES), blocks(vectors, VECTOR_BLOCK)
    q = queries.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), nq).cast("int").alias("qb"),
                       F.explode(F.sequence(F.lit(0), nv - 1)).alias("vb"))
    v = vectors.select("id", "pos", "embedding", F.pmod(F.xxhash64("id"), nv).cast("int").alias("vb"),
                       F.explode(F.sequence(F.lit(0), nq - 1)).alias("qb"))
    id_type, pos_type = v.schema["id"].dataType.simpleString(), v.schema["pos"].dataType.simpleString()
    query_type = q.schema["query_id"].dataType.simpleString()
    cells = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(
        _cell(k), f"query_id {query_type}, id {id_type}, pos {pos_type}, score double")
    return top_k(cells, k)


def rrf(lexical: DataFrame, dense: DataFrame, k: int, constant: int = fixed.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two rankings (query_id, id, rank); ties go to the better keyword
    rank, then the better dense rank."""
    both = lexical.select("query_id", "id", F.col("rank").alias("lexical_rank"), F.lit(None).cast("int").alias("dense_rank")).unionByName(
        dense.select("query_id", "id", F.lit(None).cast("int").alias("lexical_rank"), F.col("rank").alias("dense_rank")))
    fused = both.groupBy("query_id", "id").agg(
        F.max("lexical_rank").alias("lexical_rank"), F.max("dense_rank").alias("dense_rank"))
    def part(rank):
        return F.coalesce(1.0 / (constant + F.col(rank)), F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(
        F.desc("score"), F.asc_nulls_last("lexical_rank"), F.asc_nulls_last("dense_rank"))
    return (
        fused.withColumn("score", F.round(part("lexical_rank") + part("dense_rank"), 12))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "id", "score", "rank")
    )


def search(
    queries: DataFrame, index: Index, k: int = 4,
    query_vectors: DataFrame | None = None, vectors: DataFrame | None = None,
) -> DataFrame:
    """Hits (query_id, rank, id, score, method): fused when vectors are given, else keyword only.
    A query that matches nothing has no rows in keyword mode."""
    lexical = bm25_topk(queries, index)
    if vectors is None or query_vectors is None:
        hits, method = lexical.where(F.col("rank") <= k), "bm25"
    else:
        hits, method = rrf(lexical, cosine_topk(query_vectors, vectors), k), "hybrid"
    return hits.select("query_id", "rank", "id", F.round("score", 4).alias("score"), F.lit(method).alias("method"))
