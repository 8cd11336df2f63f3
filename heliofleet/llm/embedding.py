"""Embedding near-duplicates on a robust-pruned flat graph.

Equal vectors form a class and travel once. Centres fitted on a bounded sample cut the classes into
clusters; every class enters its ``OVERLAP`` nearest ones, and a cluster with more than
``SHARD_NODES`` members is dealt into parts. In each shard a graph is built by robust pruning, the
adjacency lists of a class from all its shards are united, and each class searches its home
cluster's parts: a greedy beam search from the shard's medoids, then an expansion through every
node near the range. Cosines of what is found are worked out again in double precision. Recall is
audited against brute force on a bounded set of queries; below the target the overlap is doubled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from heliofleet.llm.graph import components
from heliofleet.llm.tables import parts_for, staged
from heliofleet.llm.words import mix

CLUSTER_SIZE, SHARD_NODES = 1500, 4000
SAMPLE, CENTRE_BYTES = 20_000, 8 << 20  # bounds of the fitting sample (rows) and of the centres
OVERLAP, DEGREE, POOL, BEAM, ALPHA = 3, 16, 40, 32, 1.2
STARTS, EXPAND, SLACK = 8, 4, 0.03
AUDIT_QUERIES, TARGET = 64, 0.97
NODE = "shard int, part int, cls long, vec binary, near array<long>"


def _matrix(column) -> np.ndarray:
    """Unit vectors of one width."""
    data = column.to_pylist() if hasattr(column, "to_pylist") else list(column)
    x = np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1) if data else np.zeros((0, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _classes(batches):
    """The class of each vector: 64 bits of its components; null where it links with nothing."""
    for batch in batches:
        cls, dims, vecs = [], [], []
        for values in batch.column("embedding").to_pylist():
            ok = values is not None and len(values) > 0 and None not in values
            x = np.array(values, np.float64) + 0.0 if ok else np.zeros(1)
            top = np.abs(x).max() if np.isfinite(x).all() else 0.0
            if top == 0.0:
                cls.append(None), dims.append(None), vecs.append(None)
                continue
            key = mix(np.bitwise_xor.reduce(mix(x.view(np.uint64) + mix(np.arange(1, len(x) + 1, dtype=np.uint64)))).reshape(1))
            cls.append(int(key.view(np.int64)[0])), dims.append(len(x)), vecs.append((x / top).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(cls, pa.int64()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())],
            names=["vec_id", "cls", "dim", "vec"])


def fit_centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on the sample."""
    rng = np.random.default_rng(9)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(x, max(1, len(x) // 2000))])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return centres


def _assign(centres: dict, overlap: int):
    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                first, own = centres[int(dim)]
                near = np.argsort(-(_matrix(some.column("vec")) @ own.T), axis=1, kind="stable")[:, :overlap]
                width = near.shape[1]
                at = np.repeat(np.arange(some.num_rows), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((near.ravel() + first).astype(np.int32)), some.column("cls").take(pa.array(at)),
                     some.column("vec").take(pa.array(at)), pa.array(np.tile(np.arange(width) == 0, some.num_rows))],
                    names=["shard", "cls", "vec", "home"])
    return run


def robust_prune(cosines: np.ndarray, pool: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """For every node, up to ``degree`` of its pool such that none is much nearer to one kept before (-1: none)."""
    n = len(pool)
    rows = np.arange(n)
    apart = 1 - cosines
    left = apart[rows[:, None], pool]
    left[pool == rows[:, None]] = np.inf
    own = left.copy()
    out = np.full((n, degree), -1)
    for k in range(degree):
        best = left.argmin(axis=1)
        ok = np.isfinite(left[rows, best])
        if not ok.any():
            break
        chosen = pool[rows, best]
        out[ok, k] = chosen[ok]
        left[ALPHA * apart[chosen[:, None], pool] <= own] = np.inf
        left[rows, best] = np.inf
    return out


def start_nodes(x: np.ndarray) -> np.ndarray:
    """The medoid, then nodes far from those chosen."""
    starts = [int((x @ x.mean(axis=0)).argmax())]
    nearest = x @ x[starts[0]]
    for _ in range(min(STARTS, len(x)) - 1):
        starts.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[starts[-1]])
    return np.unique(starts)


def build_graph(x: np.ndarray) -> list[np.ndarray]:
    """Adjacency of a shard's nodes: pruned neighbours, their back links, and every node reachable."""
    n = len(x)
    cosines = (x @ x.T).astype(np.float32)
    size = min(POOL, n)
    pool = np.argpartition(-cosines, size - 1, axis=1)[:, :size]
    far = np.random.default_rng(n).integers(0, n, (n, min(POOL // 2, n)))  # long links
    out = robust_prune(cosines, np.hstack([pool, far]))
    src, dst = np.repeat(np.arange(n), out.shape[1]), out.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    pairs = np.unique(np.concatenate([src * n + dst, dst * n + src]))
    near = np.split(pairs % n, np.searchsorted(pairs // n, np.arange(1, n)))
    seen = np.zeros(n, bool)
    front = start_nodes(x)
    while True:
        seen[front] = True
        while len(front):
            step = np.unique(np.concatenate([near[i] for i in front]))
            front = step[~seen[step]]
            seen[front] = True
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return near
        node = lost[0]
        link = int(np.where(seen, cosines[node], -2).argmax())
        near[link] = np.append(near[link], node)
        near[node] = np.append(near[node], link)
        front = np.array([node])


def _build(table: pa.Table) -> pa.Table:
    cls = table.column("cls").to_numpy()
    near = build_graph(_matrix(table.column("vec")))
    ends = np.concatenate([[0], np.cumsum([len(a) for a in near])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(cls[np.concatenate(near).astype(np.int64)] if len(near) else cls[:0]))
    return table.select(["shard", "part", "cls", "vec"]).append_column("near", lists)


def range_search(x: np.ndarray, near: list[np.ndarray], queries: np.ndarray, least: float):
    """(query, node) pairs with cosine near ``least`` or above, by beam search and range expansion."""
    n, q = len(x), len(queries)
    width = max((len(a) for a in near), default=0) or 1
    table = np.full((n, width), -1)
    for i, a in enumerate(near):
        table[i, :len(a)] = a
    score = np.full((q, n), -2.0, np.float32)
    open_ = np.zeros((q, n), bool)
    starts = start_nodes(x)
    score[:, starts] = queries @ x[starts].T
    open_[:, starts] = True
    x32, q32 = x.astype(np.float32), queries.astype(np.float32)

    def expand(rows, nodes):
        open_[rows, nodes] = False
        to = table[nodes]
        r, c = np.repeat(rows, width), to.ravel()
        keys = np.unique((r * n + c)[c >= 0])
        r, c = keys // n, keys % n
        fresh = score[r, c] <= -2
        r, c = r[fresh], c[fresh]
        for lo in range(0, len(r), 200_000):
            a, b = r[lo:lo + 200_000], c[lo:lo + 200_000]
            score[a, b] = np.einsum("ij,ij->i", q32[a], x32[b])
        open_[r, c] = True

    beam = min(BEAM, n)
    active = np.arange(q)
    while len(active):
        now = np.where(open_[active], score[active], -2)
        some = np.argpartition(-now, min(EXPAND, n) - 1, axis=1)[:, :EXPAND]
        bar = np.partition(score[active], n - beam, axis=1)[:, n - beam]
        values = np.take_along_axis(now, some, axis=1)
        worth = (values > -2) & (values >= bar[:, None])
        at, k = np.nonzero(worth)
        if not len(at):
            break
        expand(active[at], some[at, k])
        active = active[worth.any(axis=1)]
    while True:
        rows, nodes = np.nonzero(open_ & (score >= least - SLACK))
        if not len(rows):
            break
        for lo in range(0, len(rows), 20_000):
            expand(rows[lo:lo + 20_000], nodes[lo:lo + 20_000])
    return np.nonzero(score >= least - 1e-4)


def _search(least: float):
    def run(nodes: pa.Table, asked: pa.Table) -> pa.Table:
        a, b = [], []
        if nodes.num_rows and asked.num_rows:
            cls, x = nodes.column("cls").to_numpy(), _matrix(nodes.column("vec"))
            place = pd.Series(np.arange(len(cls)), index=cls)
            near = []
            for own in nodes.column("near").to_pylist():
                at = place.reindex(own).to_numpy()
                near.append(np.unique(at[~np.isnan(at)]).astype(np.int64))
            who, q = asked.column("cls").to_numpy(), _matrix(asked.column("vec"))
            for lo in range(0, len(q), 256):
                rows, hits = range_search(x, near, q[lo:lo + 256], least)
                for some in np.array_split(np.arange(len(rows)), max(1, len(rows) // 50_000)):
                    exact = np.einsum("ij,ij->i", q[lo + rows[some]], x[hits[some]])
                    good = (exact >= least) & (who[lo + rows[some]] != cls[hits[some]])
                    a.append(who[lo + rows[some]][good])
                    b.append(cls[hits[some]][good])
        empty = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate(a) if a else empty, "b": np.concatenate(b) if b else empty})
    return run


def _brute(queries: pd.DataFrame, least: float):
    asked = {dim: (own["cls"].to_numpy(), _matrix(own["vec"])) for dim, own in queries.groupby("dim")}

    def run(batches):
        for batch in batches:
            dims, cls = batch.column("dim").to_numpy(), batch.column("cls").to_numpy()
            for dim, (who, q) in asked.items():
                at = np.flatnonzero(dims == dim)
                x = _matrix(batch.column("vec").take(pa.array(at)))
                i, j = np.nonzero(q @ x.T >= least) if len(at) else (at, at)
                other = who[i] != cls[at[j]]
                yield pa.RecordBatch.from_arrays([pa.array(who[i][other]), pa.array(cls[at[j]][other])], names=["a", "b"])
    return run


def find_links(classes: DataFrame, least: float, overlap: int = OVERLAP) -> DataFrame:
    """Distinct pairs ``a < b`` of classes found with cosine at least ``least``."""
    spark = classes.sparkSession
    sizes = {r.dim: r.n for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row per width
    centres, first = {}, 0
    for dim, n in sorted(sizes.items()):
        sample = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("cls", F.lit(1))).limit(SAMPLE).select("vec").toPandas()
        k = max(1, min(parts_for(n, CLUSTER_SIZE), CENTRE_BYTES // (8 * dim)))
        own = fit_centres(_matrix(sample["vec"]), k)
        centres[int(dim)] = (first, own)
        first += len(own)
    placed = staged(classes.mapInArrow(_assign(centres, overlap), "shard int, cls long, vec binary, home boolean"), "embedding-shards")
    counts = placed.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_NODES).cast("int").alias("parts"))  # one row per centre
    placed = placed.join(F.broadcast(counts), "shard")
    nodes = placed.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).select("shard", "part", "cls", "vec")
    built = staged(nodes.groupBy("shard", "part").applyInArrow(_build, NODE), "embedding-graph")
    united = built.select("cls", F.explode("near").alias("n")).groupBy("cls").agg(F.collect_set("n").alias("near"))  # overlap x degree
    graph = built.drop("near").join(united, "cls")
    asked = placed.where("home").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "cls", "vec")
    found = graph.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInArrow(_search(least), "a long, b long")
    return staged(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "embedding-links")


def audit_recall(classes: DataFrame, links: DataFrame, least: float) -> float:
    """Share of the brute-force links of a bounded set of queries that the graph found."""
    queries = classes.orderBy(F.xxhash64("cls", F.lit(2))).limit(AUDIT_QUERIES).select("cls", "dim", "vec").toPandas()
    if not len(queries):
        return 1.0
    true = classes.mapInArrow(_brute(queries, least), "a long, b long").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    row = true.join(links.withColumn("found", F.lit(1)), ["a", "b"], "left").agg(F.count("*").alias("n"), F.count("found").alias("f")).first()
    return row.f / row.n if row.n else 1.0


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id, kept, audit_recall`` for every vector.

    Pairs found with cosine at least ``least`` are linked. Null, empty and zero vectors and those with
    null or non-finite components link with nothing, nor do vectors of different widths. Rows that
    repeat an id stay separate. A row without an id is linked, but never gives a component its id.
    An empty table gives no rows. ``audit_recall`` is the run's measured recall.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    known = staged(rows.mapInArrow(_classes, "vec_id long, cls long, dim int, vec binary"), "vectors")
    classes = staged(known.where("cls is not null").groupBy("cls").agg(
        F.count("*").alias("members"), F.min("vec_id").alias("least"), F.any_value("dim").alias("dim"), F.any_value("vec").alias("vec")), "vector-classes")
    overlap, recall = OVERLAP, 0.0
    for _ in range(3):
        links = find_links(classes, least, overlap)
        recall = audit_recall(classes, links, least)
        if recall >= TARGET:
            break
        overlap *= 2
    size = classes.select("cls", "members")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(size.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("members").alias("others"))
    found = (classes.select("cls", "members", "least").join(components(links).withColumnRenamed("node", "cls"), "cls", "left")
             .join(degree, "cls", "left").select("cls", "least", F.coalesce("root", "cls").alias("root"),
                                                (F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("n_links")))
    heads = found.groupBy("root").agg(F.min("least").alias("component_id"))
    named = found.join(heads, "root").select("cls", "n_links", "component_id")
    return (known.select("vec_id", "cls").join(named, "cls", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
            .withColumn("audit_recall", F.lit(float(recall))))
