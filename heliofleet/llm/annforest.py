"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

Equal vectors form a class and travel once. Vectors are lifted by one coordinate so that all have the
length of the longest (Euclidean order is then the order of inner products), and a query is lifted by 0.

* Growing. A cell is cut into leaves of about ``LEAF`` classes by a tree of random projections, fitted
  on a bounded sample of the cell's classes (``SAMPLE``); every class is then routed down it. Cells still
  of twice that size are cut again in the next round: models and members are tables keyed by (tree, cell), so
  the forest grows with the data and nothing grows on the driver.
* Searching. A query enters the roots of all trees in one priority queue, ordered by the squared margins
  crossed so far, and takes leaves until they hold ``budget`` rows. Where leaves were cut again, the
  query goes on from each with its margin, and its leaves of all cells are put in one order again.
* Reranking. Each leaf, in blocks, scores its queries exactly, in double precision, on the original
  vectors; the best of all leaves are merged per query. Leaves are scored in two passes, nearest
  first, and the second sends on only what reaches the last of the best found before, so what a
  query sends does not grow with the leaves it visits.
* Budget. The true neighbours of a bounded sample of queries are found by brute force and the least
  budget is taken that finds ``TARGET`` of them; it grows until it does, at last to all rows. The
  recall reported is measured on other queries than those the budget was fitted on.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from heliofleet.llm.tables import keyed, staged

TREES, LEAF, SAMPLE, LEAST_SAMPLE = 4, 512, 4096, 8
CUTS, CHILDREN = 8, 1024  # projections tried per cut; ids of a cell's leaves
ROUTE_BLOCK, QUERY_BLOCK, MEMBER_BLOCK = 16_384, 1024, 8192
STEP = 16  # how much further the second pass of reranking goes
AUDIT, FIRST_BUDGET, TARGET, LEAST_RECALL = 192, 1 << 15, 0.94, 0.9
MODEL = "tree int, cell long, planes binary, cuts binary, kids binary, leaves int"


def _classes(dtype: str):
    def run(batches):
        for batch in batches:
            out = []
            for values in batch.column("embedding").to_pylist():
                ok = values is not None and len(values) > 0 and None not in values
                x = np.array(values, dtype) + np.array(0, dtype) if ok else np.zeros(1, dtype)
                out.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
            dims = pa.array([None if v is None else len(v) // np.dtype(dtype).itemsize for v in out], pa.int32())
            longest = [None if v is None else float(np.abs(np.frombuffer(v, dtype).astype(np.float64)).max()) for v in out]
            norms = [None if v is None else min(m * float(np.linalg.norm(np.frombuffer(v, dtype).astype(np.float64) / m)), 1e308) for v, m in zip(out, longest)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary()), dims, pa.array(norms, pa.float64())],
                                             names=["vec_id", "vec", "dim", "norm"])
    return run


def _matrix(column, dtype: str) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), dtype).reshape(len(data), -1).astype(np.float64)


def lifted(x: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Vectors over the longest length, with the coordinate that fills them up to length 1."""
    y = x / reach[:, None]
    return np.hstack([y, np.sqrt(np.maximum(1 - (y * y).sum(axis=1), 0))[:, None]])


def aimed(x: np.ndarray) -> np.ndarray:
    """Queries of length 1, lifted by 0."""
    y = x / np.abs(x).max(axis=1, keepdims=True)
    return np.hstack([y / np.linalg.norm(y, axis=1, keepdims=True), np.zeros((len(x), 1))])


def fit_tree(x: np.ndarray, least: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Planes, cuts, children (a leaf as its complement) and the number of leaves of a tree over a sample."""
    rng, planes, cuts, kids, leaves = np.random.default_rng(seed), [], [], [], 0
    todo = [(np.arange(len(x)), None)]
    while todo:
        rows, slot = todo.pop()
        made = None
        if len(rows) >= 2 * least:
            w = x[rng.choice(rows, CUTS)] - x[rng.choice(rows, CUTS)]
            w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300)
            spread = (x[rows] @ w.T).var(axis=0)
            w = w[spread.argmax()].astype(np.float32)
            at = x[rows] @ w.astype(np.float64)
            cut = float(np.median(at))
            if not (at < cut).any():
                cut = np.nextafter(cut, np.inf)
            if (at < cut).any() and (at >= cut).any():
                made = len(cuts)
                planes.append(w), cuts.append(cut), kids.append([0, 0])
                todo += [(rows[at >= cut], (made, 1)), (rows[at < cut], (made, 0))]
        if made is None:
            made, leaves = ~leaves, leaves + 1
        if slot is not None:
            kids[slot[0]][slot[1]] = made
    width = x.shape[1]
    return (np.array(planes, np.float32).reshape(-1, width), np.array(cuts, np.float64), np.array(kids, np.int32).reshape(-1, 2), leaves)


def route(model, x: np.ndarray) -> np.ndarray:
    """The leaf of every row."""
    planes, cuts, kids = model
    at = np.zeros(len(x), np.int64) if len(cuts) else np.full(len(x), -1)
    while (inside := np.flatnonzero(at >= 0)).size:
        node = at[inside]
        right = np.einsum("ij,ij->i", x[inside], planes[node].astype(np.float64)) >= cuts[node]
        at[inside] = kids[node, right.astype(np.int64)]
    return ~at


def best_first(roots, budget: int):
    """Leaves ``(start, leaf, squared margin, rows taken with it)`` in the order of one queue over all roots,
    until they hold ``budget`` rows. A root is (start, squared margin so far, margins, children, rows per leaf)."""
    queue = [(far, start, 0 if len(kids) else -1) for start, far, _, kids, _ in roots]
    of = {start: (margins, kids, counts) for start, _, margins, kids, counts in roots}
    heapq.heapify(queue)
    taken = 0
    while queue and taken < budget:
        far, start, node = heapq.heappop(queue)
        margins, kids, counts = of[start]
        while node >= 0:
            margin = margins[node]
            left, right = kids[node]
            node, other = (right, left) if margin >= 0 else (left, right)
            heapq.heappush(queue, (far + margin * margin, start, other))
        if counts[~node]:
            taken += counts[~node]
            yield start, ~node, far, taken


def _model(row) -> tuple:
    cuts = np.frombuffer(row["cuts"], np.float64)
    return (np.frombuffer(row["planes"], np.float32).reshape(len(cuts), -1) if len(cuts) else np.zeros((0, 0), np.float32), cuts,
            np.frombuffer(row["kids"], np.int32).reshape(-1, 2))


def _fit(dtype: str, leaf: int, least: int):
    def run(table: pa.Table) -> pa.Table:
        first = table.select(["tree", "cell", "n"]).slice(0, 1).to_pylist()[0]
        table = table.sort_by("cls")
        x = lifted(_matrix(table.column("vec"), dtype), table.column("reach").to_numpy())
        some = max(least, int(leaf * len(x) / max(first["n"], 1) / 2))
        planes, cuts, kids, leaves = fit_tree(x, some, first["cell"] % 100_003 * 101 + first["tree"])
        return pa.table({"tree": pa.array([first["tree"]], pa.int32()), "cell": pa.array([first["cell"]], pa.int64()), "planes": pa.array([planes.tobytes()], pa.binary()),
                         "cuts": pa.array([cuts.tobytes()], pa.binary()), "kids": pa.array([kids.tobytes()], pa.binary()), "leaves": pa.array([leaves], pa.int32())})
    return run


def _route(dtype: str):
    def run(rows: pa.Table, models: pa.Table) -> pa.Table:
        kept = rows.select(["tree", "cls", "least", "reach", "vec"])
        if not models.num_rows or not rows.num_rows:
            return kept.slice(0, 0).append_column("cell", pa.array([], pa.int64()))
        model = models.select(["planes", "cuts", "kids"]).to_pylist()[0]
        leaf = route(_model(model), lifted(_matrix(rows.column("vec"), dtype), rows.column("reach").to_numpy()))
        return kept.append_column("cell", pa.array(rows.column("cell").to_numpy() * CHILDREN + leaf + 1, pa.int64()))
    return run


def grow(classes: DataFrame, dtype: str, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE,
         least: int = LEAST_SAMPLE) -> tuple[list[DataFrame], DataFrame]:
    """The models of each round (with the rows of their leaves) and the members ``tree, cell, cls, least, vec`` of all leaves."""
    rows = classes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).select(
        "tree", F.col("dim").cast("long").alias("cell"), "cls", "least", "reach", "vec")
    levels, leaves, keys = [], [], ["tree", "cell"]
    while True:
        sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
        large = staged(sizes if not levels else sizes.where(F.col("n") > 2 * leaf), "forest-sizes")
        if levels:
            leaves.append(rows.join(large, keys, "left_anti").select("tree", "cell", "cls", "least", "vec"))
            if large.isEmpty():
                break
        wide = rows.join(large, keys)
        drawn = wide.where(F.pmod(F.xxhash64("cls", F.lit(len(levels)), "tree"), F.col("n")) < sample)
        models = staged(drawn.groupBy(*keys).applyInArrow(_fit(dtype, leaf, least), MODEL).join(large, keys), "forest-models")
        if levels:  # a cell that no projection divides stays a leaf
            leaves.append(wide.join(models.where("leaves < 2"), keys, "left_semi").select("tree", "cell", "cls", "least", "vec"))
            models = models.where("leaves > 1")
        count = F.ceil(F.col("n") / ROUTE_BLOCK).cast("int")
        dealt = wide.withColumn("block", F.pmod(F.xxhash64("cls"), count).cast("int"))
        copies = models.withColumn("block", F.explode(F.sequence(F.lit(0), count - 1)))
        cut = dealt.groupBy(*keys, "block").cogroup(copies.groupBy(*keys, "block")).applyInArrow(
            _route(dtype), "tree int, cls long, least long, reach double, vec binary, cell long")
        rows = staged(cut.select("tree", "cell", "cls", "least", "reach", "vec"), "forest-cells")
        held = rows.groupBy(*keys).agg(F.count("*").alias("n"))
        parent, child = F.floor((F.col("cell") - 1) / CHILDREN).cast("long"), ((F.col("cell") - 1) % CHILDREN).cast("int")
        counts = held.select("tree", parent.alias("cell"), F.struct(child.alias("leaf"), "n").alias("held")).groupBy(*keys).agg(
            F.collect_list("held").alias("held"))  # at most CHILDREN
        levels.append(staged(models.drop("n").join(counts, keys), "forest-level"))
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return levels, out


def _descend(dtype: str, budget: int):
    """Queries of a block against the trees of a cell: one queue over all of them."""
    def run(asked: pa.Table, models: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and models.num_rows:
            trees = []
            for row in models.select(["tree", "cell", "planes", "cuts", "kids", "leaves", "held"]).to_pylist():
                counts = [0] * row["leaves"]
                for held in row["held"]:
                    counts[held["leaf"]] = held["n"]
                planes, cuts, kids = _model(row)
                trees.append((row["tree"], row["cell"], planes, cuts, kids.tolist(), counts))
            x = aimed(_matrix(asked.column("vec"), dtype))
            cls, far = asked.column("cls").to_pylist(), asked.column("far").to_pylist()
            margins = [(x @ planes.T.astype(np.float64) - cuts).tolist() if len(cuts) else [[]] * len(x) for _, _, planes, cuts, _, _ in trees]
            cell_of = [t[1] for t in trees]
            for i, one in enumerate(cls):
                roots = [(k, far[i], margins[k][i], t[4], t[5]) for k, t in enumerate(trees)]
                for k, leaf, margin, taken in best_first(roots, budget):
                    out.append((one, trees[k][0], cell_of[k] * CHILDREN + leaf + 1, margin, taken, trees[k][5][leaf]))
        cols = list(zip(*out)) if out else [[]] * 6
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("cls", "tree", "cell", "far", "taken", "n"), cols, kinds)})
    return run


def probes(queries: DataFrame, levels: list[DataFrame], dtype: str, reach: int, budget: int) -> DataFrame:
    """``cls, tree, cell, taken, n``: the leaves each query class (cls, dim, vec) visits, the rows visited with each, and its own.

    The last round takes ``budget`` rows; rounds before it take cells of ``reach`` rows, as near leaves lie in many cells."""
    limits = [reach] * (len(levels) - 1) + [budget]
    schema = "cls long, tree int, cell long, far double, taken long, n long"
    blocks = queries.groupBy("dim").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    entry = queries.join(blocks, "dim").select("cls", F.col("dim").cast("long").alias("cell"), F.lit(0.0).alias("far"), "vec",
                                               F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block"))
    roots = levels[0].join(blocks.select(F.col("dim").cast("long").alias("cell"), "blocks"), "cell").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    found = entry.groupBy("cell", "block").cogroup(roots.groupBy("cell", "block")).applyInArrow(_descend(dtype, limits[0]), schema)
    for level, limit in zip(levels[1:], limits[1:]):
        found = staged(found, "forest-probes")
        keys = ["tree", "cell"]
        inner = found.join(level.select(*keys), keys).select("cls", "far", *keys)
        blocks = inner.groupBy(*keys).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
        entry = inner.join(blocks, keys).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).drop("blocks").join(queries.select("cls", "vec"), "cls")
        below = level.join(blocks, keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        deeper = entry.groupBy(*keys, "block").cogroup(below.groupBy(*keys, "block")).applyInArrow(_descend(dtype, limit), schema)
        flat = found.join(level.select(*keys), keys, "left_anti").unionByName(deeper)
        order = Window.partitionBy("cls").orderBy("far", "tree", "cell")
        found = flat.withColumn("taken", F.sum("n").over(order)).where(F.col("taken") - F.col("n") < limit)
    return found.select("cls", "tree", "cell", "taken", "n")


def _rerank(dtype: str, k: int):
    """The ``k`` best classes of a block of members for every query that visits the leaf, as far as they reach its ``bar``."""
    def run(asked: pa.Table, members: pa.Table) -> pa.Table:
        a, b = [], []
        scores = []
        if asked.num_rows and members.num_rows:
            q, x = _matrix(asked.column("vec"), dtype), _matrix(members.column("vec"), dtype)
            least = members.column("least").to_numpy()
            reach = [-np.inf if b is None else b for b in asked.column("bar").to_pylist()] if "bar" in asked.column_names else [-np.inf] * len(q)
            with np.errstate(over="ignore", invalid="ignore"):
                rounding = 1e-12 * np.sqrt((x * x).sum(axis=1).max())
                for lo in range(0, len(q), 128):
                    rough = q[lo:lo + 128] @ x.T
                    rough[np.isnan(rough)] = -np.inf
                    for i, row in enumerate(rough, lo):
                        bar = max(reach[i], np.partition(row, -k)[-k] if len(row) > k else -np.inf)
                        slack = rounding * np.sqrt(q[i] @ q[i])
                        at = np.flatnonzero(row >= (bar - slack if np.isfinite(bar) and np.isfinite(slack) else -np.inf if bar < np.inf else bar))
                        exact = np.einsum("j,ij->i", q[i], x[at])
                        exact[np.isnan(exact)] = -np.inf
                        best = np.lexsort((least[at], -exact))[:k]
                        a.append(np.full(len(best), i)), b.append(at[best]), scores.append(exact[best])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        return pa.table({"query": asked.column("cls").take(pa.array(a)), "cls": members.column("cls").take(pa.array(b)),
                         "least": members.column("least").take(pa.array(b)), "score": pa.array(np.concatenate(scores) if scores else np.zeros(0))})
    return run


NEAR = "query long, cls long, least long, score double"


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "least", "cls")
    once = found.groupBy("query", "cls").agg(F.max("least").alias("least"), F.max("score").alias("score"))
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def nearest_classes(queries: DataFrame, levels: list[DataFrame], members: DataFrame, dtype: str, reach: int, budget: int, k: int) -> DataFrame:
    """``query, cls, least, score, place``: the ``k`` best classes each query class finds."""
    keys = ["tree", "cell"]
    visits = staged(probes(queries, levels, dtype, reach, budget).withColumn("start", F.col("taken") - F.col("n")), "forest-visits")
    asked_blocks = visits.groupBy(*keys).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("qs"))
    member_blocks = members.groupBy(*keys).agg(F.ceil(F.count("*") / MEMBER_BLOCK).cast("int").alias("ms"))
    sizes = staged(asked_blocks.join(member_blocks, keys), "forest-blocks")

    def dealt(rows, own, count, other, others):
        return rows.join(sizes, keys).withColumn(own, F.pmod(F.xxhash64("cls"), F.col(count)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("qs", "ms")

    cell, near = [*keys, "qb", "mb"], None
    held = dealt(members, "mb", "ms", "qb", "qs")
    edges = [0, budget // STEP, budget]
    for low, high in zip(edges, edges[1:]):
        if high <= low:
            continue
        now = visits.where((F.col("start") >= low) & (F.col("start") < high)).select("cls", *keys)
        asked = dealt(now, "qb", "qs", "mb", "ms").join(queries.select("cls", "vec"), "cls")
        if near is not None:
            asked = asked.join(near.where(F.col("place") == k).select(F.col("query").alias("cls"), F.col("score").alias("bar")), "cls", "left")
        found = asked.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInArrow(_rerank(dtype, k), NEAR)
        near = staged(_merged(found if near is None else found.unionByName(near.drop("place")), k), "forest-near")
    return near


def brute_force(queries: DataFrame, classes: DataFrame, dtype: str, k: int) -> DataFrame:
    """The same, exactly, for a bounded set of query classes: every block of classes meets them all."""
    sizes = classes.groupBy("dim").agg(F.ceil(F.count("*") / MEMBER_BLOCK).cast("int").alias("blocks"))
    held = classes.select("dim", "cls", "least", "vec").join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).drop("blocks")
    asked = queries.select("cls", "dim", "vec").join(sizes, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return _merged(asked.groupBy("dim", "block").cogroup(held.groupBy("dim", "block")).applyInArrow(_rerank(dtype, k), NEAR), k)


def fitted_budget(asked: DataFrame, classes: DataFrame, levels, members: DataFrame, dtype: str, k: int, first: int = FIRST_BUDGET,
                  audit: int = AUDIT, target: float = TARGET) -> tuple[int, int, float | None]:
    """The budget asked for, the least that finds ``target`` of the true neighbours of one sample of queries (``vec_id, cls``),
    and the recall at the latter on another sample; no recall without queries. Queries and neighbours count once per row, so a vector
    that many rows share weighs as much as they do. The budget asked for grows until both samples are met or it covers
    every row; a target of 1 or more covers every row from the start."""
    most = members.count()
    if target >= 1:
        return most, most, 1.0
    drawn = asked.orderBy(F.xxhash64("vec_id", "cls", F.lit(3))).limit(2 * audit)
    half = F.pmod(F.xxhash64("vec_id", "cls", F.lit(4)), F.lit(2)) == 0
    weights = staged(drawn.groupBy("cls").agg(F.count(F.when(half, 1)).alias("fit"), F.count(F.when(~half, 1)).alias("rest")), "forest-audit")
    if weights.isEmpty():
        return 1, 1, None
    queries = staged(classes.join(weights, "cls").select("cls", "dim", "vec"), "forest-audit")
    near = brute_force(queries, classes, dtype, k + 1).join(classes.select("cls", F.size("ids").alias("rows")), "cls").withColumn(
        "rows", F.col("rows") - F.when(F.col("cls") == F.col("query"), 1).otherwise(0))
    sofar = F.sum("rows").over(Window.partitionBy("query").orderBy("place"))
    true = staged(near.withColumn("sofar", sofar).select("query", "cls", F.least("rows", k - F.col("sofar") + F.col("rows")).alias("rows")).where("rows > 0"), "forest-true")
    homes = members.join(true.select("cls").distinct(), "cls", "left_semi").select("cls", "tree", "cell")
    sought = staged(true.join(homes, "cls").select("query", "cls", "rows", "tree", "cell"), "forest-homes")
    if sought.isEmpty():
        return 1, 1, None
    budget = min(first, most)
    while True:
        visits = probes(queries, levels, dtype, budget, budget).withColumnRenamed("cls", "query")
        cost = sought.join(visits, ["query", "tree", "cell"], "left").groupBy("query", "cls", "rows").agg(F.min("taken").alias("cost"))
        seen = cost.join(weights.withColumnRenamed("cls", "query"), "query").select("rows", "cost", "fit", "rest").toPandas()  # 2 x audit x k rows
        seen = seen.fillna({"cost": np.inf}).sort_values("cost")
        cost, fit, rest = seen["cost"].to_numpy(), (seen["rows"] * seen["fit"]).to_numpy(), (seen["rows"] * seen["rest"]).to_numpy()
        fit, rest = fit if fit.sum() else rest, rest if rest.sum() else fit
        need = cost[min(int(np.searchsorted(fit.cumsum(), target * fit.sum())), len(cost) - 1)]
        recall = float(rest[cost <= need].sum() / rest.sum())
        if np.isfinite(need) and recall >= LEAST_RECALL:
            return budget, int(need), recall
        if budget >= most:
            return most, most, 1.0
        budget = min(budget * 8, most)


def nearest_vectors(vectors: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
                    first_budget: int = FIRST_BUDGET, target: float = TARGET, **shape) -> DataFrame:
    """``query_id, rank, vec_id, score, audit_recall``: the ``k`` nearest found for every row whose id is divisible by ``every``.

    Nearness is the inner product in double precision, largest first, ties to the smaller id; a query's
    own id is no candidate, and with fewer candidates all are returned. Rows without an id and vectors
    that are null, empty, zero or hold a null or non-finite component take no part. Vectors of different
    widths do not meet. Rows that repeat an id with the same vector count once; with different vectors each
    is a row of its own. Products too large for a double are infinite, undefined ones the least of all.
    An empty table gives no rows. Further columns are ignored. ``audit_recall`` is the run's measured recall
    (null where no query has a candidate). With ``target`` 1 every leaf is visited and the result is exact.
    """
    kind = vectors.schema[embedding].dataType
    dtype = "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"
    rows = vectors.where(F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>" if dtype == "<f4" else "array<double>").alias("embedding"))
    known = staged(rows.mapInArrow(_classes(dtype), "vec_id long, vec binary, dim int, norm double").where("vec is not null").dropDuplicates(["vec_id", "vec"]), "forest-vectors")
    order = Window.partitionBy("vec").orderBy("vec_id")
    ids = known.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).groupBy("vec").agg(
        F.array_sort(F.collect_list("vec_id")).alias("ids"), F.any_value("dim").alias("dim"), F.any_value("norm").alias("norm"))
    longest = known.groupBy("dim").agg(F.max("norm").alias("reach"))
    classes, key = keyed(ids.join(longest, "dim").select("dim", "vec", "reach", "ids", F.col("ids")[0].alias("least")), "forest-classes")
    classes = classes.withColumnRenamed(key, "cls")
    asked = staged(known.where(F.col("vec_id") % every == 0).select("vec_id", "vec").join(classes.select("cls", "vec"), "vec").select("vec_id", "cls"), "forest-asked")
    queries = staged(classes.join(asked.select("cls").distinct(), "cls", "left_semi").select("cls", "dim", "vec"), "forest-queries")
    levels, members = grow(classes, dtype, **shape)
    reach, budget, recall = fitted_budget(asked, classes, levels, members, dtype, k, first_budget, target=target)
    near = nearest_classes(queries, levels, members, dtype, reach, budget, k + 1)
    named = near.join(classes.select("cls", "ids"), "cls").select("query", F.explode("ids").alias("vec_id"), "score")
    top = named.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    lists = top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))  # k + 1 each
    picked = asked.join(lists, asked["cls"] == lists["query"]).select(
        F.col("vec_id").alias("query_id"), F.slice(F.filter("near", lambda one: one["vec_id"] != F.col("vec_id")), 1, k).alias("near"))
    return picked.select("query_id", F.posexplode("near").alias("place", "one")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), F.col("one.score").alias("score"),
        F.lit(recall).cast("double").alias("audit_recall"))
