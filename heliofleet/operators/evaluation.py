"""Retrieval and routing evaluation, and exact rank percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from heliofleet import fixed
from heliofleet.functions.columns import rounded, scalar


def case_ranks(expected: DataFrame, ranked: DataFrame, known: DataFrame, k_max: int = 5, doc_sep: str = "#") -> DataFrame:
    """Per case: rank of the first relevant hit within ``k_max`` and of the first hit in a relevant
    document. ``expected`` (case_id, id), ``ranked`` (case_id, id, rank), ``known`` (id). An
    expected id outside ``known`` is an error."""
    present = known.select("id", F.lit(True).alias("_known")).distinct()
    wanted = expected.distinct().join(present, "id", "left").withColumn("id", F.when(F.col("_known"), F.col("id")).otherwise(
        F.raise_error(F.concat(F.lit("unknown expected id: "), F.col("id").cast("string"))).cast(expected.schema["id"].dataType))).drop("_known")
    def doc(id_):
        return F.substring_index(id_.cast("string"), doc_sep, 1)
    hits = ranked.where(F.col("rank") <= k_max)
    exact = hits.join(wanted, ["case_id", "id"]).groupBy("case_id").agg(F.min("rank").alias("rank"))
    by_doc = hits.withColumn("_doc", doc(F.col("id"))).join(
        wanted.select("case_id", doc(F.col("id")).alias("_doc")).distinct(), ["case_id", "_doc"]
    ).groupBy("case_id").agg(F.min("rank").alias("doc_rank"))
    return wanted.select("case_id").distinct().join(exact, "case_id", "left").join(by_doc, "case_id", "left")


def evaluate_retrieval(ranks: DataFrame) -> DataFrame:
    """One row of hit rates, mean reciprocal rank and document hit rate."""
    def rate(rank, k):
        return rounded(F.avg(F.coalesce((F.col(rank) <= k).cast("double"), F.lit(0.0))), 3)
    return ranks.agg(
        F.count(F.lit(1)).alias("cases"), rate("rank", 1).alias("hit_at_1"), rate("rank", 3).alias("hit_at_3"),
        rate("rank", 5).alias("hit_at_5"), rounded(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 3).alias("mrr"),
        rate("doc_rank", 3).alias("doc_hit_at_3"))


def misses(ranks: DataFrame, ranked: DataFrame, k: int = 3) -> DataFrame:
    """Cases without a relevant hit in the first k, with what they got (k ids at most)."""
    missed = ranks.where(F.col("rank").isNull() | (F.col("rank") > k)).select("case_id")
    got = ranked.where(F.col("rank") <= k).groupBy("case_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda h: h["id"].cast("string")).alias("got"))
    return missed.join(got, "case_id", "left").select(
        "case_id", F.coalesce("got", F.array().cast("array<string>")).alias("got"))


def gate(report: DataFrame, least: dict[str, float]) -> DataFrame:
    """The report itself, or an error that names the first figure below its minimum (or missing)."""
    def held(name: str) -> Column:
        message = F.concat(F.lit(f"{name} is "), F.coalesce(F.col(name).cast("string"), F.lit("missing")), F.lit(f", less than {least[name]}"))
        return F.when(F.col(name) >= least[name], F.col(name)).otherwise(F.raise_error(message).cast(report.schema[name].dataType))
    return report.withColumns({name: held(name) for name in least})


STEPS = 8  # halvings of the search among 2 ** STEPS - 1 splitters


def rank_percentiles(df: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """Median and the floor-index 95th percentile per group, exactly: (groups, n, p50, p95).

    Values are counted per distinct value. A quantile sketch per group, of fixed size and merged map-side, gives
    255 splitters, so a bin holds about a 256th of a group wherever its values lie; running counts over the bins
    find the bins of the wanted ranks, and only their values are ordered. No task sorts a whole group, and
    neither the range of the values nor a crowd in one place matters.
    """
    groups = list(groups)
    rows = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).alias("v"))
    parts = 1 << STEPS
    cuts = rows.groupBy(*groups).agg(
        F.percentile_approx("v", F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10 * parts).alias("cuts"), F.count(F.lit(1)).alias("n"))
    counted = rows.groupBy(*groups, "v").agg(F.count(F.lit(1)).alias("c"))
    same = F.lit(True)
    for g in groups:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    binned = counted.alias("a").join(cuts.alias("b"), same).select("a.*", "cuts", "n").withColumn("bin", F.lit(0))
    for step in range(STEPS - 1, -1, -1):  # bin: how many splitters lie below the value
        ahead = F.col("bin") + (1 << step)
        binned = binned.withColumn("bin", F.when(F.element_at("cuts", ahead) < F.col("v"), ahead).otherwise(F.col("bin")))
    binned = binned.drop("cuts")
    bins = binned.groupBy(*groups, "bin").agg(F.sum("c").alias("bc"), F.max("n").alias("n"))
    sized = bins.withColumn("upto", F.sum("bc").over(Window.partitionBy(*groups).orderBy("bin")))  # 256 bins at most
    n = F.col("n")
    targets = F.array(
        F.struct(F.lit("lo").alias("kind"), F.floor((n - 1) / 2).alias("at")),
        F.struct(F.lit("hi").alias("kind"), F.ceil((n - 1) / 2).alias("at")),
        F.struct(F.lit("p95").alias("kind"), F.floor(F.lit(0.95) * (n - 1)).alias("at")))
    wanted = (
        sized.withColumn("start", F.col("upto") - F.col("bc"))
        .withColumn("hits", F.filter(targets, lambda t: (t["at"] >= F.col("start")) & (t["at"] < F.col("upto"))))
        .where(F.size("hits") > 0)
        .select(*groups, "bin", "start", "hits"))
    same = F.col("a.bin") == F.col("b.bin")
    for g in groups:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    inside = Window.partitionBy(*groups, "bin").orderBy("v")
    found = (
        binned.alias("a").join(wanted.alias("b"), same).select("a.*", "start", "hits")
        .withColumn("last", F.col("start") + F.sum("c").over(inside))
        .select(*groups, "n", "v", "last", (F.col("last") - F.col("c")).alias("first"), F.explode("hits").alias("t"))
        .where((F.col("t.at") >= F.col("first")) & (F.col("t.at") < F.col("last"))))
    def pick(kind):
        return F.max(F.when(F.col("t.kind") == kind, F.col("v")))
    return found.groupBy(*groups).agg(
        F.max("n").alias("n"), ((pick("lo") + pick("hi")) / 2).alias("p50"), pick("p95").alias("p95"))
