"""Constraint checks and argument bounds as counting jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from heliofleet import fixed


def row_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations per row rule (a rule is what must hold; NULL counts as a violation), one pass."""
    counts = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return counts.select(F.explode(pairs).alias("r")).select("r.rule", "r.violations")


def key_rule(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """How many key values occur more than once."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")
    )


def reference_rule(df: DataFrame, name: str, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose key has no parent."""
    known = parent.select(F.col(parent_key).alias(child_key))
    return (
        df.select(child_key).join(known, child_key, "left_anti")
        .agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")
    )


def not_empty_rule(df: DataFrame, name: str) -> DataFrame:
    return df.agg((F.count(F.lit(1)) == 0).cast("bigint").alias("violations")).select(F.lit(name).alias("rule"), "violations")


def check_constraints(*reports: DataFrame) -> DataFrame:
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """The same rows; a key held twice is an error."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    checked = F.when(F.col("_n") == 1, F.col(key)).otherwise(
        F.raise_error(F.concat(F.lit("duplicate id: "), F.col(key).cast("string"))).cast(df.schema[key].dataType))
    return df.join(counts, key).withColumn(key, checked).select(*df.columns)


def argument_rules(spark: SparkSession) -> DataFrame:
    """The tool argument bounds, one row per tool: a dozen rules in all, fixed in code."""
    schema = ("tool string, arg string, kind string, low double, high double, fallback string, required boolean")
    rows = [(t, a, k, None if lo is None else float(lo), None if hi is None else float(hi), d, r)
            for t, a, k, lo, hi, d, r in fixed.TOOL_ARGUMENTS]
    return spark.createDataFrame(rows, schema).groupBy("tool").agg(
        F.array_sort(F.collect_list(F.struct("arg", "kind", "low", "high", "fallback", "required"))).alias("rules"))


def validate_calls(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Calls (call_id, tool, args map) with ``valid``, ``reasons`` and ``args`` completed by defaults.

    A NULL map value is an explicit null, allowed for a region only; a missing argument takes its
    default.
    """
    joined = calls.join(F.broadcast(rules), "tool", "left")
    args = F.coalesce("args", F.create_map().cast("map<string,string>"))
    known = F.transform("rules", lambda r: r["arg"])

    def fault(rule: Column) -> Column:
        name, value = rule["arg"], F.col("_args")[rule["arg"]]
        given = F.array_contains(F.map_keys("_args"), name)
        number = value.try_cast("double")
        within = number.between(rule["low"], rule["high"])
        whole = F.when(rule["kind"] == "int", number == F.floor(number)).otherwise(F.lit(True))
        ok = (
            F.when(~given, ~rule["required"])
            .when(rule["kind"] == "region", value.isNull() | value.isin(*fixed.REGION_CODES))
            .when(rule["kind"] == "text", F.length(value).between(rule["low"], rule["high"]))
            .otherwise(within & whole)
        )
        return F.when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit("invalid "), name))

    faults = F.array_compact(F.transform("rules", fault))
    unknown = F.transform(F.array_sort(F.array_except(F.map_keys("_args"), known)),
                          lambda a: F.concat(F.lit("unknown argument "), a))
    reasons = F.when(F.col("rules").isNull(), F.array(F.lit("unknown tool"))).otherwise(F.concat(faults, unknown))
    filled = F.map_from_entries(F.transform(
        "rules", lambda r: F.struct(r["arg"], F.when(
            F.array_contains(F.map_keys("_args"), r["arg"]), F.col("_args")[r["arg"]]).otherwise(r["fallback"]))))
    return (
        joined.withColumn("_args", args).withColumn("reasons", reasons)
        .withColumn("valid", F.size("reasons") == 0)
        .select("call_id", "tool", F.when(F.col("valid"), filled).otherwise(F.col("args")).alias("args"), "valid", "reasons")
    )
