"""Golden sets: JSON documents of questions with the call, or the sections, each should lead to.

A set is one small document; a folder of them, or a column of payloads, is read set by set in
parallel. A document that is no JSON of its shape raises an error, since a set that silently
lost its cases would pass any gate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ROUTING_SET = ("facilities array<array<string>>, "
               "cases array<struct<question: string, expect: struct<tool: string, args: map<string, string>>>>")
RETRIEVAL_SET = "cases array<struct<question: string, expect: array<string>>>"


def read_sets(spark: SparkSession, path: str) -> DataFrame:
    """(set_id, payload): one row per JSON file of a folder, named by the file."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    return files.select(F.col("_metadata.file_name").alias("set_id"), F.col("value").alias("payload"))


def _cases(sets: DataFrame, schema: str) -> DataFrame:
    parsed = F.from_json("payload", schema, {"mode": "FAILFAST"})
    return (
        sets.select(F.col("set_id").cast("string").alias("set_id"), F.posexplode(parsed["cases"]).alias("position", "case"))
        .withColumn("case_id", F.concat("set_id", F.lit("#"), "position")))


def routing_cases(sets: DataFrame) -> DataFrame:
    """(set_id, case_id, question, tool, args): arguments as texts; those listed as null stay, as null."""
    return _cases(sets, ROUTING_SET).select(
        "set_id", "case_id", "case.question", "case.expect.tool",
        F.coalesce("case.expect.args", F.create_map().cast("map<string,string>")).alias("args"))


def routing_facilities(sets: DataFrame) -> DataFrame:
    """(set_id, facility_code, facility_name): the farms that the questions of a set are about."""
    parsed = F.from_json("payload", ROUTING_SET, {"mode": "FAILFAST"})
    return sets.select(F.col("set_id").cast("string").alias("set_id"), F.explode(parsed["facilities"]).alias("f")).select(
        "set_id", F.get("f", F.lit(0)).alias("facility_code"), F.get("f", F.lit(1)).alias("facility_name"))


def retrieval_cases(sets: DataFrame) -> DataFrame:
    """(set_id, case_id, question, expect): ``expect`` lists section ids; a case without any is an error."""
    expect = F.when(F.size("case.expect") > 0, F.col("case.expect")).otherwise(
        F.raise_error(F.concat(F.lit("no expected section in case "), "case_id")).cast("array<string>"))
    return _cases(sets, RETRIEVAL_SET).select("set_id", "case_id", "case.question", expect.alias("expect"))


def expected_sections(cases: DataFrame) -> DataFrame:
    """(case_id, id) as the retrieval evaluation takes them."""
    return cases.select("case_id", F.explode("expect").alias("id")).distinct()
