"""Extractive answers from ranked passages, and citation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from heliofleet import fixed
from heliofleet.functions.text import sentences, tokens
from heliofleet.operators.ranking import query_terms


def best_sentences(passages: DataFrame, queries: DataFrame, terms: DataFrame) -> DataFrame:
    """The ``take`` sentences of each passage (query_id, n, text, take) that share the rarest query
    terms, put back in document order: (query_id, n, extract).

    A query's weights travel to its passages, and sentences are weighed and chosen where the passage lies: neither they
    nor their terms are rows. Texts that share (query_id, n) are one passage, sentences at one place weighed together."""
    weights = (
        query_terms(queries).join(terms.select("term", "idf"), "term")
        .groupBy("query_id", "term").agg(F.sum("idf").alias("idf"))
        .groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("_weights")))  # a query's terms at most

    def own(sentence: Column) -> Column:
        return F.aggregate(F.array_distinct(tokens(sentence)), F.lit(0.0), lambda sum_, t: sum_ + F.coalesce(F.col("_weights")[t], F.lit(0.0)))

    def overlap(at: Column) -> Column:
        return F.round(F.aggregate("_rows", F.lit(0.0), lambda sum_, r: sum_ + F.coalesce(F.get(r["own"], at), F.lit(0.0))), 9)

    parts = F.flatten(F.transform("_rows", lambda r: F.transform(r["sentences"], lambda s, at: F.struct(
        (-overlap(at)).alias("o"), at.alias("at"), r["take"].alias("take"), s.alias("sentence")))))
    best = F.filter(F.array_sort(parts), lambda p, i: i < p["take"])
    return (
        passages.select("query_id", "n", "take", sentences(F.col("text")).alias("sentences"))
        .where(F.size("sentences") > 0).join(weights, "query_id", "left")
        .groupBy("query_id", "n").agg(F.collect_list(F.struct("take", "sentences", F.transform("sentences", own).alias("own"))).alias("_rows"))
        .select("query_id", "n", F.concat_ws(" ", F.transform(
            F.array_sort(F.transform(best, lambda p: F.struct(p["at"], p["sentence"]))), lambda p: p["sentence"])).alias("extract")))


def extractive_answers(hits: DataFrame, queries: DataFrame, terms: DataFrame) -> DataFrame:
    """Cited answers (query_id, answer) for every query. ``hits`` (query_id, n, score, text): three
    sentences of the top passage, two of the second if it scores at least half as much."""
    top = F.max(F.when(F.col("n") == 1, F.col("score"))).over(Window.partitionBy("query_id"))
    used = (
        hits.where("n <= 2").withColumn("_top", top)
        .where((F.col("n") == 1) | (F.col("score") >= 0.5 * F.when(F.col("_top") != 0, F.col("_top")).otherwise(1.0)))
        .select("query_id", "n", "text", F.when(F.col("n") == 1, 3).otherwise(2).alias("take"))
    )
    cited = best_sentences(used, queries, terms).withColumn(
        "extract", F.concat("extract", F.lit(" ["), F.col("n").cast("string"), F.lit("]")))
    answers = cited.groupBy("query_id").agg(F.concat_ws(" ", F.transform(
        F.array_sort(F.collect_list(F.struct("n", "extract"))), lambda s: s["extract"])).alias("answer"))
    return queries.select("query_id").join(answers, "query_id", "left").select(
        "query_id", F.coalesce("answer", F.lit(fixed.NO_PASSAGES_TEXT)).alias("answer"))


def check_citations(answers: DataFrame, text: str = "text", given: str = "given") -> DataFrame:
    """``valid`` and ``reason``: an answer must cite a passage when it has some, and only those."""
    cited = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.try_cast("bigint")))
    numbers = F.col(given).cast("array<bigint>")
    unknown = F.array_sort(F.array_except(cited, numbers))
    reason = (
        F.when((F.size(numbers) > 0) & (F.size(cited) == 0), "answer cites no passages")
        .when(F.size(unknown) > 0, F.concat(
            F.lit("answer cites unknown passages ["), F.concat_ws(", ", unknown.cast("array<string>")), F.lit("]"))))
    return answers.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
