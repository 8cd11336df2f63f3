"""Answers to a table of questions: route, validate, compute each distinct call once, word it.

Windows of any length share one roll-up: rows are first reduced to (facility, age in hours, clock hour),
at most 336 per facility, and every call sums the ages it covers; fleet windows sum regions by age.
Answers are a cascade: a proposed call if it is valid, else the rule route; a proposed text if its
citations hold, else the template or the passages' own sentences. The first reason to fall back is kept.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from heliofleet import fixed
from heliofleet.functions.columns import energy_mwh, micros, rounded
from heliofleet.operators import catalogue, quality, ranking, routing
from heliofleet.operators.fleet import Fleet, between, hours
from heliofleet.operators.index import Index
from heliofleet.operators.passages import check_citations, extractive_answers
from heliofleet.operators.scoring import held_back_mw
from heliofleet.session import staged

ALL = "all regions"
_HOUR = 3_600_000_000
_MOST_PASSAGES = 8
# One row per tool call; unused arguments are NULL.
_ARGS = ("facility string", "hours int", "limit int", "threshold double", "region string", "query string", "k int")


def percent(value: Column) -> Column:
    return F.when(value.isNull(), "n/a").otherwise(F.concat(F.bround(value * 100, 0).cast("bigint").cast("string"), F.lit("%")))


def one_decimal(value: Column) -> Column:
    return F.when(value.isNull(), "None").otherwise(F.format_string("%.1f", value))


def market_time(at: Column) -> Column:
    return F.coalesce(F.date_format(F.from_utc_timestamp(at, fixed.NEM_OFFSET), "HH:mm 'AEST'"), F.lit("the latest interval"))


def _where(region_key: Column) -> Column:
    return F.when(region_key == ALL, "").otherwise(F.concat(F.lit(" in "), region_key))


def _region_of(region_key: Column) -> Column:
    return F.when(region_key != ALL, region_key)


def _both_keys(df: DataFrame) -> DataFrame:
    """Each row under its own region and under all regions."""
    return df.withColumn("region_key", F.explode(F.array(F.col("region"), F.lit(ALL))))


def _listed(rows: Column, field: str, most: int, glue: str) -> Column:
    return F.array_join(F.transform(F.slice(rows, 1, most), lambda r: r[field]), glue)


def _calls_of(calls: DataFrame, tool: str, *args: str) -> DataFrame:
    return calls.where(F.col("tool") == tool).select("call", *args).distinct()


def _ranked_farms(farms: DataFrame, calls: DataFrame, keep: Column, order: Column, shown: Column) -> DataFrame:
    """Per call, its first ``limit`` farms of the region as (call, region_key, threshold, at, farms)."""
    place = Window.partitionBy("call").orderBy(order, "facility_code")
    found = (
        calls.join(_both_keys(farms), "region_key").where(keep)
        .withColumn("place", F.row_number().over(place)).where("place <= `limit`")
        .groupBy("call").agg(
            F.max("interval_end").alias("at"),
            F.array_sort(F.collect_list(F.struct(
                "place", "facility_code", "facility_name", F.col("region"), *[rounded(F.col(c), 1).alias(c) for c in ("actual_mw", "expected_mw", "curtailed_mw")],
                rounded(F.col("performance_index"), 2).alias("performance_index"), rounded(F.col("rrp"), 2).alias("price_per_mwh"), "status",
                shown.alias("text")))).alias("farms")))
    return calls.join(found, "call", "left")


def _shown(ranked: DataFrame) -> Column:
    """The farms of a call without what only serves its wording."""
    return F.transform(F.coalesce("farms", F.array().cast(ranked.schema["farms"].dataType)), lambda f: f.dropFields("place", "text")).alias("farms")


def _underperformers(calls: DataFrame, farms: DataFrame) -> DataFrame:
    held_back = F.coalesce("status", F.lit("")).isin(*fixed.CURTAILED_KINDS)
    excluded = _both_keys(farms).groupBy("region_key").agg(F.least(F.count_if(held_back), F.lit(25)).alias("excluded"))
    shown = F.concat("facility_name", F.lit(" ("), "region", F.lit(") at "), percent(rounded(F.col("performance_index"), 2)), F.lit(" - "),
                     one_decimal(rounded(F.col("actual_mw"), 1)), F.lit(" MW vs "), one_decimal(rounded(F.col("expected_mw"), 1)), F.lit(" MW expected"))
    asked = _calls_of(calls, "underperformers", "threshold", "limit", "region_key")
    rows = _ranked_farms(farms, asked, (F.col("performance_index") < F.col("threshold")) & ~held_back,
                         F.asc(rounded(F.col("performance_index"), 2)), shown).join(excluded, "region_key", "left")
    note = F.when(F.coalesce("excluded", F.lit(0)) > 0, F.concat(
        F.lit(" "), F.col("excluded").cast("string"), F.lit(" curtailed farm(s) were excluded as not faults."))).otherwise("")
    none = F.concat(F.lit("No farms"), _where(F.col("region_key")), F.lit(" are below "), percent(F.col("threshold")),
                    F.lit(" of expected output at the latest daylight interval."), note)
    some = F.concat(F.lit("At "), market_time(F.col("at")), F.lit(", "), F.size("farms").cast("string"), F.lit(" farm(s)"), _where(F.col("region_key")),
                    F.lit(" were below "), percent(F.col("threshold")), F.lit(" of expected: "), _listed(F.col("farms"), "text", 5, "; "), F.lit("."), note)
    return rows.select("call", F.when(F.col("farms").isNull(), none).otherwise(some).alias("answer"),
                       F.to_json(F.struct("threshold", _region_of(F.col("region_key")).alias("region"), _shown(rows), F.coalesce("excluded", F.lit(0)).alias("curtailed_excluded"))).alias("data"))


def _curtailed(calls: DataFrame, farms: DataFrame) -> DataFrame:
    why = F.when(F.col("status") == "curtailed", F.concat(one_decimal(rounded(F.col("curtailed_mw"), 1)), F.lit(" MW held back by a dispatch cap"))).otherwise(
        F.concat(F.lit("price $"), rounded(F.col("rrp"), 2).cast("string"), F.lit("/MWh, likely curtailed (provisional)")))
    shown = F.concat("facility_name", F.lit(" ("), "region", F.lit(") at "), one_decimal(rounded(F.col("actual_mw"), 1)), F.lit(" MW, "), why)
    asked = _calls_of(calls, "curtailed_farms", "limit", "region_key")
    rows = _ranked_farms(farms, asked, F.col("status").isin(*fixed.CURTAILED_KINDS),
                         F.desc(F.col("expected_mw") - F.col("actual_mw")), shown)
    none = F.concat(F.lit("No farms"), _where(F.col("region_key")), F.lit(" were curtailed at the latest daylight interval."))
    some = F.concat(F.lit("At "), market_time(F.col("at")), F.lit(", "), F.size("farms").cast("string"), F.lit(" farm(s)"), _where(F.col("region_key")),
                    F.lit(" were producing below the weather because of curtailment, not faults: "), _listed(F.col("farms"), "text", 5, "; "), F.lit("."))
    return rows.select("call", F.when(F.col("farms").isNull(), none).otherwise(some).alias("answer"), F.to_json(F.struct(_region_of(F.col("region_key")).alias("region"), _shown(rows))).alias("data"))


def _aged(df: DataFrame, anchor: Column) -> DataFrame:
    """Rows with their hours behind the anchor, from 1: age h is inside every window of h hours or more."""
    behind = micros(anchor) - micros(F.col("interval_end"))
    return df.withColumn("_behind", behind).withColumn("age", F.expr(f"cast(_behind div {_HOUR} as int) + 1")).drop("_behind")


def _by_age(perf: DataFrame, anchor: Column) -> DataFrame:
    """Scored rows reduced to (region, facility, age, clock hour)."""
    return (
        _aged(perf, anchor)
        .groupBy("region", "facility_code", "age", F.date_trunc("hour", "interval_end").alias("hour")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("actual_mw").alias("mw"), F.max("actual_mw").alias("peak"),
            F.sum("expected_mw").alias("expected"), F.sum("performance_index").alias("ix"), F.count("performance_index").alias("ix_n"),
            F.min("performance_index").alias("ix_min"), F.sum("curtailed_mw").alias("cut"),
            F.count_if(F.col("status") == "curtailed").alias("cut_n"), F.count_if(F.col("status") == "likely_curtailed").alias("likely_n"),
            F.max("interval_end").alias("latest")))


def _facility(calls: DataFrame, aged: DataFrame, units: DataFrame, step: int) -> DataFrame:
    asked = _calls_of(calls, "facility_performance", "facility", "hours")
    found = catalogue.find_facility_batch(units, asked.select(F.col("facility").alias("text")))
    named = asked.withColumn("searched_for", F.trim("facility")).join(found.drop("_exact"), "searched_for", "left")
    # One row per (call, clock hour): the profile, and what the summary adds up.
    hourly = (
        named.select("call", "facility_code", "hours").join(aged, "facility_code").where("age <= hours")
        .groupBy("call", "hour").agg(
            F.sum("n").alias("n"), F.sum("mw").alias("mw"), F.max("peak").alias("peak"), F.sum("expected").alias("expected"), F.sum("ix").alias("ix"),
            F.sum("ix_n").alias("ix_n"), F.min("ix_min").alias("ix_min"), F.sum("cut").alias("cut"), F.sum("cut_n").alias("cut_n"),
            F.sum("likely_n").alias("likely_n"), F.max("latest").alias("latest")))
    profile = F.struct(
        F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), rounded(F.col("mw") / F.col("n"), 1).alias("avg_mw"),
        rounded(F.col("expected") / F.col("n"), 1).alias("expected_mw"), rounded(F.try_divide(F.col("ix"), F.col("ix_n")), 2).alias("performance_index"))
    sums = hourly.groupBy("call").agg(
        F.sum("n").alias("intervals"), rounded(energy_mwh(F.sum("mw"), step), 1).alias("energy_mwh"), rounded(F.max("peak"), 1).alias("peak_mw"),
        rounded(F.try_divide(F.sum("ix"), F.sum("ix_n")), 2).alias("avg_performance_index"), rounded(F.min("ix_min"), 2).alias("min_performance_index"),
        rounded(energy_mwh(F.sum("cut"), step), 1).alias("curtailed_mwh"), F.sum("cut_n").alias("curtailed_intervals"),
        F.sum("likely_n").alias("likely_curtailed_intervals"), F.date_format(F.max("latest"), "yyyy-MM-dd HH:mm").alias("latest_interval"),
        F.array_sort(F.collect_list(profile)).alias("hourly"))  # 169 hours at most
    h = F.col("hours").cast("string")
    curtailed = F.when(F.coalesce("curtailed_mwh", F.lit(0.0)) != 0, F.concat(
        F.lit(" "), one_decimal(F.col("curtailed_mwh")), F.lit(" MWh was curtailed by AEMO dispatch caps."))).otherwise("")
    text = (
        F.when(F.col("facility_code").isNull(), F.concat(F.lit("I couldn't find a solar farm matching '"), "facility", F.lit("'.")))
        .when(F.col("intervals").isNull(), F.concat(F.lit("No readings for "), "facility_name", F.lit(" in the last "), h, F.lit(" hours.")))
        .otherwise(F.concat(
            "facility_name", F.lit(" ("), "region", F.lit(", "), one_decimal(F.col("capacity_mw")), F.lit(" MW) produced "), one_decimal(F.col("energy_mwh")),
            F.lit(" MWh in the last "), h, F.lit(" h, peaking at "), one_decimal(F.col("peak_mw")), F.lit(" MW. Average performance index "),
            percent(F.col("avg_performance_index")), F.lit(" (lowest "), percent(F.col("min_performance_index")), F.lit(")."), curtailed)))
    farm = F.when(F.col("facility_code").isNotNull(), F.struct("facility_code", "facility_name", "region", "capacity_mw"))
    summary = F.struct(
        F.coalesce("intervals", F.lit(0)).alias("intervals"), "energy_mwh", "peak_mw", "avg_performance_index", "min_performance_index", "curtailed_mwh",
        F.coalesce("curtailed_intervals", F.lit(0)).alias("curtailed_intervals"),
        F.coalesce("likely_curtailed_intervals", F.lit(0)).alias("likely_curtailed_intervals"), "latest_interval")
    known = F.to_json(F.struct(farm.alias("facility"), "hours", summary.alias("summary"), F.coalesce("hourly", F.array()).alias("hourly")))
    unknown = F.to_json(F.struct(F.col("facility").alias("searched_for")))
    return named.join(sums, "call", "left").select(
        "call", text.alias("answer"), F.when(F.col("facility_code").isNull(), unknown).otherwise(known).alias("data"))


def _fleet(calls: DataFrame, aged: DataFrame, held: DataFrame, farms: DataFrame, step: int) -> DataFrame:
    """``held``: (region, age, held) MW that dispatch caps held back. Regions are summed by age first, so a
    window meets at most 168 rows per region, whatever the number of farms."""
    asked = _calls_of(calls, "fleet_summary", "hours", "region_key")
    windows = asked.select("hours", "region_key").distinct()
    flags = farms.groupBy("region").agg(
        F.count_if(F.col("status") == "underperforming").alias("under"), F.count_if(F.col("status").isin(*fixed.CURTAILED_KINDS)).alias("cut_n"))
    first = aged.groupBy("region", "facility_code").agg(F.min("age").alias("age")).groupBy("region", "age").agg(F.count(F.lit(1)).alias("farms"))
    summed = aged.groupBy("region", "age").agg(F.sum("mw").alias("mw"), F.sum("ix").alias("ix"), F.sum("ix_n").alias("ix_n"))
    by_age = summed.join(first, ["region", "age"], "left").join(held, ["region", "age"], "full").withColumn("seen", F.col("mw").isNotNull())
    regions = (
        windows.join(_both_keys(by_age), "region_key").where("age <= hours")
        .groupBy("hours", "region_key", "region").agg(
            F.bool_or("seen").alias("seen"), F.sum("farms").alias("facilities"), rounded(energy_mwh(F.sum("mw"), step), 1).alias("energy_mwh"),
            rounded(F.try_divide(F.sum("ix"), F.sum("ix_n")), 2).alias("avg_performance_index"),
            rounded(energy_mwh(F.coalesce(F.sum("held"), F.lit(0.0)), step), 1).alias("curtailed_mwh"))
        .where("seen").join(flags, "region", "left")
        .withColumns({"underperforming_latest": F.coalesce("under", F.lit(0)), "curtailed_latest": F.coalesce("cut_n", F.lit(0))}))
    part = F.concat(
        "region", F.lit(" "), one_decimal(F.col("energy_mwh")), F.lit(" MWh from "), F.col("facilities").cast("string"), F.lit(" farms (avg index "),
        percent(F.col("avg_performance_index")), F.lit(", "), F.col("underperforming_latest").cast("string"), F.lit(" underperforming and "),
        F.col("curtailed_latest").cast("string"), F.lit(" curtailed at the last daylight interval)"))
    row = F.struct((-F.col("energy_mwh")).alias("o"), "region", "facilities", "energy_mwh", "avg_performance_index", "underperforming_latest",
                   "curtailed_latest", "curtailed_mwh", part.alias("text"))
    listed = regions.groupBy("hours", "region_key").agg(
        F.sum("energy_mwh").alias("total"), F.array_sort(F.collect_list(row)).alias("regions"))
    h = F.col("hours").cast("string")
    text = F.when(F.col("regions").isNull(), F.concat(F.lit("No readings in the last "), h, F.lit(" hours."))).otherwise(F.concat(
        F.lit("Last "), h, F.lit(" h: "), one_decimal(F.col("total")), F.lit(" MWh in total. "), F.array_join(F.transform("regions", lambda r: r["text"]), "; "), F.lit(".")))
    shown = F.transform(F.coalesce("regions", F.array().cast(listed.schema["regions"].dataType)), lambda r: r.dropFields("o", "text"))
    return asked.join(listed, ["hours", "region_key"], "left").select(
        "call", text.alias("answer"), F.to_json(F.struct("hours", _region_of(F.col("region_key")).alias("region"), shown.alias("regions"))).alias("data"))


def _find(calls: DataFrame, units: DataFrame) -> DataFrame:
    asked = _calls_of(calls, "find_facilities", "region_key")
    named = _both_keys(catalogue.facilities(units))
    place = Window.partitionBy("region_key").orderBy("facility_name", "facility_code")
    counts = named.groupBy("region_key").agg(F.count(F.lit(1)).alias("count"))
    first = named.withColumn("place", F.row_number().over(place)).where("place <= 50").groupBy("region_key").agg(
        F.array_sort(F.collect_list(F.struct("place", "facility_code", "facility_name", "region", "capacity_mw", "units"))).alias("facilities"))
    n = F.coalesce("count", F.lit(0))
    text = F.concat(n.cast("string"), F.lit(" solar farms"), _where(F.col("region_key")), F.lit(": "),
                    F.coalesce(_listed(F.col("facilities"), "facility_name", 10, ", "), F.lit("")), F.when(n > 10, " ...").otherwise(""))
    shown = F.coalesce("facilities", F.array().cast(first.schema["facilities"].dataType))
    return asked.join(counts, "region_key", "left").join(first, "region_key", "left").select(
        "call", text.alias("answer"), F.to_json(F.struct(_region_of(F.col("region_key")).alias("region"), n.alias("count"), shown.alias("facilities"))).alias("data"))


def typed_calls(calls: DataFrame) -> DataFrame:
    """Validated argument maps as columns, with one text key per distinct call."""
    columns = [(a.split()[0], a.split()[1]) for a in _ARGS]
    typed = calls.select("question_id", "tool", "valid", "reasons", "args", *[
        (F.floor(F.col("args")[name].try_cast("double")).cast("int") if kind == "int" else F.col("args")[name].try_cast(kind)).alias(name)
        for name, kind in columns])
    return typed.withColumn("region_key", F.coalesce("region", F.lit(ALL))).withColumn(
        "call", F.when(F.col("valid"), F.to_json(F.struct("tool", *[n for n, _ in columns]))))


def _scored_days(fleet: Fleet, as_of: datetime | None) -> DataFrame:
    """The scored view over the longest window that a call may ask for; every tool reads it."""
    return catalogue.trailing(fleet, fixed.MAX_HOURS, as_of)


def _latest_farms(scored: DataFrame, anchor: Column) -> DataFrame:
    """Rows of the newest interval with an index in the last day."""
    day = scored.where(F.col("interval_end") > anchor - hours(24))
    latest = day.where(F.col("performance_index").isNotNull()).agg(F.max("interval_end"))
    return day.where(F.col("interval_end") == latest.scalar())


def _searched(
    lookup: DataFrame, index: Index, vectors: DataFrame | None, question_vectors: DataFrame | None,
) -> tuple[DataFrame, DataFrame]:
    """Per (lookup, take) its ``key``, its query_id and whether a document question asks it (``whole``); and the hits
    by query_id.

    Each distinct text is searched once, under the least id that asks it; with vectors for that id the search is
    hybrid, else by keywords.
    """
    wanted = staged(lookup.where("lookup is not null").groupBy("lookup", "take").agg(
        F.min("question_id").alias("least"), F.bool_or(F.col("tool") == "search_docs").alias("whole")), "answers-lookups")
    texts = wanted.groupBy(F.col("lookup").alias("query")).agg(F.min("least").alias("query_id"))
    if vectors is None or question_vectors is None:
        hits = ranking.search(texts, index, _MOST_PASSAGES)
    else:
        known = question_vectors.select(F.col("question_id").alias("query_id"), "embedding")
        seen = known.select("query_id").distinct()
        hits = ranking.search(texts.join(seen, "query_id", "left_semi"), index, _MOST_PASSAGES, known.join(texts.select("query_id"), "query_id", "left_semi"), vectors)
        hits = hits.unionByName(ranking.search(texts.join(seen, "query_id", "left_anti"), index, _MOST_PASSAGES))
    key = F.concat_ws("/", F.col("query_id").cast("string"), F.col("take").cast("string"))
    asked = wanted.join(texts.withColumnRenamed("query", "lookup"), "lookup").select(key.alias("key"), "query_id", "lookup", "take", "whole")
    return staged(asked, "answers-asked"), staged(hits, "answers-hits")


def _given(asked: DataFrame, hits: DataFrame, chunks: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Per key its passages in order, as (n, ``fields``): eight at most."""
    chosen = asked.select("key", "query_id", "take").join(hits, "query_id").where(F.col("rank") <= F.col("take"))
    found = chosen.join(chunks.select("id", *[f for f in fields if f not in hits.columns]), "id")
    return found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("n"), *fields))).alias("passages"))


def _or_none(passages: str, listed: DataFrame) -> Column:
    return F.coalesce(passages, F.array().cast(listed.schema[passages].dataType))


def _sources(asked: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(key, sources): the passages of a key without their texts."""
    listed = _given(asked, hits, chunks, ("id", "title", "section"))
    return asked.select("key").join(listed, "key", "left").select("key", _or_none("passages", listed).alias("sources"))


def _passages(asked: DataFrame, hits: DataFrame, chunks: DataFrame, index: Index) -> DataFrame:
    """(key, sources, extract, passages) for document questions: the extract of the first two passages, and all of
    them. Texts are dealt by chunk and then by key, and sentences are chosen where they lie."""
    asked = asked.where("whole")
    listed = _given(asked, hits, chunks, ("id", "title", "section", "text", "score", "method"))
    first = listed.select(F.col("key").alias("query_id"), F.explode(F.filter("passages", lambda p: p["n"] <= 2)).alias("p"))
    extracts = extractive_answers(first.select("query_id", "p.n", "p.score", "p.text"),
                                  asked.select(F.col("key").alias("query_id"), F.col("lookup").alias("query")), index.terms)
    # Texts that share an id share a key, and each asks for its own lookup.
    both = (
        extracts.select(F.col("query_id").alias("key"), F.col("answer").alias("extract"))
        .join(listed, "key", "left").withColumn("passages", _or_none("passages", listed)))
    sources = F.transform("passages", lambda p: F.struct(*[p[c].alias(c) for c in ("n", "id", "title", "section")]))
    return both.select("key", sources.alias("sources"), "extract", "passages")


def answer_batch(
    spark: SparkSession, questions: DataFrame, fleet: Fleet, chunks: DataFrame, index: Index,
    proposals: DataFrame | None = None, as_of: datetime | None = None, texts: DataFrame | None = None,
    vectors: DataFrame | None = None, question_vectors: DataFrame | None = None, corpus_version: str | None = None,
) -> DataFrame:
    """Answers (question_id, question, answer, tool, args, data, provider, fallback_reason, sources).

    ``proposals`` (question_id, tool, args) and ``texts`` (question_id, text) come from elsewhere. An invalid
    proposal falls back to the rule route. A text is used only with its own proposal; for passages it must cite
    one of those given and no other, else the passages' own sentences answer. ``fallback_reason`` is the first
    reason. ``vectors`` (id, pos, embedding) and ``question_vectors`` (question_id, embedding) make passage search
    hybrid. A "why" question answered with data gets up to three passages attached. ``data`` is the tool's whole
    result as JSON.
    """
    rules = quality.argument_rules(spark)
    asked = questions.select("question_id", routing.normalised(F.col("question")).alias("question"))
    facilities = fleet.units.groupBy("facility_code").agg(F.max("facility_name").alias("facility_name"))
    routed = routing.route(asked, facilities, index.terms).withColumn("provider", F.lit("rules")).withColumn(
        "fallback_reason", F.lit(None).cast("string"))
    if proposals is not None:
        tried = quality.validate_calls(proposals.select(F.col("question_id").alias("call_id"), "tool", "args"), rules).select(
            F.col("call_id").alias("question_id"), F.col("tool").alias("_tool"), F.col("args").alias("_args"),
            F.col("valid").alias("_valid"), F.concat_ws("; ", "reasons").alias("_why"))
        taken = F.coalesce("_valid", F.lit(False))
        routed = routed.join(tried, "question_id", "left").select(
            "question_id", "question", F.when(taken, F.col("_tool")).otherwise(F.col("tool")).alias("tool"),
            F.when(taken, F.col("_args")).otherwise(F.col("args")).alias("args"),
            F.when(taken, "proposed").otherwise("rules").alias("provider"),
            F.when(~F.col("_valid"), F.substring("_why", 1, 300)).alias("fallback_reason"))
    # Routed questions, the latest scored farms and the aged roll-up feed several branches each.
    routed = staged(routed, "answers-routed")
    checked = quality.validate_calls(routed.select(F.col("question_id").alias("call_id"), "tool", "args"), rules)
    calls = staged(typed_calls(checked.withColumnRenamed("call_id", "question_id")), "answers-calls")

    anchor, step = catalogue._anchor(fleet, as_of), fleet.interval_minutes
    scored = staged(_scored_days(fleet, as_of), "answers-scored")
    farms = staged(_latest_farms(scored, anchor), "answers-farms")
    aged = staged(_by_age(scored, anchor), "answers-aged")
    capped = between(fleet.dispatch, "interval_end", anchor - hours(fixed.MAX_HOURS), catalogue._upto(as_of)).where("semidispatch_cap")
    held = _aged(capped.join(fleet.units.select("duid", "region"), "duid"), anchor).groupBy("region", "age").agg(F.sum(held_back_mw()).alias("held"))
    worded = _underperformers(calls, farms)
    for part in (_curtailed(calls, farms), _facility(calls, aged, fleet.units, step),
                 _fleet(calls, aged, held, farms, step), _find(calls, fleet.units)):
        worded = worded.unionByName(part)

    # Passages: for document questions, and as guidance for diagnostic questions about data. Questions stay narrow until
    # the last join: a call's or a passage's whole result is moved once per distinct call, never with the questions.
    docs = F.col("tool") == "search_docs"
    why = ~docs & F.lower("question").rlike("(?U)" + fixed.DIAGNOSTIC_PATTERN) & (F.length("question").between(3, 300))
    lookup = routed.select("question_id", "question", "provider", "fallback_reason").join(
        calls.select("question_id", "tool", "args", "valid", "reasons", "call", "query", "k"), "question_id").withColumn(
        "lookup", F.when(docs & F.col("valid"), F.col("query")).when(why, F.col("question"))).withColumn(
        "take", F.when(docs, F.col("k")).otherwise(3)).drop("query", "k")
    if texts is None:
        lookup = lookup.withColumn("text", F.lit(None).cast("string"))
    else:
        lookup = lookup.join(texts.select("question_id", "text"), "question_id", "left")
    lookup = staged(lookup, "answers-narrow")
    asked, hits = _searched(lookup, index, vectors, question_vectors)
    worded = staged(worded.select("call", F.col("answer").alias("own"), "data"), "answers-worded")
    keyed = lookup.where(F.col("lookup").isNotNull()).join(asked.select("lookup", "take", "key"), ["lookup", "take"], "left")
    passages = _passages(asked, hits, chunks, index)
    found = F.to_json(F.struct("query", F.lit(corpus_version).alias("corpus_version"), F.col("passages").alias("results")))
    none = F.array().cast(passages.schema["sources"].dataType)
    parts = (
        keyed.where(docs).withColumnRenamed("lookup", "query").join(passages.withColumnRenamed("extract", "own"), "key", "left")
        .withColumn("sources", F.coalesce("sources", none)).withColumn("data", found),
        keyed.where(~docs).join(_sources(asked, hits, chunks), "key", "left").withColumn("sources", F.coalesce("sources", none)).join(worded, "call", "left"),
        lookup.where(F.col("lookup").isNull()).withColumn("sources", none).join(worded, "call", "left"))
    told = _told(parts[0])
    for part in parts[1:]:
        told = told.unionByName(_told(part))
    return told


def _told(rows: DataFrame) -> DataFrame:
    """The answer of each row from its proposed ``text`` if that holds, else its ``own``."""
    docs, mine = F.col("tool") == "search_docs", F.coalesce("_valid", F.lit(False))
    told = check_citations(rows.withColumnRenamed("valid", "_valid").withColumn("given", F.transform("sources", lambda p: p["n"])),
                           "text", "given").withColumnRenamed("reason", "_cites")
    offered = mine & (F.col("provider") == "proposed") & F.col("text").isNotNull()
    refused = F.when(offered, F.when(F.trim("text") == "", "empty answer").when(docs, F.col("_cites")))
    guidance = F.when(~docs & (F.size("sources") > 0), F.concat(
        F.lit(" Related guidance: "),
        F.array_join(F.transform("sources", lambda p: F.concat(p["title"], F.lit(" - "), p["section"], F.lit(" ["), p["n"].cast("string"), F.lit("]"))), "; "),
        F.lit("."))).otherwise("")
    return told.withColumn("_refused", refused).select(
        "question_id", "question",
        F.when(mine, F.concat(F.when(offered & F.col("_refused").isNull(), F.col("text")).otherwise(F.col("own")), guidance)).alias("answer"),
        "tool", "args", F.when(mine, F.col("data")).alias("data"),
        F.when(F.col("_refused").isNotNull(), "rules").otherwise(F.col("provider")).alias("provider"),
        F.coalesce("fallback_reason", F.when(~mine, F.concat_ws("; ", "reasons")), "_refused").alias("fallback_reason"), "sources")
