"""Questions to tool calls as batch classification, and its evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from heliofleet import fixed
from heliofleet.functions.columns import rounded
from heliofleet.functions.text import collapsed
from heliofleet.operators import quality
from heliofleet.operators.evaluation import rank_percentiles
from heliofleet.operators.ranking import query_terms
from heliofleet.session import staged


def normalised(question: Column) -> Column:
    return F.substring(collapsed(question), 1, fixed.MAX_QUESTION_CHARS)


def _says(q: Column, pattern: str) -> Column:
    return q.rlike("(?U)" + pattern)


def _number_in(q: Column, pattern: str) -> Column:
    """First number a pattern finds, NULL without one; absurdly long ones read as a million."""
    digits = F.regexp_extract(q, "(?U)" + pattern, 1)
    return F.when(digits != "", F.coalesce(F.when(F.length(digits) < 10, digits.try_cast("bigint")), F.lit(1_000_000)))


def hours_of(q: Column) -> Column:
    def clamp(n):
        return F.greatest(F.lit(1), F.least(F.lit(fixed.MAX_HOURS), n)).cast("int")
    hours, days = _number_in(q, fixed.HOURS_PATTERN), _number_in(q, fixed.DAYS_PATTERN)
    return (
        F.when(hours.isNotNull(), clamp(hours))
        .when(days.isNotNull(), clamp(days * 24))
        .when(_says(q, fixed.WEEK_PATTERN), fixed.MAX_HOURS)
        .when(_says(q, fixed.ONE_HOUR_PATTERN), 1)
        .otherwise(fixed.DEFAULT_HOURS)
    )


def region_of(q: Column) -> Column:
    return F.coalesce(*[F.when(_says(q, pattern), code) for pattern, code in fixed.REGION_PATTERNS])


def threshold_of(q: Column) -> Column:
    percent = _number_in(q, fixed.THRESHOLD_PATTERN)
    return F.when(percent.isNotNull(), F.greatest(F.lit(0.05), F.least(F.lit(1.5), percent / 100)))


def extract_slots(questions: DataFrame) -> DataFrame:
    q = F.lower("question")
    return questions.withColumns({"hours": hours_of(q), "region": region_of(q), "threshold": threshold_of(q)})


def name_candidates(facilities: DataFrame) -> DataFrame:
    """Phrases that identify a facility (candidate, code, name): one row per phrase, the facility
    that comes first by name keeping a shared one."""
    bare = collapsed(F.regexp_replace(F.lower("facility_name"), "(?U)" + fixed.NAME_NOISE_PATTERN, " "))
    w = F.col("_words")
    distinctive = (F.size(w) > 1) & (F.length(w[0]) >= 6) & ~w[0].isin(*fixed.GENERIC_FIRST_WORDS)
    phrases = F.array(
        F.lower("facility_code"), F.array_join(w, " "),
        F.when(F.size(w) > 2, F.array_join(F.slice(w, 1, 2), " ")), F.when(distinctive, F.try_element_at(w, F.lit(1))))
    return (
        facilities.withColumn("_words", F.split(bare, " "))
        .select("facility_code", "facility_name", F.explode(F.array_distinct(F.array_compact(phrases))).alias("candidate"))
        .where(F.length("candidate") >= 4)
        .groupBy("candidate").agg(F.min(F.struct("facility_name", "facility_code")).alias("_first"))
        .select("candidate", F.col("_first.facility_code").alias("facility_code"), F.col("_first.facility_name").alias("facility_name"))
    )


def match_facility(questions: DataFrame, facilities: DataFrame) -> DataFrame:
    """(question_id, facility) for questions naming a facility; the longest phrase wins.

    Questions meet phrases on the phrase's whole run of words (an equi join of the question's runs
    up to the longest phrase), so a word that many names share pairs nothing. The phrase is then
    looked for on word boundaries, which settles the marks between words.
    """
    word = F.lit(r"(?U)\w+")
    words = F.regexp_extract_all("candidate", word, F.lit(0))
    # Written, so that their size is known before the runs of all questions would be dealt to meet them.
    phrases = staged(name_candidates(facilities).withColumn("_run", F.array_join(words, " ")).withColumn("_n", F.size(words)), "phrases")
    asked = questions.select("question_id", F.lower("question").alias("_q")).withColumn(
        "_words", F.regexp_extract_all("_q", word, F.lit(0))).where(F.size("_words") > 0)
    asked = asked.withColumn("_longest", F.least(F.size("_words"), phrases.agg(F.coalesce(F.max("_n"), F.lit(1))).scalar()))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.col("_longest")), lambda n: F.transform(
        F.sequence(F.lit(1), F.size("_words") - n + 1), lambda i: F.array_join(F.slice("_words", i, n), " "))))
    asked = asked.select("question_id", "_q", F.explode(F.array_distinct(runs)).alias("_run"))
    pattern = F.concat(F.lit(r"(?U)\b\Q"), "candidate", F.lit(r"\E\b"))
    return (
        asked.join(phrases, "_run")
        .where(F.contains("_q", "candidate")).where(F.regexp_like("_q", pattern))
        .groupBy("question_id")
        .agg(F.min_by("facility_code", F.struct(-F.length("candidate"), "facility_name", "facility_code")).alias("facility"))
    )


def route(questions: DataFrame, facilities: DataFrame, terms: DataFrame) -> DataFrame:
    """One tool call per question (question_id, question, tool, args).

    Rules go in order and the first that holds names the tool. Only questions that no earlier rule decides
    are taken apart and held against the corpus ``terms``.
    """
    q = F.lower("question")
    region = F.col("region").isNotNull()
    live = _says(q, fixed.LIVE_PATTERN)
    early = (
        F.when(F.col("facility").isNotNull(), "facility_performance")
        .when(_says(q, fixed.DOCS_PATTERN) & ~live, "search_docs")
        .when(_says(q, fixed.CURTAIL_PATTERN), "curtailed_farms")
        .when(_says(q, fixed.UNDER_PATTERN) & (region | live | _says(q, fixed.DATA_ASK_PATTERN)), "underperformers")
        .when(_says(q, fixed.LIST_PATTERN), "find_facilities")
        .when(region | live | _says(q, fixed.FLEET_PATTERN), "fleet_summary")
    )
    decided = staged(extract_slots(questions).join(match_facility(questions, facilities), "question_id", "left").select(
        "question_id", "question", "hours", "region", "threshold", "facility", early.alias("tool")), "questions")
    open_ = decided.where("tool is null").select(F.col("question_id").alias("query_id"), F.col("question").alias("query"))
    covered = query_terms(open_).join(terms.select("term"), "term", "left_semi").select(F.col("query_id").alias("question_id")).distinct()

    def args(**values):
        return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    with_threshold = F.when(F.col("threshold").isNotNull(), args(region=F.col("region"), threshold=F.col("threshold")))
    by_tool = (
        F.when(F.col("tool") == "facility_performance", args(facility=F.col("facility"), hours=F.col("hours")))
        .when(F.col("tool") == "search_docs", args(query=F.col("question"), k=F.lit(4)))
        .when(F.col("tool") == "underperformers", F.coalesce(with_threshold, args(region=F.col("region"))))
        .when(F.col("tool") == "fleet_summary", args(hours=F.col("hours"), region=F.col("region")))
        .otherwise(args(region=F.col("region")))
    )
    late = F.when(F.coalesce("_covered", F.lit(False)), "search_docs").otherwise("fleet_summary")
    return (
        decided.join(covered.withColumn("_covered", F.lit(True)), "question_id", "left")
        .withColumn("tool", F.coalesce("tool", late)).withColumn("args", by_tool)
        .select("question_id", "question", "tool", "args")
    )


def check_calls(golden: DataFrame, calls: DataFrame, facilities: DataFrame, rules: DataFrame) -> DataFrame:
    """Errors per case. ``golden`` (case_id, tool, args map), ``calls`` (case_id, tool, args map).

    Tool first, then argument bounds, then only the arguments the golden row lists; a listed null
    must stay null.
    """
    checked = quality.validate_calls(calls.select(F.col("case_id").alias("call_id"), "tool", "args"), rules).select(
        F.col("call_id").alias("case_id"), F.col("tool").alias("got_tool"), F.col("args").alias("got"), "valid", "reasons")
    wanted = golden.select("case_id", F.col("tool").alias("want_tool"), F.col("args").alias("want"))
    names = facilities.select(F.lower("facility_code").alias("_code"), F.lower("facility_name").alias("_full"))
    both = (
        wanted.join(checked, "case_id", "left")
        .withColumn("_code", F.lower(F.col("want")["facility"])).join(names, "_code", "left"))

    def compare(key: Column, want: Column) -> Column:
        got = F.col("got")[key]
        text = F.lower(F.coalesce(got, F.lit("None")))
        facility = (text == F.lower(want)) | ((F.length(text) >= 4) & F.coalesce(F.contains(F.col("_full"), text), F.lit(False)))
        numeric = F.abs(got.try_cast("double") - want.try_cast("double")) <= 1e-6
        same = F.when(key == "facility", facility).otherwise(F.coalesce(numeric, got.eqNullSafe(want)))
        return F.when(~same, F.concat(key, F.lit(" "), F.coalesce(got, F.lit("null")), F.lit(" != "), F.coalesce(want, F.lit("null"))))

    argument_errors = F.array_compact(F.transform(F.map_entries(F.coalesce("want", F.create_map().cast("map<string,string>"))),
                                                  lambda e: compare(e["key"], e["value"])))
    errors = (
        F.when(F.col("got_tool").isNull(), F.array(F.lit("no call")))
        .when(F.col("got_tool") != F.col("want_tool"), F.array(F.concat(F.lit("tool "), "got_tool", F.lit(" != "), "want_tool")))
        .when(~F.col("valid"), F.col("reasons"))
        .otherwise(argument_errors))
    return both.select("case_id", errors.alias("errors")).withColumn("passed", F.size("errors") == 0)


def evaluate_routing(checked: DataFrame, latencies: DataFrame | None = None) -> DataFrame:
    """One row: total, passed, accuracy; with ``latencies`` (latency_ms) also p50 and p95."""
    out = checked.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"),
        rounded(F.avg(F.col("passed").cast("int")), 3).alias("accuracy"))
    if latencies is not None:
        timed = rank_percentiles(latencies.withColumn("_all", F.lit(1)), "latency_ms", ["_all"])
        out = out.withColumns({
            "p50_ms": rounded(timed.select("p50").scalar(), 1), "p95_ms": rounded(timed.select("p95").scalar(), 1)})
    return out
