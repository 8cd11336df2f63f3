"""Registered queries for question routing. Questions are worded from every order, plus the user
turns of the conversations; suppliers stand in for facilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from heliofleet import fixed
from heliofleet.operators import quality, routing
from heliofleet.plans.bindings import sql_round, table
from heliofleet.plans.text_plans import SQL_CORPUS, index, q as quoted, sql_tokens
from heliofleet.session import configure

TEMPLATES = (
    "Which solar farms in {r} are underperforming   right now?",
    "Any farms below {n}% of expected",
    "How did Orchard {n} do in the last {n} hours?",
    "Western Ridge {n} output over the past {n} days",
    "Total generation in {r} this week",
    "Find farms in {r}",
    "What is economic curtailment?",
    "Is lake {n} losing output in the last hour",
    "Which farms are being curtailed in {r} today",
    "sup{n} performance over {n}h",
    "Compare the market for {n} hours in {r}",
    "Explain why western ridge sites trip",
    "Why are farms in {r} behind today? less than {n} percent",
    "and the onesh thing",
    "zzqx wwvk",
    "How much did the orchards make",
)
PLACES = ("NSW", "queensland", "Vic", "SA", "Tasmania", "the usa", "South   Australia")


def questions(spark, sf) -> DataFrame:
    configure(spark)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    template = F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), (k % len(TEMPLATES) + 1).cast("int"))
    place = F.element_at(F.array(*[F.lit(p) for p in PLACES]), (c % len(PLACES) + 1).cast("int"))
    worded = table(spark, sf, "orders").select(
        k.alias("question_id"), F.replace(F.replace(template, F.lit("{r}"), place), F.lit("{n}"), (c % 200).cast("string")).alias("question"))
    turns = table(spark, sf, "conversations").where("role = 'user'").select(
        (-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("question_id"), F.col("text").alias("question"))
    return worded.unionByName(turns).withColumn("question", routing.normalised(F.col("question")))


def facilities(spark, sf) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("SUP"), k).alias("facility_code"),
        F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Orchard "), k, F.lit(" Solar Farm")))
        .when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("Western Ridge "), k, F.lit(" Power Hub")))
        .otherwise(F.concat(F.lit("Lake "), k, F.lit(" Solar Park"))).alias("facility_name"))


def routed(spark, sf) -> DataFrame:
    return routing.route(questions(spark, sf), facilities(spark, sf), index(spark, sf).terms)


def routed_flat(spark, sf) -> DataFrame:
    return routed(spark, sf).select(
        "question_id", "tool", *[F.col("args")[a].alias(a) for a in ("facility", "hours", "region", "threshold", "query", "k")])


def golden(spark, sf) -> DataFrame:
    """What half of the templates should give; some rows are wrong on purpose."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    region = F.element_at(F.array(*[F.lit(x) for x in ("NSW1", "QLD1", "VIC1", "SA1", "TAS1")], F.lit(None).cast("string"), F.lit("SA1")), (c % 7 + 1).cast("int"))
    n = len(TEMPLATES)
    tool = F.when(k % n == 0, "underperformers").when(k % n == 2, "facility_performance").when(k % n == 5, "find_facilities").otherwise("fleet_summary")
    args = (
        F.when(k % n == 0, F.create_map(F.lit("region"), region))
        .when(k % n == 2, F.create_map(F.lit("facility"), F.concat(F.lit("sup"), c % 200), F.lit("hours"), F.greatest(F.lit(1), F.least(F.lit(168), c % 200)).cast("string")))
        .when(k % n == 5, F.create_map(F.lit("region"), F.lit(None).cast("string")))
        .otherwise(F.create_map(F.lit("hours"), F.lit("168"))))
    return table(spark, sf, "orders").select(k.alias("case_id"), tool.alias("tool"), args.alias("args"))


def checked(spark, sf) -> DataFrame:
    calls = routed(spark, sf).select(F.col("question_id").alias("case_id"), "tool", "args")
    return routing.check_calls(golden(spark, sf), calls, facilities(spark, sf), quality.argument_rules(spark))


def evaluated(spark, sf) -> DataFrame:
    timing = table(spark, sf, "orders").select((F.col("o_totalprice") / 1000).alias("latency_ms"))
    return routing.evaluate_routing(checked(spark, sf), timing)


# ---------- SQL twins ----------

def sql_questions() -> str:
    templates = "[" + ", ".join(quoted(t) for t in TEMPLATES) + "]"
    places = "[" + ", ".join(quoted(p) for p in PLACES) + "]"
    return f"""
raw AS (SELECT o_orderkey AS question_id, replace(replace({templates}[o_orderkey % {len(TEMPLATES)} + 1], '{{r}}', {places}[o_custkey % {len(PLACES)} + 1]), '{{n}}', CAST(o_custkey % 200 AS VARCHAR)) AS t FROM orders
        UNION ALL SELECT -1 - conv_id * 1000 - turn, text FROM conversations WHERE role = 'user'),
ques AS (SELECT question_id, substr(trim(regexp_replace(t, '\\s+', ' ', 'g')), 1, 500) AS question FROM raw),
low AS (SELECT *, lower(question) AS ql FROM ques)"""


def sql_slots() -> str:
    h, d = quoted(fixed.HOURS_PATTERN), quoted(fixed.DAYS_PATTERN)
    region = " ".join(f"WHEN regexp_matches(ql, {quoted(p)}) THEN {quoted(c)}" for p, c in fixed.REGION_PATTERNS)
    return f"""
slots AS (SELECT *, CAST(CASE WHEN regexp_matches(ql, {h}) THEN least(168, greatest(1, CAST(regexp_extract(ql, {h}, 1) AS BIGINT)))
    WHEN regexp_matches(ql, {d}) THEN least(168, greatest(1, 24 * CAST(regexp_extract(ql, {d}, 1) AS BIGINT)))
    WHEN regexp_matches(ql, '\\bweek\\b') THEN 168 WHEN regexp_matches(ql, '\\b(last|past|this) hour\\b') THEN 1 ELSE 24 END AS INTEGER) AS hours,
  CASE {region} END AS region,
  CASE WHEN regexp_matches(ql, {quoted(fixed.THRESHOLD_PATTERN)}) THEN least(1.5, greatest(0.05, CAST(regexp_extract(ql, {quoted(fixed.THRESHOLD_PATTERN)}, 1) AS DOUBLE) / 100)) END::DOUBLE AS threshold FROM low)"""


SQL_SUPPLIERS = """
sup AS (SELECT 'SUP' || s_suppkey AS code, CASE s_suppkey % 3 WHEN 0 THEN 'Orchard ' || s_suppkey || ' Solar Farm' WHEN 1 THEN 'Western Ridge ' || s_suppkey || ' Power Hub'
        ELSE 'Lake ' || s_suppkey || ' Solar Park' END AS name, s_suppkey AS n FROM supplier)"""

SQL_MATCH = """
cand AS (SELECT code, name, lower(code) AS c FROM sup
  UNION ALL SELECT code, name, CASE n % 3 WHEN 0 THEN 'orchard ' WHEN 1 THEN 'western ridge ' ELSE 'lake ' END || n FROM sup
  UNION ALL SELECT code, name, 'western ridge' FROM sup WHERE n % 3 = 1 UNION ALL SELECT code, name, 'orchard' FROM sup WHERE n % 3 = 0),
firsts AS (SELECT c, arg_min(code, (name, code)) AS code, min(name) AS name FROM cand WHERE length(c) >= 4 GROUP BY 1),
fac AS (SELECT question_id, arg_min(code, (-length(c), name, code)) AS facility
        FROM (SELECT question_id, ' ' || regexp_replace(ql, '[^a-z0-9_]+', ' ', 'g') || ' ' AS padded FROM low), firsts
        WHERE contains(padded, ' ' || c || ' ') GROUP BY 1)"""

SQL_NAMES = f"{SQL_SUPPLIERS},{SQL_MATCH}"


def sql_route(suppliers: str = SQL_SUPPLIERS) -> str:
    def says(p):
        return f"regexp_matches(ql, {quoted(p)})"
    live = says(fixed.LIVE_PATTERN)
    return f"""{SQL_CORPUS.strip()}, {sql_questions().strip()}, {sql_slots().strip()}, {suppliers.strip()}, {SQL_MATCH.strip()},
hit AS (SELECT DISTINCT question_id FROM ({sql_tokens('ques', 'question_id', 'question', True)}) WHERE term IN (SELECT term FROM idf)),
routed AS (SELECT s.*, f.facility, CASE WHEN f.facility IS NOT NULL THEN 'facility_performance'
   WHEN {says(fixed.DOCS_PATTERN)} AND NOT {live} THEN 'search_docs'
   WHEN {says(fixed.CURTAIL_PATTERN)} THEN 'curtailed_farms'
   WHEN {says(fixed.UNDER_PATTERN)} AND (region IS NOT NULL OR {live} OR {says(fixed.DATA_ASK_PATTERN)}) THEN 'underperformers'
   WHEN {says(fixed.LIST_PATTERN)} THEN 'find_facilities'
   WHEN region IS NULL AND NOT {live} AND NOT {says(fixed.FLEET_PATTERN)} AND s.question_id IN (SELECT question_id FROM hit) THEN 'search_docs'
   ELSE 'fleet_summary' END AS tool FROM slots s LEFT JOIN fac f USING (question_id))"""


N = len(TEMPLATES)
SQL_CHECKED = f"""{{0}}, gold AS (SELECT o_orderkey AS case_id, o_orderkey % {N} AS k,
  ['NSW1','QLD1','VIC1','SA1','TAS1',NULL,'SA1'][o_custkey % 7 + 1] AS wr, 'sup' || (o_custkey % 200) AS wf, greatest(1, least(168, o_custkey % 200)) AS wh FROM orders),
verdict AS (SELECT case_id, CASE
  WHEN tool <> CASE k WHEN 0 THEN 'underperformers' WHEN 2 THEN 'facility_performance' WHEN 5 THEN 'find_facilities' ELSE 'fleet_summary' END THEN false
  WHEN k = 0 THEN region IS NOT DISTINCT FROM wr
  WHEN k = 2 THEN hours = wh AND (lower(facility) = wf OR coalesce((SELECT contains(lower(name), lower(facility)) FROM sup WHERE lower(code) = wf), false))
  WHEN k = 5 THEN region IS NULL
  ELSE hours = 168 END AS passed FROM gold JOIN routed ON question_id = case_id)"""

REGISTERED = {
    "normalise_question": (questions, f"WITH {sql_questions().strip()} SELECT * FROM ques"),
    "extract_slots": (
        lambda s, d: routing.extract_slots(questions(s, d)).select("question_id", "hours", "region", "threshold"),
        f"WITH {sql_questions().strip()}, {sql_slots().strip()} SELECT question_id, hours, region, threshold FROM slots"),
    "match_facility": (
        lambda s, d: routing.match_facility(questions(s, d), facilities(s, d)),
        f"WITH {sql_questions().strip()}, {SQL_NAMES.strip()} SELECT * FROM fac"),
    "route_questions": (
        routed_flat,
        f"""WITH {sql_route()} SELECT question_id, tool, CASE WHEN tool = 'facility_performance' THEN facility END AS facility,
 CASE WHEN tool IN ('facility_performance', 'fleet_summary') THEN CAST(hours AS VARCHAR) END AS hours,
 CASE WHEN tool NOT IN ('facility_performance', 'search_docs') THEN region END AS region,
 CASE WHEN tool = 'underperformers' THEN CAST(threshold AS VARCHAR) END AS threshold,
 CASE WHEN tool = 'search_docs' THEN question END AS query, CASE WHEN tool = 'search_docs' THEN '4' END AS k FROM routed"""),
    "check_routing": (
        lambda s, d: checked(s, d).select("case_id", "passed"),
        f"WITH {SQL_CHECKED.format(sql_route())} SELECT case_id, passed FROM verdict"),
    "evaluate_routing": (
        evaluated,
        f"""WITH {SQL_CHECKED.format(sql_route())} SELECT count(*) AS total, count(*) FILTER (passed) AS passed,
 {sql_round('avg(CASE WHEN passed THEN 1.0 ELSE 0 END)', 3)} AS accuracy,
 (SELECT {sql_round('median(o_totalprice / 1000)', 1)} FROM orders) AS p50_ms,
 (SELECT {sql_round('list_sort(list(o_totalprice / 1000))[CAST(floor(0.95 * (count(*) - 1)) AS BIGINT) + 1]', 1)} FROM orders) AS p95_ms FROM verdict"""),
}

