"""The registered batch of answers: every order's question and every user turn, answered over the bound fleet.

The ten farms carry names that the questions use and market regions. Orders also propose calls and
texts, some of them invalid, so that every step of the cascade is taken.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from heliofleet import fixed
from heliofleet.operators import answers
from heliofleet.operators.fleet import Fleet
from heliofleet.plans.bindings import SQL_PERFORMANCE, SQL_VIEWS, fleet, sql_round, table
from heliofleet.plans.fleet_plans import AS_OF, AS_OF_SQL, sql_latest, sql_window
from heliofleet.plans.routing_plans import questions, sql_route
from heliofleet.plans.text_plans import corpus, index, q as quoted, sql_best, sql_hits

PLACES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")  # market regions in this order
LOOKUPS = ("en src1", "de src2 src14", "src7", "zzqx")
# The list that a tool's data holds; looked for in the data of its tools only, which may be long.
LISTS = {"farms": ("underperformers", "curtailed_farms"), "hourly": ("facility_performance",), "regions": ("fleet_summary",),
         "facilities": ("find_facilities",), "results": ("search_docs",)}


def named_fleet(spark, sf) -> Fleet:
    f = fleet(spark, sf)
    regions = F.create_map(*[F.lit(x) for pair in zip(PLACES, fixed.REGION_CODES) for x in pair])

    def named(df: DataFrame) -> DataFrame:
        n = F.substring("facility_code", 2, 9)
        name = (F.when(n % 3 == 0, F.concat(F.lit("Orchard "), n, F.lit(" Solar Farm")))
                .when(n % 3 == 1, F.concat(F.lit("Western Ridge "), n, F.lit(" Power Hub"))).otherwise(F.concat(F.lit("Lake "), n, F.lit(" Solar Park"))))
        if "facility_name" in df.columns:
            df = df.withColumn("facility_name", name)
        return df.withColumn("facility_code", F.concat(F.lit("SUP"), n))

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("region", regions[F.col("region")])

    return replace(f, units=placed(named(f.units)), weather=named(f.weather), prices=placed(f.prices))


def _proposing(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").where("o_orderkey % 5 = 0").select(
        F.col("o_orderkey").alias("question_id"), (F.col("o_orderkey") % 3).alias("kind"), F.col("o_custkey").alias("c"))


def proposals(spark, sf) -> DataFrame:
    def args(*pairs: str | Column) -> Column:
        return F.create_map(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in pairs])
    lookup = F.element_at(F.array(*[F.lit(x) for x in LOOKUPS]), (F.col("c") % len(LOOKUPS) + 1).cast("int"))
    return _proposing(spark, sf).select(
        "question_id", F.when(F.col("kind") == 0, "fleet_summary").when(F.col("kind") == 1, "search_docs").otherwise("nowhere").alias("tool"),
        F.when(F.col("kind") == 0, args("hours", F.col("c") % 200)).when(F.col("kind") == 1, args("query", lookup, "k", F.col("c") % 10 + 1)).alias("args"))


def texts(spark, sf) -> DataFrame:
    cited = F.when(F.col("c") % 7 == 0, "Seen there.").otherwise(F.concat(F.lit("Seen in ["), F.col("c") % 4, F.lit("].")))
    return _proposing(spark, sf).where("kind = 1 or (kind = 0 and c % 2 = 0)").select(
        "question_id", F.when(F.col("kind") == 1, cited).otherwise(F.lit("All fine.")).alias("text"))


def answered(spark, sf) -> DataFrame:
    """Every question answered at a fixed instant; ``n_rows`` counts the rows that ``data`` holds."""
    out = answers.answer_batch(spark, questions(spark, sf), named_fleet(spark, sf), corpus(spark, sf), index(spark, sf),
                               proposals(spark, sf), as_of=AS_OF, texts=texts(spark, sf))
    held = F.coalesce(*[F.when(F.col("tool").isin(*tools), F.json_array_length(F.get_json_object("data", f"$.{part}"))) for part, tools in LISTS.items()])
    return out.select("question_id", "question", "answer", "tool", "provider", "fallback_reason", F.size("sources").alias("n_sources"), held.alias("n_rows"))


# ---------- SQL twin ----------

def _pct(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'n/a' ELSE concat(CAST(round_even({x} * 100, 0) AS BIGINT), '%') END"


def _one(x: str) -> str:
    return f"coalesce(printf('%.1f', {x}), 'None')"


def _name(n: str) -> str:
    return f"CASE {n} % 3 WHEN 0 THEN concat('Orchard ', {n}, ' Solar Farm') WHEN 1 THEN concat('Western Ridge ', {n}, ' Power Hub') ELSE concat('Lake ', {n}, ' Solar Park') END"


REGION_SQL = "CASE region " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in zip(PLACES, fixed.REGION_CODES)) + " END"
IN_REGION = "CASE WHEN f.region IS NULL THEN '' ELSE concat(' in ', f.region) END"
SQL_FARMS = f"sup AS (SELECT DISTINCT concat('SUP', user_id % 10) AS code, {_name('(user_id % 10)')} AS name, user_id % 10 AS n FROM events)"
LOOKUPS_SQL = "[" + ", ".join(quoted(x) for x in LOOKUPS) + "]"

SQL_ANSWERS = f"""WITH {SQL_VIEWS.strip()}, {SQL_PERFORMANCE.strip()}, {sql_route(SQL_FARMS)},
farm AS (SELECT concat('SUP', uid % 10) AS code, max({_name('(uid % 10)')}) AS name, max({REGION_SQL}) AS region, {sql_round('sum(capacity_mw)', 1)} AS capacity, uid % 10 AS n
  FROM units GROUP BY uid % 10),
week AS (SELECT code, name, farm.region, perf.* EXCLUDE (facility_code, facility_name, region) FROM perf JOIN farm ON farm.n = CAST(substr(facility_code, 2) AS INTEGER)
  WHERE {sql_window(168, AS_OF_SQL)}),
late AS (SELECT * FROM week WHERE interval_end = {sql_latest(AS_OF_SQL)}),
prop AS (SELECT o_orderkey AS question_id, o_orderkey % 3 AS kind, o_custkey AS c,
  CASE o_orderkey % 3 WHEN 0 THEN o_custkey % 200 BETWEEN 1 AND 168 WHEN 1 THEN o_custkey % 10 <= 7 ELSE false END AS taken FROM orders WHERE o_orderkey % 5 = 0),
f AS (SELECT r.question_id, r.question, coalesce(taken, false) AS taken, p.c, p.kind, r.facility,
  CASE WHEN taken THEN CASE kind WHEN 0 THEN 'fleet_summary' ELSE 'search_docs' END ELSE tool END AS tool,
  CASE WHEN NOT taken THEN CASE kind WHEN 0 THEN 'invalid hours' WHEN 1 THEN 'invalid k' ELSE 'unknown tool' END END AS why_not,
  CASE WHEN taken AND kind = 0 THEN c % 200 ELSE hours END AS hours, CASE WHEN taken THEN NULL ELSE region END AS region, coalesce(threshold, 0.6) AS threshold,
  CASE WHEN taken THEN {LOOKUPS_SQL}[c % {len(LOOKUPS)} + 1] ELSE question END AS lookup, CASE WHEN taken THEN c % 10 + 1 ELSE 4 END AS k,
  CASE WHEN taken AND kind = 1 THEN CASE WHEN c % 7 = 0 THEN 'Seen there.' ELSE concat('Seen in [', c % 4, '].') END WHEN taken AND c % 2 = 0 THEN 'All fine.' END AS offer
  FROM routed r LEFT JOIN prop p USING (question_id)),
look AS (SELECT question_id, CASE WHEN tool = 'search_docs' THEN lookup ELSE question END AS lookup, CASE WHEN tool = 'search_docs' THEN k ELSE 3 END AS take FROM f
  WHERE CASE WHEN tool = 'search_docs' THEN length(lookup) BETWEEN 3 AND 300
        ELSE regexp_matches(lower(question), {quoted(fixed.DIAGNOSTIC_PATTERN)}) AND length(question) BETWEEN 3 AND 300 END),
lk AS (SELECT lookup, min(question_id) AS lid FROM look GROUP BY 1), {sql_hits('lk', 'lid', 'lookup', 'a').strip()}, {sql_best('lid', 'a').strip()},
src AS (SELECT question_id, lid, take, count(doc_id) AS m,
   string_agg(concat(lang, ' - ', source, ' [', rank, ']'), '; ' ORDER BY rank) AS cites
  FROM look JOIN lk USING (lookup) LEFT JOIN alex USING (lid) LEFT JOIN documents USING (doc_id) WHERE rank IS NULL OR rank <= take AND rank <= 8 GROUP BY ALL),
ext AS (SELECT s.question_id, coalesce(string_agg(t, ' ' ORDER BY n), {quoted(fixed.NO_PASSAGES_TEXT)}) AS extract FROM src s LEFT JOIN apiece p ON p.lid = s.lid AND p.n <= s.take GROUP BY 1),
under AS (SELECT f.question_id, f.region AS asked, l.*, row_number() OVER (PARTITION BY f.question_id ORDER BY {sql_round('performance_index', 2)}, code) AS place
  FROM f JOIN late l ON f.tool = 'underperformers' AND (f.region IS NULL OR f.region = l.region) AND performance_index < f.threshold AND coalesce(status, '') NOT LIKE '%curtailed' QUALIFY place <= 10),
a_under AS (SELECT f.question_id, coalesce(n, 0) AS n_rows,
  CASE WHEN n IS NULL THEN concat('No farms', {IN_REGION}, ' are below ', {_pct('f.threshold')}, ' of expected output at the latest daylight interval.', note)
   ELSE concat('At ', clock_at, ' AEST, ', n, ' farm(s)', {IN_REGION}, ' were below ', {_pct('f.threshold')}, ' of expected: ', parts, '.', note) END AS a
  FROM f LEFT JOIN (SELECT question_id, count(*) AS n, strftime(max(interval_end) + INTERVAL 10 HOUR, '%H:%M') AS clock_at,
     string_agg(concat(name, ' (', region, ') at ', {_pct(sql_round('performance_index', 2))}, ' - ', {_one(sql_round('actual_mw', 1))}, ' MW vs ', {_one(sql_round('expected_mw', 1))}, ' MW expected'),
                '; ' ORDER BY place) FILTER (place <= 5) AS parts FROM under GROUP BY 1) u USING (question_id),
   LATERAL (SELECT CASE WHEN count(*) > 0 THEN concat(' ', least(count(*), 25), ' curtailed farm(s) were excluded as not faults.') ELSE '' END AS note
            FROM late WHERE status LIKE '%curtailed' AND (f.region IS NULL OR late.region = f.region)) x WHERE f.tool = 'underperformers'),
cut AS (SELECT f.question_id, l.*, row_number() OVER (PARTITION BY f.question_id ORDER BY expected_mw - actual_mw DESC, code) AS place
  FROM f JOIN late l ON f.tool = 'curtailed_farms' AND (f.region IS NULL OR f.region = l.region) AND status LIKE '%curtailed' QUALIFY place <= 10),
a_cut AS (SELECT f.question_id, coalesce(n, 0) AS n_rows, CASE WHEN n IS NULL THEN concat('No farms', {IN_REGION}, ' were curtailed at the latest daylight interval.')
   ELSE concat('At ', clock_at, ' AEST, ', n, ' farm(s)', {IN_REGION}, ' were producing below the weather because of curtailment, not faults: ', parts, '.') END AS a
  FROM f LEFT JOIN (SELECT question_id, count(*) AS n, strftime(max(interval_end) + INTERVAL 10 HOUR, '%H:%M') AS clock_at,
     string_agg(concat(name, ' (', region, ') at ', {_one(sql_round('actual_mw', 1))}, ' MW, ', CASE WHEN status = 'curtailed' THEN concat({_one(sql_round('curtailed_mw', 1))}, ' MW held back by a dispatch cap')
        ELSE concat('price $', {sql_round('rrp', 2)}, '/MWh, likely curtailed (provisional)') END), '; ' ORDER BY place) FILTER (place <= 5) AS parts FROM cut GROUP BY 1) c USING (question_id)
  WHERE f.tool = 'curtailed_farms'),
per AS (SELECT code, hours, count(w.interval_end) AS n, {sql_round('sum(actual_mw)', 1)} AS energy, {sql_round('max(actual_mw)', 1)} AS peak, {sql_round('avg(performance_index)', 2)} AS ix,
   {sql_round('min(performance_index)', 2)} AS ix_min, {sql_round('sum(curtailed_mw)', 1)} AS cut, count(DISTINCT date_trunc('hour', w.interval_end)) AS clock
  FROM (SELECT DISTINCT facility AS code, hours FROM f WHERE tool = 'facility_performance') d LEFT JOIN (SELECT code, interval_end, actual_mw, performance_index, curtailed_mw FROM week) w
   USING (code) WHERE w.interval_end > {AS_OF_SQL} - to_hours(hours) GROUP BY ALL),
a_fac AS (SELECT f.question_id, coalesce(clock, 0) AS n_rows, CASE WHEN per.n IS NULL THEN concat('No readings for ', name, ' in the last ', f.hours, ' hours.')
   ELSE concat(name, ' (', farm.region, ', ', {_one('capacity')}, ' MW) produced ', {_one('energy')}, ' MWh in the last ', f.hours, ' h, peaking at ', {_one('peak')},
     ' MW. Average performance index ', {_pct('ix')}, ' (lowest ', {_pct('ix_min')}, ').', CASE WHEN coalesce(cut, 0) <> 0 THEN concat(' ', {_one('cut')}, ' MWh was curtailed by AEMO dispatch caps.') ELSE '' END) END AS a
  FROM f JOIN farm ON farm.code = f.facility LEFT JOIN per ON per.code = f.facility AND per.hours = f.hours WHERE f.tool = 'facility_performance'),
wins AS (SELECT DISTINCT hours, region FROM f WHERE tool = 'fleet_summary'),
reg AS (SELECT wins.hours, wins.region AS asked, w.region, {sql_round('sum(actual_mw)', 1)} AS energy, count(DISTINCT code) AS farms, {sql_round('avg(performance_index)', 2)} AS ix
  FROM wins JOIN week w ON (wins.region IS NULL OR wins.region = w.region) AND w.interval_end > {AS_OF_SQL} - to_hours(wins.hours) GROUP BY ALL),
flag AS (SELECT region, count(*) FILTER (status = 'underperforming') AS u, count(*) FILTER (status LIKE '%curtailed') AS c FROM late GROUP BY 1),
told AS (SELECT hours, asked, count(*) AS n, sum(energy) AS total, string_agg(concat(region, ' ', {_one('energy')}, ' MWh from ', farms, ' farms (avg index ', {_pct('ix')}, ', ', coalesce(u, 0),
   ' underperforming and ', coalesce(c, 0), ' curtailed at the last daylight interval)'), '; ' ORDER BY energy DESC, region) AS parts FROM reg LEFT JOIN flag USING (region) GROUP BY 1, 2),
a_fleet AS (SELECT f.question_id, coalesce(n, 0) AS n_rows, CASE WHEN n IS NULL THEN concat('No readings in the last ', f.hours, ' hours.')
   ELSE concat('Last ', f.hours, ' h: ', {_one('total')}, ' MWh in total. ', parts, '.') END AS a
  FROM f LEFT JOIN told ON told.hours = f.hours AND told.asked IS NOT DISTINCT FROM f.region WHERE f.tool = 'fleet_summary'),
a_find AS (SELECT f.question_id, count(farm.code) AS n_rows, concat(count(farm.code), ' solar farms', {IN_REGION}, ': ',
   coalesce(array_to_string(list(farm.name ORDER BY farm.name, farm.code) FILTER (farm.code IS NOT NULL)[1:10], ', '), ''), CASE WHEN count(farm.code) > 10 THEN ' ...' ELSE '' END) AS a
  FROM f LEFT JOIN farm ON f.region IS NULL OR farm.region = f.region WHERE f.tool = 'find_facilities' GROUP BY f.question_id, f.region),
worded AS (SELECT * FROM a_under UNION ALL SELECT * FROM a_cut UNION ALL SELECT * FROM a_fac UNION ALL SELECT * FROM a_fleet UNION ALL SELECT * FROM a_find),
judged AS (SELECT f.*, coalesce(m, 0) AS m, cites, extract, w.a, w.n_rows, f.tool <> 'search_docs' OR s.question_id IS NOT NULL AS valid,
   CASE WHEN f.offer IS NOT NULL AND f.tool = 'search_docs' THEN CASE WHEN m > 0 AND c % 7 = 0 THEN 'answer cites no passages'
     WHEN c % 7 <> 0 AND NOT (c % 4 BETWEEN 1 AND m) THEN concat('answer cites unknown passages [', c % 4, ']') END END AS refused
  FROM f LEFT JOIN src s USING (question_id) LEFT JOIN ext USING (question_id) LEFT JOIN worded w USING (question_id))
SELECT question_id, question, tool, CASE WHEN taken AND refused IS NULL THEN 'proposed' ELSE 'rules' END AS provider,
 coalesce(why_not, CASE WHEN NOT valid THEN 'invalid query' END, refused) AS fallback_reason, CAST(m AS INTEGER) AS n_sources,
 CASE WHEN valid THEN CAST(CASE WHEN tool = 'search_docs' THEN m ELSE n_rows END AS INTEGER) END AS n_rows,
 CASE WHEN valid THEN concat(CASE WHEN offer IS NOT NULL AND refused IS NULL THEN offer WHEN tool = 'search_docs' THEN extract ELSE a END,
   CASE WHEN tool <> 'search_docs' AND m > 0 THEN concat(' Related guidance: ', cites, '.') ELSE '' END) END AS answer FROM judged"""

REGISTERED = {"answer_questions": (answered, SQL_ANSWERS)}
