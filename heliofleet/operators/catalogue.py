"""The fixed query catalogue over the scored view.

Windows trail back from the newest reading, not from the wall clock. ``as_of`` replaces that
anchor with a literal instant: answers for a past moment, and static partition pruning.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from heliofleet import fixed
from heliofleet.functions.columns import energy_mwh, instant, rounded, scalar
from heliofleet.operators.fleet import Fleet, between, hours
from heliofleet.operators.scoring import held_back_mw


def in_region(df: DataFrame, region: str | None) -> DataFrame:
    """Rows of one region; no region means all of them."""
    return df if region is None else df.where(F.col("region") == region)


# ---------- anchors and windows ----------

def latest_interval(readings: DataFrame) -> DataFrame:
    return readings.agg(F.max("interval_end").alias("latest_interval"))


def _anchor(fleet: Fleet, as_of: datetime | None) -> Column:
    if as_of is not None:
        return instant(as_of)
    return scalar(latest_interval(fleet.readings))


def _upto(as_of: datetime | None) -> Column | None:
    return None if as_of is None else instant(as_of)


def trailing(fleet: Fleet, n_hours: int, as_of: datetime | None = None) -> DataFrame:
    """Scored rows of the last ``n_hours`` (start excluded). The anchor is global."""
    return fleet.performance(_anchor(fleet, as_of) - hours(n_hours), _upto(as_of))


def latest_scored(fleet: Fleet, as_of: datetime | None = None) -> DataFrame:
    """Newest interval with an index in the last day; NULL when there is none."""
    return (
        trailing(fleet, 24, as_of)
        .where(F.col("performance_index").isNotNull())
        .agg(F.max("interval_end").alias("latest_scored"))
    )


def at_latest_scored(fleet: Fleet, as_of: datetime | None = None) -> DataFrame:
    """Scored rows of the newest interval with an index in the last day, from one view.

    Each farm keeps its newest scored row; of those, the ones that share the newest time stay. Farms
    without an index then are left out: they are neither below a threshold nor held back.
    """
    scored = trailing(fleet, 24, as_of).where(F.col("performance_index").isNotNull())
    columns = [c for c in scored.columns if c not in ("facility_code", "interval_end")]
    newest = scored.groupBy("facility_code").agg(
        F.max("interval_end").alias("interval_end"), F.max_by(F.struct(*columns), "interval_end").alias("_row"))
    return (
        newest.withColumn("_place", F.rank().over(Window.orderBy(F.desc("interval_end")))).where("_place = 1")
        .select("facility_code", "interval_end", "_row.*").select(*scored.columns)
    )


# ---------- registry and status ----------

def status_counts(fleet: Fleet) -> DataFrame:
    """One row: table sizes and newest timestamps."""
    facilities = fleet.units.select("facility_code").distinct().agg(F.count(F.lit(1)))
    def size(df):
        return scalar(df.agg(F.count(F.lit(1))))
    return fleet.units.agg(F.count(F.lit(1)).alias("units")).select(
        "units",
        scalar(facilities).alias("facilities"),
        size(fleet.ledger).alias("files"),
        size(fleet.readings).alias("readings"),
        scalar(latest_interval(fleet.readings)).alias("latest_interval"),
        scalar(fleet.weather.agg(F.max("observed_at"))).alias("latest_weather"),
    )


def facilities(units: DataFrame, region: str | None = None) -> DataFrame:
    return (
        in_region(units, region)
        .groupBy("facility_code")
        .agg(
            F.max("facility_name").alias("facility_name"),
            F.max("region").alias("region"),
            rounded(F.sum("capacity_mw"), 1).alias("capacity_mw"),
            F.count(F.lit(1)).alias("units"),
            rounded(F.avg("latitude"), 4).alias("latitude"),
            rounded(F.avg("longitude"), 4).alias("longitude"),
        )
        .orderBy(F.asc_nulls_last("facility_name"), "facility_code")
    )


def facility_sites(units: DataFrame) -> DataFrame:
    return units.groupBy("facility_code").agg(
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude")
    )


def find_facilities_report(units: DataFrame, region: str | None = None, limit: int = 50) -> DataFrame:
    """The first facilities by name, each row carrying the total count."""
    total = in_region(units, region).select("facility_code").distinct().agg(F.count(F.lit(1)))
    return facilities(units, region).limit(limit).withColumn("count", scalar(total))


def _facility_matches(matched: DataFrame, exact: Column, *group: str) -> DataFrame:
    return matched.groupBy(*group, "facility_code").agg(
        F.max("facility_name").alias("facility_name"),
        F.max("region").alias("region"),
        rounded(F.sum("capacity_mw"), 1).alias("capacity_mw"),
        F.bool_or(exact).alias("_exact"),
    )


def _pattern(text: Column) -> Column:
    """A text as LIKE reads it: a backslash before an ordinary character, or at the end, says nothing."""
    return F.regexp_replace(text, r"(\\[%_\\])|\\", "$1")


def find_facility(units: DataFrame, text: str) -> DataFrame:
    """Exact code first, else the shortest name containing the text (LIKE wildcards live)."""
    wanted = text.strip()
    exact = F.lower("facility_code") == wanted.lower()
    inner = re.sub(r"(\\[%_\\])|\\", lambda m: m.group(1) or "", wanted)
    matched = units.where(exact | F.col("facility_name").ilike(f"%{inner}%"))
    return (
        _facility_matches(matched, exact)
        .orderBy(F.desc("_exact"), F.length("facility_name"), "facility_code")
        .limit(1)
        .drop("_exact")
    )


def _starts(last: Column) -> Column:
    """Places 1 to ``last``, and 1 in any case."""
    return F.sequence(F.lit(1), F.greatest(last, F.lit(1)))


def find_facility_batch(units: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """``find_facility`` for a table of texts, one row per distinct text that matches.

    A text meets only names that hold its rarest piece: of all three-letter pieces of its longest
    literal run (the run itself if shorter, the empty piece if it is all wildcards) the one that fewest
    names hold. The LIKE test then decides.
    """
    wanted = texts.select(F.trim(text).alias("searched_for")).where("searched_for is not null").distinct()
    literal = F.array_max(F.transform(
        F.split(F.lower(_pattern(F.col("searched_for"))), r"\\[%_\\]|[%_]"), lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))
    ))["p"]
    name = F.lower("facility_name")
    names = units.select("facility_name").distinct()
    held = names.withColumn("piece", F.explode(F.array_union(F.array(F.lit("")), F.array_distinct(F.flatten(F.transform(
        _starts(F.length(name)), lambda i: F.array(*[F.substr(name, i, F.lit(n)) for n in (1, 2, 3)])))))))
    frequency = held.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    asked = (
        wanted.withColumn("literal", literal)
        .withColumn("piece", F.explode(F.array_distinct(F.transform(
            _starts(F.length("literal") - 2), lambda i: F.substr("literal", i, F.lit(3))))))
        .join(frequency, "piece", "left")  # a piece that no name holds is the rarest of all
        .groupBy("searched_for").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece"))
        .withColumn("like", _pattern(F.col("searched_for")))
    )
    by_name = (
        held.join(asked, "piece")
        .where(F.expr("facility_name ilike concat('%', like, '%')"))
        .select("searched_for", "facility_name").distinct()
        .join(units, "facility_name")
    )
    by_code = wanted.join(units, F.lower("searched_for") == F.lower("facility_code"))
    columns = ["searched_for", "duid", "facility_code", "facility_name", "region", "capacity_mw"]
    matched = by_name.select(*columns).union(by_code.select(*columns)).distinct()
    exact = F.lower("facility_code") == F.lower("searched_for")
    order = Window.partitionBy("searched_for").orderBy(
        F.desc("_exact"), F.length("facility_name"), "facility_code")
    return (
        _facility_matches(matched, exact, "searched_for")
        .withColumn("_rank", F.row_number().over(order)).where("_rank = 1")
        .drop("_rank", "_exact")
    )


# ---------- ranked questions ----------

def _under(perf: DataFrame, threshold: float, *also: str) -> DataFrame:
    held_back = F.coalesce("status", F.lit("")).isin(*fixed.CURTAILED_KINDS)
    return perf.where((F.col("performance_index") < threshold) & ~held_back).select(
        "facility_code", "facility_name", "region", "interval_end",
        rounded(F.col("actual_mw"), 1).alias("actual_mw"),
        rounded(F.col("expected_mw"), 1).alias("expected_mw"),
        rounded(F.col("performance_index"), 2).alias("performance_index"),
        rounded(F.col("rrp"), 2).alias("price_per_mwh"), *also,
    )


# The index is ordered as shown (rounded); the shortfall is ordered unrounded.
_UNDER_ORDER = (F.asc_nulls_last, "performance_index")
_CURTAILED_ORDER = (F.desc_nulls_first, "shortfall")


def _curtailed(perf: DataFrame) -> DataFrame:
    return perf.where(F.col("status").isin(*fixed.CURTAILED_KINDS)).select(
        "facility_code", "facility_name", "region", "interval_end", "status",
        rounded(F.col("actual_mw"), 1).alias("actual_mw"),
        rounded(F.col("expected_mw"), 1).alias("expected_mw"),
        rounded(F.col("curtailed_mw"), 1).alias("curtailed_mw"),
        rounded(F.col("rrp"), 2).alias("price_per_mwh"),
        (F.col("expected_mw") - F.col("actual_mw")).alias("shortfall"),
    )


def _first(df: DataFrame, order, limit: int) -> DataFrame:
    direction, column = order
    return df.orderBy(direction(column), "facility_code").limit(limit)


def _first_per_interval(df: DataFrame, order, limit: int) -> DataFrame:
    direction, column = order
    ranked = Window.partitionBy("interval_end").orderBy(direction(column), "facility_code")
    return df.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= limit)


def underperformers(
    fleet: Fleet, threshold: float = fixed.UNDERPERFORMING_BELOW, limit: int = 10,
    region: str | None = None, as_of: datetime | None = None,
) -> DataFrame:
    """Farms below the threshold at the latest scored interval, curtailed ones left out."""
    return _first(_under(in_region(at_latest_scored(fleet, as_of), region), threshold), _UNDER_ORDER, limit)


def curtailed_farms(
    fleet: Fleet, limit: int = 10, region: str | None = None, as_of: datetime | None = None
) -> DataFrame:
    """Farms held back at the latest scored interval, largest shortfall first."""
    found = _curtailed(in_region(at_latest_scored(fleet, as_of), region))
    return _first(found, _CURTAILED_ORDER, limit).drop("shortfall")


def underperformers_by_interval(
    fleet: Fleet, threshold: float = fixed.UNDERPERFORMING_BELOW, limit: int = 10
) -> DataFrame:
    """The same ranking for every interval at once."""
    return _first_per_interval(_under(fleet.performance(), threshold), _UNDER_ORDER, limit)


def curtailed_by_interval(fleet: Fleet, limit: int = 10) -> DataFrame:
    return _first_per_interval(_curtailed(fleet.performance()), _CURTAILED_ORDER, limit).drop("shortfall")


def underperformers_report(
    fleet: Fleet, threshold: float = fixed.UNDERPERFORMING_BELOW, limit: int = 10,
    region: str | None = None, as_of: datetime | None = None,
) -> DataFrame:
    """Underperformers, each row carrying how many curtailed farms were left out (25 at most)."""
    rows = in_region(at_latest_scored(fleet, as_of), region)  # the farms of one interval
    cut = F.count_if(F.col("status").isin(*fixed.CURTAILED_KINDS)).over(Window.partitionBy())
    found = _under(rows.withColumn("curtailed_excluded", F.least(cut, F.lit(25))), threshold, "curtailed_excluded")
    return _first(found, _UNDER_ORDER, limit)


# ---------- window summaries ----------

def facility_summary(
    fleet: Fleet, n_hours: int = 24, facility_code: str | None = None, as_of: datetime | None = None
) -> DataFrame:
    """Energy, peak, index and curtailment per facility over the window; a named facility has its row
    even where it has no readings, with counts of zero."""
    rows = trailing(fleet, n_hours, as_of)
    grouped = rows.groupBy("facility_code")
    if facility_code is not None:
        grouped = rows.where(F.col("facility_code") == facility_code).groupBy()
    step = fleet.interval_minutes
    summary = grouped.agg(
        F.count(F.lit(1)).alias("intervals"),
        rounded(energy_mwh(F.sum("actual_mw"), step), 1).alias("energy_mwh"),
        rounded(F.max("actual_mw"), 1).alias("peak_mw"),
        rounded(F.avg("performance_index"), 2).alias("avg_performance_index"),
        rounded(F.min("performance_index"), 2).alias("min_performance_index"),
        rounded(energy_mwh(F.sum("curtailed_mw"), step), 1).alias("curtailed_mwh"),
        F.count_if(F.col("status") == "curtailed").alias("curtailed_intervals"),
        F.count_if(F.col("status") == "likely_curtailed").alias("likely_curtailed_intervals"),
        F.max("interval_end").alias("latest_interval"),
    )
    if facility_code is None:
        return summary
    return summary.select(F.lit(facility_code).alias("facility_code"), *summary.columns)


def facility_hourly(
    fleet: Fleet, n_hours: int = 24, facility_code: str | None = None, as_of: datetime | None = None
) -> DataFrame:
    rows = trailing(fleet, n_hours, as_of)
    if facility_code is not None:
        rows = rows.where(F.col("facility_code") == facility_code)
    return rows.groupBy("facility_code", F.date_trunc("hour", "interval_end").alias("hour")).agg(
        rounded(F.avg("actual_mw"), 1).alias("avg_mw"),
        rounded(F.avg("expected_mw"), 1).alias("expected_mw"),
        rounded(F.avg("performance_index"), 2).alias("performance_index"),
    )


def dispatch_curtailed_mwh(fleet: Fleet, after: Column, upto: Column | None) -> DataFrame:
    """MWh held back per region over every capped dispatch row, with or without a reading."""
    capped = between(fleet.dispatch, "interval_end", after, upto).where("semidispatch_cap")
    return (
        capped.join(fleet.units.select("duid", "region"), "duid")
        .groupBy("region")
        .agg(energy_mwh(F.sum(held_back_mw()), fleet.interval_minutes).alias("_curtailed_mwh"))
    )


def fleet_summary(
    fleet: Fleet, n_hours: int = 24, region: str | None = None, as_of: datetime | None = None
) -> DataFrame:
    """Per region: farms, energy, mean index, flags at the latest scored interval, curtailed MWh."""
    anchor = _anchor(fleet, as_of)
    inside, today = F.col("interval_end") > anchor - hours(n_hours), F.col("interval_end") > anchor - hours(24)
    scored = today & F.col("performance_index").isNotNull()
    # The view is scored once and added up twice: by farm for the window, by interval for the flags of the day.
    rows = trailing(fleet, max(n_hours, 24), as_of).select(
        "region", "facility_code", "interval_end", "status", F.when(inside, F.col("actual_mw")).alias("mw"),
        F.when(inside, F.col("performance_index")).alias("ix"), inside.alias("inside"), scored.alias("scored"))
    both = rows.groupingSets([["region", "facility_code"], ["region", "interval_end"]], "region", "facility_code", "interval_end").agg(
        F.sum("mw").alias("mw"), F.sum("ix").alias("ix"), F.count("ix").alias("n"), F.bool_or("inside").alias("inside"), F.bool_or("scored").alias("scored"),
        F.count_if(F.col("status") == "underperforming").alias("under"), F.count_if(F.col("status").isin(*fixed.CURTAILED_KINDS)).alias("cut"),
        F.grouping("interval_end").alias("by_farm"))
    farm = (F.col("by_farm") == 1) & F.col("inside")
    at = F.when((F.col("by_farm") == 0) & F.col("scored"), F.col("interval_end"))
    regions = both.groupBy("region").agg(
        F.count_if(farm).alias("facilities"), F.sum(F.when(farm, F.col("mw"))).alias("mw"), F.sum(F.when(farm, F.col("ix"))).alias("ix"),
        F.sum(F.when(farm, F.col("n"))).alias("n"), F.max(at).alias("at"), F.max_by(F.struct("under", "cut"), at).alias("flags"))
    # A region whose newest scored interval is older than another's has no flag at the newest.
    newest = F.max("at").over(Window.partitionBy())
    totals = in_region(regions.withColumn("now", F.col("at") == newest).where("facilities > 0"), region).select(
        "region", "facilities", rounded(energy_mwh(F.col("mw"), fleet.interval_minutes), 1).alias("energy_mwh"),
        rounded(F.try_divide("ix", "n"), 2).alias("avg_performance_index"),
        F.when(F.col("now"), F.col("flags.under")).alias("_under"), F.when(F.col("now"), F.col("flags.cut")).alias("_cut"))
    held = dispatch_curtailed_mwh(fleet, _anchor(fleet, as_of) - hours(n_hours), _upto(as_of))
    return (
        totals.join(held, "region", "left")
        .select(
            "region", "facilities", "energy_mwh", "avg_performance_index",
            F.coalesce("_under", F.lit(0)).alias("underperforming_latest"),
            F.coalesce("_cut", F.lit(0)).alias("curtailed_latest"),
            rounded(F.coalesce("_curtailed_mwh", F.lit(0.0)), 1).alias("curtailed_mwh"),
        )
        .orderBy(F.desc_nulls_first("energy_mwh"), "region")
    )


def fleet_kpis(summary: DataFrame) -> DataFrame:
    """One row over a fleet summary; the mean index is weighted by farms, scored regions only."""
    weight = F.when(F.col("avg_performance_index").isNotNull(), F.col("facilities"))
    return summary.agg(
        rounded(F.sum("energy_mwh"), 1).alias("energy_mwh"),
        F.sum("facilities").alias("facilities"),
        rounded(F.try_divide(F.sum(weight * F.col("avg_performance_index")), F.sum(weight)), 4)
        .alias("avg_performance_index"),
        F.sum("underperforming_latest").alias("underperforming"),
        F.sum("curtailed_latest").alias("curtailed"),
        rounded(F.sum("curtailed_mwh"), 1).alias("curtailed_mwh"),
    )


def freshness(latest: DataFrame, now: Column, column: str = "latest_interval") -> DataFrame:
    """Minutes behind ``now`` and the state shown for it."""
    lag = F.round((F.unix_micros(now) - F.unix_micros(column)) / 60_000_000).cast("bigint")
    label = (
        F.when(lag.isNull(), "no data")
        .when(lag <= fixed.FRESH_LIVE_MINUTES, "live")
        .when(lag <= fixed.FRESH_DELAYED_MINUTES, "delayed")
        .otherwise("stale")
    )
    return latest.withColumn("lag_minutes", lag).withColumn("state", label)


# ---------- model usage ----------

def usage_cost(usage: DataFrame, prices: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Tokens and USD per model. ``usage`` holds model, input_tokens, output_tokens; unknown
    models cost nothing; ``overrides`` rows replace list prices."""
    base = F.regexp_replace("model", fixed.MODEL_PREFIX_PATTERN, "")
    per_model = usage.groupBy(base.alias("model")).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    listed = prices
    if overrides is not None:
        listed = prices.join(overrides, "model", "left_anti").unionByName(overrides)
    cost = (
        F.col("input_tokens") * F.coalesce("price_in", F.lit(0.0))
        + F.col("output_tokens") * F.coalesce("price_out", F.lit(0.0))
    ) / 1_000_000
    return per_model.join(listed, "model", "left").select(
        "model", "input_tokens", "output_tokens", rounded(cost, 8).alias("cost_usd"))


def list_docs(chunks: DataFrame) -> DataFrame:
    """Each document with its sections in order (headings only, no text)."""
    return chunks.groupBy("doc").agg(
        F.max("title").alias("title"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("section_no", "part_no", "id", "section"))),
            lambda s: F.struct(s["id"].alias("id"), s["section"].alias("section")),
        ).alias("sections"),
    )
