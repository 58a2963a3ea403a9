"""Analyses on silver tables and marts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polderlake.functions.numbers import ratio
from polderlake.operators.percentiles import histogram, percentiles
from polderlake.operators.ranking import with_neighbour
from polderlake.plans.journey import EVENT_ORDER, PHASES, phases_of_events

# ---- journeys -----------------------------------------------------------------------------------


def phase_funnel(phases: DataFrame) -> DataFrame:
    """Distinct persons per phase and their share of all persons.

    The total is the rollup's top row, so the phases are read once; the window that spreads it runs
    over one row per phase.
    """
    counts = phases.rollup("fase").agg(F.count_distinct("bsn").alias("n"), F.grouping("fase").alias("is_total"))
    total = F.max(F.when(F.col("is_total") == 1, F.col("n"))).over(Window.partitionBy(F.lit(0)))
    return (
        counts.withColumn("_total", total)
        .filter("is_total = 0")
        .select("fase", F.col("n").alias("uniek_bsn"), F.round(ratio(F.col("n") * 100, F.col("_total")), 1).alias("pct_van_totaal"))
    )


def phase_duration_stats(phases: DataFrame) -> DataFrame:
    """Days per closed phase (interpolated quartiles) and the number of open phases."""
    days = histogram(phases, ["fase", "is_lopend"], "duur_dagen")
    closed = days.filter("not is_lopend and value is not null").drop("is_lopend")
    quartiles = percentiles(closed, ["fase"], {"p25": 0.25, "mediaan": 0.5, "p75": 0.75})
    sizes = closed.groupBy("fase").agg(F.sum("n").alias("n"), F.max("value").alias("max_dagen"))
    running = days.groupBy("fase").agg(F.coalesce(F.sum(F.when(F.col("is_lopend"), F.col("n"))), F.lit(0)).alias("lopend"))
    joined = sizes.join(quartiles, "fase").join(running, "fase")
    return joined.select("fase", "n", "p25", "mediaan", "p75", "max_dagen", "lopend")


def events_per_domain(events: DataFrame) -> DataFrame:
    return events.groupBy("domein").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "domein")


def top_event_types(events: DataFrame, limit: int = 15) -> DataFrame:
    counts = events.groupBy("domein", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "domein", "event_type").limit(limit)


def phase_transitions(phases: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Matrix of phase -> next phase counts, zero where a transition never happens.

    `journey.phase_steps` has the next phase already; in plain phases it is found by a join on (person, number),
    which a busy person does not skew.
    """
    columns = sorted(set(PHASES.values())) if names is None else list(names)
    if "next_fase" not in phases.columns:
        phases = phases.select("bsn", "fase_volgnr", "fase")
        phases = with_neighbour(phases, ["bsn"], "fase_volgnr", 1, {"next_fase": "fase"})
    pairs = phases.filter(F.col("next_fase").isNotNull())
    return pairs.groupBy("fase").pivot("next_fase", columns).count().na.fill(0, columns)


def richest_journeys(events: DataFrame, limit: int = 5) -> DataFrame:
    per_person = events.groupBy("bsn").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_distinct("domein").alias("n_domeinen")
    )
    return per_person.orderBy(F.desc("n_domeinen"), F.desc("n_events"), "bsn").limit(limit)


def journey_measures(events: DataFrame, phases: DataFrame) -> DataFrame:
    """(measure, value): clients, events, domains, phases, mean closed duration."""
    of_events = events.agg(
        F.count_distinct("bsn").cast("double").alias("aantal_clienten"),
        F.count(F.lit(1)).cast("double").alias("aantal_events"),
        F.count_distinct("domein").cast("double").alias("aantal_domeinen"),
    )
    of_phases = phases.agg(
        F.count(F.lit(1)).cast("double").alias("aantal_fases"), F.avg("duur_dagen").alias("gem_duur_dagen")
    )
    long = lambda df: df.unpivot([], df.columns, "measure", "value")
    return long(of_events).unionByName(long(of_phases))


def journey_timeline(events: DataFrame, limit: int = 20) -> DataFrame:
    """The first events by person, time and order of events; they need no numbers for that."""
    return events.orderBy("bsn", *EVENT_ORDER).limit(limit).select(
        "bsn", "event_ts", "domein", "event_type", "event_label", "regio_code"
    )


def person_phases(events: DataFrame, bsn: str | Column, at_most: int | None = None) -> DataFrame:
    """One person's phases in order, from that person's events alone."""
    chosen = bsn if isinstance(bsn, Column) else F.lit(bsn)
    phases = phases_of_events(events.filter(F.col("bsn") == chosen), at_most=at_most)
    return phases.orderBy("fase_volgnr").select(
        "bsn", "fase_volgnr", "fase", "fase_start_ts", "fase_eind_ts", "duur_dagen", "is_lopend"
    )


# ---- plain reports ------------------------------------------------------------------------------


def cohort_summary(df: DataFrame, cohort: str, number: str, flag: Column) -> DataFrame:
    """Size, mean and filtered count per cohort."""
    return df.groupBy(F.col(cohort).alias("cohort_id")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(number).alias("gemiddelde"), F.count_if(flag).alias("n_gefilterd")
    )


def outcome_rates(df: DataFrame, groups: Sequence[str], success: Column, minimum: int) -> DataFrame:
    """Success rate and standard deviation per group, for groups of at least `minimum` rows."""
    hit = F.when(success, F.lit(1.0)).otherwise(F.lit(0.0))
    rates = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit).alias("slaag_pct"), F.stddev(hit).alias("std")
    )
    return rates.filter(F.col("n") >= minimum)


def weekly_percentile(df: DataFrame, day: str, score: str, since: date | datetime, share: float = 0.95) -> DataFrame:
    """Rows, mean and discrete percentile per week."""
    recent = df.filter(F.col(day) >= F.lit(since))
    week = F.date_trunc("week", F.col(day)).cast("date")
    scores = histogram(recent.withColumn("week", week), ["week"], score)
    weight = F.sum(F.when(F.col("value").isNotNull(), F.col("n")))
    means = scores.groupBy("week").agg(
        F.sum("n").alias("n"), ratio(F.sum(F.col("value") * F.col("n")), weight).alias("gem_score")
    )
    return means.join(percentiles(scores, ["week"], {"p95": share}, interpolate=False), "week", "left")


def wait_percentiles(df: DataFrame, groups: Sequence[str], wait: str) -> DataFrame:
    """Discrete median and 95th percentile of waiting days per group."""
    waits = histogram(df, groups, wait)
    sizes = waits.groupBy(*groups).agg(F.sum("n").alias("aantal_cases"))
    return sizes.join(percentiles(waits, groups, {"p50": 0.5, "p95": 0.95}, interpolate=False), list(groups), "left")


def utilization_ratio(df: DataFrame, team: str, day: str, planned: Column, available: Column, since: date) -> DataFrame:
    """Planned over available hours per team and week; null where nothing is available."""
    return (
        df.filter(F.col(day) >= F.lit(since))
        .groupBy(F.col(team).alias("team"), F.date_trunc("week", F.col(day)).cast("date").alias("week"))
        .agg(F.sum(planned).alias("gepland"), F.sum(available).alias("beschikbaar"))
        .withColumn("bezet_pct", ratio(F.col("gepland"), F.col("beschikbaar")))
    )


def null_pct_by_day(df: DataFrame, day: str, column: str, since: date) -> DataFrame:
    return (
        df.filter(F.col(day) >= F.lit(since))
        .groupBy(F.col(day).cast("date").alias("dag"))
        .agg((F.avg(F.col(column).isNull().cast("double")) * 100.0).alias("null_pct"))
    )


def aged_open_cases(df: DataFrame, day: str, status: str, as_of: date, days: int = 56) -> DataFrame:
    """Cases in a status for longer than `days`."""
    return df.filter((F.col("status") == status) & (F.col(day) < F.date_sub(F.lit(as_of), days))).select(
        "bsn", day, "status"
    )


def percent_scenarios(df: DataFrame, key: str, value: str, percent: float = 5.0) -> DataFrame:
    base = F.col(value).cast("double")
    return df.select(
        key,
        base.alias("basis"),
        (base * F.lit(1 + percent / 100)).alias("plus_pct"),
        (base * F.lit(1 - percent / 100)).alias("min_pct"),
    )


def forecast_error(forecast: DataFrame, actual: DataFrame, keys: Sequence[str], p: str, r: str) -> DataFrame:
    """Actual minus forecast for the keys both sides have."""
    joined = forecast.select(*keys, F.col(p).alias("p")).join(actual.select(*keys, F.col(r).alias("r")), list(keys))
    return joined.withColumn("afwijking", F.col("r") - F.col("p"))


def conversion_by_channel(df: DataFrame, channel: str, converted: Column, day: str, since: date | datetime) -> DataFrame:
    hits = F.count_if(converted)
    return (
        df.filter(F.col(day) >= F.lit(since))
        .groupBy(F.col(channel).alias("kanaal"))
        .agg(F.count(F.lit(1)).alias("contacten"), hits.alias("geconverteerd"))
        .withColumn("conversie_pct", ratio(F.col("geconverteerd") * 100, F.col("contacten")))
    )


def case_payments_scores(cases: DataFrame, payments: DataFrame, scores: DataFrame, bsn: str) -> DataFrame:
    """One person's cases with payments and risk score, newest payment first.

    The person is filtered on every input before the joins.
    """
    mine = lambda df: df.filter(F.col("bsn") == bsn)
    joined = mine(cases).join(mine(payments), "bsn", "left").join(mine(scores), "bsn", "left")
    return joined.orderBy(F.desc_nulls_last("betaal_datum"))


def layer_reconcile(silver: DataFrame, gold: DataFrame, day: str, count: str, limit: int = 24) -> DataFrame:
    """Monthly row counts in silver beside the counts reported in gold, oldest months first."""
    month = F.trunc(day, "MM").alias("mnd")
    seen = silver.groupBy(month).agg(F.count(F.lit(1)).alias("silver_count"))
    reported = gold.groupBy(month).agg(F.sum(count).alias("gold_count"))
    return seen.join(reported, "mnd", "left").orderBy("mnd").limit(limit)
