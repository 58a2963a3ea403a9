"""Analyses, charts and dashboards."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import marts
from catalog.oracle import oracle
from catalog.registry import query, rounded
from fixtures.domain import AS_OF_DATE, domain
from polderlake.operators import matching, regression
from polderlake.operators.charts import Chart, Filter, Metric, chart_query
from polderlake.plans import analyses, dashboards, journey
from polderlake.session import freeze, stored

REFERENCE = date.fromisoformat(AS_OF_DATE)
PHASE_NAMES = sorted(set(marts.journey.PHASES.values()))

# ---- journeys -----------------------------------------------------------------------------------


@query(
    "phase_funnel",
    oracle(
        "phases",
        """select fase, count(distinct bsn) as uniek_bsn,
 round(count(distinct bsn)*100.0::double / (select count(distinct bsn) from phases), 1) as pct_van_totaal
 from phases group by fase""",
    ),
)
def phase_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return analyses.phase_funnel(marts.phases(spark, sf))


@query(
    "phase_duration_stats",
    oracle(
        "phases",
        """select fase, count(duur_dagen) as n, quantile_cont(duur_dagen, 0.25) as p25, quantile_cont(duur_dagen, 0.5) as mediaan,
 quantile_cont(duur_dagen, 0.75) as p75, max(duur_dagen) as max_dagen, count(*) filter (where is_lopend) as lopend
 from phases group by fase having count(duur_dagen) > 0""",
    ),
)
def phase_duration_stats(spark: SparkSession, sf: str) -> DataFrame:
    return analyses.phase_duration_stats(marts.phases(spark, sf))


@query("events_per_domain", oracle("events_all", "select domein, count(*) as n from events_all group by domein"))
def events_per_domain(spark: SparkSession, sf: str) -> DataFrame:
    return analyses.events_per_domain(marts.events(spark, sf))


@query(
    "top_event_types",
    oracle(
        "events_all",
        "select domein, event_type, count(*) as n from events_all group by all order by n desc, domein, event_type limit 15",
    ),
)
def top_event_types(spark: SparkSession, sf: str) -> DataFrame:
    return analyses.top_event_types(marts.events(spark, sf))


@query(
    "phase_transitions",
    oracle(
        "phases",
        "select fase, "
        + ", ".join(f"count(*) filter (where next_fase = '{name}') as {name}" for name in PHASE_NAMES)
        + """ from (select fase, lead(fase) over (partition by bsn order by fase_volgnr) as next_fase from phases)
 where next_fase is not null group by fase""",
    ),
)
def phase_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return analyses.phase_transitions(journey.phase_steps(marts.events(spark, sf), at_most=marts.most_events(spark, sf)))


@query(
    "richest_journeys",
    oracle(
        "events_all",
        """select bsn, count(*) as n_events, count(distinct domein) as n_domeinen from events_all group by bsn
 order by n_domeinen desc, n_events desc, bsn limit 5""",
    ),
)
def richest_journeys(spark: SparkSession, sf: str) -> DataFrame:
    return analyses.richest_journeys(marts.events(spark, sf))


@query(
    "journey_measures",
    oracle(
        "phases",
        """select 'aantal_clienten' as measure, cast(count(distinct bsn) as double) as value from events_all
 union all select 'aantal_events', count(*) from events_all
 union all select 'aantal_domeinen', count(distinct domein) from events_all
 union all select 'aantal_fases', count(*) from phases
 union all select 'gem_duur_dagen', round(avg(duur_dagen), 6) from phases""",
    ),
)
def journey_measures(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(analyses.journey_measures(marts.events(spark, sf), marts.phases(spark, sf)), 6, "value")


@query(
    "journey_timeline",
    oracle(
        "ranked",
        """select bsn, event_ts, domein, event_type, event_label, regio_code from ranked
 order by bsn, event_ts, event_seq limit 20""",
    ),
)
def journey_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return analyses.journey_timeline(marts.events(spark, sf))


@query(
    "journey_person_phases",
    oracle(
        "phases ww",
        """select bsn, fase_volgnr, fase, fase_start_ts, fase_eind_ts, duur_dagen, is_lopend from phases
 where bsn = (select min(bsn) from ww)""",
    ),
)
def journey_person_phases(spark: SparkSession, sf: str) -> DataFrame:
    first = domain(spark, sf, "ww").agg(F.min("bsn").alias("bsn")).scalar()
    return analyses.person_phases(marts.events(spark, sf), first, marts.most_events(spark, sf))


# ---- regressions and comparisons ------------------------------------------------------------------


def features(spark: SparkSession, sf: str) -> DataFrame:
    return regression.pay_features(domain(spark, sf, "ikv"), domain(spark, sf, "persona"), REFERENCE)


@query("pay_features", oracle("pay_features", "select * replace (round(tenure_years,6) as tenure_years) from pay_features"))
def pay_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features(spark, sf), 6, "tenure_years")


@query(
    "feature_describe",
    oracle(
        "pay_features",
        " union all ".join(
            f"""select '{c}' as feature, count({c}) as n, round(avg({c}),4) as mean, round(stddev({c}),4) as std,
 round(cast(min({c}) as double),4) as "min", round(cast(quantile_cont({c},0.25) as double),4) as p25,
 round(cast(quantile_cont({c},0.5) as double),4) as p50, round(cast(quantile_cont({c},0.75) as double),4) as p75,
 round(cast(max({c}) as double),4) as "max" from pay_features"""
            for c in ("age", "tenure_years", "loon_bruto_jaar")
        ),
    ),
)
def feature_describe(spark: SparkSession, sf: str) -> DataFrame:
    described = regression.feature_describe(features(spark, sf), ["age", "tenure_years", "loon_bruto_jaar"])
    return rounded(described, 4, "mean", "std", "min", "p25", "p50", "p75", "max")


@query(
    "regression_simple",
    oracle(
        "pay_features",
        """select round(regr_slope(loon_bruto_jaar, age),4) as slope, round(regr_intercept(loon_bruto_jaar, age),4) as intercept,
 round(regr_r2(loon_bruto_jaar, age),6) as r2 from pay_features""",
    ),
)
def regression_simple(spark: SparkSession, sf: str) -> DataFrame:
    fit = regression.regression_simple(features(spark, sf), "loon_bruto_jaar", "age")
    return rounded(rounded(fit, 4, "slope", "intercept"), 6, "r2")


@query(
    "regression_two_features",
    oracle(
        "pay_features",
        """, m as (select avg(age) as ma, avg(tenure_years) as mb, avg(loon_bruto_jaar) as mc, var_pop(age) as aa,
 var_pop(tenure_years) as bb, var_pop(loon_bruto_jaar) as cc, covar_pop(age, tenure_years) as ab,
 covar_pop(age, loon_bruto_jaar) as ac, covar_pop(tenure_years, loon_bruto_jaar) as bc from pay_features),
 s as (select *, (ac*bb - bc*ab) / (aa*bb - ab*ab) as c1, (bc*aa - ac*ab) / (aa*bb - ab*ab) as c2 from m)
select round(c1,4) as coef_1, round(c2,4) as coef_2, round(mc - c1*ma - c2*mb, 4) as intercept,
 round((c1*ac + c2*bc) / cc, 6) as r2 from s""",
    ),
)
def regression_two_features(spark: SparkSession, sf: str) -> DataFrame:
    fit = regression.regression_two_features(features(spark, sf), "loon_bruto_jaar", "age", "tenure_years")
    return rounded(rounded(fit, 4, "coef_1", "coef_2", "intercept"), 6, "r2")


@query("logistic_effect")
def logistic_effect(spark: SparkSession, sf: str) -> DataFrame:
    """Granted WW benefit against age, gender and present status."""
    panel = freeze(marts.effect_panel(spark, sf).select("ooit_ww_toegekend", "leeftijd", "geslacht", "n_wia_aanvragen"))
    return regression.logistic_effect(panel, "ooit_ww_toegekend", ["leeftijd", "n_wia_aanvragen"], ["geslacht"])


@query(
    "logistic_effect_binary",
    oracle(
        "effect_panel",
        """, t as (select geslacht = 'M' as x, ooit_ww_toegekend as y, count(*) as n from effect_panel
 where geslacht in ('M', 'V') and ooit_ww_toegekend is not null group by all), c as (select
 cast(sum(n) filter (where x and y) as double) as a, cast(sum(n) filter (where x and not y) as double) as b,
 cast(sum(n) filter (where not x and y) as double) as c, cast(sum(n) filter (where not x and not y) as double) as d from t)
select 'man' as feature, round(ln(a*d/(b*c)), 4) as coefficient, round(sqrt(1/a + 1/b + 1/c + 1/d), 4) as std_error from c
union all select 'const', round(ln(c/d), 4), round(sqrt(1/c + 1/d), 4) from c""",
    ),
)
def logistic_effect_binary(spark: SparkSession, sf: str) -> DataFrame:
    """With one yes/no feature the fit has a closed form: the log of the odds ratio and its standard error."""
    panel = marts.effect_panel(spark, sf).where("geslacht in ('M', 'V')")
    panel = panel.select("ooit_ww_toegekend", (F.col("geslacht") == "M").cast("double").alias("man"))
    fitted = regression.logistic_effect(panel, "ooit_ww_toegekend", ["man"], [])
    return rounded(fitted.select("feature", "coefficient", "std_error"), 4, "coefficient", "std_error")


@query(
    "logistic_effect_saturated",
    oracle(
        "effect_panel",
        """, t as (select geslacht = 'M' as x, n_wia_aanvragen > 0 as z, cast(count(*) filter (where ooit_ww_toegekend) as double) as y,
 cast(count(*) filter (where not ooit_ww_toegekend) as double) as n from effect_panel where geslacht in ('M', 'V') group by all),
c as (select max(ln(y/n)) filter (where not x and not z) as l00, max(ln(y/n)) filter (where x and not z) as l10,
 max(ln(y/n)) filter (where not x and z) as l01, max(ln(y/n)) filter (where x and z) as l11,
 max(1/y + 1/n) filter (where not x and not z) as v00, max(1/y + 1/n) filter (where x and not z) as v10,
 max(1/y + 1/n) filter (where not x and z) as v01, max(1/y + 1/n) filter (where x and z) as v11 from t)
select 'const' as feature, round(l00, 4) as coefficient, round(sqrt(v00), 4) as std_error from c
union all select 'man', round(l10 - l00, 4), round(sqrt(v10 + v00), 4) from c
union all select 'wia', round(l01 - l00, 4), round(sqrt(v01 + v00), 4) from c
union all select 'beide', round(l11 - l10 - l01 + l00, 4), round(sqrt(v11 + v10 + v01 + v00), 4) from c""",
    ),
)
def logistic_effect_saturated(spark: SparkSession, sf: str) -> DataFrame:
    """With two yes/no features and their product the fit has a closed form too: differences of the log-odds of four cells."""
    man, wia = (F.col("geslacht") == "M").cast("double"), (F.col("n_wia_aanvragen") > 0).cast("double")
    panel = marts.effect_panel(spark, sf).where("geslacht in ('M', 'V')")
    panel = freeze(panel.select("ooit_ww_toegekend", man.alias("man"), wia.alias("wia"), (man * wia).alias("beide")))
    fitted = regression.logistic_effect(panel, "ooit_ww_toegekend", ["man", "wia", "beide"], [])
    return rounded(fitted.select("feature", "coefficient", "std_error"), 4, "coefficient", "std_error")


_PANEL = """, m as (select e.leeftijd, e.geslacht, e.huidige_status, p.regio_code from effect_panel e
 join (select upper(sha256(concat(bsn,'demo-salt'))) as bsn_pseudo, regio_code from persona) p using (bsn_pseudo))"""


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    regions = marts.persona_pseudonymized(spark, sf).select("bsn", "bsn_pseudo").join(
        domain(spark, sf, "persona").select("bsn", "regio_code"), "bsn"
    )
    return marts.effect_panel(spark, sf).join(regions.select("bsn_pseudo", "regio_code"), "bsn_pseudo")


@query(
    "matched_pairs",
    oracle(
        "effect_panel persona",
        f"""{_PANEL} select count(*) as n_pairs from m a join m b on abs(a.leeftijd - b.leeftijd) <= 2
 and a.geslacht = b.geslacht and a.regio_code = b.regio_code and a.huidige_status = 'werkend' and b.huidige_status = 'WW'""",
    ),
)
def matched_pairs(spark: SparkSession, sf: str) -> DataFrame:
    panel = _panel(spark, sf)
    of = lambda status: panel.filter(F.col("huidige_status") == status)
    return matching.matched_pairs(of("werkend"), of("WW"), ["geslacht", "regio_code"])


@query(
    "matched_counts",
    oracle(
        "effect_panel persona",
        f"""{_PANEL} select a.geslacht, a.regio_code, a.leeftijd, count(distinct a.k) as n_treated,
 count(*) // count(distinct a.k) as n_controls
 from (select *, row_number() over () as k from m where huidige_status='werkend') a
 join (select * from m where huidige_status='WW') b
  on abs(a.leeftijd - b.leeftijd) <= 2 and a.geslacht = b.geslacht and a.regio_code = b.regio_code group by all""",
    ),
)
def matched_counts(spark: SparkSession, sf: str) -> DataFrame:
    panel = _panel(spark, sf)
    of = lambda status: panel.filter(F.col("huidige_status") == status)
    return matching.matched_counts(of("werkend"), of("WW"), ["geslacht", "regio_code"])


_AGES = """, ages as (select geslacht, woonplaats, date_diff('day', geboortedatum, date '2026-01-01') + 0.25::double as dagen,
 n_lopende_ww > 0 as treated, n_dienstverbanden_lopend > 0 as working from client_360)"""


@query(
    "matched_counts_real",
    oracle(
        "client_360",
        f"""{_AGES}, a as (select geslacht, woonplaats, dagen, count(*) as n from ages where treated group by all)
select a.geslacht, a.woonplaats, a.dagen, n as n_treated, count(*) as n_controls from a
join ages b on b.geslacht = a.geslacht and b.woonplaats = a.woonplaats and not b.treated and b.working
 and abs(a.dagen - b.dagen) <= 730.5 group by a.geslacht, a.woonplaats, a.dagen, n""",
    ),
)
def matched_counts_real(spark: SparkSession, sf: str) -> DataFrame:
    """Persons with a benefit, and working persons without one whose age in days is within two years."""
    ages = marts.client_360(spark, sf).select(
        "geslacht",
        "woonplaats",
        (F.date_diff(F.lit(REFERENCE), "geboortedatum") + F.lit(0.25)).alias("dagen"),
        (F.col("n_lopende_ww") > 0).alias("treated"),
        (F.col("n_dienstverbanden_lopend") > 0).alias("working"),
    )
    ages = stored(ages)
    return matching.matched_counts_real(ages.where("treated"), ages.where("NOT treated AND working"), ["geslacht", "woonplaats"], "dagen", 730.5)


# ---- plain reports ------------------------------------------------------------------------------


@query(
    "cohort_summary",
    oracle(
        "effect_panel",
        """select huidige_status as cohort_id, count(*) as n, round(avg(leeftijd),6) as gemiddelde,
 count(*) filter (where geslacht='V') as n_gefilterd from effect_panel group by huidige_status""",
    ),
)
def cohort_summary(spark: SparkSession, sf: str) -> DataFrame:
    panel = marts.effect_panel(spark, sf)
    return rounded(analyses.cohort_summary(panel, "huidige_status", "leeftijd", F.col("geslacht") == "V"), 6, "gemiddelde")


@query(
    "outcome_rates",
    oracle(
        "effect_panel",
        """select geslacht, huidige_status, count(*) as n,
 round(avg(case when ooit_ww_toegekend then 1.0::double else 0 end),6) as slaag_pct,
 round(stddev(case when ooit_ww_toegekend then 1.0::double else 0 end),6) as std
 from effect_panel group by all having count(*) >= 30""",
    ),
)
def outcome_rates(spark: SparkSession, sf: str) -> DataFrame:
    panel = marts.effect_panel(spark, sf)
    rates = analyses.outcome_rates(panel, ["geslacht", "huidige_status"], F.col("ooit_ww_toegekend"), 30)
    return rounded(rates, 6, "slaag_pct", "std")


@query(
    "weekly_percentile",
    oracle(
        "satisfaction",
        """select cast(date_trunc('week', meting_datum) as date) as week, count(*) as n, round(avg(n_respondenten),6) as gem_score,
 cast(quantile_disc(n_respondenten, 0.95) as double) as p95 from satisfaction where meting_datum >= date '2024-01-03'
 group by 1""",
    ),
)
def weekly_percentile(spark: SparkSession, sf: str) -> DataFrame:
    rows = domain(spark, sf, "satisfaction")
    return rounded(analyses.weekly_percentile(rows, "meting_datum", "n_respondenten", date(2024, 1, 3)), 6, "gem_score")


@query(
    "wait_percentiles",
    oracle(
        "wia",
        """select regio_code, onderdeel, cast(quantile_disc(arbeidsongeschikt_pct, 0.5) as double) as p50,
 cast(quantile_disc(arbeidsongeschikt_pct, 0.95) as double) as p95, count(*) as aantal_cases from wia group by 1, 2""",
    ),
)
def wait_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return analyses.wait_percentiles(domain(spark, sf, "wia"), ["regio_code", "onderdeel"], "arbeidsongeschikt_pct")


@query(
    "utilization_ratio",
    oracle(
        "stg_satisfaction",
        """select team, week, gepland, beschikbaar, round(cast(gepland as double) / nullif(beschikbaar,0), 6) as bezet_pct
 from (select kanaal as team, cast(date_trunc('week', meting_datum) as date) as week, cast(sum(score) as bigint) as gepland,
 cast(sum(case when score=1 then 0 else n_respondenten end) as bigint) as beschikbaar
 from stg_satisfaction where meting_datum >= date '2024-01-03' group by 1, 2)""",
    ),
)
def utilization_ratio(spark: SparkSession, sf: str) -> DataFrame:
    free = F.when(F.col("score") == 1, F.lit(0)).otherwise(F.col("n_respondenten"))
    rows = marts.stg_satisfaction(spark, sf)
    ratios = analyses.utilization_ratio(rows, "kanaal", "meting_datum", F.col("score"), free, date(2024, 1, 3))
    return rounded(ratios, 6, "bezet_pct")


@query(
    "null_pct_by_day",
    oracle(
        "crm",
        """select event_date as dag, round(100.0::double * sum(case when duur_seconden is null then 1 else 0 end) / count(*), 6)
 as null_pct from crm where event_date >= date '2024-01-10' group by event_date""",
    ),
)
def null_pct_by_day(spark: SparkSession, sf: str) -> DataFrame:
    days = analyses.null_pct_by_day(domain(spark, sf, "crm"), "event_date", "duur_seconden", date(2024, 1, 10))
    return rounded(days, 6, "null_pct")


@query(
    "aged_open_cases",
    oracle(
        "wia",
        """select bsn, aanvraag_datum, status from wia where status='IN_BEHANDELING'
 and aanvraag_datum < date '2000-01-01' - 56""",
    ),
)
def aged_open_cases(spark: SparkSession, sf: str) -> DataFrame:
    return analyses.aged_open_cases(domain(spark, sf, "wia"), "aanvraag_datum", "IN_BEHANDELING", date(2000, 1, 1))


@query(
    "percent_scenarios",
    oracle(
        "projection",
        """select wet, basis, round(basis*1.05::double,4) as plus_pct, round(basis*0.95::double,4) as min_pct
 from (select wet, cast(sum(uitbetaald_bruto_eur_projection) as double) as basis from projection group by wet)""",
    ),
)
def percent_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    totals = marts.projection(spark, sf).groupBy("wet").agg(F.sum("uitbetaald_bruto_eur_projection").alias("eur"))
    return rounded(analyses.percent_scenarios(totals, "wet", "eur"), 4, "plus_pct", "min_pct")


@query(
    "forecast_error",
    oracle(
        "projection",
        """select wet, regio_code, p, r, r - p as afwijking from (select wet, regio_code, uitbetaald_bruto_eur_projection as p
 from projection where jaar=2026 and maand=1) join (select wet, regio_code, cast(sum(uitbetaald_bruto_eur) as bigint) as r
 from fez where jaar=2000 and maand=6 group by all) using (wet, regio_code)""",
    ),
)
def forecast_error(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["wet", "regio_code"]
    forecast = marts.projection(spark, sf).filter("jaar = 2026 and maand = 1")
    actual = domain(spark, sf, "fez").filter("jaar = 2000 and maand = 6").groupBy(*keys).agg(
        F.sum("uitbetaald_bruto_eur").alias("eur")
    )
    return analyses.forecast_error(forecast, actual, keys, "uitbetaald_bruto_eur_projection", "eur")


@query(
    "conversion_by_channel",
    oracle(
        "crm",
        """select kanaal, count(*) as contacten, count(*) filter (where duur_seconden > 30) as geconverteerd,
 round(100.0::double * count(*) filter (where duur_seconden > 30) / count(*), 6) as conversie_pct from crm
 where event_date >= date '2024-01-05' group by kanaal""",
    ),
)
def conversion_by_channel(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.col("duur_seconden") > 30
    shares = analyses.conversion_by_channel(domain(spark, sf, "crm"), "kanaal", hit, "event_date", date(2024, 1, 5))
    return rounded(shares, 6, "conversie_pct")


@query(
    "case_payments_scores",
    oracle(
        "ww zw persona",
        """select w.bsn, w.aanvraag_datum, w.status, z.iban, z.bedrag, z.betaal_datum, r.score
 from ww w left join (select bsn, 'NL01BANK0' || bsn as iban, duur_dagen as bedrag, eerste_ziektedag as betaal_datum from zw) z
 using (bsn) left join (select bsn, huisnummer as score from persona) r using (bsn)
 where w.bsn = (select min(bsn) from ww)""",
    ),
)
def case_payments_scores(spark: SparkSession, sf: str) -> DataFrame:
    ww = domain(spark, sf, "ww")
    payments = domain(spark, sf, "zw").select(
        "bsn", F.concat(F.lit("NL01BANK0"), "bsn").alias("iban"), F.col("duur_dagen").alias("bedrag"),
        F.col("eerste_ziektedag").alias("betaal_datum"),
    )
    scores = domain(spark, sf, "persona").select("bsn", F.col("huisnummer").alias("score"))
    first = ww.agg(F.min("bsn").alias("bsn")).scalar()
    return analyses.case_payments_scores(ww.select("bsn", "aanvraag_datum", "status"), payments, scores, first)


@query(
    "layer_reconcile",
    oracle(
        "wia_funnel",
        """select mnd, silver_count, gold_count from (select cast(date_trunc('month', aanvraag_datum) as date) as mnd,
 count(*) as silver_count from wia group by 1) left join (select cast(date_trunc('month', aanvraag_datum) as date) as mnd,
 cast(sum(n_aanvragen) as bigint) as gold_count from wia_funnel group by 1) using (mnd) order by mnd limit 24""",
    ),
)
def layer_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return analyses.layer_reconcile(domain(spark, sf, "wia"), marts.wia_funnel(spark, sf), "aanvraag_datum", "n_aanvragen")


# ---- charts -------------------------------------------------------------------------------------


@query(
    "chart_query",
    oracle(
        "events_all",
        """select date_trunc('month', event_ts) as event_ts, domein, count(*) as n, count(distinct bsn) as clients,
 round(avg(numeric_value),6) as mean from events_all where domein in ('ww','wia','zw') and numeric_value is not null
 and numeric_value >= 10 group by 1, 2 order by n desc, event_ts, domein limit 100""",
    ),
)
def chart(spark: SparkSession, sf: str) -> DataFrame:
    wanted = Chart(
        [Metric("bsn", "COUNT", "n"), Metric("bsn", "COUNT_DISTINCT", "clients"), Metric("numeric_value", "AVG", "mean")],
        ["domein"], "event_ts", "P1M",
        (Filter("domein", "IN", ["ww", "wia", "zw"]), Filter("numeric_value", "IS NOT NULL"), Filter("numeric_value", ">=", 10)),
        100,
    )
    return rounded(chart_query(marts.events(spark, sf), wanted), 6, "mean")


@query(
    "chart_table",
    oracle(
        "wia_funnel",
        """select regio_code, status, cast(sum(n_aanvragen) as bigint) as n, round(avg(gemid_ao_pct),6) as pct from wia_funnel
 where onderdeel = 'WGA' group by 1, 2 order by n desc, regio_code, status limit 20""",
    ),
)
def chart_table(spark: SparkSession, sf: str) -> DataFrame:
    wanted = Chart(
        [Metric("n_aanvragen", "SUM", "n"), Metric("gemid_ao_pct", "AVG", "pct")],
        ["regio_code", "status"], filters=(Filter("onderdeel", "=", "WGA"),), row_limit=20,
    )
    return rounded(chart_query(marts.wia_funnel(spark, sf), wanted), 6, "pct")


# Names of the marts in the chart sets -> view in the comparison SQL.
_VIEWS = {"journey_events": "ranked", "journey_phases": "phases"}
_SQL_AGGREGATES = {"SUM": "sum({0})", "AVG": "avg({0})", "COUNT": "count({0})", "COUNT_DISTINCT": "count(distinct {0})"}
_SQL_GRAINS = {"P1D": "day", "P1M": "month"}


def _tile_sql(label: str, mart: str, wanted: Chart) -> str:
    value = _SQL_AGGREGATES[wanted.metrics[0].aggregate].format(wanted.metrics[0].column)
    dims = []
    if wanted.time_column:
        dims.append(f"strftime(date_trunc('{_SQL_GRAINS[wanted.time_grain]}', {wanted.time_column}), '%Y-%m-%d')")
    dims += list(wanted.group_by)
    conditions = {
        "IS NOT NULL": lambda f: f"{f.column} is not null",
        "==": lambda f: f"{f.column} = '{f.value}'",
        "<=": lambda f: f"{f.column} <= {f.value}",
    }
    where = " and ".join(conditions[f.operator](f) for f in wanted.filters)
    view = _VIEWS.get(mart, mart)
    named = ", ".join(f"{dim} as d{i}" for i, dim in enumerate(dims))
    text = "concat_ws('|', " + ", ".join(f"coalesce(d{i}, '')" for i in range(len(dims))) + ")" if dims else "''"
    order = ", ".join(["v desc nulls last", *[f"d{i} asc nulls first" for i in range(len(dims))]])
    inner = f"select {named + ', ' if dims else ''}{value} as v from {view}"
    inner += f" where {where}" if where else ""
    inner += f" group by {', '.join(str(i + 1) for i in range(len(dims)))} order by {order} limit {wanted.row_limit}" if dims else ""
    return f"select '{label}' as chart, {text} as dimension, round(cast(v as double), 4) as value from ({inner})"


def _dashboard_sql(name: str) -> str:
    tiles = dashboards.DASHBOARDS[name]
    views = sorted({_VIEWS.get(mart, mart) for mart, _ in tiles.values()})
    return oracle(" ".join(views), " union all ".join(_tile_sql(label, mart, c) for label, (mart, c) in tiles.items()))


_MARTS = {
    "wia_funnel": marts.wia_funnel,
    "tw_eligibility": marts.tw_eligibility,
    "client_360": marts.client_360,
    "projection": marts.projection,
    "dq_daily": marts.dq_daily,
    "effect_panel": marts.effect_panel,
    "dq_overview": marts.dq_overview,
    "dq_violations": marts.dq_violations,
    "journey_events": marts.ranked,
    "journey_phases": marts.phases,
}


def _dashboard(name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        if name == "cloud_cost":
            sources = marts.raw_billing_marts(spark, sf)
        else:
            used = {mart for mart, _ in dashboards.DASHBOARDS[name].values()}
            sources = {mart: _MARTS[mart](spark, sf) for mart in used}
        # Charts read stored marts: each mart is computed once, then read by all its charts.
        # Only the columns that they name are stored.
        charts = dashboards.DASHBOARDS[name].values()
        columns = {mart: set().union(*(chart.columns() for of, chart in charts if of == mart)) for mart in sources}
        kept = {mart: stored(df.select(*[c for c in df.columns if c in columns[mart]])) for mart, df in sources.items() if columns[mart]}
        return rounded(dashboards.dashboard(name, kept), 4, "value")

    return run


for _name in dashboards.DASHBOARDS:
    query(f"dashboard_{_name}", _dashboard_sql(_name))(_dashboard(_name))
