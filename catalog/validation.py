"""Checks, profiles, drift and alerts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import marts
from catalog.oracle import oracle
from catalog.registry import query, rounded
from fixtures.domain import domain
from polderlake.functions.identifiers import bsn_check_digit, is_payroll_number, is_valid_bsn
from polderlake.functions.identifiers import account_check_digits
from polderlake.operators import alerts, checks, profiling

_DIGIT_SUM = "+".join(f"{w}*cast(substr(bsn,{i},1) as int)" for i, w in enumerate((9, 8, 7, 6, 5, 4, 3, 2, -1), 1))
# Numbers of mixed quality: good ones, cut ones, ones with a letter or a leading zero, and null.
_NUMBERS = """(select contact_id, case when cast(substr(contact_id,4) as bigint)%11=1 then substr(bsn,1,8)
 when cast(substr(contact_id,4) as bigint)%11=2 then '0' || substr(bsn,2)
 when cast(substr(contact_id,4) as bigint)%11=3 then substr(bsn,1,5) || 'abc' || substr(bsn,9)
 when cast(substr(contact_id,4) as bigint)%11=4 then null else bsn end as bsn from crm)"""


def _numbers(spark: SparkSession, sf: str) -> DataFrame:
    text = _NUMBERS.strip("()").replace("from crm", "from {crm}")
    return spark.sql(text, crm=domain(spark, sf, "crm"))


@query(
    "check_not_null",
    oracle("ikv", "select ikv_id, bsn, event_date from ikv where loon_bruto_jaar is null"),
)
def check_not_null(spark: SparkSession, sf: str) -> DataFrame:
    return checks.check_not_null(domain(spark, sf, "ikv"), "loon_bruto_jaar").select("ikv_id", "bsn", "event_date")


@query(
    "check_unique",
    oracle("wia", "select bsn, count(*) as n_records from wia where bsn is not null group by bsn having count(*) > 1"),
)
def check_unique(spark: SparkSession, sf: str) -> DataFrame:
    return checks.check_unique(domain(spark, sf, "wia"), "bsn")


@query(
    "check_accepted_values",
    oracle("crm", "select contact_id, kanaal from crm where kanaal not in ('telefoon','mail','balie')"),
)
def check_accepted_values(spark: SparkSession, sf: str) -> DataFrame:
    failing = checks.check_accepted_values(domain(spark, sf, "crm"), "kanaal", ["telefoon", "mail", "balie"])
    return failing.select("contact_id", "kanaal")


@query(
    "check_accepted_range",
    oracle("ikv", "select ikv_id, loon_bruto_jaar from ikv where loon_bruto_jaar < 18000 or loon_bruto_jaar > 250000"),
)
def check_accepted_range(spark: SparkSession, sf: str) -> DataFrame:
    failing = checks.check_accepted_range(domain(spark, sf, "ikv"), "loon_bruto_jaar", 18000, 250000)
    return failing.select("ikv_id", "loon_bruto_jaar")


@query(
    "check_relationship",
    oracle("ww zw", "select aanvraag_id, bsn from ww where bsn is not null and bsn not in (select bsn from zw)"),
)
def check_relationship(spark: SparkSession, sf: str) -> DataFrame:
    failing = checks.check_relationship(domain(spark, sf, "ww"), "bsn", domain(spark, sf, "zw"), "bsn")
    return failing.select("aanvraag_id", "bsn")


@query(
    "check_bsn",
    oracle(
        "crm",
        f"""select contact_id, bsn from {_NUMBERS} where bsn is not null and (not regexp_matches(bsn,'^[0-9]{{9}}$')
 or substr(bsn,1,1)='0' or coalesce((case when regexp_matches(bsn,'^[0-9]{{9}}$') then {_DIGIT_SUM} end)%11,0)<>0)""",
    ),
)
def check_bsn(spark: SparkSession, sf: str) -> DataFrame:
    return checks.check_bsn(_numbers(spark, sf), "bsn").select("contact_id", "bsn")


@query(
    "bsn_check_digit",
    oracle(
        "persona_base",
        """select f8, case when r < 10 then cast(r as int) end as digit from (select f8, (9*cast(substr(f8,1,1) as int)
 +8*cast(substr(f8,2,1) as int)+7*cast(substr(f8,3,1) as int)+6*cast(substr(f8,4,1) as int)
 +5*cast(substr(f8,5,1) as int)+4*cast(substr(f8,6,1) as int)+3*cast(substr(f8,7,1) as int)
 +2*cast(substr(f8,8,1) as int))%11 as r from persona_base)""",
    ),
)
def check_digit(spark: SparkSession, sf: str) -> DataFrame:
    return domain(spark, sf, "persona_base").select("f8", bsn_check_digit(F.col("f8")).alias("digit"))


_ACCOUNT = """case when c_custkey%7=0 then null when c_custkey%5=0 then 'NL9' || bsn
 else 'NL' || lpad(cast(c_custkey%100 as varchar(2)),2,'0') || 'BANK' || '0' || bsn end"""


@query(
    "check_iban_modulus",
    oracle(
        "persona",
        """, a as (select bsn, c_custkey, cast('111023200' || bsn || '232100' as hugeint) as n from persona),
b as (select *, 98 - n % 97 as dd from a),
c as (select bsn, dd, case when c_custkey%7=0 then (dd + 1 + c_custkey%90) % 100 else dd end as told, c_custkey%11=0 as lower from b)
select bsn, 'NL' || lpad(cast(told as varchar), 2, '0') || case when lower then 'bank0' else 'BANK0' end || bsn as iban
from c where lower or (cast('111023200' || bsn || '2321' || lpad(cast(told as varchar), 2, '0') as hugeint) % 97) <> 1""",
    ),
)
def check_iban_modulus(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts with right check digits but for every seventh, and in small letters for every eleventh."""
    key = F.col("c_custkey")
    right = account_check_digits(F.lit("NL"), F.concat(F.lit("BANK0"), "bsn"))
    told = F.when(key % 7 == 0, F.lpad(((right.cast("int") + 1 + key % 90) % 100).cast("string"), 2, "0")).otherwise(right)
    bank = F.when(key % 11 == 0, "bank0").otherwise("BANK0")
    accounts = domain(spark, sf, "persona").select("bsn", F.concat(F.lit("NL"), told, bank, "bsn").alias("iban"))
    return checks.check_iban_modulus(accounts, "iban")


@query(
    "check_iban",
    oracle(
        "persona",
        f"""select bsn, iban from (select bsn, {_ACCOUNT} as iban from persona)
 where not regexp_matches(iban,'^NL[0-9]{{2}}[A-Z]{{4}}[0-9]{{10}}$')""",
    ),
)
def check_iban(spark: SparkSession, sf: str) -> DataFrame:
    accounts = domain(spark, sf, "persona").select("bsn", F.expr(_ACCOUNT).alias("iban"))
    return checks.check_iban(accounts, "iban")


@query(
    "check_payroll_number",
    oracle("ikv", "select ikv_id, lh_nummer from ikv where not regexp_matches(lh_nummer,'^[0-9]{9}L[0-9]{2}$')"),
)
def check_payroll_number(spark: SparkSession, sf: str) -> DataFrame:
    return checks.check_payroll_number(domain(spark, sf, "ikv"), "lh_nummer").select("ikv_id", "lh_nummer")


@query(
    "check_row_count",
    oracle("wia_funnel", "select count(*) as n_records, count(*) >= 1 as passed from wia_funnel"),
)
def check_row_count(spark: SparkSession, sf: str) -> DataFrame:
    return checks.check_row_count(marts.wia_funnel(spark, sf), 1)


@query(
    "check_column_min_max",
    oracle(
        "dq_daily wia_funnel",
        """select 'max' as statistic, max(n_bsn_buiten_test_bereik) as value, max(n_bsn_buiten_test_bereik) <= 0 as passed
 from dq_daily union all select 'min', min(n_aanvragen), min(n_aanvragen) >= 2 from wia_funnel""",
    ),
)
def check_column_min_max(spark: SparkSession, sf: str) -> DataFrame:
    highest = checks.check_column_min_max(marts.dq_daily(spark, sf), "n_bsn_buiten_test_bereik", "max", high=0)
    lowest = checks.check_column_min_max(marts.wia_funnel(spark, sf), "n_aanvragen", "min", low=2)
    return highest.select(F.lit("max").alias("statistic"), "*").unionByName(lowest.select(F.lit("min").alias("statistic"), "*"))


@query(
    "run_check_suite",
    oracle(
        "ikv ww",
        """, r as (
 select 'bsn_not_null' as test_name, count(*) filter (where bsn is null) as failures from ikv
 union all select 'loon_not_null', count(*) filter (where loon_bruto_jaar is null) from ikv
 union all select 'loon_range', count(*) filter (where loon_bruto_jaar < 18000 or loon_bruto_jaar > 250000) from ikv
 union all select 'lh_format', count(*) filter (where not regexp_matches(lh_nummer,'^[0-9]{9}L[0-9]{2}$')) from ikv
 union all select 'not_empty', case when count(*)=0 then 1 else 0 end from ikv
 union all select 'ikv_id_unique', count(*) - count(distinct ikv_id) from ikv
 union all select 'bsn_unique', count(*) from (select bsn from ikv group by bsn having count(*)>1)
 union all select 'bsn_has_ww', count(*) from ikv where bsn not in (select bsn from ww))
select test_name, failures, case when failures > 0 then 'failed' else 'passed' end as status from r""",
    ),
)
def run_check_suite(spark: SparkSession, sf: str) -> DataFrame:
    ikv = domain(spark, sf, "ikv")
    pay = F.col("loon_bruto_jaar")
    return checks.run_check_suite(
        ikv,
        [
            checks.RowCheck("bsn_not_null", F.col("bsn").isNull()),
            checks.RowCheck("loon_not_null", pay.isNull()),
            checks.RowCheck("loon_range", checks.outside_range(pay, 18000, 250000)),
            checks.RowCheck("lh_format", ~is_payroll_number(F.col("lh_nummer"))),
            checks.TableCheck("not_empty", F.when(F.count(F.lit(1)) == 0, 1).otherwise(0)),
            checks.TableCheck("ikv_id_unique", checks.duplicates("ikv_id")),
            checks.FrameCheck("bsn_unique", checks.check_unique(ikv, "bsn")),
            checks.FrameCheck("bsn_has_ww", checks.check_relationship(ikv, "bsn", domain(spark, sf, "ww"), "bsn")),
        ],
    )


@query(
    "bsn_valid_share",
    oracle(
        "persona",
        f"""select geslacht, count(*) as n, count(*) filter (where ({_DIGIT_SUM})%11=0) as n_valid
 from persona group by geslacht""",
    ),
)
def bsn_valid_share(spark: SparkSession, sf: str) -> DataFrame:
    valid = F.count_if(is_valid_bsn(F.col("bsn")))
    return domain(spark, sf, "persona").groupBy("geslacht").agg(F.count(F.lit(1)).alias("n"), valid.alias("n_valid"))


# ---- profiles and drift -----------------------------------------------------------------------------

_PROFILED = ("bsn", "kanaal", "duur_seconden", "event_date")


def _profile_sql(rows: str) -> str:
    return oracle(
        "crm",
        " union all ".join(
            f"""select '{c}' as column_name, count(*) as n_records, count(*) filter (where {c} is null) as n_null,
 round(cast(count(*) filter (where {c} is null) as double) / count(*), 6) as null_fraction,
 count(distinct {c}) as n_distinct, cast(min({c}) as varchar) as min_value, cast(max({c}) as varchar) as max_value
 from {rows}"""
            for c in _PROFILED
        ),
    )


@query("column_profile", _profile_sql("crm"))
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profiling.column_profile(domain(spark, sf, "crm"), _PROFILED, exact=True), 6, "null_fraction")


@query(
    "column_profile_sampled",
    _profile_sql("(select * from crm where cast('0x' || substr(md5(contact_id), 1, 8) as bigint) % 100 < 5)"),
)
def column_profile_sampled(spark: SparkSession, sf: str) -> DataFrame:
    sample = profiling.sample_by_key(domain(spark, sf, "crm"), "contact_id", 5)
    return rounded(profiling.column_profile(sample, _PROFILED, exact=True), 6, "null_fraction")


@query(
    "value_distribution",
    oracle(
        "crm",
        """, b as (select cast(min(duur_seconden) as double) as lo, cast(max(duur_seconden) as double) as hi,
 (cast(max(duur_seconden) as double) - cast(min(duur_seconden) as double)) / 10 as w from crm)
select bucket, round(lo + (bucket-1)*w, 6) as low, round(lo + bucket*w, 6) as high, count(*) as n
from (select lo, w, cast(least(floor((duur_seconden - lo) / w) + 1, 10) as int) as bucket from crm, b
 where duur_seconden is not null) group by all""",
    ),
)
def value_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profiling.value_distribution(domain(spark, sf, "crm"), "duur_seconden"), 6, "low", "high")


@query(
    "top_values",
    oracle(
        "crm",
        """select cast(duur_seconden as varchar) as value, count(*) as n from crm group by duur_seconden
 order by n desc, value asc nulls first limit 10""",
    ),
)
def top_values(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.top_values(domain(spark, sf, "crm"), "duur_seconden")


@query(
    "volume_drift",
    oracle(
        "crm",
        """select *, coalesce(abs(change) > 0.05, false) as flagged from (select dag, n_records, n_previous,
 round(cast(n_records - n_previous as double) / n_previous, 6) as change from (select event_date as dag,
 count(*) as n_records, lag(count(*)) over (order by event_date) as n_previous from crm group by event_date))""",
    ),
)
def volume_drift(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profiling.volume_drift(domain(spark, sf, "crm"), "event_date"), 6, "change")


@query(
    "null_drift",
    oracle(
        "crm",
        """, d as (select event_date as dag, avg(case when kanaal is null then 1.0::double else 0 end) as k,
 avg(case when duur_seconden is null then 1.0::double else 0 end) as s, cast(count(distinct bsn) as double) as u
 from crm group by event_date), l as (select dag, 'null:kanaal' as metric, k as value from d
 union all select dag, 'null:duur_seconden', s from d union all select dag, 'distinct:bsn', u from d),
 p as (select *, lag(value) over (partition by metric order by dag) as previous from l)
select metric, dag, round(value,6) as value, round(previous,6) as previous,
 coalesce(case when metric like 'null:%' then value - previous > 0.01 else value < previous end, false) as flagged
from p""",
    ),
)
def null_drift(spark: SparkSession, sf: str) -> DataFrame:
    drift = profiling.null_drift(domain(spark, sf, "crm"), "event_date", ["kanaal", "duur_seconden"], "bsn")
    return rounded(drift, 6, "value", "previous")


# ---- alerts -----------------------------------------------------------------------------------------

CLASSIFIED = """, classified as (select * from (select *, case
 when container like '%csv-uploader%' and message like '%upload_failed%' then 'csv_upload_failed'
 when container like '%keycloak%' and message like '%LOGIN_ERROR%' then 'keycloak_login_error'
 when message like '%java.lang.OutOfMemoryError%' then 'jvm_oom'
 when container like '%trino%' and message like '%Access Denied%' then 'trino_access_denied'
 when container like '%opa%' and message like '%decision_id%' and message like '%"result":false%' then 'opa_deny'
 end as alert_event from log_lines) where alert_event is not null)"""


@query("classify_log_events", oracle("log_lines", f"{CLASSIFIED} select * from classified"))
def classify_log_events(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.classify_log_events(domain(spark, sf, "log_lines"))


def sensitive(rules: tuple[alerts.RateRule, ...]) -> tuple[alerts.RateRule, ...]:
    """The rules with thresholds low enough for the test tables' event rate."""
    return tuple(replace(rule, threshold=0.0) for rule in rules)


def alert_sql(until: str | None = None) -> str:
    parts = []
    for rule in sensitive(alerts.RATE_RULES):
        labels = ", ".join(name if name in rule.per else f"null as {name}" for name in ("namespace", "container"))
        keys = "".join(f", {name}" for name in rule.per)
        needed = rule.hold_minutes + 1
        parts.append(
            f"""select '{rule.alert}' as alert, '{rule.severity}' as severity, {labels}, fired_at
 from (select e + to_minutes(cast(j as int)) as fired_at{keys}, count(*) as n
  from (select distinct date_trunc('minute', ts) + to_minutes(cast(k as int)) as e{keys} from classified,
   (select unnest(range(1, {rule.minutes + 1})) as k) where alert_event = '{rule.event}'),
   (select unnest(range(0, {needed})) as j) group by e + to_minutes(cast(j as int)){keys})
 where n = {needed}"""
        )
    bound = f" where fired_at <= {until}" if until else ""
    return oracle(
        "log_lines",
        f"{CLASSIFIED}, fired as ({' union all '.join(parts)}) select * from fired{bound}",
    )


@query("alert_rates", alert_sql())
def alert_rates(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.alerts(domain(spark, sf, "log_lines"), sensitive(alerts.RATE_RULES))


@query(
    "alert_rates_thresholds",
    oracle(
        "log_lines",
        f"""{CLASSIFIED} select 'JvmOutOfMemory' as alert, 'critical' as severity, namespace, container,
 date_trunc('minute', ts) + to_minutes(cast(k as int)) as fired_at
 from classified, (select unnest(range(1, 11)) as k) where alert_event = 'jvm_oom' group by all""",
    ),
)
def alert_rates_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """With the real thresholds only the memory rule fires on the test tables."""
    return alerts.alerts(domain(spark, sf, "log_lines"))
