"""The domain tables, derived from the given test tables.

One text serves both engines; only integer division differs (`@div@`). `{name}` refers to a test
table or to another domain table.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

TEST_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# Clock values used wherever a rule needs "now".
AS_OF_DATE = "2026-01-01"
AS_OF_TS = "2024-01-31 00:00:00"
SALT = "demo-salt"

VIEWS: dict[str, str] = {
    "persona_base": """
select *, lpad(cast(case when c_custkey between 0 and 99999999 then (90000000+c_custkey)%100000000
  else cast(concat('no number left for customer ',cast(c_custkey as varchar(20))) as bigint) end as varchar(20)),8,'0')
  as f8
from {customer} join {nation} on c_nationkey=n_nationkey""",
    "persona": """
select concat(f8, cast(((9*cast(substr(f8,1,1) as int)+8*cast(substr(f8,2,1) as int)
  +7*cast(substr(f8,3,1) as int)+6*cast(substr(f8,4,1) as int)+5*cast(substr(f8,5,1) as int)
  +4*cast(substr(f8,6,1) as int)+3*cast(substr(f8,7,1) as int)+2*cast(substr(f8,8,1) as int))%11)%10
  as varchar(2))) as bsn, c_name as voornaam, c_mktsegment as achternaam,
 case c_custkey%3 when 0 then 'M' when 1 then 'V' else 'X' end as geslacht,
 date '1946-01-01' + cast((c_custkey*7919)%21900 as int) as geboortedatum, n_name as woonplaats, c_custkey,
 case when c_custkey%17=0 then null else concat('Straat ', c_mktsegment) end as straat,
 cast(c_custkey%200+1 as int) as huisnummer,
 concat(cast(1000+c_custkey%9000 as varchar(4)),'AB') as postcode, n_name as nationaliteit,
 case c_nationkey%9 when 0 then 'AMS' when 1 then 'RTM' when 2 then 'DHN' when 3 then 'UTR' when 4 then 'EHV'
  when 5 then 'GRO' when 6 then 'ZWO' when 7 then 'ARN' else 'BRD' end as regio_code,
 date '2024-01-01' + cast(c_custkey%30 as int) as event_date,
 cast(date '2024-01-01' + cast(c_custkey%30 as int) as timestamp) as ingestion_source_ts
from {persona_base}""",
    "ikv": """
select concat('IKV-',cast(o_orderkey as varchar(20))) as ikv_id, bsn,
 case when o_orderkey%97=0 then cast(o_orderkey as varchar(20))
  when o_orderkey between 0 and 98999999999
   then concat(lpad(cast(o_orderkey%1000000000 as varchar(20)),9,'0'),'L',lpad(cast(o_orderkey%99+1 as varchar(2)),2,'0'))
  else cast(cast(concat('no number left for order ',cast(o_orderkey as varchar(20))) as bigint) as varchar(20))
  end as lh_nummer,
 case when o_orderkey%83=0 then null else o_orderpriority end as werkgever_naam,
 cast(o_orderdate as date) as aanvang_dienstverband,
 case when o_orderstatus='F' then cast(o_orderdate as date) + cast(90+o_orderkey%1000 as int) end
  as einde_dienstverband,
 case when o_orderkey%89=0 then null else cast(floor(o_totalprice) as int) end as loon_bruto_jaar,
 o_orderstatus<>'F' as is_lopend,
 date '2024-01-01' + cast(o_orderkey%10 as int) as event_date
from {orders} join {persona} on o_custkey=c_custkey where o_orderkey%2=0""",
    "ww": """
select concat('WW-',cast(o_orderkey as varchar(20))) as aanvraag_id, bsn,
 cast(o_orderdate as date) as aanvraag_datum, cast(o_orderdate as date) - 14 as laatste_werkdag,
 case o_orderkey%4 when 0 then 'ontslag_werkgever' when 1 then 'einde_contract'
  when 2 then 'wederzijds_goedvinden' else 'eigen_initiatief' end as reden_einde_dienstverband,
 case (o_orderkey @div@ 10)%4 when 0 then 'INGEDIEND'
  when 1 then case when o_orderkey%10=9 then 'in behandeling' else 'IN_BEHANDELING' end when 2 then 'TOEGEKEND'
  else case when o_orderkey%10=9 then 'afgewezen' else 'AFGEWEZEN' end end as status
from {orders} join {persona} on o_custkey=c_custkey where o_orderkey%10 in (1,9)""",
    "wia": """
select concat('WIA-',cast(o_orderkey as varchar(20))) as aanvraag_id, bsn,
 cast(o_orderdate as date) as aanvraag_datum, cast(o_orderdate as date) - 700 as eerste_ziektedag, regio_code,
 case when o_orderkey%3=0 then 'IVA' else 'WGA' end as onderdeel,
 case (o_orderkey @div@ 10)%6 when 0 then 'INGEDIEND' when 1 then 'IN_BEHANDELING' when 2 then 'TOEGEKEND_WGA'
  when 3 then 'TOEGEKEND_IVA' when 4 then 'TOEGEKEND' else 'AFGEWEZEN' end as status,
 case when o_orderkey%7=0 then null else cast(o_orderkey%101 as int) end as arbeidsongeschikt_pct
from {orders} join {persona} on o_custkey=c_custkey where o_orderkey%10=3""",
    "zw": """
select concat('ZW-',cast(o_orderkey as varchar(20))) as melding_id, bsn,
 cast(o_orderdate as date) as eerste_ziektedag, cast(o_orderkey%731 as int) as duur_dagen
from {orders} join {persona} on o_custkey=c_custkey where o_orderkey%10=5""",
    "wajong": """
select concat('WAJ-',cast(o_orderkey as varchar(20))) as dossier_id, bsn,
 case o_orderkey%3 when 0 then 'oude_Wajong' when 1 then 'Wajong_2010' else 'Wajong_2015' end as regime,
 case o_orderkey%4 when 0 then null when 1 then 'volledig' when 2 then 'gedeeltelijk' else 'duurzaam_geen' end
  as arbeidsvermogen,
 case when o_orderkey%40=7 then null else cast(o_orderdate as date) end as ingangsdatum
from {orders} join {persona} on o_custkey=c_custkey where o_orderkey%10=7""",
    "crm": """
select concat('CC-',cast(event_id as varchar(20))) as contact_id, bsn,
 case event_type when 'view' then 'telefoon' when 'click' then 'mail' when 'signup' then 'balie'
  when 'error' then 'beeldbellen' else null end as kanaal,
 case event_id%4 when 0 then 'WW' when 1 then 'WIA' when 2 then 'Wajong' else 'algemeen' end as onderwerp,
 cast(ts as timestamp) as contact_ts,
 case when event_type='click' then null else cast(floor(value) as int) end as duur_seconden,
 cast(ts as date) as event_date
from {events} join {persona} on user_id=c_custkey""",
    "satisfaction": """
select cast(ts as date) as meting_datum,
 case event_id%5 when 0 then ' Web ' when 1 then 'TELEFOON' when 2 then 'email' when 3 then 'Balie'
  else 'chat' end as kanaal,
 ' Werkzoekend' as doelgroep, event_id%5+1 as score, event_id%40+1 as n_respondenten,
 case when event_id%3=0 then '  ' else event_type end as opmerking
from {events}""",
    "fez": """
select cast(year(o_orderdate) as int) as jaar, cast(month(o_orderdate) as int) as maand,
 case o_orderpriority when '1-URGENT' then 'WW' when '2-HIGH' then 'WIA' when '3-MEDIUM' then 'Wajong'
  when '5-LOW' then 'ZW' else 'TW' end as wet, regio_code,
 cast(floor(o_totalprice) as int) as uitbetaald_bruto_eur, cast(o_orderkey%4500+500 as int) as aantal_uitkeringen
from {orders} join {persona} on o_custkey=c_custkey""",
    "billing": """
select concat('acct-',cast(s_suppkey%4 as varchar(2))) as BillingAccountId,
 cast(null as varchar(20)) as BillingAccountName, 'EUR' as BillingCurrency,
 cast(date_trunc('month', l_shipdate) as timestamp) as BillingPeriodStart,
 cast(null as timestamp) as BillingPeriodEnd, cast(l_shipdate as timestamp) as ChargePeriodStart,
 cast(null as timestamp) as ChargePeriodEnd,
 case when l_orderkey%20=0 then 'Purchase' when l_orderkey%20=1 then 'Credit' when l_orderkey%50=2 then 'Tax'
  else 'Usage' end as ChargeCategory,
 cast(null as varchar(20)) as ChargeSubcategory, cast(null as varchar(20)) as ChargeDescription,
 'Usage-Based' as ChargeFrequency,
 cast(case when l_orderkey%20=1 then -1 else 1 end * l_extendedprice*(1-l_discount) as decimal(18,6)) as BilledCost,
 cast(case when l_orderkey%20=1 then -1 else 1 end * l_extendedprice*(1-l_discount) as decimal(18,6))
  as EffectiveCost,
 case when l_orderkey%11=0 then null else cast(l_extendedprice as decimal(18,6)) end as ListCost,
 cast(null as decimal(18,8)) as ListUnitPrice,
 case l_returnflag when 'A' then 'Committed' when 'N' then 'Standard' else 'Dynamic' end as PricingCategory,
 cast(null as decimal(24,8)) as PricingQuantity, cast(null as varchar(20)) as PricingUnit,
 cast(l_quantity as decimal(24,8)) as UsageQuantity, 'Hours' as UsageUnit,
 cast(null as varchar(20)) as CommitmentDiscountCategory,
 case l_returnflag when 'A' then concat('cd-',cast(l_suppkey%17 as varchar(3))) end as CommitmentDiscountId,
 cast(null as varchar(20)) as CommitmentDiscountName, cast(null as varchar(20)) as CommitmentDiscountType,
 case s_suppkey%4 when 0 then 'OCI' when 1 then 'AWS' when 2 then 'Azure' else 'GCP' end as Provider,
 cast(null as varchar(20)) as Publisher, cast(null as varchar(20)) as InvoiceIssuer,
 p_type as ServiceCategory, p_brand as ServiceName,
 case when l_partkey%50=0 then null else concat('res-',cast(l_partkey as varchar(20))) end as ResourceId,
 p_name as ResourceName, p_type as ResourceType, n_name as Region, cast(null as varchar(20)) as AvailabilityZone,
 concat('sku-',p_brand) as SkuId, cast(null as varchar(20)) as SkuPriceId,
 concat('sub-',cast(s_suppkey%4 as varchar(2))) as SubAccountId, s_name as SubAccountName,
 case when l_linenumber=1 then '{{}}' else concat('{{"environment":"',case l_linenumber%3 when 0 then 'prod'
  when 1 then 'acc' else 'test' end,'","application":"app-',cast(l_partkey%6 as varchar(2)),
  '","cost_center":"CC-',cast(l_suppkey%4 as varchar(2)),'"}}') end as Tags,
 cast(null as varchar(20)) as oci_ReferenceNumber, concat('comp-',cast(l_suppkey%9 as varchar(2))) as oci_CompartmentId,
 cast(null as varchar(20)) as oci_CompartmentName, case when l_linenumber=7 then 'Y' else 'N' end as oci_OverageFlag,
 cast(null as decimal(18,8)) as oci_UnitPriceOverage, cast(null as decimal(24,8)) as oci_BilledQuantityOverage,
 cast(null as decimal(18,6)) as oci_CostOverage, cast(null as decimal(24,8)) as oci_AttributedUsage,
 cast(null as decimal(18,6)) as oci_AttributedCost, cast(null as varchar(20)) as oci_BackReferenceNumber,
 cast(l_shipdate as timestamp) as ingestion_ts, 'billing.csv' as source_file, cast(l_shipdate as date) as event_date
from {lineitem} join {supplier} on l_suppkey=s_suppkey join {part} on l_partkey=p_partkey
 join {nation} on s_nationkey=n_nationkey""",
    "log_lines": """
select cast(ts as timestamp) as ts, concat('ns-',cast(user_id%3 as varchar(2))) as namespace,
 case event_type when 'error' then 'spark-driver' when 'view' then 'trino' when 'click' then 'opa'
  when 'signup' then 'keycloak' else 'csv-uploader' end as container,
 case event_type when 'error' then 'java.lang.OutOfMemoryError: heap'
  when 'view' then case when event_id%2=0 then 'Access Denied: x' else 'query ok' end
  when 'click' then concat('{{"decision_id":"',cast(event_id as varchar(20)),'","result":',
   case when event_id%2=0 then 'false' else 'true' end,'}}')
  when 'signup' then 'type=LOGIN_ERROR' else 'upload_failed schema' end as message
from {events}""",
    "access_requests": """
select event_id as request_id,
 case when event_id%31=0 then '' else concat('u',cast(user_id as varchar(20))) end as user_name,
 case user_id%6 when 0 then 'crm_medewerker' when 1 then 'wia_beoordelaar' when 2 then 'data_steward'
  when 3 then 'fez_analist' when 4 then 'platform_admin' else 'researcher' end as role,
 case when event_id%13=0 then 'data_access:gold.uc05_client_360' end as grant_role,
 case event_type when 'purchase' then 'InsertIntoTable' when 'error' then 'ExecuteQuery' else 'SelectFromColumns'
  end as operation, 'gold' as catalog_name,
 case event_id%4 when 0 then 'uc05_client_360' when 1 then 'uc01_wia_funnel' when 2 then 'uc06_lastprognose'
  else 'uc11_klantreis' end as schema_name, 'mart' as table_name,
 case event_id%5 when 0 then 'klantcontact' when 1 then 'sturingsinfo' when 2 then 'Actuarie'
  when 3 then 'behandeling' else '' end as purpose
from {events}""",
}


def _needs(name: str) -> list[str]:
    text = VIEWS[name].replace("{{", "").replace("}}", "")
    return re.findall(r"\{(\w+)\}", text)


_SEEN: dict[tuple, DataFrame] = {}


def _stamp(sf_dir: str) -> tuple | None:
    """Sizes and times of the test tables, so that a plan is not reused after a table has changed."""
    files = [os.path.join(sf_dir, f"{name}.parquet") for name in TEST_TABLES]
    if not all(os.path.isfile(file) for file in files):
        return None
    return tuple((os.stat(file).st_mtime_ns, os.stat(file).st_size) for file in files)


def stamp_key(sf_dir: str, name: str) -> tuple | None:
    """A key for what is made of the test tables as they are now; None if their state can't be seen."""
    stamp = _stamp(sf_dir)
    return None if stamp is None else (name, sf_dir, stamp)


def domain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table as a lazy DataFrame. Only the plan is kept for the next call, never rows."""
    return _domain(spark, sf_dir, name, _stamp(sf_dir))


def _key(spark: SparkSession, sf_dir: str, name: str, stamp: tuple | None) -> tuple:
    return (spark.sparkContext.applicationId, id(spark), sf_dir, name, stamp)


def _domain(spark: SparkSession, sf_dir: str, name: str, stamp: tuple | None) -> DataFrame:
    key = _key(spark, sf_dir, name, stamp)
    if stamp is not None and key in _SEEN:
        return _SEEN[key]
    if name in TEST_TABLES:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    else:
        inputs = {needed: _domain(spark, sf_dir, needed, stamp) for needed in dict.fromkeys(_needs(name))}
        df = spark.sql(VIEWS[name].replace("@div@", "div"), **inputs)
    if stamp is not None:
        _SEEN[key] = df
    return df


_ROWS: dict[tuple, int] = {}


def row_count(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Rows of a test table, from its file footers; kept until the table changes."""
    stamp = _stamp(sf_dir)
    key = (sf_dir, name, stamp)
    if stamp is None or key not in _ROWS:
        _ROWS[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet").count()
    return _ROWS[key]
