"""Sources, sinks, upkeep and streams.

These queries write files derived from the test tables below the shared scratch folder, run the
operator on them, and return what arrived.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import marts
from catalog.oracle import oracle
from catalog.registry import query
from catalog.validation import alert_sql, sensitive
from fixtures.domain import domain
from polderlake.functions.streams import stream_of_path, table_of_stream
from polderlake.operators.alerts import RATE_RULES
from polderlake.plans import billing, staging
from polderlake.plans.staging import PAYLOADS
from polderlake.session import scratch_path
from polderlake.sources import csv_files, envelopes, lookups, tables, upkeep
from polderlake.sources.csv_files import CsvColumn
from polderlake.streaming import alert_stream, bronze, csv_drop

DAY = "2024-01-15"
# stream -> (domain view, payload fields)
STREAMS = {
    "org.persona.created": ("persona", tuple(PAYLOADS["persona"])),
    "org.wia.aanvraag.ingediend": ("wia", tuple(PAYLOADS["wia"])),
    "org.zw.melding": ("zw", tuple(PAYLOADS["zw"])),
}
# Written, but not routed: wrong prefix, and too few parts.
STRAY = {"other.ww.aanvraag": ("ww", tuple(PAYLOADS["ww"])), "org.wajong": ("wajong", tuple(PAYLOADS["wajong"]))}


def _write_streams(spark: SparkSession, sf: str, root: str, streams: dict) -> None:
    for stream, (view, fields) in streams.items():
        wrapped = envelopes.wrap_rows(domain(spark, sf, view), stream.split(".", 1)[1], list(fields))
        envelopes.write_envelopes(wrapped, root, stream, DAY)


def _drain(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Run a stream to its end into files and read them back."""
    target = scratch_path(spark, "drained")
    writer = df.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "checkpoint"))
    writer.trigger(availableNow=True).start(target).awaitTermination()
    return spark.read.parquet(target)


@query(
    "raw_jsonl_stream",
    oracle(
        "persona wia zw",
        """select 'persona.created' as event_type, bsn as ref from persona
 union all select 'wia.aanvraag.ingediend', aanvraag_id from wia union all select 'zw.melding', melding_id from zw""",
    ),
)
def raw_jsonl_stream(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "raw")
    _write_streams(spark, sf, root, STREAMS)
    lines = _drain(bronze.raw_jsonl_stream(spark, root), spark)
    field = lambda path: F.get_json_object("value", path)
    ref = F.coalesce(field("$.payload.aanvraag_id"), field("$.payload.melding_id"), field("$.payload.bsn"))
    return lines.select(field("$.event_type").alias("event_type"), ref.alias("ref"))


_PATHS = """case event_id%5 when 0 then 's3a://raw/org/crm/' || event_type || '/dt=2024-01-01/part-1.jsonl'
 when 1 then 's3a://raw/org/' || event_type || '/dt=2024-01-01/part-1.jsonl'
 when 2 then 's3a://raw/org/crm/' || event_type || '/part-1.jsonl'
 when 3 then 's3a://other/x/' || event_type || '/y/dt=2024-01-01/part-1.jsonl'
 else 's3a://raw/x/' || event_type || '/y/dt=2024-01-01/part-1.jsonl' end"""


@query(
    "stream_id_from_path",
    f"""select event_id, replace(nullif(regexp_extract(p, '/raw/(.+?)/dt=', 1), ''), '/', '.') as stream
 from (select event_id, {_PATHS} as p from events)""",
)
def stream_id_from_path(spark: SparkSession, sf: str) -> DataFrame:
    paths = domain(spark, sf, "events").select("event_id", F.expr(_PATHS).alias("p"))
    return paths.select("event_id", stream_of_path(F.col("p"), "s3a://raw/").alias("stream"))


_NAMES = """case event_id%4 when 0 then 'org.crm.' || event_type when 1 then 'org.' || event_type
 when 2 then 'other.crm.' || event_type else 'org.wia.aanvraag.' || event_type end"""


@query(
    "stream_to_table",
    """select event_id, case event_id%4 when 0 then 'crm_' || event_type when 3 then 'wia_aanvraag_' || event_type end
 as table_name from events""",
)
def stream_to_table(spark: SparkSession, sf: str) -> DataFrame:
    names = domain(spark, sf, "events").select("event_id", F.expr(_NAMES).alias("n"))
    return names.select("event_id", table_of_stream(F.col("n"), "org").alias("table_name"))


@query(
    "bronze_enrich",
    oracle(
        "persona wia zw",
        """select stream, count(*) as n, true as complete from (select 'org.persona.created' as stream from persona
 union all select 'org.wia.aanvraag.ingediend' from wia union all select 'org.zw.melding' from zw) group by stream""",
    ),
)
def bronze_enrich(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "raw")
    _write_streams(spark, sf, root, STREAMS)
    rows = _drain(bronze.bronze_enrich(bronze.raw_jsonl_stream(spark, root), root), spark)
    whole = (F.col("source_ts") == F.col("ingestion_ts")) & (F.col("event_date") == F.to_date("source_ts"))
    return rows.groupBy("stream").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(whole & F.col("payload").isNotNull() & F.col("source_file").endswith(".jsonl")).alias("complete"),
    )


@query(
    "route_streams",
    oracle(
        "persona wia zw",
        """select 'persona_created' as table_name, bsn as ref from persona
 union all select 'wia_aanvraag_ingediend', aanvraag_id from wia union all select 'zw_melding', melding_id from zw""",
    ),
)
def route_streams(spark: SparkSession, sf: str) -> DataFrame:
    root, base = scratch_path(spark, "raw"), scratch_path(spark, "bronze")
    _write_streams(spark, sf, root, STREAMS | STRAY)
    enriched = bronze.bronze_enrich(bronze.raw_jsonl_stream(spark, root), root)
    bronze.route_streams(enriched, base, "org", scratch_path(spark, "checkpoint"), None).awaitTermination()
    keys = {"persona_created": "bsn", "wia_aanvraag_ingediend": "aanvraag_id", "zw_melding": "melding_id"}
    parts = [
        bronze.bronze_table(spark, base, table).select(
            F.lit(table).alias("table_name"), F.get_json_object("payload", f"$.payload.{key}").alias("ref")
        )
        for table, key in keys.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _database(spark: SparkSession) -> str:
    location = scratch_path(spark, "tables")
    name = location.rsplit("-", 1)[-1]
    tables.ensure_database(spark, f"t_{name}", location)
    return f"t_{name}"


@query("write_table", oracle("persona", "select bsn, voornaam, geboortedatum, event_date from persona"))
def write_table(spark: SparkSession, sf: str) -> DataFrame:
    table = f"{_database(spark)}.persona"
    rows = domain(spark, sf, "persona").select("bsn", "voornaam", "geboortedatum", "event_date")
    tables.write_table(rows, table, "overwrite", ["event_date"])
    tables.write_table(rows, table, "overwrite", ["event_date"])  # replaced, not doubled
    return spark.table(table)


@query("register_location", oracle("zw", "select melding_id, duur_dagen, eerste_ziektedag from zw"))
def register_location(spark: SparkSession, sf: str) -> DataFrame:
    path, table = scratch_path(spark, "zw"), f"{_database(spark)}.zw"
    rows = domain(spark, sf, "zw").select("melding_id", "duur_dagen", "eerste_ziektedag")
    tables.write_path(rows.filter("duur_dagen < 300"), path)
    tables.register_location(spark, table, path)
    tables.write_path(rows.filter("duur_dagen >= 300"), path)
    tables.register_location(spark, table, path)
    spark.catalog.refreshTable(table)
    return spark.table(table)


@query("write_stream_table", oracle("wia", "select aanvraag_id, status, aanvraag_datum from wia"))
def write_stream_table(spark: SparkSession, sf: str) -> DataFrame:
    source, table = scratch_path(spark, "wia"), f"{_database(spark)}.wia"
    rows = domain(spark, sf, "wia").select("aanvraag_id", "status", "aanvraag_datum")
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    query_ = tables.write_stream_table(
        stream, table, scratch_path(spark, "checkpoint"), partition_by=["status"], trigger_seconds=None
    )
    query_.awaitTermination()
    return spark.table(table)


# ---- CSV ------------------------------------------------------------------------------------------

_CSV = (
    CsvColumn("id", "integer"),
    CsvColumn("at", "timestamp"),
    CsvColumn("day", "date"),
    CsvColumn("kind", "varchar", required=False),
    CsvColumn("amount", "decimal", required=False, min=0, max=90, precision=18, scale=2),
    CsvColumn("share", "double", required=False),
    CsvColumn("flag", "boolean"),
)


def _csv_text(spark: SparkSession, sf: str) -> DataFrame:
    """The events as uploaded text: five timestamp forms, four null texts, an extra column."""
    patterns = [
        "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSS",
        "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss",
    ]
    at = F.coalesce(*[F.when(F.col("event_id") % 5 == i, F.date_format("ts", p)) for i, p in enumerate(patterns)])
    nulls = F.element_at(F.array(F.lit(""), F.lit("NULL"), F.lit("null"), F.lit("NA")), (F.col("event_id") % 4 + 1).cast("int"))
    return domain(spark, sf, "events").select(
        F.lit("x").alias("extra"),
        F.when(F.col("event_id") % 7 == 0, nulls).otherwise(F.col("event_type")).alias("kind"),
        F.col("event_id").cast("string").alias("id"),
        at.alias("at"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.when(F.col("event_id") % 6 == 0, nulls).otherwise(F.col("value").cast("decimal(18,2)").cast("string")).alias("amount"),
        F.col("value").cast("string").alias("share"),
        F.when(F.col("event_id") % 2 == 0, F.lit("true")).otherwise(F.lit("0")).alias("flag"),
    )


@query(
    "csv_typed_scan",
    """select event_id as id, case event_id%5 when 0 then ts when 2 then date_trunc('milliseconds', ts)
 else date_trunc('second', ts) end as "at", cast(ts as date) as "day",
 case when event_id%7=0 then null else event_type end as kind,
 case when event_id%6=0 then null else cast(value as decimal(18,2)) end as amount, value as share, event_id%2=0 as flag
 from events""",
)
def csv_typed_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Two uploads in one folder, whose headers differ in order and in the extra column."""
    path = scratch_path(spark, "upload")
    text = _csv_text(spark, sf)
    odd = F.col("id").cast("long") % 3 == 0
    for rows in (text.filter(~odd), text.filter(odd).select(*reversed(text.columns[1:]))):
        rows.write.mode("append").option("header", True).option("emptyValue", "").csv(path)
    return csv_files.read_csv(spark, path, _CSV)


@query(
    "csv_constraints",
    """select 'non_empty' as rule, cast(0 as bigint) as n_violations from (select 1) where (select count(*) from events) > 0
 union all select 'required:id', count(*) filter (where event_id is null) from events
 union all select 'required:at', count(*) filter (where ts is null) from events
 union all select 'required:day', count(*) filter (where ts is null) from events
 union all select 'required:kind', count(*) filter (where event_id%7=0) from events
 union all select 'min:amount', count(*) filter (where event_id%6<>0 and value < 5) from events
 union all select 'max:amount', count(*) filter (where event_id%6<>0 and value > 20) from events
 union all select 'required:flag', 0 from events where event_id = 0""",
)
def csv_constraints(spark: SparkSession, sf: str) -> DataFrame:
    rows = csv_files.typed_columns(_csv_text(spark, sf), _CSV)
    rules = [
        CsvColumn("id", "integer"), CsvColumn("at", "timestamp"), CsvColumn("day", "date"), CsvColumn("kind", "varchar"),
        CsvColumn("amount", "decimal", required=False, min=5, max=20, scale=2), CsvColumn("flag", "boolean"),
    ]
    return csv_files.constraint_report(rows, rules)


@query(
    "csv_audit_columns",
    """select event_id as id, timestamp '2024-02-01 10:00:00' as ingestion_ts, 'incoming/events.csv' as source_file,
 date '2024-02-01' as event_date from events""",
)
def csv_audit_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = csv_files.typed_columns(_csv_text(spark, sf), _CSV[:1])
    return csv_files.add_audit_columns(rows, "incoming/events.csv", now=datetime(2024, 2, 1, 10))


@query(
    "csv_append_bronze",
    "select event_type as kind, cast(ts as date) as event_date, cast(count(*)*2 as bigint) as n from events group by all",
)
def csv_append_bronze(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "bronze")
    rows = domain(spark, sf, "events").select(F.col("event_type").alias("kind"), F.to_date("ts").alias("event_date"))
    for _ in range(2):
        csv_files.append_bronze(rows, path)
    return spark.read.parquet(path).groupBy("kind", "event_date").agg(F.count(F.lit(1)).alias("n"))


_SATISFACTION = (
    CsvColumn("meting_datum", "date"),
    CsvColumn("kanaal", "varchar"),
    CsvColumn("doelgroep", "varchar"),
    CsvColumn("score", "integer", min=1, max=5),
    CsvColumn("n_respondenten", "integer", min=1),
    CsvColumn("opmerking", "varchar", required=False),
)


@query(
    "csv_staging_stream",
    oracle(
        "satisfaction",
        """select meting_datum, trim(kanaal) as kanaal, score, n_respondenten,
 case when trim(opmerking)='' then null else opmerking end as opmerking from satisfaction""",
    ),
)
def csv_staging_stream(spark: SparkSession, sf: str) -> DataFrame:
    incoming, target = scratch_path(spark, "incoming"), scratch_path(spark, "bronze")
    rows = domain(spark, sf, "satisfaction").select(*[F.trim(c.name).alias(c.name) for c in _SATISFACTION])
    # At least three uploads, more when the table has more splits.
    rows.repartition(max(3, rows.rdd.getNumPartitions())).write.option("header", True).csv(incoming)
    for _ in range(2):  # the second run finds nothing new
        csv_drop.watch_incoming(
            spark, incoming, f"{target}-processed", _SATISFACTION, target, f"{target}-checkpoint", trigger_seconds=None
        ).awaitTermination()
    return spark.read.parquet(target).select("meting_datum", "kanaal", "score", "n_respondenten", "opmerking")


def _with_header(header: str):
    """Puts one line before those of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([header])], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])

    return run


@query(
    "csv_quarantine_stream",
    """select 'accepted' as sink, cast(event_id as varchar) as ref, cast(null as varchar) as reasons from events
 where event_id%10 not in (1, 3, 5, 7) and (value is null or event_id%6=0 or cast(value as decimal(18,2)) between 0 and 90)
 union all select 'refused', case event_id%10 when 1 then 'x' || event_id else cast(event_id as varchar) end,
 case when event_id%10=7 then 'fields' else array_to_string(list_filter([case when event_id%10=1 then 'type:id' end,
  case when event_id%10=3 then 'required:at' end, case when event_id%6<>0 and cast(value as decimal(18,2)) < 0 then 'min:amount' end,
  case when event_id%6<>0 and cast(value as decimal(18,2)) > 90 then 'max:amount' end, case when event_id%10=5 then 'type:flag' end],
  lambda x: x is not null), ',') end from events
 where event_id%10 in (1, 3, 5, 7) or not (value is null or event_id%6=0 or cast(value as decimal(18,2)) between 0 and 90)""",
)
def csv_quarantine_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Uploads with bad numbers, missing times, odd flags and lines with a field too many, in two kinds of headers."""
    incoming, target = scratch_path(spark, "incoming"), scratch_path(spark, "bronze")
    case = F.col("id").cast("long") % 10
    text = _csv_text(spark, sf).withColumns(
        {
            "at": F.when(case == 3, "").otherwise(F.col("at")),
            "flag": F.when(case == 5, "maybe").otherwise(F.col("flag")),
            "share": F.when(case == 7, F.concat(F.col("share"), F.lit(",more"))).otherwise(F.col("share")),
            "id": F.when(case == 1, F.concat(F.lit("x"), F.col("id"))).otherwise(F.col("id")),
        }
    )
    odd = F.xxhash64("id") % 3 == 0
    for rows in (text.filter(~odd), text.filter(odd).select(*reversed(text.columns[1:]))):
        line = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in rows.columns])
        # A header line before the lines of each file.
        files = rows.select(line.alias("value")).repartition(3).mapInArrow(_with_header(",".join(rows.columns)), "value string")
        files.write.mode("append").text(incoming)
    for _ in range(2):  # the second run finds nothing new
        csv_drop.watch_with_quarantine(
            spark, incoming, f"{target}-processed", _CSV, target, f"{target}-refused", f"{target}-checkpoint", trigger_seconds=None
        ).awaitTermination()
    accepted = spark.read.parquet(target).select(F.lit("accepted").alias("sink"), F.col("id").cast("string").alias("ref"), F.lit(None).cast("string").alias("reasons"))
    parts = F.split("line", ",")
    number = F.when(F.col("line").startswith("x,"), F.element_at(parts, 3)).otherwise(F.element_at(parts, -2))
    refused = spark.read.parquet(f"{target}-refused").select(F.lit("refused").alias("sink"), number.alias("ref"), F.array_join("refused_for", ",").alias("reasons"))
    return accepted.unionByName(refused)


# ---- sinks and upkeep -------------------------------------------------------------------------------


@query(
    "envelope_jsonl_sink",
    oracle(
        "wia",
        """select 'wia.created' as event_type, '1.0.0' as schema_version, 'true' as synthetic, aanvraag_id,
 cast(aanvraag_datum as varchar) as aanvraag_datum, cast(arbeidsongeschikt_pct as varchar) as pct from wia""",
    ),
)
def envelope_jsonl_sink(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "raw")
    wrapped = envelopes.wrap_rows(domain(spark, sf, "wia"), "wia.created", list(PAYLOADS["wia"]))
    envelopes.write_envelopes(wrapped, root, "org.wia.created", DAY)
    lines = spark.read.option("pathGlobFilter", "*.jsonl").text(f"{root}/org/wia/created/dt={DAY}")
    wanted = {
        "event_type": "$.event_type", "schema_version": "$.schema_version", "synthetic": "$.meta.synthetic",
        "aanvraag_id": "$.payload.aanvraag_id", "aanvraag_datum": "$.payload.aanvraag_datum",
        "pct": "$.payload.arbeidsongeschikt_pct",
    }
    return lines.select(*[F.get_json_object("value", path).alias(name) for name, path in wanted.items()])


# Silver table -> bronze column -> silver column.
SILVER = {
    "persona": {
        "bsn": "bsn", "voornaam": "voornaam", "achternaam": "achternaam", "geslacht": "geslacht",
        "geboortedatum": "geboortedatum", "woonplaats": "woonplaats", "ingestion_source_ts": "ingestion_source_ts",
        "event_date": "event_date",
    },
    "ikv": {c: c for c in ("ikv_id", "bsn", "werkgever_naam", "aanvang_dienstverband", "einde_dienstverband", "loon_bruto_jaar")},
    "ww": {c: c for c in ("aanvraag_id", "bsn", "aanvraag_datum", "status", "reden_einde_dienstverband")},
    "zw": {c: c for c in ("melding_id", "bsn", "eerste_ziektedag", "duur_dagen")},
    "wia": {c: c for c in ("aanvraag_id", "bsn", "aanvraag_datum", "status", "onderdeel", "arbeidsongeschikt_pct", "regio_code")},
    "wajong": {c: c for c in ("dossier_id", "bsn", "ingangsdatum", "regime", "arbeidsvermogen")},
    "crm": {c: c for c in ("contact_id", "bsn", "contact_ts", "kanaal", "onderwerp", "duur_seconden")},
}


@query(
    "silver_full_refresh",
    oracle(
        " ".join(SILVER),
        " union all ".join(
            f"select '{t}' as table_name, count(*) as n, count(distinct {next(iter(c))}) as n_keys, "
            f"cast({len(c)} as int) as n_columns from {t}"
            for t, c in SILVER.items()
        ),
    ),
)
def silver_full_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Seven tables, each delivered twice in bronze, refreshed to one copy of each row."""
    parts = []
    for table, columns in SILVER.items():
        rows = domain(spark, sf, table)
        silver = tables.refresh_silver(rows.unionByName(rows), columns, scratch_path(spark, f"silver-{table}"))
        parts.append(
            silver.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(next(iter(columns.values()))).alias("n_keys")).select(
                F.lit(table).alias("table_name"), "n", "n_keys", F.lit(len(silver.columns)).alias("n_columns")
            )
        )
    return reduce(DataFrame.unionByName, parts)


@query(
    "silver_dedup_rows",
    oracle("crm", "select distinct bsn, kanaal, onderwerp from crm"),
)
def silver_dedup_rows(spark: SparkSession, sf: str) -> DataFrame:
    return tables.refresh_silver(domain(spark, sf, "crm"), {c: c for c in ("bsn", "kanaal", "onderwerp")})


@query(
    "seed_lookup",
    oracle(
        "persona fez",
        """select 'regio' as lookup, provincie as label, count(*) as n from persona join (values ('AMS','Noord-Holland'),
 ('RTM','Zuid-Holland'),('DHN','Zuid-Holland'),('UTR','Utrecht'),('EHV','Noord-Brabant'),('GRO','Groningen'),
 ('ZWO','Overijssel'),('ARN','Gelderland'),('BRD','Noord-Brabant')) r(code, provincie) on regio_code=code group by 2
 union all select 'wet', naam, count(*) from fez join (values ('WW','Werkloosheidswet'),
 ('WIA','Wet werk en inkomen naar arbeidsvermogen'),('Wajong','Wet arbeidsongeschiktheidsvoorziening jonggehandicapten'),
 ('ZW','Ziektewet'),('TW','Toeslagenwet')) l(code, naam) on wet=code group by 2
 union all select 'typen', wet, count(*) * case wet when 'WIA' then 2 else 1 end from fez group by wet""",
    ),
)
def seed_lookup(spark: SparkSession, sf: str) -> DataFrame:
    fez = domain(spark, sf, "fez")
    joined = {
        "regio": domain(spark, sf, "persona").join(lookups.regions(spark), F.col("regio_code") == F.col("code")).select(
            F.col("provincie").alias("label")
        ),
        "wet": fez.join(lookups.laws(spark), F.col("wet") == F.col("code")).select(F.col("naam").alias("label")),
        "typen": fez.join(lookups.benefit_types(spark), "wet").select(F.col("wet").alias("label")),
    }
    parts = [
        df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("lookup"), "label", "n")
        for name, df in joined.items()
    ]
    return reduce(DataFrame.unionByName, parts)


RETAIN_AT = date(2005, 1, 15)


@query(
    "retention_delete",
    oracle("ww", "select aanvraag_id, bsn, aanvraag_datum from ww where aanvraag_datum >= date '1998-01-15'"),
)
def retention_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Whole load-date folders go; what is left is read back."""
    path = scratch_path(spark, "ww")
    rows = domain(spark, sf, "ww").select("aanvraag_id", "bsn", "aanvraag_datum")
    tables.write_path(rows.withColumn("month", F.trunc("aanvraag_datum", "MM")), path, partition_by=["month"])
    # Months that end before the cutoff are dropped as folders; the month it cuts through is filtered.
    upkeep.drop_expired_partitions(spark, path, "month", 7, date(2005, 1, 1))
    left = spark.read.parquet(path)
    return upkeep.retention_survivors(left, "aanvraag_datum", 7, RETAIN_AT).drop("month")


@query(
    "retention_rewrite",
    oracle("zw", "select melding_id, eerste_ziektedag from zw where eerste_ziektedag >= date '1998-01-15'"),
)
def retention_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    path, target = scratch_path(spark, "zw"), scratch_path(spark, "zw-kept")
    tables.write_path(domain(spark, sf, "zw").select("melding_id", "eerste_ziektedag"), path)
    return spark.read.parquet(upkeep.rewrite_survivors(spark, path, target, "eerste_ziektedag", 7, RETAIN_AT))


@query(
    "retention_enforced",
    oracle(
        "crm fez zw persona",
        """, f as (select make_date(jaar, maand, 1) as d from fez)
select 'crm' as table_name, 'delete' as action, count(*) filter (where event_date < date '2024-01-20') as n_deleted,
 count(*) filter (where event_date >= date '2024-01-20') as n_left from crm
union all select 'fez', 'dry_run', count(*) filter (where d < date '2016-01-20'), count(*) from f
union all select 'zw', 'delete', count(*) filter (where eerste_ziektedag < date '1998-01-20'),
 count(*) filter (where eerste_ziektedag >= date '1998-01-20' or eerste_ziektedag is null) from zw
union all select 'persona', 'manual', null, count(*) from persona""",
    ),
)
def retention_enforced(spark: SparkSession, sf: str) -> DataFrame:
    """One rule of each kind on stored tables: by folder, by rewriting, a dry run, and one left to a person."""
    rows = {
        "crm": domain(spark, sf, "crm").select("contact_id", "event_date"),
        "fez": domain(spark, sf, "fez").select("wet", F.make_date("jaar", "maand", F.lit(1)).alias("event_date")),
        "zw": domain(spark, sf, "zw").select("melding_id", "eerste_ziektedag"),
        "persona": domain(spark, sf, "persona").select("bsn"),
    }
    rules = [
        upkeep.RetentionRule("crm", "event_date", 2),
        upkeep.RetentionRule("fez", "event_date", 10, dry_run=True),
        upkeep.RetentionRule("zw", "eerste_ziektedag", 28),
        upkeep.RetentionRule("persona", None, 7),
    ]
    paths = {name: scratch_path(spark, name) for name in rows}
    for name, df in rows.items():
        tables.write_path(df, paths[name], partition_by=["event_date"] if name == "crm" else [])
    report, now = upkeep.enforce_retention(spark, paths, rules, date(2026, 1, 20))
    left = None
    for name, path in now.items():
        one = spark.read.schema(rows[name].schema).parquet(path).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_left"))
        left = one if left is None else left.unionByName(one)
    return report.join(left, "table_name").select("table_name", "action", "n_deleted", "n_left")


# Options of the upload's files: a compressed file is read by one task, so its rows are limited; the usual level takes thrice the time.
UPLOAD = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": 250_000}


@query(
    "billing_upload_to_spend",
    marts._money_sql("spend_monthly", *marts._MONEY),
)
def billing_upload_to_spend(spark: SparkSession, sf: str) -> DataFrame:
    """The billing upload by its declared columns: CSV, checks, bronze, staging, mart."""
    upload, bronze_path = scratch_path(spark, "billing-csv"), scratch_path(spark, "billing")
    rows = domain(spark, sf, "billing")
    # The fixture has no period ends, which an upload must have.
    ends = {"BillingPeriodEnd": F.add_months("BillingPeriodStart", 1).cast("timestamp"), "ChargePeriodEnd": F.date_add("ChargePeriodStart", 1).cast("timestamp")}
    columns = csv_files.BILLING_CSV
    text = rows.withColumns(ends).select(*[csv_files.as_text(c).alias(c.name) for c in columns])
    text.write.option("header", True).option("emptyValue", "").option("escape", '"').options(**UPLOAD).csv(upload)
    csv_files.ingest_csv(spark, f"{upload}/", upload, columns, bronze_path, load_date=date(2024, 1, 31))
    return marts._money(billing.spend_monthly(staging.stg_billing(spark.read.parquet(bronze_path))))


@query(
    "retention_dry_run",
    oracle(
        "crm fez wia_funnel persona",
        """select 'crm' as table_name, 'event_date' as date_column, cast(2 as int) as years,
 count(*) filter (where event_date < date '2024-01-20') as would_delete, 'delete' as action from crm
 union all select 'fez', 'event_date', 10, count(*) filter (where make_date(jaar, maand, 1) < date '2016-01-20'), 'dry_run' from fez
 union all select 'wia_funnel', 'aanvraag_datum', 7, count(*) filter (where aanvraag_datum < date '2019-01-20'), 'delete'
 from wia_funnel union all select 'client_360', null, 7, null, 'manual' from (select 1)""",
    ),
)
def retention_dry_run(spark: SparkSession, sf: str) -> DataFrame:
    rules = [
        upkeep.RetentionRule("crm", "event_date", 2),
        upkeep.RetentionRule("fez", "event_date", 10, dry_run=True),
        upkeep.RetentionRule("wia_funnel", "aanvraag_datum", 7),
        upkeep.RetentionRule("client_360", None, 7, dry_run=True),
    ]
    found = {
        "crm": domain(spark, sf, "crm"),
        "fez": domain(spark, sf, "fez").withColumn("event_date", F.make_date("jaar", "maand", F.lit(1))),
        "wia_funnel": marts.wia_funnel(spark, sf),
        "client_360": domain(spark, sf, "persona"),
    }
    return upkeep.retention_report(found, rules, date(2026, 1, 20))


@query(
    "compact_table",
    oracle("crm", "select event_date, count(*) as n, count(distinct contact_id) as n_ids, true as fewer_files from crm group by event_date"),
)
def compact_table(spark: SparkSession, sf: str) -> DataFrame:
    path, target = scratch_path(spark, "crm"), scratch_path(spark, "crm-compact")
    rows = domain(spark, sf, "crm")
    tables.write_path(rows.repartition(max(8, rows.rdd.getNumPartitions())), path, partition_by=["event_date"])
    files = spark.read.parquet(path).groupBy("event_date").agg(F.count_distinct("_metadata.file_path").alias("before"))
    after = upkeep.compact_path(spark, path, target, ["event_date"])
    counts = after.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("contact_id").alias("n_ids"),
        F.count_distinct("_metadata.file_path").alias("after"),
    )
    return counts.join(files, "event_date").select(
        "event_date", "n", "n_ids", (F.col("after") < F.col("before")).alias("fewer_files")
    )


@query(
    "bronze_freshness",
    oracle(
        "crm log_lines",
        """select 'crm' as source, 'streaming' as mode, count(*) as n_records, max(contact_ts) as max_source_ts,
 datesub('second', max(contact_ts), timestamp '2024-01-31 00:00:00') as lag_seconds,
 case when datesub('second', max(contact_ts), timestamp '2024-01-31 00:00:00') > 300 then 'late' else 'ok' end as status
 from crm where event_date >= date '2024-01-30'
 union all select 'old_stream', 'streaming', 0, null, null, 'stale' from (select 1)
 union all select 'old_batch', 'batch', 0, null, null, 'ok' from (select 1)""",
    ),
)
def bronze_freshness(spark: SparkSession, sf: str) -> DataFrame:
    recent = domain(spark, sf, "crm").withColumn("source_ts", F.col("contact_ts"))
    old = domain(spark, sf, "ikv").select("event_date", F.col("event_date").cast("timestamp").alias("source_ts"))
    slas = [
        upkeep.SourceSla("crm", "streaming", 300),
        upkeep.SourceSla("old_stream", "streaming", 300),
        upkeep.SourceSla("old_batch", "batch", 3600),
    ]
    return upkeep.bronze_freshness(
        {"crm": recent, "old_stream": old, "old_batch": old}, slas, datetime(2024, 1, 31)
    )


@query("alert_rate_stream", alert_sql("(select max(ts) from log_lines)"))
def alert_rate_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The alert rates as a stream over the same log lines."""
    source, target = scratch_path(spark, "log"), scratch_path(spark, "alerts")
    lines = domain(spark, sf, "log_lines")
    # One memory error ten days later moves the watermark past every earlier window.
    later = lines.agg((F.max("ts") + F.expr("INTERVAL 10 DAYS")).alias("ts")).select(
        "ts", F.lit("ns-0").alias("namespace"), F.lit("spark-driver").alias("container"),
        F.lit("java.lang.OutOfMemoryError").alias("message"),
    )
    lines.unionByName(later).write.parquet(source)
    stream = spark.readStream.schema(lines.schema).parquet(source)
    alert_stream.alert_stream(
        stream, target, f"{target}-checkpoint", sensitive(RATE_RULES), trigger_seconds=None
    ).awaitTermination()
    until = lines.agg(F.max("ts").alias("ts")).scalar()
    return spark.read.parquet(target).filter(F.col("fired_at") <= until)
