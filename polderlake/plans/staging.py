"""Bronze to typed silver: decode the envelope once, cast, rename.

All results are lazy projections that parse each event once, whatever the number of fields. A job
that needs a few fields passes only those to `decode_payload`; the others are then skipped.
"""

from __future__ import annotations

import re

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polderlake.functions.numbers import month_of

# Payload fields per event entity, with the type each gets in silver.
PAYLOADS: dict[str, dict[str, str]] = {
    "persona": {
        "bsn": "string", "voornaam": "string", "achternaam": "string", "geslacht": "string",
        "geboortedatum": "date", "straat": "string", "huisnummer": "int", "postcode": "string",
        "woonplaats": "string", "nationaliteit": "string",
    },
    "employment": {
        "ikv_id": "string", "bsn": "string", "lh_nummer": "string", "werkgever_naam": "string",
        "aanvang_dienstverband": "date", "einde_dienstverband": "date", "loon_bruto_jaar": "int",
    },
    "ww": {
        "aanvraag_id": "string", "bsn": "string", "aanvraag_datum": "date", "laatste_werkdag": "date",
        "reden_einde_dienstverband": "string", "status": "string",
    },
    "wia": {
        "aanvraag_id": "string", "bsn": "string", "aanvraag_datum": "date", "eerste_ziektedag": "date",
        "onderdeel": "string", "regio_code": "string", "status": "string", "arbeidsongeschikt_pct": "int",
    },
    "wajong": {
        "dossier_id": "string", "bsn": "string", "regime": "string", "arbeidsvermogen": "string",
        "ingangsdatum": "date",
    },
    "zw": {"melding_id": "string", "bsn": "string", "eerste_ziektedag": "date", "duur_dagen": "int"},
    "crm": {
        "contact_id": "string", "bsn": "string", "kanaal": "string", "onderwerp": "string",
        "timestamp": "timestamp", "duur_seconden": "int",
    },
    "fez": {
        "jaar": "int", "maand": "int", "wet": "string", "regio_code": "string",
        "uitbetaald_bruto_eur": "int", "aantal_uitkeringen": "int",
    },
}


def payload_text_schema(fields: Mapping[str, str]) -> T.StructType:
    """Envelope schema with every payload field read as text, so that a bad value cannot hide a row."""
    payload = T.StructType([T.StructField(name, T.StringType()) for name in fields])
    return T.StructType([T.StructField("payload", payload)])


def decode_payload(
    bronze: DataFrame, fields: Mapping[str, str], *extra: Column, strict: bool = False
) -> DataFrame:
    """Typed payload columns, then `extra` columns, ingestion time and load date.

    A value that does not fit its type becomes null, or fails the job when `strict`. The column
    `timestamp` holds ISO-8601 text and is renamed by the caller.
    """
    decoded = bronze.withColumn("_event", F.from_json("payload", payload_text_schema(fields)))
    convert = Column.cast if strict else Column.try_cast
    return decoded.select(
        *[convert(F.col(f"_event.payload.{name}"), dtype).alias(name) for name, dtype in fields.items()],
        *extra,
        F.col("source_ts").alias("ingestion_source_ts"),
        "event_date",
    )


def count_bad_casts(bronze: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Per payload field, the number of non-null texts that do not fit the declared type."""
    decoded = bronze.select(F.from_json("payload", payload_text_schema(fields)).alias("_event"))
    counts = []
    for name, dtype in fields.items():
        text = F.col(f"_event.payload.{name}")
        counts.append(F.count_if(text.isNotNull() & text.try_cast(dtype).isNull()).alias(name))
    return decoded.agg(*counts).unpivot([], list(fields), "field", "n_bad")


def stg_persona(bronze: DataFrame) -> DataFrame:
    return decode_payload(bronze, PAYLOADS["persona"])


def stg_employment(bronze: DataFrame) -> DataFrame:
    running = F.col("_event.payload.einde_dienstverband").isNull().alias("is_lopend")
    return decode_payload(bronze, PAYLOADS["employment"], running)


def stg_ww(bronze: DataFrame) -> DataFrame:
    return decode_payload(bronze, PAYLOADS["ww"])


def stg_wia(bronze: DataFrame) -> DataFrame:
    return decode_payload(bronze, PAYLOADS["wia"])


def stg_wajong(bronze: DataFrame) -> DataFrame:
    return decode_payload(bronze, PAYLOADS["wajong"])


def stg_zw(bronze: DataFrame) -> DataFrame:
    return decode_payload(bronze, PAYLOADS["zw"])


def stg_crm(bronze: DataFrame) -> DataFrame:
    return decode_payload(bronze, PAYLOADS["crm"]).withColumnRenamed("timestamp", "contact_ts")


def stg_fez(bronze: DataFrame) -> DataFrame:
    return decode_payload(bronze, PAYLOADS["fez"])


def stg_satisfaction(bronze: DataFrame) -> DataFrame:
    tidy = lambda name: F.lower(F.trim(name)).alias(name)
    return bronze.select(
        "meting_datum",
        tidy("kanaal"),
        tidy("doelgroep"),
        "score",
        "n_respondenten",
        F.nullif(F.trim("opmerking"), F.lit("")).alias("opmerking"),
        *[name for name in ("ingestion_ts", "source_file", "event_date") if name in bronze.columns],
    )


# The 49 declared billing columns (name, type, required) in file order.
BILLING_COLUMNS: tuple[tuple[str, str, bool], ...] = (
    ("BillingAccountId", "string", True),
    ("BillingAccountName", "string", False),
    ("BillingCurrency", "string", True),
    ("BillingPeriodStart", "timestamp", True),
    ("BillingPeriodEnd", "timestamp", True),
    ("ChargePeriodStart", "timestamp", True),
    ("ChargePeriodEnd", "timestamp", True),
    ("ChargeCategory", "string", True),
    ("ChargeSubcategory", "string", False),
    ("ChargeDescription", "string", False),
    ("ChargeFrequency", "string", False),
    ("BilledCost", "decimal(18,6)", True),
    ("EffectiveCost", "decimal(18,6)", True),
    ("ListCost", "decimal(18,6)", False),
    ("ListUnitPrice", "decimal(18,8)", False),
    ("PricingCategory", "string", False),
    ("PricingQuantity", "decimal(24,8)", False),
    ("PricingUnit", "string", False),
    ("UsageQuantity", "decimal(24,8)", False),
    ("UsageUnit", "string", False),
    ("CommitmentDiscountCategory", "string", False),
    ("CommitmentDiscountId", "string", False),
    ("CommitmentDiscountName", "string", False),
    ("CommitmentDiscountType", "string", False),
    ("Provider", "string", True),
    ("Publisher", "string", False),
    ("InvoiceIssuer", "string", False),
    ("ServiceCategory", "string", False),
    ("ServiceName", "string", True),
    ("ResourceId", "string", False),
    ("ResourceName", "string", False),
    ("ResourceType", "string", False),
    ("Region", "string", False),
    ("AvailabilityZone", "string", False),
    ("SkuId", "string", False),
    ("SkuPriceId", "string", False),
    ("SubAccountId", "string", False),
    ("SubAccountName", "string", False),
    ("Tags", "string", False),
    ("oci_ReferenceNumber", "string", False),
    ("oci_CompartmentId", "string", False),
    ("oci_CompartmentName", "string", False),
    ("oci_OverageFlag", "string", False),
    ("oci_UnitPriceOverage", "decimal(18,8)", False),
    ("oci_BilledQuantityOverage", "decimal(24,8)", False),
    ("oci_CostOverage", "decimal(18,6)", False),
    ("oci_AttributedUsage", "decimal(24,8)", False),
    ("oci_AttributedCost", "decimal(18,6)", False),
    ("oci_BackReferenceNumber", "string", False),
)

# Keys taken out of the tags.
BILLING_TAGS = ("environment", "application", "cost_center")


def snake_case(name: str) -> str:
    """`BillingAccountId` -> `billing_account_id`, `oci_CostOverage` -> `oci_cost_overage`."""
    head, sep, tail = name.rpartition("_")
    spaced = "".join(f"_{c.lower()}" if c.isupper() else c for c in tail).lstrip("_")
    return f"{head}{sep}{spaced}"


def stg_billing(bronze: DataFrame) -> DataFrame:
    """The billing rows under snake-case names, with month, savings and three tags, which are parsed once for all three."""
    renamed = {name: snake_case(name) for name, _, _ in BILLING_COLUMNS}
    special = {"Provider": F.lower("Provider").alias("provider"), "Tags": F.col("Tags").alias("tags_raw")}
    columns = [special.get(name, F.col(name).alias(new)) for name, new in renamed.items()]
    list_cost = F.coalesce("ListCost", "EffectiveCost")
    parsed = bronze.withColumn("_tags", F.from_json("Tags", ", ".join(f"{tag} string" for tag in BILLING_TAGS)))
    return parsed.select(
        *columns,
        month_of(F.col("BillingPeriodStart")).alias("billing_month"),
        (list_cost - F.col("EffectiveCost")).cast("decimal(18,6)").alias("savings_amount"),
        *[F.col(f"_tags.{tag}").alias(f"tag_{tag}") for tag in BILLING_TAGS],
        *[name for name in ("ingestion_ts", "source_file", "event_date") if name in bronze.columns],
    )


def inferred_payload_schema(bronze: DataFrame) -> str:
    """Schema of all payloads, merged over every row by one aggregate (only its text reaches the driver)."""
    payload = F.try_parse_json(F.get_json_object("payload", "$.payload"))
    return typed_schema(bronze.agg(F.schema_of_variant_agg(payload).alias("s")).first().s)


def typed_schema(merged: str) -> str:
    """A variant schema as the schema of a struct: objects are structs, and what is always null is text.

    Only types are replaced: field names that contain the same letters, and quoted names, stay.
    """
    words = r"`(?:[^`]|``)*`|(?<![\w`])OBJECT<|(?<![\w`])VOID(?=[,>]|$)"
    return re.sub(words, lambda found: {"OBJECT<": "STRUCT<", "VOID": "STRING"}.get(found[0], found[0]), merged)


def explode_payload(bronze: DataFrame, schema: str | None = None) -> DataFrame:
    """Payload fields as columns; the schema is taken from the data unless given."""
    wanted = schema or inferred_payload_schema(bronze)
    return bronze.select(F.from_json(F.get_json_object("payload", "$.payload"), wanted).alias("p")).select("p.*")
