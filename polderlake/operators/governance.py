"""Governed reads: row filters, column masks, purpose and access decisions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from polderlake.functions.numbers import first_of_year
from polderlake.plans.clients import WIA_GRANTED
from polderlake.sources.lookups import ROLES

# Schemas the rules name.
REGION_SCHEMAS = ("wia", "uc01_wia_funnel")
OPT_OUT_SCHEMA = "uc04_tw_eligibility"
JOURNEY_SCHEMA = "uc11_klantreis"
SANDBOX = "sandbox"


def capable(roles: Iterable[str], capability: str) -> bool:
    """Whether one of the roles has the capability."""
    return any(bool(ROLES.get(role, {}).get(capability)) for role in roles)


def region_code(region: str | None) -> str | None:
    """Upper-case region when it is exactly three letters, else None (no filter)."""
    lowered = (region or "").lower()
    return lowered.upper() if re.fullmatch("[a-z]{3}", lowered) else None


# ---- row filters --------------------------------------------------------------------------------


def filter_region(schema: str, roles: Sequence[str], region: str | None) -> Column | None:
    code = region_code(region)
    if "wia_beoordelaar" in roles and schema in REGION_SCHEMAS and code:
        return F.col("regio_code") == code
    return None


def filter_opt_out(schema: str) -> Column | None:
    return ~F.col("opt_out") if schema == OPT_OUT_SCHEMA else None


def filter_pseudo_only(schema: str, catalog: str | None = None) -> Column | None:
    """In the sandbox, by catalog or by the prefix of the schema, only rows with a pseudonym."""
    return F.col("bsn_pseudo").isNotNull() if catalog == SANDBOX or schema.startswith(SANDBOX) else None


def filter_region_or_null(schema: str, roles: Sequence[str], region: str | None) -> Column | None:
    code = region_code(region)
    if "wia_beoordelaar" in roles and schema == JOURNEY_SCHEMA and code:
        return (F.col("regio_code") == code) | F.col("regio_code").isNull()
    return None


def filter_medical_events(schema: str, roles: Sequence[str]) -> Column | None:
    """As in SQL, a wia row without status is dropped: NOT of an unknown condition is not true."""
    if "ww_handhaver" in roles and schema == JOURNEY_SCHEMA:
        return ~((F.col("domein") == "wia") & F.col("event_status").isin(*WIA_GRANTED))
    return None


def row_filters(
    schema: str, roles: Sequence[str], region: str | None = None, catalog: str | None = None
) -> list[Column]:
    candidates = [
        filter_region(schema, roles, region),
        filter_opt_out(schema),
        filter_pseudo_only(schema, catalog),
        filter_region_or_null(schema, roles, region),
        filter_medical_events(schema, roles),
    ]
    return [condition for condition in candidates if condition is not None]


# ---- column masks -------------------------------------------------------------------------------


def mask_bsn(roles: Sequence[str]) -> Column | None:
    bsn = F.col("bsn")
    if "crm_medewerker" in roles:
        return F.concat(F.lit("XXXXX"), F.substring(bsn, 6, 4))
    if not capable(roles, "can_see_pii"):
        return F.concat(F.lit("XXXXXX"), F.substring(bsn, 7, 3))
    return None


def mask_bank_account(roles: Sequence[str]) -> Column | None:
    if capable(roles, "can_see_bankrekening") or capable(roles, "break_glass"):
        return None
    return F.lit("NLxx XXXX XXXX XXXX")


def mask_medical(roles: Sequence[str], data_type: str | DataType = "string") -> Column | None:
    """Null of the column's own type."""
    if capable(roles, "can_see_medical") or capable(roles, "break_glass"):
        return None
    return F.lit(None).cast(data_type)


def mask_birth_year(roles: Sequence[str]) -> Column | None:
    return first_of_year(F.col("geboortedatum")) if list(roles) == ["data_steward"] else None


def mask_event_label(schema: str, roles: Sequence[str]) -> Column | None:
    hidden = not capable(roles, "can_see_medical") and not capable(roles, "break_glass")
    if schema.lower() == JOURNEY_SCHEMA and hidden:
        return F.concat(F.col("domein"), F.lit("."), F.col("event_type"))
    return None


def mask_source_ref(schema: str, roles: Sequence[str]) -> Column | None:
    hidden = not capable(roles, "can_see_pii") and "crm_medewerker" not in roles
    return F.lit("***") if schema.lower() == JOURNEY_SCHEMA and hidden else None


def column_mask(
    schema: str, column: str, roles: Sequence[str], data_type: str | DataType = "string"
) -> Column | None:
    """The mask for one column of the given type, or None for clear text."""
    name = column.lower()
    if name == "bsn":
        return mask_bsn(roles)
    if name in ("iban", "bankrekening"):
        return mask_bank_account(roles)
    if name in ("diagnose", "icd10"):
        return mask_medical(roles, data_type)
    if name == "geboortedatum":
        return mask_birth_year(roles)
    if name == "event_label":
        return mask_event_label(schema, roles)
    if name == "source_ref_id":
        return mask_source_ref(schema, roles)
    return None


def governed_read(
    df: DataFrame, schema: str, roles: Sequence[str], region: str | None = None, catalog: str | None = None
) -> DataFrame:
    """All row filters (joined by AND) and all masks, as one filter and one projection.

    The filters see clear values. Both steps are narrow, so they reach the scan like any filter.
    """
    conditions = row_filters(schema, roles, region, catalog)
    visible = df.filter(reduce(and_, conditions)) if conditions else df
    masked = []
    for name in df.columns:
        mask = column_mask(schema, name, roles, df.schema[name].dataType)
        masked.append(F.col(name) if mask is None else mask.alias(name))
    return visible.select(*masked)


def min_group_size(groups: DataFrame, size_column: str, minimum: int) -> DataFrame:
    """Drop groups too small to publish."""
    return groups.filter(F.col(size_column) >= minimum)


# ---- access decisions ---------------------------------------------------------------------------

# Operation classes and the roles that may write.
READ_OPERATIONS = (
    "SelectFromColumns", "ReadFromTable", "FilterColumns", "ShowSchemas", "ShowTables", "ShowColumns",
    "FilterCatalogs", "FilterSchemas", "FilterTables", "FilterViews",
)
META_OPERATIONS = ("ExecuteQuery", "AccessCatalog", "ImpersonateUser", "ReadSystemInformation")
WRITE_OPERATIONS = (
    "InsertIntoTable", "DeleteFromTable", "TruncateTable", "DropTable", "DropSchema", "CreateTable",
    "CreateSchema", "CreateView", "CreateViewWithSelectFromColumns", "DropView", "RenameTable",
    "RenameSchema", "RenameView", "SetSchemaAuthorization", "SetTableProperties", "AddColumn",
    "DropColumn", "RenameColumn", "ExecuteProcedure",
)
WRITERS = ("data_engineer", "platform_admin", "smoketest")


def access_decisions(requests: DataFrame, roles: DataFrame, purposes: DataFrame) -> DataFrame:
    """Decide a table of requests.

    requests: request_id, user_name, roles (array), operation, catalog_name, schema_name, table_name,
    purpose. roles and purposes: the policy tables of `sources.lookups`.

    The policy tables are folded into one row each and attached to every request, so a request is
    decided in place: no shuffle, and no explode of requests over their roles.
    """
    policy = roles.agg(
        F.map_from_entries(
            F.collect_list(F.struct("role", F.struct("catalogs", "schemas", "purposes")))
        ).alias("by_role")
    )
    wanted = purposes.agg(F.map_from_entries(F.collect_list(F.struct("resource", "purposes"))).alias("by_resource"))
    # Both have exactly one row, made from lookup tables whose size does not depend on the data.
    facts = requests.withColumns({"_policy": policy.scalar(), "_purposes": wanted.scalar()})

    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    given = F.filter(F.coalesce("roles", F.array().cast("array<string>")), lambda role: role.isNotNull())
    static_user = (F.size(given) == 0) & (F.col("user_name") == "smoketest")
    facts = facts.withColumn("_roles", F.when(static_user, F.array(F.lit("smoketest"))).otherwise(given))

    known = F.filter(
        F.transform("_roles", lambda role: F.try_element_at("_policy", role)), lambda entry: entry.isNotNull()
    )
    facts = facts.withColumn("_entries", known)
    named = F.concat_ws(".", text("catalog_name"), text("schema_name"))
    granted = (
        (text("catalog_name") != "")
        & (text("schema_name") != "")
        & F.array_contains("_roles", F.concat(F.lit("data_access:"), named))
    )
    by_role = F.exists(
        "_entries",
        lambda entry: F.array_contains(entry["catalogs"], text("catalog_name"))
        & (entry["schemas"].isNull() | F.array_contains(entry["schemas"], text("schema_name"))),
    )
    exact = F.try_element_at("_purposes", F.concat_ws(".", named, text("table_name")))
    by_schema = F.try_element_at("_purposes", F.concat(named, F.lit(".*")))
    facts = facts.withColumns(
        {
            "role_ok": F.coalesce(by_role, F.lit(False)) | granted,
            "_granted": granted,
            "_required": F.coalesce(exact, by_schema, F.array().cast("array<string>")),
            "_own": F.flatten(F.transform("_entries", lambda entry: entry["purposes"])),
            "_purpose": F.lower(text("purpose")),
        }
    )
    declared = F.array_contains("_required", F.col("_purpose"))
    purpose_ok = (
        (F.size("_required") == 0)
        | F.array_contains("_own", "*")
        | (declared & (F.col("_granted") | F.array_contains("_own", F.col("_purpose"))))
    )
    facts = facts.withColumn("purpose_ok", purpose_ok)
    operation = F.col("operation")
    writer = F.arrays_overlap("_roles", F.array(*[F.lit(role) for role in WRITERS]))
    allowed = (
        F.when(text("user_name") == "", F.lit(False))
        .when(operation.isin(*META_OPERATIONS), F.lit(True))
        .when(operation.isin(*READ_OPERATIONS), F.col("role_ok") & F.col("purpose_ok"))
        .when(operation.isin(*WRITE_OPERATIONS), writer)
        .otherwise(F.lit(False))
    )
    return facts.select("request_id", "role_ok", "purpose_ok", allowed.alias("allowed"))
