"""Person parts stored in buckets of the citizen number, and the marts that are joined on that layout.

Each part has one row per person: what a person's records add up to is summed before it is stored, with partial sums
made before the shuffle, so a person with very many records makes no bucket larger than the others. The marts then
read bucket beside bucket; no row is shuffled again.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from polderlake.plans import clients
from polderlake.sources.buckets import BUCKET_ROWS, bucket_count, in_layout, write_bucketed

PARTS = ("persona", "jobs", "ww", "wia", "contacts")


def write_person_store(
    entities: Mapping[str, DataFrame], database: str, as_of: datetime, bucket_rows: int = BUCKET_ROWS
) -> None:
    """Store persona, jobs, ww, wia and contacts of `entities` (persona, employment, ww, wia, crm) as bucketed tables."""
    persona = entities["persona"]
    buckets = bucket_count(persona.count(), bucket_rows)
    parts = {
        "persona": persona,
        "jobs": clients.jobs_part(entities["employment"]),
        "ww": clients.ww_part(entities["ww"]),
        "wia": clients.wia_part(entities["wia"]),
        "contacts": clients.contacts_part(entities["crm"], as_of),
    }
    for name in PARTS:
        write_bucketed(parts[name], f"{database}.{name}", ["bsn"], buckets)


def person_store(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """The stored parts; the four beside persona are read in the layout of their buckets."""
    return {name: spark.table(f"{database}.{name}") if name == "persona" else in_layout(spark.table(f"{database}.{name}")) for name in PARTS}


def client_360(store: Mapping[str, DataFrame]) -> DataFrame:
    return clients.client_360_of(*[store[name] for name in PARTS])


def effect_panel(store: Mapping[str, DataFrame], salt: str, as_of) -> DataFrame:
    pseudonymized = clients.persona_pseudonymized(store["persona"], salt, as_of)
    return clients.effect_panel_of(pseudonymized, store["ww"], store["wia"], store["jobs"])


def tw_eligibility(store: Mapping[str, DataFrame], norms: DataFrame) -> DataFrame:
    return clients.tw_eligibility(store["persona"], in_layout(clients.income_of(store["jobs"])), norms)
