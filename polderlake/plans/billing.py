"""Cloud-cost marts on the staged billing rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polderlake.functions.numbers import ratio
from polderlake.operators.ranking import HEAVY_ROWS, number_rows

#: The staged columns that the marts read.
MART_COLUMNS = (
    "billing_month", "provider", "service_category", "service_name", "region", "charge_category", "pricing_category",
    "billing_currency", "billed_cost", "effective_cost", "list_cost", "savings_amount", "usage_quantity", "usage_unit",
    "resource_id", "resource_name", "resource_type", "sub_account_id", "sub_account_name", "commitment_discount_id",
    "tag_environment", "tag_application", "tag_cost_center",
)


def _list_cost() -> Column:
    return F.coalesce("list_cost", "effective_cost")


def _usage(billing: DataFrame) -> DataFrame:
    return billing.filter(F.col("charge_category") == "Usage")


def _or_unknown(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("unknown"))


def _with_counts(billing: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], counted: Mapping[str, str]) -> DataFrame:
    """Sums and `n_charges` per key, and how many values (nulls apart) each column of `counted` has there.

    Sums are combined before they are sent, so they travel as few rows. Only the keys and one column are sent to be
    counted, each pair once from a task, and none of the sums with them.
    """
    result = billing.groupBy(*keys).agg(*[F.sum(value).alias(name) for name, value in sums.items()], F.count(F.lit(1)).alias("n_charges"))
    for name, column in counted.items():
        pairs = billing.where(F.col(column).isNotNull()).select(*keys, column).distinct()
        counts = pairs.groupBy(*[F.col(key).alias(f"_key_{key}") for key in keys]).agg(F.count(F.lit(1)).alias(name))
        same = reduce(and_, [F.col(key).eqNullSafe(F.col(f"_key_{key}")) for key in keys])
        result = result.join(counts, same, "left").drop(*[f"_key_{key}" for key in keys]).withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))
    return result


def spend_monthly(billing: DataFrame) -> DataFrame:
    """Sums per month, and how many resources and accounts they come from."""
    keys = ["billing_month", "provider", "service_category", "charge_category", "billing_currency"]
    sums = {"billed_cost": F.col("billed_cost"), "effective_cost": F.col("effective_cost"), "list_cost": _list_cost(),
            "savings_amount": F.col("savings_amount"), "usage_quantity": F.col("usage_quantity")}
    return _with_counts(billing, keys, sums, {"n_resources": "resource_id", "n_sub_accounts": "sub_account_id"})


def service_breakdown(billing: DataFrame) -> DataFrame:
    return (
        _usage(billing)
        .groupBy(
            "billing_month",
            "provider",
            "service_category",
            "service_name",
            "region",
            _or_unknown("tag_environment").alias("environment"),
            _or_unknown("tag_application").alias("application"),
            "billing_currency",
        )
        .agg(
            F.sum("effective_cost").alias("effective_cost"),
            F.sum("billed_cost").alias("billed_cost"),
            F.sum("usage_quantity").alias("usage_quantity"),
            F.count_distinct("resource_id").alias("n_resources"),
            F.count(F.lit(1)).alias("n_charges"),
        )
    )


def commitment_utilization(billing: DataFrame) -> DataFrame:
    """Committed against on-demand spend; the discount ratio is null where its base is zero."""
    priced = lambda category: F.col("pricing_category") == category
    spend = lambda category: F.sum(F.when(priced(category), F.col("effective_cost")).otherwise(F.lit(0)))
    sums = (
        _usage(billing)
        .groupBy("billing_month", "provider", "service_category", "billing_currency")
        .agg(
            spend("Committed").alias("committed_spend"),
            spend("Standard").alias("on_demand_spend"),
            spend("Dynamic").alias("dynamic_spend"),
            F.sum("effective_cost").alias("total_spend"),
            F.sum("savings_amount").alias("savings_amount"),
            F.count_distinct(F.when(priced("Committed"), F.col("commitment_discount_id"))).alias("n_active_commitments"),
        )
    )
    split = F.col("committed_spend") + F.col("on_demand_spend") + F.col("dynamic_spend")
    return sums.select(
        "*",
        F.when(F.col("total_spend") > 0, ratio(F.col("committed_spend"), F.col("total_spend")))
        .otherwise(F.lit(0.0))
        .alias("commitment_coverage_pct"),
        F.when(split > 0, ratio(F.col("savings_amount"), split + F.col("savings_amount")))
        .otherwise(F.lit(0.0))
        .alias("effective_discount_pct"),
    )


def savings(billing: DataFrame) -> DataFrame:
    keys = ["billing_month", "provider", "pricing_category", "service_category", "charge_category", "billing_currency"]
    costs = {"list_cost": _list_cost(), "effective_cost": F.col("effective_cost"), "savings_amount": F.col("savings_amount")}
    sums = _with_counts(billing, keys, costs, {"n_resources": "resource_id"})
    share = F.when(F.col("list_cost") > 0, ratio(F.col("savings_amount"), F.col("list_cost"))).otherwise(F.lit(0.0))
    return sums.withColumn("savings_pct", share)


def top_resources(billing: DataFrame, heavy_rows: int = HEAVY_ROWS, at_most: int | None = None) -> DataFrame:
    """Cost per resource and month, ranked by cost within month and provider (ties by resource id)."""
    resource = F.coalesce(F.col("resource_id"), F.concat(F.lit("account-level:"), F.col("sub_account_id")))
    attributes = {
        "resource_name": F.col("resource_name"),
        "resource_type": F.col("resource_type"),
        "service_name": F.col("service_name"),
        "service_category": F.col("service_category"),
        "region": F.col("region"),
        "application": _or_unknown("tag_application"),
        "environment": _or_unknown("tag_environment"),
        "cost_center": _or_unknown("tag_cost_center"),
        "sub_account_name": F.col("sub_account_name"),
        "usage_unit": F.col("usage_unit"),
    }
    per_resource = (
        _usage(billing)
        .groupBy("billing_month", "provider", resource.alias("resource_id"), "billing_currency")
        .agg(
            *[F.max(column).alias(name) for name, column in attributes.items()],
            F.sum("effective_cost").alias("effective_cost"),
            F.sum("billed_cost").alias("billed_cost"),
            F.sum("usage_quantity").alias("usage_quantity"),
            F.count(F.lit(1)).alias("n_charges"),
        )
    )
    order = [F.desc("effective_cost"), F.asc("resource_id"), F.asc("billing_currency")]
    ranked_by = ["billing_month", "provider"]
    # A charge belongs to one resource, so charges per month and provider bound the rows to rank.
    return number_rows(per_resource, ranked_by, order, "rank_in_month", heavy_rows, counted=_usage(billing), at_most=at_most)


def satisfaction_monthly(satisfaction: DataFrame) -> DataFrame:
    """Scores per month and channel, plain and weighted by the number of respondents."""
    weighted = F.sum(F.col("score") * F.col("n_respondenten"))
    return satisfaction.groupBy(F.trunc("meting_datum", "MM").alias("maand"), "kanaal").agg(
        F.sum("n_respondenten").alias("n_respondenten"),
        ratio(weighted, F.sum("n_respondenten")).alias("gemid_score_gewogen"),
        F.avg("score").alias("gemid_score_ongew"),
        F.count(F.lit(1)).alias("n_metingen"),
    )
