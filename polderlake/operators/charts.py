"""General aggregate query behind a chart: metrics, group-by, time grain, filters, order, limit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, eq, ge, gt, le, lt, ne
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATES = {
    "SUM": F.sum,
    "AVG": F.avg,
    "COUNT": F.count,
    "COUNT_DISTINCT": F.count_distinct,
    "MIN": F.min,
    "MAX": F.max,
}
COMPARISONS = {"=": eq, "==": eq, "!=": ne, "<": lt, "<=": le, ">": gt, ">=": ge}
GRAINS = {"P1D": "day", "P1W": "week", "P1M": "month", "P1Y": "year"}


@dataclass(frozen=True)
class Metric:
    column: str
    aggregate: str
    label: str

    def expression(self) -> Column:
        return AGGREGATES[self.aggregate](F.col(self.column)).alias(self.label)


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: Any = None

    def condition(self) -> Column:
        target, name = F.col(self.column), self.operator.upper()
        if name == "IS NULL":
            return target.isNull()
        if name == "IS NOT NULL":
            return target.isNotNull()
        if name == "IN":
            return target.isin(*self.value)
        return COMPARISONS[name](target, F.lit(self.value))


@dataclass(frozen=True)
class SqlFilter:
    """A free-form condition in SQL over the table's columns. Spark parses it; it can name no other table."""

    text: str

    def condition(self) -> Column:
        return F.expr(self.text)


@dataclass(frozen=True)
class Chart:
    metrics: Sequence[Metric]
    group_by: Sequence[str] = ()
    time_column: str | None = None
    time_grain: str = "P1D"
    filters: Sequence[Filter | SqlFilter] = field(default_factory=tuple)
    row_limit: int = 1000

    def columns(self) -> set[str]:
        """The columns that metrics, groups, time and plain filters name."""
        named = {metric.column for metric in self.metrics} | set(self.group_by)
        named |= {one.column for one in self.filters if isinstance(one, Filter)}
        return named | ({self.time_column} if self.time_column else set())


def chart_query(df: DataFrame, chart: Chart) -> DataFrame:
    """Rows of a chart, largest first metric first (ties by the group columns), up to the row limit.

    The limit is part of a chart; order and limit together run as a distributed top-k.
    """
    rows = df
    if chart.filters:
        rows = rows.filter(reduce(and_, [one.condition() for one in chart.filters]))
    keys: list[Column] = []
    if chart.time_column:
        keys.append(F.date_trunc(GRAINS[chart.time_grain], F.col(chart.time_column)).alias(chart.time_column))
    keys += [F.col(name) for name in chart.group_by if name != chart.time_column]
    metrics = [metric.expression() for metric in chart.metrics]
    if not keys:
        return rows.agg(*metrics)
    grouped = rows.groupBy(*keys).agg(*metrics)
    names = [name for name in grouped.columns if name not in {m.label for m in chart.metrics}]
    order = [F.desc_nulls_last(chart.metrics[0].label), *[F.asc_nulls_first(name) for name in names]]
    return grouped.orderBy(*order).limit(chart.row_limit)
