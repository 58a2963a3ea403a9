"""Alert events in log lines, and alert rates over time windows (batch and stream alike)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polderlake.session import freeze

# Alert -> texts the container name and the message must contain. A later rule wins.
LOG_RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("opa_deny", "opa", ("decision_id", '"result":false')),
    ("trino_access_denied", "trino", ("Access Denied",)),
    ("jvm_oom", "", ("java.lang.OutOfMemoryError",)),
    ("keycloak_login_error", "keycloak", ("LOGIN_ERROR",)),
    ("csv_upload_failed", "csv-uploader", ("upload_failed",)),
)


def classify_log_events(lines: DataFrame) -> DataFrame:
    """Add `alert_event`; lines that match no rule are dropped."""
    container = F.coalesce("container", F.lit(""))
    message = F.coalesce("message", F.lit(""))
    chosen = None
    for name, owner, texts in reversed(LOG_RULES):
        test = container.contains(owner)
        for text in texts:
            test = test & message.contains(text)
        chosen = F.when(test, name) if chosen is None else chosen.when(test, name)
    return lines.withColumn("alert_event", chosen).filter(F.col("alert_event").isNotNull())


@dataclass(frozen=True)
class RateRule:
    """Fire when events per second over `minutes` stay above `threshold` for `hold_minutes`."""

    alert: str
    event: str
    minutes: int
    threshold: float
    hold_minutes: int
    severity: str
    per: tuple[str, ...] = ()


# Fixed values. The memory rule counts events instead of a rate: any event fires at once.
RATE_RULES: tuple[RateRule, ...] = (
    RateRule("OpaDecisionDenySpike", "opa_deny", 5, 0.2, 5, "warning"),
    RateRule("TrinoAccessDeniedSpike", "trino_access_denied", 5, 0.1, 5, "warning"),
    RateRule("JvmOutOfMemory", "jvm_oom", 10, 0.0, 0, "critical", ("namespace", "container")),
    RateRule("KeycloakLoginErrorSpike", "keycloak_login_error", 5, 0.5, 5, "warning"),
    RateRule("CsvUploadFailureSpike", "csv_upload_failed", 15, 0.05, 10, "warning"),
)


def minute_counts(events: DataFrame, time: str = "ts") -> DataFrame:
    """Events per alert, namespace, container and minute: the counter all rates are made from."""
    tumbling = F.window(time, "1 minute").alias("minute")
    return events.groupBy(tumbling, "alert_event", "namespace", "container").agg(F.count(F.lit(1)).alias("n"))


def _by_event(rules: Sequence[RateRule], value: Callable[[RateRule], object]) -> Column:
    """The value of the rule that belongs to the row's event."""
    pairs = [F.lit(x) for rule in rules for x in (rule.event, value(rule))]
    return F.create_map(*pairs)[F.col("alert_event")]


def _label(rules: Sequence[RateRule], name: str) -> Column:
    """A label where the rule splits by it, else null: all its counts then fall into one group."""
    return F.when(_by_event(rules, lambda rule: name in rule.per), F.col(name)).alias(name)


def alert_rates(counts: DataFrame, rules: Sequence[RateRule]) -> DataFrame:
    """Evaluations, one per minute, that are above the threshold of their rule.

    All `rules` must have the same window length. Windows slide over minute counts, not over events:
    what multiplies is at most one row per minute and label set.
    """
    (minutes,) = {rule.minutes for rule in rules}
    span = F.window(F.window_time("minute"), f"{minutes} minutes", "1 minute").alias("span")
    relevant = counts.filter(F.col("alert_event").isin(*[rule.event for rule in rules]))
    totals = relevant.groupBy(span, "alert_event", _label(rules, "namespace"), _label(rules, "container")).agg(
        F.sum("n").alias("n")
    )
    rate = F.col("n") / F.lit(minutes * 60.0)
    return totals.filter(rate > _by_event(rules, lambda rule: rule.threshold)).select(
        _by_event(rules, lambda rule: rule.alert).alias("alert"),
        _by_event(rules, lambda rule: rule.severity).alias("severity"),
        "namespace",
        "container",
        "span",
        "n",
        rate.alias("rate"),
    )


def firing(rates: DataFrame, hold_minutes: int) -> DataFrame:
    """Evaluations at which the rate has been above the threshold for the whole hold time.

    Above for `hold_minutes` means that the evaluations of the last hold_minutes + 1 minutes are all
    present; counting them in a sliding window needs no ordering, so it works on a stream as well.
    """
    labels = ("alert", "severity", "namespace", "container")
    if hold_minutes == 0:
        return rates.select(*labels, F.col("span.end").alias("fired_at"))
    needed = hold_minutes + 1
    held = F.window(F.window_time("span"), f"{needed} minutes", "1 minute").alias("held")
    steady = rates.groupBy(held, *labels).agg(F.count(F.lit(1)).alias("_n"))
    return steady.filter(F.col("_n") == needed).select(*labels, F.col("held.end").alias("fired_at"))


def alerts(lines: DataFrame, rules: Sequence[RateRule] = RATE_RULES, watermark: str = "1 minute") -> DataFrame:
    """Firing alerts for log lines (ts, namespace, container, message), batch or stream.

    Rules with the same window and hold time share one chain of aggregates. In batch the log is read
    once: the minute counts, small beside it, are stored before the windows slide over them.
    """
    events = classify_log_events(lines)
    if events.isStreaming:
        counts = minute_counts(events.withWatermark("ts", watermark))
    else:
        counts = freeze(minute_counts(events))
    families: dict[tuple[int, int], list[RateRule]] = {}
    for rule in rules:
        families.setdefault((rule.minutes, rule.hold_minutes), []).append(rule)
    fired = [firing(alert_rates(counts, family), hold) for (_, hold), family in families.items()]
    return reduce(DataFrame.unionByName, fired)
