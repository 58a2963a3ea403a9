"""Alert rates on a stream of log lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from polderlake.operators.alerts import RATE_RULES, RateRule, alerts


def alert_stream(
    lines: DataFrame,
    path: str,
    checkpoint: str,
    rules: Sequence[RateRule] = RATE_RULES,
    watermark: str = "1 minute",
    trigger_seconds: int | None = 60,
) -> StreamingQuery:
    """Write firing alerts as files. State holds minute counts, never log lines.

    A window is final once the watermark has passed its end, so an alert is written once and lines
    later than the watermark are not counted.
    """
    fired = alerts(lines, rules, watermark)
    writer = fired.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if trigger_seconds is None:
        return writer.trigger(availableNow=True).start(path)
    return writer.trigger(processingTime=f"{trigger_seconds} seconds").start(path)
