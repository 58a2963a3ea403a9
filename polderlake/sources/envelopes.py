"""Event envelopes: wrap rows as JSON lines and lay them out per stream and date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the envelope.
SCHEMA_VERSION = "1.0.0"
META_SOURCE = "data-generation"


def envelope(payload: Column, event_type: Column | str) -> Column:
    """JSON text of one event. Null payload fields are kept as JSON null."""
    kind = event_type if isinstance(event_type, Column) else F.lit(event_type)
    event = F.struct(
        kind.alias("event_type"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        payload.alias("payload"),
        F.struct(F.lit(True).alias("synthetic"), F.lit(META_SOURCE).alias("source")).alias("meta"),
    )
    return F.to_json(event, {"ignoreNullFields": "false"})


def wrap_rows(df: DataFrame, event_type: str, columns: list[str] | None = None) -> DataFrame:
    """One JSON text per row, in column `payload` (the bronze name of the raw event)."""
    fields = F.struct(*(columns or df.columns))
    return df.select(envelope(fields, event_type).alias("payload"))


def write_envelopes(events: DataFrame, root: str, stream: str, day: str) -> None:
    """JSONL files below `<root>/<stream as folders>/dt=<day>/`; `events` has one text column.

    The folder is fixed by the arguments, so all tasks write in parallel and no shuffle is needed.
    The delimited writer is used for its `extension` option, with quoting off: JSON text holds no
    raw control characters, so neither the separator nor a line end can occur in it.
    """
    folder = f"{root.rstrip('/')}/{stream.replace('.', '/')}/dt={day}"
    (
        events.select(F.col(events.columns[0]).alias("value"))
        .write.mode("append")
        .option("sep", "\u0001")
        .option("quote", "")
        .option("escapeQuotes", False)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("extension", "jsonl")
        .csv(folder)
    )
