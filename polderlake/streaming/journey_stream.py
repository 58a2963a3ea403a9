"""Journey phases on a stream of events, with a small state for each person.

Events may come in any order within the watermark. A person's openings wait in state until the watermark has passed
them; a timer at the earliest one wakes the person, and the openings that are final are folded in their order. State
holds the waiting openings and the person's last phase, never the events of the past.

Every call of state costs a round trip between Python and the store, however little it moves. Persons therefore share
a state key in groups, by a hash of the citizen number: a group's openings are stored, woken and read together. Inside
a group each person is folded alone.

The result is a log: a phase is written when it opens and once more when it closes. `current_phases` reads the log as
the table of phases.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from datetime import datetime, timedelta, timezone
from itertools import batched, groupby

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from polderlake.plans.journey import EVENT_ORDER, PHASES, phase_of

# Groups of persons in state, fixed for the life of a checkpoint: a few hundred persons each at some millions.
GROUPS = 8192
# Openings in one element of a group's waiting list.
CHUNK = 1000

# A fold's entries of the log, column by column; times in microseconds.
_ENTRIES = (
    "bsn array<string>, fase_volgnr array<bigint>, fase array<string>, trigger_event_type array<string>, "
    "started array<bigint>, ended array<bigint>"
)
_ENTRY = ("bsn", "fase_volgnr", "fase", "trigger_event_type", "started", "ended")
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _chunks(openings: Iterable[str]) -> Iterator[tuple[str]]:
    """Openings (a JSON text each) as elements of the waiting list."""
    for some in batched(openings, CHUNK):
        yield (f"[{','.join(some)}]",)


def _micros(at: datetime) -> int:
    """The microseconds of a time; one without a zone is in the local zone, as Spark hands it out."""
    return (at.astimezone(timezone.utc) - _EPOCH) // timedelta(microseconds=1)


def _order(opening: tuple) -> tuple:
    """Person, time, then the domain, type and source id, where null comes first."""
    return (opening[0], opening[1], *[name or "" for name in opening[2:5]])


class PhaseFold(StatefulProcessor):
    """The openings of a group of persons, folded person by person as the watermark passes them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "openings string")
        self.last = handle.getValueState("last", "persons string")
        self.folded: set[int] = set()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first: datetime | None = None

        def texts() -> Iterator[str]:
            nonlocal first
            for row in rows:
                _, at, opening = row
                first = at if first is None or at < first else first
                yield opening

        for chunk in _chunks(texts()):
            self.waiting.appendValue(chunk)
        if first is not None:
            self._wake(_micros(first))
        return iter(())

    def _wake(self, micros: int) -> None:
        """A timer at the first whole millisecond from then on."""
        self.handle.registerTimer(-(-micros // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # The first of a group's timers folds all that is final; the others of the batch have nothing left.
        if key[0] in self.folded:
            return
        self.folded.add(key[0])
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held = [(bsn, int(at), *rest) for (chunk,) in self.waiting.get() for bsn, at, *rest in json.loads(chunk)]
        final = sorted((o for o in held if o[1] <= until), key=_order)
        if not final:
            return
        later = [o for o in held if o[1] > until]
        if later:
            self.waiting.put(list(_chunks(json.dumps(o) for o in later)))
            self._wake(min(o[1] for o in later))
        else:
            self.waiting.clear()
        stored = self.last.get()
        persons = {} if stored is None else json.loads(stored[0])
        entries: list[tuple] = []
        for bsn, openings in groupby(final, key=lambda o: o[0]):
            persons[bsn] = self._fold(bsn, openings, persons.get(bsn), entries)
        self.last.update((json.dumps(persons),))
        if entries:
            yield Row(**dict(zip(_ENTRY, map(list, zip(*entries, strict=True)), strict=True)))

    def _fold(self, bsn: str, openings: Iterable[tuple], last: list | None, entries: list[tuple]) -> list:
        """Adds one person's entries; returns the person's last phase: number, phase, event type, start."""
        for _, at, _, event_type, _, phase in openings:
            if last is not None and last[1] == phase:
                continue
            if last is not None:
                entries.append((bsn, *last, at))
            last = [(last[0] if last else 0) + 1, phase, event_type, at]
            entries.append((bsn, *last, None))
        return last

    def close(self) -> None:
        pass


def phase_log(events: DataFrame, watermark: str, rules: Mapping[str, str] = PHASES, groups: int = GROUPS) -> DataFrame:
    """The log of opened and closed phases from a stream of journey events.

    Events that open no phase move the watermark and are not kept. Events older than the watermark are left out.
    """
    timed = events.withWatermark("event_ts", watermark)
    # A filter that doesn't name the time would be moved below the watermark, which then followed the openings alone.
    phase = F.when(F.col("event_ts").isNotNull() & F.col("bsn").isNotNull(), phase_of(F.col("event_type"), F.col("event_status"), rules))
    openings = timed.select("bsn", *EVENT_ORDER, phase.alias("fase")).where(F.col("fase").isNotNull())
    # Every column is decoded value by value in Python, so an opening travels as one text: the person, the time, the rest.
    fields = F.array("bsn", F.unix_micros("event_ts").cast("string"), *EVENT_ORDER[1:], "fase")
    grouped = openings.select(F.pmod(F.xxhash64("bsn"), F.lit(groups)).cast("int").alias("persons"), "event_ts", F.to_json(fields).alias("opening"))
    log = grouped.groupBy("persons").transformWithState(PhaseFold(), _ENTRIES, "Append", "EventTime")
    return log.select(F.inline(F.arrays_zip(*_ENTRY))).select(
        *_ENTRY[:4], F.timestamp_micros("started").alias("fase_start_ts"), F.timestamp_micros("ended").alias("fase_eind_ts")
    )


def phase_stream(
    events: DataFrame, path: str, checkpoint: str, watermark: str = "30 days", rules: Mapping[str, str] = PHASES, trigger_seconds: int | None = 20,
    groups: int = GROUPS,
) -> StreamingQuery:
    """Write the log of phases below `path`; without a trigger interval it drains the input and stops.

    The state needs a store that keeps timers and lists; the session's setting is put back once the query has started.
    """
    conf = events.sparkSession.conf
    name = "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, STATE_STORE)
    try:
        writer = phase_log(events, watermark, rules, groups).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        if trigger_seconds is None:
            return writer.trigger(availableNow=True).start(path)
        return writer.trigger(processingTime=f"{trigger_seconds} seconds").start(path)
    finally:
        conf.set(name, before)


def current_phases(log: DataFrame) -> DataFrame:
    """The table of phases: of each phase its closed entry, or the opened one while there is no other."""
    entry = F.struct("fase", "trigger_event_type", "fase_start_ts", "fase_eind_ts")
    newest = log.groupBy("bsn", "fase_volgnr").agg(F.min_by(entry, F.col("fase_eind_ts").isNull()).alias("e"))
    return newest.select(
        "bsn",
        "fase_volgnr",
        "e.fase",
        "e.trigger_event_type",
        "e.fase_start_ts",
        "e.fase_eind_ts",
        F.date_diff(F.col("e.fase_eind_ts").cast("date"), F.col("e.fase_start_ts").cast("date")).alias("duur_dagen"),
        F.col("e.fase_eind_ts").isNull().alias("is_lopend"),
    )
