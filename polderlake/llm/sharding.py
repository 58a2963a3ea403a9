"""Sharding by fixed virtual slots.

A record's hash gives its virtual slot, one of a fixed number. A versioned table says which shard holds each slot. To
rebalance, the bytes of each slot are summed and slots move from the heaviest shard to the lightest: a new version of
the table that differs from the one before in the moved slots only. Records never move on their own.

Equal records (id, checksum and size) are told apart by a number within their group, which is hashed with them: a hot
group spreads over the slots like any others. The numbers come from the group's count, so no task numbers a whole group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polderlake.llm.frames import stored
from polderlake.session import scratch_path

SLOTS = 4096
SHARDS = 24
#: Numbers of one group that are handed out by one row.
RUN = 4096
_MAP = "version int, virtual_slot int, shard int, bytes long, rows long"


def first_map(slots: int, shards: int) -> np.ndarray:
    """Version 0: slots dealt to the shards in turn."""
    return np.arange(slots) % shards


def rebalanced(shard_of: np.ndarray, weight: np.ndarray, shards: int) -> np.ndarray:
    """The map after moving slots, one at a time, from the heaviest shard to the lightest, while that evens them out.

    Slots of shards that are no longer there go to the lightest shards first, the largest slots before the others.

    Each move takes the slot closest to half the difference (the smallest number if several), so every move brings the
    two shards closer together and the moves come to an end. With more shards than before, the new ones fill up first.
    """
    shard_of = shard_of.copy()
    gone = np.flatnonzero(shard_of >= shards)
    load = np.bincount(shard_of[shard_of < shards], weight[shard_of < shards], shards)
    for slot in gone[np.argsort(-weight[gone], kind="stable")]:
        shard_of[slot] = load.argmin()
        load[shard_of[slot]] += weight[slot]
    while True:
        heavy, light = int(load.argmax()), int(load.argmin())
        gap = load[heavy] - load[light]
        own = np.flatnonzero((shard_of == heavy) & (weight > 0) & (weight < gap))
        if not len(own):
            return shard_of
        slot = own[np.abs(weight[own] - gap / 2).argmin()]
        shard_of[slot] = light
        load[heavy] -= weight[slot]
        load[light] += weight[slot]


def sized_records(docs: DataFrame, id_column: str, column: str, slots: int) -> DataFrame:
    """(id, size, text_crc32, number, virtual_slot) of each record; the text is read once and not shuffled.

    `number` counts equal records from 0. Their count is combined before the shuffle, and its runs of numbers are dealt anew.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    names = [id_column, "size", "text_crc32"]
    sized = docs.select(
        F.col(id_column),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    groups = sized.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    runs = groups.select(*names, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))).alias("start"))
    dealt = runs.repartition(*names, "start")
    numbered = dealt.select(*names, F.explode(F.sequence("start", F.least(F.col("start") + RUN, F.col("n")) - 1)).alias("number"))
    return numbered.withColumn("virtual_slot", F.pmod(F.xxhash64(id_column, "text_crc32", "number"), F.lit(slots)).cast("int"))


def slot_weights(records: DataFrame, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of each virtual slot: as many numbers as there are slots."""
    size, rows = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for row in records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect():
        size[row["virtual_slot"]], rows[row["virtual_slot"]] = row["bytes"], row["rows"]
    return size, rows


def _versions(spark, path: str) -> list[int]:
    """The finished versions of the map at `path`, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [entry.getPath() for entry in system.listStatus(folder)] if system.exists(folder) else []
    done = [p.getName() for p in found if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(name.removeprefix("version=")) for name in done if name.startswith("version="))


def save_map(spark, path: str, version: int, shard_of: np.ndarray, size: np.ndarray, rows: np.ndarray) -> None:
    """Add a version to the stored map. A finished version is never written again; what a lost writer left is."""
    if version in _versions(spark, path):
        raise ValueError(f"version {version} of the slot map is there already: load it and edit that")
    values = [(version, slot, int(shard), int(size[slot]), int(rows[slot])) for slot, shard in enumerate(shard_of)]
    spark.createDataFrame(values, _MAP).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark, path: str, version: int | None = None) -> tuple[int, np.ndarray] | None:
    """(version, shard of each slot) of one version, the newest by default; None if there is none."""
    known = _versions(spark, path)
    if not known:
        return None
    version = known[-1] if version is None else version
    rows = spark.read.schema(_MAP).parquet(f"{path}/version={version}").orderBy("virtual_slot").collect()
    return version, np.array([row["shard"] for row in rows], dtype=np.int64)


def edited_map(spark, path: str, size: np.ndarray, rows: np.ndarray, slots: int, shards: int) -> tuple[int, np.ndarray]:
    """The newest map at `path` (the first one if there is none), rebalanced and saved as the next version.

    If no slot moves the newest version stays the newest. A map for another number of slots can't be edited.
    """
    now = load_map(spark, path)
    if now is None:
        save_map(spark, path, 0, first_map(slots, shards), size, rows)
        now = load_map(spark, path)
    version, shard_of = now
    if len(shard_of) != slots:
        raise ValueError(f"the slot map has {len(shard_of)} slots, not {slots}")
    moved = rebalanced(shard_of, size, shards)
    if (moved == shard_of).all():
        return version, shard_of
    save_map(spark, path, version + 1, moved, size, rows)
    return version + 1, moved


RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot", "map_version")


def assign_shards(docs: DataFrame, *, shards: int = SHARDS, slots: int = SLOTS, id_column: str = "doc_id", column: str = "text", map_path: str | None = None) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version) for each row of `docs`.

    `size` is the text's UTF-8 bytes (none if null) plus 8. The law is `bytes`: the shards' sizes are nearly equal.
    `slot` is the record's place in its shard, gapless from 0, in order of virtual slot, id, checksum, size and number;
    rows equal in id, checksum and size are interchangeable, and spread over the shards. Null ids are hashed with the
    text's checksum like any other. A record larger than a shard's share stays whole. `map_path` is where the versions of
    the slot map are kept (default: a folder of its own below the shared folder): the newest one there is edited, and the
    next one saved if a slot moved. Beside id and text no column is read.

    The map and the slots' sums have one row per virtual slot, whatever the input; records are numbered within their
    virtual slot, and the slots' first places are running sums over those few rows.
    """
    spark = docs.sparkSession
    records = stored(sized_records(docs, id_column, column, slots), "sharding")
    size, rows = slot_weights(records, slots)
    version, shard_of = edited_map(spark, map_path or scratch_path(spark, "slot-map"), size, rows, slots, shards)
    return place(records, shard_of, rows, id_column, version)


def place(records: DataFrame, shard_of: np.ndarray, rows: np.ndarray, id_column: str, version: int) -> DataFrame:
    """The records with shard and place under one version of the map."""
    spark = records.sparkSession
    starts = np.zeros(len(shard_of), np.int64)
    for shard in np.unique(shard_of):
        own = np.flatnonzero(shard_of == shard)
        starts[own] = np.cumsum(rows[own]) - rows[own]
    table = spark.createDataFrame([(slot, int(s), int(starts[slot])) for slot, s in enumerate(shard_of)], "virtual_slot int, shard int, first long")
    order = ", ".join(f"`{c}`" for c in (id_column, "text_crc32", "size", "number"))
    numbered = records.withColumn("_at", F.expr(f"row_number() over (partition by virtual_slot order by {order}) - 1"))
    return numbered.join(F.broadcast(table), "virtual_slot").select(
        id_column,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("_at")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(version).alias("map_version"),
    )
