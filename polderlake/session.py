"""Session settings, shared scratch space and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on.

    The zone is UTC because the sources carry UTC timestamps. Shuffle width is left to adaptive
    execution: it starts from `spark.sql.shuffle.partitions` and merges small partitions, so the
    caller sets a width for the largest expected shuffle, not for each query.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        # Frozen frames are deleted from the shared folder once nothing refers to them.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by the cluster in `spark.checkpoint.dir`.

    Only a local session without that setting gets a temporary folder of its own; a cluster
    session without it is an error, because executors do not share a local disk.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        current = tempfile.mkdtemp(prefix="polderlake-")
        sc.setCheckpointDir(current)
    return current


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder. What is written there stays until `clear_scratch`."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete what this process has written to scratch paths; returns their number.

    For use between queries: frames that still read such a path can't be used afterwards.
    """
    cleared = len(_SCRATCH)
    while _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return cleared


_ONCE: dict[tuple, object] = {}


def once(spark: SparkSession, key: tuple | None, make):
    """What `make()` returns, made the first time a session asks for `key`; for stored tables that several queries read.

    `make` must write below `kept_path`, which `clear_scratch` leaves alone. A key of None is made each time.
    """
    if key is None:
        return make()
    whole = (spark.sparkContext.applicationId, *key)
    if whole not in _ONCE:
        _ONCE[whole] = make()
    return _ONCE[whole]


def kept_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for a stored table that outlives a query."""
    return f"{shared_dir(spark).rstrip('/')}/kept-{label}-{uuid.uuid4().hex}"


def freeze(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: a lost executor rereads it, never recomputes it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df` as Parquet below the shared folder: made once, and read column by column."""
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
