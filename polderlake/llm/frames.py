"""Small helpers shared by the operators: tables, stored frames, clashing names, groups in sorted batches."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polderlake.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Sent:
    """A value for all tasks. It is pickled by value, so executors need no copy of its class; each task opens it once."""

    def __init__(self, spark: SparkSession, value: object):
        self._packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._open: list = []

    def get(self):
        if not self._open:
            self._open.append(pickle.loads(self._packed.value))
        return self._open[0]


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` without the columns that a result column of the same name (in any case) replaces."""
    taken = {name.lower() for name in names}
    return df.select(*[df[f"`{name}`"] for name in df.columns if name.lower() not in taken])


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: read in part, and never computed again."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, draw: Column, rows: int) -> DataFrame:
    """The rows with the `rows` smallest draws (and those that tie with the last).

    Only draws are sorted; the rows themselves stay where they are.
    """
    last = df.select(draw.alias("draw")).orderBy("draw").limit(rows).agg(F.max("draw")).first()[0]
    return df.where(draw <= last) if last is not None else df.limit(0)


def pieces(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in slices, so that what is made of its long texts stays small."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def chunks(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Batches of about `size` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        piece = (np.cumsum(lengths) - lengths) // size
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(piece)) + 1, [batch.num_rows]])
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if end > start:
                yield batch.slice(start, end - start)


def starts_of_groups(data: pa.Table, keys: list[str]) -> np.ndarray:
    """First row of every group in a table sorted by integer `keys`, and the row count at the end."""
    changed = np.zeros(data.num_rows + 1, dtype=bool)
    changed[0] = changed[-1] = True
    for key in keys:
        values = data.column(key).to_numpy()
        changed[1:-1] |= values[1:] != values[:-1]
    return np.flatnonzero(changed)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of about `rows` rows that hold whole groups only, with the groups' first rows.

    A group larger than `rows` makes a larger table; callers split such groups before.
    """
    held: list[pa.RecordBatch] = []
    n = 0

    def cut(last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        nonlocal held, n
        data = pa.Table.from_batches(held).combine_chunks()
        starts = starts_of_groups(data, keys)
        end = len(starts) - 1 if last else len(starts) - 2
        group = 0
        while group < end:
            following = max(group + 1, int(np.searchsorted(starts, starts[group] + rows, "right")) - 1)
            following = min(following, end)
            yield data.slice(starts[group], starts[following] - starts[group]), starts[group : following + 1] - starts[group]
            group = following
        rest = data.slice(starts[end])
        held, n = rest.to_batches(), rest.num_rows

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= 4 * rows:
            yield from cut(False)
    if n:
        yield from cut(True)
