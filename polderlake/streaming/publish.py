"""Writing the micro-batches of several queries into one partitioned table, each batch once."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The last partition level of a published table: which query's which batch its rows came with.
BATCH = "ingest_batch"


def query_identity(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that owns a checkpoint folder. A fresh checkpoint is another query."""
    lines = spark.read.text(f"{checkpoint.rstrip('/')}/metadata").collect()
    return json.loads("".join(line[0] for line in lines))["id"]


def publish_batch(batch: DataFrame, base: str, partitions: Sequence[str], query_id: str, batch_id: int) -> None:
    """Add a micro-batch to the table below `base`.

    The folders of a batch carry its name, so a repeated batch replaces its own files and nothing else: batches of other
    queries, or of the same query under a fresh checkpoint, have folders of their own. Spark's committer puts them in
    place. A batch must bring the same partition values each time, so a load date has to be the batch's, not the run's.
    """
    named = batch.withColumn(BATCH, F.lit(f"{query_id}-{batch_id}"))
    writer = named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partitions, BATCH).parquet(base.rstrip("/"))
