"""The corpus pipeline: from raw documents to tokens, one operator of `polderlake.llm` per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polderlake.llm import bpe, decontaminate, language_id, line_dedup, simhash
from polderlake.llm.frames import stored, table
from polderlake.llm.queries import tokenizer_file


def language_identification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text in a known language go."""
    return language_id.accepted_only(docs)


def repeated_line_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line blocks that an earlier document has go; so do documents of which nothing is left."""
    cut = line_dedup.remove_repeated_lines(docs)
    changed = F.col("n_removed") > 0
    cut = cut.where(~changed | (F.trim("text") != "")).withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")))
    return cut.select(docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return simhash.one_of_each_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; all others stay as they are."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document, with the digests of tokens and decoded text."""
    made = bpe.encode_documents(docs, bpe.Encoder.from_file(tokenizer_file()))
    return made.select("doc_id", "lang", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_identification", language_identification),
    ("repeated_line_removal", repeated_line_removal),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: The stages fit models, walk automata and join components: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
