"""From raw documents to token files: quality rules, near duplicates, benchmark leaks, mixing, token output.

Every stage takes what its predecessor kept, as Parquet in the cluster's shared folder. All but the last return the columns of the
documents; the last writes the token file and returns doc_id, start, n_tokens and ids_crc32 as read back from it.

A stage's result is written before the next stage begins; what a stage wrote on the way is deleted then, unless the next one reads it.
Where shuffles have far more parts than the documents, it comes in as many as these.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from bidloom.llm import decontaminate, mixing, near_dup, quality, token_file
from bidloom.llm.catalog import vocabulary
from bidloom.llm.common import drop_tables, merged, most_tasks, recorded, stored, table
from bidloom.session import scratch_dir


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_WRITTEN: dict[str, list[str]] = {}  # tables of each stage that are still there


def stage(run: Stage) -> Stage:
    @wraps(run)
    def cleaned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name in [n for n in _WRITTEN if n != run.__name__]:
            drop_tables(spark, _WRITTEN.pop(name), but=docs)
        with recorded() as paths:
            result = run(spark, docs, sf_dir)
        _WRITTEN.setdefault(run.__name__, []).extend(paths)
        return merged(result, most_tasks(spark, docs.rdd.getNumPartitions()))

    return cleaned


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


@stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


@stage
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "corpus-tokens")
    token_file.write_tokens(docs, vocabulary("byte_bpe_50k.json"), path)
    return token_file.read_tokens(spark, path)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mixing", source_mixing),
    ("token output", token_output),
]

# Expectation-maximisation and byte-pair merges have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, apply in STAGES:
        with recorded() as paths:
            docs = stored(apply(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_tables(spark, before)
        before = paths[-1:]
    return docs
