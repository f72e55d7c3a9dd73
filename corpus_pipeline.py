"""The corpus pipeline: filter, deduplicate, decontaminate and mix the documents.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next one's
documents. The last stage returns the mix: of the ``size`` words of each document it takes ``taken``, towards
the ``target`` of its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from splitwright.llm import decontaminate, mixing, near, recipes, toxicity
from splitwright.session import settled

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of these documents, rejects go."""
    return toxicity.without_toxic(docs.select(*COLUMNS), _table(spark, sf_dir, "labels"))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts one stays."""
    return recipes.without_copies(docs.select(*COLUMNS))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays."""
    return near.without_near_copies(docs.select(*COLUMNS))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly consist of them go."""
    return decontaminate.decontaminated(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by document: how many of its words are taken, towards the target of its source."""
    return mixing.mixed(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", remove_toxic),
    ("exact dedup", remove_copies),
    ("near dedup", remove_near_copies),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
]

#: Learned scores, sketches and permutations are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    A stage's scratch tables go once its result is written, and that result once the next one is. The last
    stage is returned as a plan, which reads the stage before it.
    """
    docs, before = _table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        result = settled(spark, lambda: stage(spark, docs, sf_dir), "pipeline")  # noqa: B023
        if before is not None:
            before.release()
        docs, before = result.table, result
    return STAGES[-1][1](spark, docs, sf_dir)
