"""From documents to packed sequences: each stage works on all that the one before kept.

STAGES: (name, function of spark, docs and the folder of the input tables). All but the last return the columns
of documents. run() writes each stage's result as Parquet to the shared folder and reads it back for the next. When a stage
begins, the tables that the ones before wrote for themselves go, unless its documents are still read from them.

The quality scorer and the host verdicts learn from the documents at hand, near-duplicates depend on hashes and
packing on a tokenizer, none of which SQL can express, so ORACLE_SQL is None and tests/llm/ hold each stage
against a brute-force version.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontamination, near_copies, packing, quality_classifier, quality_rules
from lectern.llm.common import recording, removed, written
from lectern.session import shipped

ORACLE_SQL = None


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule and no host verdict rejects."""
    return quality_rules.filtered(docs)


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained scorer does not reject."""
    return quality_classifier.filtered(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, similarity 0.8 or more of five-word shingles: that with the smallest doc_id."""
    return near_copies.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark windows cut out; those that are mostly benchmark go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their ids and their place in sequences of 2048."""
    return packing.pack(docs, keep_ids=True)


#: Tables that stages have left, by application.
_left: dict[str, list[str]] = {}


def tidied(stage):
    """stage, removing what is left of those before."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _left.setdefault(spark.sparkContext.applicationId, [])
        left[:] = removed(spark, left, docs)
        with recording() as paths:
            out = stage(spark, docs, sf_dir)
        left += paths
        return out

    return run


STAGES = [
    ("quality_rules", shipped(tidied(by_rules))),
    ("quality_classifier", shipped(tidied(by_classifier))),
    ("simhash_near_dedup", shipped(tidied(without_near_copies))),
    ("benchmark_decontamination", shipped(tidied(without_benchmark))),
    ("packing", shipped(tidied(packed))),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of the folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
