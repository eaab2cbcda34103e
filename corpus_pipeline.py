"""From raw documents to packed training batches: five stages over the documents table.

Each stage gets what the stage before it kept, as Parquet read again, and its decisions take effect:
all but the last return the columns of documents, the last the place of each document in a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from densityflow.llm import classifier, decontamination, near_dedup, packing, quality_rules
from densityflow.llm.common import cut, drop, fresh, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as good."""
    return classifier.accepted(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    verdict = fresh("quality", docs.columns)
    return quality_rules.quality_rules(docs, out="quality").where(f"`{verdict}`.kept").select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.without_near_duplicates(docs, 80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"), 0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A batch and a place for each document."""
    return packing.packed(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("near_dedup", dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]
#: The classifier's scores can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        if before is not None:
            drop(before)  # what the next stage has read in full
        before = docs
    return docs
