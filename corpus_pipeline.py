"""Five stages over documents: quality rules, near-duplicates, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm.order_minhash import drop_near_duplicates
from orrery.llm.packing import pack
from orrery.llm.quality_rules import TIGHT_BANDS, keep_compressible
from orrery.llm.suffix_dedup import cut_repeats
from orrery.llm.template_decontamination import decontaminate


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the compression bands."""
    return keep_compressible(docs, bands=TIGHT_BANDS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_near_duplicates(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand in an earlier one."""
    return cut_repeats(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows, in order."""
    return pack(docs)


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("substring_dedup", passages), ("decontamination", decontaminated), ("packing", packed)]
#: Alignment, suffix trees and the packing programme have no SQL counterpart; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
