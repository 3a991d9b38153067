"""The registered queries: each operator with its production parameters over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import warc
from .chat_formatting import conversations
from .common import Scratch
from .html_extraction import main_text
from .order_minhash import near_duplicates
from .packing import pack
from .quality_classifier import classify
from .quality_rules import TIGHT_BANDS, compression_bands
from .suffix_dedup import repeated_passages
from .template_decontamination import leaks
from .word_lm_scoring import word_perplexity


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC files to the shared folder, and read from there."""
    path = Scratch(spark).path()
    warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    rows = warc.read(spark, path)
    return rows.select(
        F.regexp_extract("record_id", r"^urn:page:(-?\d+)$", 1).cast("long").alias("page_id"), F.col("target_uri").alias("url"), F.col("type").alias("record_type"), "content_type", "content_length", "status", F.col("payload").cast("string").alias("html")
    )


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(spark.read.parquet(f"{sf_dir}/documents.parquet"), bands=TIGHT_BANDS)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_perplexity(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OPS = (op1_quality_classifier, op2_packing, op3_warc, op4_chat_formatting, op5_quality_rules, op6_suffix_dedup, op7_decontamination, op8_lm_scoring, op9_html_extraction, op10_order_minhash)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPS}
#: The pages' WARC files hold what the pages hold. The other operators have no SQL counterpart; tests hold them against brute force.
SQL: dict[str, str] = {
    "op3_warc": """
        SELECT page_id, url, 'resource' AS record_type, 'text/html' AS content_type, CAST(strlen(html) AS BIGINT) AS content_length, 'ok' AS status, html
        FROM pages""",
}
