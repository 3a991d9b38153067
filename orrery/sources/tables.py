"""Small text files beside trajectories: tables of labels, and lists of structure codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_labels(spark: SparkSession, path: str, code: str = "pdbcode", value: str = "pK") -> DataFrame:
    """(key, value, position) of a CSV file with a header: codes in lower case, numbers as doubles, and the line for 'the first'.

    Only the two columns are parsed. A header without one of them is an error; a row without a code or whose value is no number is left out."""
    rows = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    if missing := {code, value} - set(rows.columns):
        raise ValueError(f"{path} has no column {', '.join(sorted(missing))}")
    number = F.expr(f"try_cast(`{value}` as double)")
    return rows.select(F.lower(F.trim(F.col(f"`{code}`"))).alias("key"), number.alias("value"), F.monotonically_increasing_id().alias("position")).where("key <> '' and value is not null")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(key, position): a code on each line, in lower case; empty lines are skipped, repeated codes stay."""
    rows = spark.read.text(path).select(F.lower(F.trim("value")).alias("key"), F.monotonically_increasing_id().alias("position"))
    return rows.where("key <> ''")
