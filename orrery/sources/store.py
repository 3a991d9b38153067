"""A feature store: Parquet partitioned by outkey, with the parameters beside it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dataset import normalize_minmax, normalize_zscore, scrub, upsert


class FeatureStore:
    """path/features and path/parameters. Rows: outkey, sample_id, gx, gy, gz, v; labels have null cells."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, rows: DataFrame) -> None:
        """Adds rows; NaN becomes 0. Rows of a sample go to one file, sorted, so that readers prune by sample."""
        clean = rows.withColumn("v", scrub("v").cast("float"))
        spread = clean.repartition("outkey", "sample_id").sortWithinPartitions("outkey", "sample_id")
        spread.write.mode("append").option("compression", "zstd").partitionBy("outkey").parquet(f"{self.path}/features")

    def read(self, outkey: str, normalize: str | None = None, samples: tuple[int, int] | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/features").where(F.col("outkey") == outkey)
        if samples:
            rows = rows.where((F.col("sample_id") >= samples[0]) & (F.col("sample_id") < samples[1]))
        if normalize is None:
            return rows
        return {"minmax": normalize_minmax, "zscore": normalize_zscore}[normalize](rows, ["sample_id"])

    def update(self, outkey: str, rows: DataFrame) -> None:
        """Replaces the values of rows' cells and adds what is new. The partition is written beside and then exchanged as one."""
        old = self.read(outkey).drop("outkey")
        new = upsert(old, rows.select(*old.columns).withColumn("v", scrub("v").cast("float")), [c for c in old.columns if c != "v"])
        staged = f"{self.path}/staged"
        new.write.mode("overwrite").parquet(staged)
        done = self.spark.read.parquet(staged).withColumn("outkey", F.lit(outkey))
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("outkey").parquet(f"{self.path}/features")

    def write_parameters(self, parameters: dict) -> None:
        rows = [(k, json.dumps(0 if v is None else v)) for k, v in parameters.items()]
        self.spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/parameters")

    def parameters(self) -> dict:
        return {r.name: json.loads(r.value) for r in self.spark.read.parquet(f"{self.path}/parameters").collect()}
