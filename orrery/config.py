"""Settings of a session: a file or a dictionary with known keys alone, turned into Spark's configuration."""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from pyspark.sql import SparkSession

SPARK = {
    "master": "spark.master", "app_name": "spark.app.name", "shuffle_partitions": "spark.sql.shuffle.partitions", "shared_folder": "spark.checkpoint.dir",
    "split_bytes": "spark.sql.files.maxPartitionBytes", "broadcast_bytes": "spark.sql.autoBroadcastJoinThreshold", "driver_memory": "spark.driver.memory", "executor_memory": "spark.executor.memory",
}


@dataclass(frozen=True)
class Settings:
    """What is None stays as Spark has it. log_level is that of Spark and of this package's logger."""

    master: str | None = None
    app_name: str | None = "orrery"
    shuffle_partitions: int | None = None
    shared_folder: str | None = None
    split_bytes: int | None = None
    broadcast_bytes: int | None = None
    driver_memory: str | None = None
    executor_memory: str | None = None
    log_level: str = "WARN"

    @classmethod
    def of(cls, values: dict | str | Path) -> Settings:
        """From a dictionary or a JSON file; an unknown key is an error."""
        values = values if isinstance(values, dict) else json.loads(Path(values).read_text())
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(values) - known):
            raise KeyError(f"no setting {', '.join(unknown)}; there are {', '.join(sorted(known))}")
        return cls(**values)

    def updated(self, **values) -> Settings:
        return Settings.of(asdict(self) | values)

    def spark_conf(self) -> dict[str, str]:
        return {SPARK[k]: str(v) for k, v in asdict(self).items() if k in SPARK and v is not None}

    def session(self) -> SparkSession:
        """The session with these settings; Arrow and adaptive plans are on, times are in UTC."""
        fixed = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"}
        spark = SparkSession.builder.config(map=fixed | self.spark_conf()).getOrCreate()
        spark.sparkContext.setLogLevel(self.log_level)
        logging.getLogger("orrery").setLevel(getattr(logging, {"WARN": "WARNING"}.get(self.log_level, self.log_level), logging.WARNING))
        return spark
