"""New trajectories as a stream: the batch operators over each micro-batch of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def featurize_stream(spark: SparkSession, path: str, schema: str, features: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame], None], checkpoint: str, files: int = 64) -> StreamingQuery:
    """Parquet files with whole trajectories that appear under path are featurized, at most so many at a time, and given to the sink.

    A batch that is repeated after a failure gives the same rows; the checkpoint records which files are done."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.writeStream.foreachBatch(lambda batch, _: sink(features(batch))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
