"""Runs a streaming view to the end of what is there and keeps its result in the shared folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetdelta.session import scratch_path


def drain(view: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Result of a streaming view over all data available now.

    Without ``keys`` rows are appended to a file sink. With keys the view runs in update
    mode: a micro-batch writes the changed rows to a folder of its own, so a restarted batch
    writes the same again, and the newest row of each key is the result.
    """
    spark: SparkSession = view.sparkSession
    target = scratch_path(spark, "stream-out")
    writer = view.writeStream.option("checkpointLocation", scratch_path(spark, "stream-state")).trigger(availableNow=True)
    if not keys:
        writer.outputMode("append").format("parquet").start(target).awaitTermination()
        return spark.read.schema(view.schema).parquet(target)

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/step={number}")

    writer.outputMode("update").foreachBatch(replace).start().awaitTermination()
    changed = spark.read.option("basePath", target).parquet(f"{target}/step=*")
    rest = [c for c in view.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), "step").alias("newest")
    return changed.groupBy(*keys).agg(newest).select(*keys, "newest.*").select(*view.columns)
