"""Probe results as a stream: files that arrive in a folder are counted by kind."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismcat.plans.scratch import Scratch


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """A file stream with the schema of what is there now."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*.parquet").parquet(folder if _is_file(spark, path) else path)


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def run_once(spark: SparkSession, path: str) -> DataFrame:
    """Process all that has arrived and stop; every batch's partial sums are written before its files count as seen."""
    scratch = Scratch(spark, f"probe-{uuid.uuid4().hex[:8]}")
    out = f"{scratch.base}/batches"

    def put(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        sums.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = arrivals(spark, path).select("event_type", "value")
    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{scratch.base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))
