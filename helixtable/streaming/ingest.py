"""Bounded incremental ingestion: files are taken batch by batch, results and cumulative counters are updated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def files(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, so many to a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def counted_batches(stream: DataFrame, key: str, target: str, checkpoint: str) -> DataFrame:
    """key, rows, total over everything there is, by batches: each writes what it adds under its own number and nothing stays on
    the driver. A batch that runs again replaces its own part, so it counts once; reading sums the parts."""

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(key).agg(F.count("*").alias("rows"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return counters(stream.sparkSession, key, target, stream.schema)


def counters(spark: SparkSession, key: str, target: str, schema: StructType) -> DataFrame:
    """The counters as they stand: the sums of what the batches added."""
    kind = schema[key].dataType.simpleString()
    parts = spark.read.schema(f"{key} {kind}, rows long, total double").option("recursiveFileLookup", True).parquet(target)
    return parts.groupBy(key).agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"))


def append_batches(stream: DataFrame, target: str, checkpoint: str, transform) -> None:
    """transform of each batch, appended under its batch number; a batch that runs again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
