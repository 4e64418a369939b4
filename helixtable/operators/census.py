"""Census: one wide row for each survivor, from stage tables that are laid out alike, so that joining them moves nothing.

Each stage's table is bucketed and sorted by the same keys when it is written; bucket i of one meets bucket i of the
others, already in order. A survivor's key is in one task's bucket, and keys are pairs, so no bucket is hot.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixtable.sources.sinks import shared_folder


def _dropped(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session may be gone at exit
        pass


def laid_out(rows: DataFrame, stage: str, keys: list[str], buckets: int) -> DataFrame:
    """rows as a table of their own in the shared folder, bucketed and sorted by keys."""
    spark = rows.sparkSession
    name = f"census_{stage}_{uuid.uuid4().hex}"
    dealt = rows.repartition(buckets, *keys)  # a task for each bucket, so each bucket is one sorted file
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", shared_folder(spark, name)).saveAsTable(name)
    atexit.register(_dropped, spark, name)
    return spark.table(name)


def census(survivors: str, stages: dict[str, DataFrame], keys: list[str], buckets: int = 64) -> DataFrame:
    """keys, survivors' columns, and each other stage's as <stage>_<column> (NULL where that stage has no row of the key).

    The tables hold a key once; a key that stands twice in a stage is an error.
    """
    tables = {k: laid_out(v, k, keys, buckets) for k, v in stages.items()}
    out = tables[survivors]
    for k, t in tables.items():
        if k != survivors:
            t = t.groupBy(*keys).agg(F.count("*").alias("copies_"), *[F.first(c).alias(f"{k}_{c}") for c in t.columns if c not in keys])
            out = out.hint("merge").join(t.hint("merge"), keys, "left")
            twice = F.when(F.col("copies_") > 1, F.raise_error(F.lit(f"a key stands twice in {k}")).cast("boolean")).otherwise(F.col("copies_").isNotNull())
            out = out.withColumn(f"{k}_there", twice).drop("copies_")
    return out
