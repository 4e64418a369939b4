"""Shared pieces: reading tables, cutting lineage in the shared folder, ranks and components that no single task holds."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a text: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 1000
BITS = 1 << 24  # of a bitmap of keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it. In local mode, where driver and executors
    are one process, a folder below the warehouse will do; elsewhere a folder must be named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/helixtable"


def drop_folder(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit
        pass


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for as long as the block runs; the caller's own comes back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends there and a lost executor costs a reread.

    Nothing reads the shuffle files behind the table again: Spark drops them when it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.select("*").write.parquet(path)
    atexit.register(drop_folder, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path_ = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        drop_folder(t.sparkSession, t.written_path_)


def marked(ids: DataFrame, column: str) -> DataFrame:
    """A bitmap of BITS bits of the hashes of a column, in BITS / 32768 rows at most (b, bits): small whatever the input."""
    h = F.pmod(F.xxhash64(column), F.lit(BITS))
    return ids.select(F.bitmap_bucket_number(h).alias("b"), F.bitmap_bit_position(h).alias("at")).groupBy("b").agg(F.bitmap_construct_agg("at").alias("bits"))


def kept_by(df: DataFrame, column: str, bitmap: DataFrame) -> DataFrame:
    """Rows of df whose column may be in the bitmap: all that are, few others."""
    h = F.pmod(F.xxhash64(column), F.lit(BITS))
    rows = df.withColumn("b", F.bitmap_bucket_number(h)).withColumn("at_", F.bitmap_bit_position(h)).join(F.broadcast(bitmap), "b")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at_ div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return rows.where(byte.bitwiseAND(F.expr("cast(shiftleft(1, cast(at_ % 8 as int)) as int)")) != 0).drop("b", "at_", "bits")


def nested(docs: DataFrame, **more: Column) -> DataFrame:
    """docs as one column, row, beside `more`: no name of theirs clashes with one of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in more.items()])


def small_batches(spark: SparkSession) -> None:
    """Texts may be long: Python workers get BATCH_ROWS of them at a time, unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_of(column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ranked(df: DataFrame, keys: list[str], by: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """df with rank_ (from 0 within keys, ordered by the hash `by`) and, for each column of sums, <column>_before_.

    Rows of one key are dealt to 256 salts, the upper bits of the hash; what stands before a salt comes from
    counts by key and salt, so a key that holds a third of all rows is still ranked in 256 parts.
    """
    salted = df.withColumn("salt_", F.shiftrightunsigned(by, 56))
    parts = salted.groupBy(*keys, "salt_").agg(F.count("*").alias("n_"), *[F.sum(c).alias(f"{c}_n_") for c in sums])
    before = Window.partitionBy(*keys).orderBy("salt_").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *keys, "salt_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("n0_"), *[F.coalesce(F.sum(f"{c}_n_").over(before), F.lit(0)).alias(f"{c}_0_") for c in sums]
    )
    own = Window.partitionBy(*keys, "salt_").orderBy(by)
    run = own.rowsBetween(Window.unboundedPreceding, -1)
    out = salted.join(parts, [*keys, "salt_"])
    out = out.withColumn("rank_", F.col("n0_") + F.row_number().over(own) - 1)
    for c in sums:
        out = out.withColumn(f"{c}_before_", F.col(f"{c}_0_") + F.coalesce(F.sum(c).over(run), F.lit(0)))
    return out.drop("salt_", "n0_", *[f"{c}_0_" for c in sums])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest reachable node) of the undirected edges (a, b); nodes without an edge are absent.

    Every round each node takes the smallest label among its neighbours, then its label's label. Rounds go on until
    no label changes. Minimum is an aggregate with partial sums, so a hub is no single task's burden; labels are
    written between rounds. A path that needs more than `rounds` rounds is an error, never a wrong answer.
    """
    edges = edges.where("a <> b")
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        took = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("was"), F.least("component", "near").alias("took"))
        jump = labels.select(F.col("node").alias("took"), F.col("component").alias("further"))
        new = written(took.join(jump, "took", "left").select("node", "was", F.least("took", F.coalesce("further", "took")).alias("component")), "labels")
        labels, changed = new.select("node", "component"), new.where("component <> was").limit(1).count()
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
