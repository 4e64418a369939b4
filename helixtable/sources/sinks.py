"""Writers: result rows, hit tables, FASTA and profile text, JSON and report folders."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below the one the cluster names, in local mode below the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    named = named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/helixtable"
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit
        pass


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: several readers cost one run, a lost executor a reread. It goes at exit."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def result_row(columns: dict[str, Column]) -> Column:
    """One tab-separated line: name, query, score, evalue, c_evalue, i_evalue, envelope, domain score, alignment and model coordinates."""
    f = columns
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    two, sci = (lambda c: F.format_string("%.2f", c)), (lambda c: F.format_string("%.2e", c))
    ali_from, ali_to = F.coalesce(f["ali_from"], f["env_from"]), F.coalesce(f["ali_to"], f["env_to"])
    return F.concat_ws(
        "\t", f["name"], f["query"], two(f["score"]), sci(f["evalue"]), sci(f["c_evalue"]), sci(f["i_evalue"]), text(f["env_from"]), text(f["env_to"]), two(f["domain_score"]), text(ali_from), text(ali_to), text(f["hmm_from"]), text(f["hmm_to"])
    )


def write_lines(lines: DataFrame, path: str) -> None:
    """One text column, in its order of partitions; Spark's commit makes the files appear whole or not at all."""
    lines.write.mode("errorifexists").text(path)


def target_table(hits: DataFrame) -> DataFrame:
    """value: fixed-width lines of hits, as a table of targets."""
    left, right = (lambda c, n: F.rpad(F.col(c).cast("string"), n, " ")), (lambda c, n: F.lpad(c, n, " "))
    return hits.select(
        F.concat_ws(" ", left("target", 20), left("query", 20), right(F.format_string("%.2g", "evalue"), 9), right(F.format_string("%.1f", "score"), 6), right(F.format_string("%.1f", "bias"), 5), right(F.col("reported").cast("string"), 3)).alias("value")
    )


def domain_table(domains: DataFrame) -> DataFrame:
    """value: fixed-width lines of domains."""
    left, right = (lambda c, n: F.rpad(F.col(c).cast("string"), n, " ")), (lambda c, n: F.lpad(F.col(c).cast("string"), n, " "))
    numbers = [right(c, 6) for c in ("hmm_from", "hmm_to", "ali_from", "ali_to", "env_from", "env_to")]
    return domains.select(F.concat_ws(" ", left("target", 20), left("query", 20), right("domain_ordinal", 3), F.lpad(F.format_string("%.2g", "i_evalue"), 9, " "), F.lpad(F.format_string("%.1f", "domain_score"), 6, " "), *numbers).alias("value"))


def write_report(parts: dict[str, DataFrame], folder: str) -> DataFrame:
    """Each part as a Parquet table in a new folder; returns their manifest: part, rows, sha256 of the sorted rows."""
    manifest = None
    for name, part in parts.items():
        part.write.mode("errorifexists").parquet(f"{folder}/{name}")
        row = digest(part.sparkSession.read.parquet(f"{folder}/{name}")).select(F.lit(name).alias("part"), "rows", "digest")
        manifest = row if manifest is None else manifest.unionByName(row)
    manifest.coalesce(1).write.mode("errorifexists").json(f"{folder}/manifest")
    return manifest


def digest(df: DataFrame) -> DataFrame:
    """rows, digest of a table, whatever its order: sums of two 64-bit hashes of its rows, so nothing is sorted or gathered."""
    h = lambda seed: F.xxhash64(F.lit(seed), F.to_json(F.struct(*sorted(df.columns))))
    total = lambda seed: F.coalesce(F.sum(h(seed).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return df.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(",", total(1), total(2)), 256).alias("digest"))


def science_lines(lines: DataFrame) -> DataFrame:
    """rows, digest of report lines without comments and trailing space: equal for runs that differ in timing alone."""
    return digest(lines.where(~F.col("value").startswith("#")).select(F.rtrim("value").alias("value")))
