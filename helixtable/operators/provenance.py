"""Provenance and stability: seals chained over stages, order-free fingerprints, calls that rounding cannot flip, checked merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixtable.sources.sinks import digest


def row_seal(stage: str, columns: list[str], previous: Column | None = None) -> Column:
    """SHA-256 of a row's values at a stage, bound to the seal of the stage before."""
    values = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.sha2(F.concat_ws("|", F.lit(stage), F.coalesce(previous, F.lit("")) if previous is not None else F.lit(""), values), 256)


def sealed(df: DataFrame, stages: dict[str, list[str]]) -> DataFrame:
    """df with seal_<stage> columns, each over its own columns and the seal before."""
    last: Column | None = None
    for stage, columns in stages.items():
        df = df.withColumn(f"seal_{stage}", row_seal(stage, columns, last))
        last = F.col(f"seal_{stage}")
    return df


def broken_seals(df: DataFrame, stages: dict[str, list[str]]) -> DataFrame:
    """Rows whose seals don't match their values, with the first broken stage."""
    broken, last = None, None
    for stage, columns in stages.items():
        test = F.col(f"seal_{stage}") != row_seal(stage, columns, last)
        broken = F.when(test, stage) if broken is None else broken.when(test, stage)
        last = F.col(f"seal_{stage}")
    return df.withColumn("broken", broken).where("broken IS NOT NULL")


def same_content(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, by digests that need no order."""
    return a.columns == b.columns and digest(a).first() == digest(b).first()


def stable_call(score: Column, error: Column, threshold: float) -> Column:
    """True if no value within error of the score changes `score >= threshold`."""
    return F.coalesce(F.abs(score - threshold) > error, F.lit(False))


def stable_evalue(p_low: Column, p_high: Column, space: Column, threshold: float) -> Column:
    """True if both ends of a P-value interval are on one side of an E-value threshold."""
    return F.coalesce(((p_low * space) <= threshold) == ((p_high * space) <= threshold), F.lit(False))


def scattered(rows: DataFrame, facts: DataFrame, index: str) -> DataFrame:
    """rows with the facts of their index; a fact that stands twice or points nowhere is an error."""
    once = facts.groupBy(index).agg(F.count("*").alias("n_"), *[F.first(c).alias(c) for c in facts.columns if c != index])
    d = rows.withColumn("here_", F.lit(True)).join(once, index, "full")
    problem = F.when(F.col("n_") > 1, F.raise_error(F.lit("a fact stands twice"))).when(F.col("here_").isNull(), F.raise_error(F.lit("a fact points nowhere")))
    return d.withColumn("here_", F.coalesce(problem.cast("boolean"), F.col("here_"))).where("here_").drop("here_", "n_")


def one_to_one(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner join of tables that must hold the same keys once each; gaps and repeats are errors."""
    count = lambda d, c: d.groupBy(key).agg(F.count("*").alias(c))
    bad = count(a, "na").join(count(b, "nb"), key, "full").where("na IS NULL OR nb IS NULL OR na > 1 OR nb > 1")
    n = bad.count()
    if n:
        raise ValueError(f"{n} keys of {key} are missing or stand twice")
    return a.join(b, key)
