"""Facts of rows as bitmaps: how many rows have any, or all, of a set of facts, without another look at the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decoded(bits: Column, names: dict[str, int]) -> Column:
    """The names of the bits that are set, in the order given; bits of no name give UNKNOWN."""
    known = sum(names.values())
    rest = F.when(bits.bitwiseAND(F.lit(~known)) != 0, "UNKNOWN")
    return F.array_compact(F.array(*[F.when(bits.bitwiseAND(F.lit(b)) != 0, n) for n, b in names.items()], rest))


def fact_bitmaps(rows: DataFrame, stage: str, ordinal: str, facts: str) -> DataFrame:
    """stage, fact, bucket, bits: for each stage and fact the ordinals (from 0) of the rows that have it, 32,768 to a bitmap of 4 KB.

    Tasks build bitmaps of what they read before anything is shuffled.
    """
    d = rows.select(stage, (F.col(ordinal) + 1).alias("at_"), F.explode(facts).alias("fact"))  # bitmaps count from 1
    return d.groupBy(stage, "fact", F.bitmap_bucket_number("at_").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at_")).alias("bits"))


def fact_totals(bitmaps: DataFrame, stage: str) -> DataFrame:
    """stage, fact, rows."""
    return bitmaps.groupBy(stage, "fact").agg(F.sum(F.bitmap_count("bits")).alias("rows"))


def with_any(bitmaps: DataFrame, stage: str, sets: DataFrame) -> DataFrame:
    """stage, name, rows: how many rows have any fact of each set (name, facts)."""
    wanted = sets.select("name", F.explode("facts").alias("fact"))
    d = bitmaps.join(wanted, "fact").groupBy(stage, "name", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return d.groupBy(stage, "name").agg(F.sum(F.bitmap_count("bits")).alias("rows"))


def with_all(bitmaps: DataFrame, stage: str, sets: DataFrame) -> DataFrame:
    """stage, name, rows: how many rows have all facts of each set. A bucket counts only where each fact has a bitmap."""
    wanted = sets.select("name", F.size(F.array_distinct("facts")).alias("many"), F.explode(F.array_distinct("facts")).alias("fact"))
    d = bitmaps.join(wanted, "fact").groupBy(stage, "name", "many", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("there")).where("there = many")
    return d.groupBy(stage, "name").agg(F.sum(F.bitmap_count("bits")).alias("rows"))
