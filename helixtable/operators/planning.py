"""Orders, record selection and work planning: ranks without a one-task window, bounded window sums, routes by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixtable.sources.sinks import materialised

#: Targets that one batch of a profile takes, and cells (model positions x residues) below which a pair is small.
MOST_TARGETS, SMALL_CELLS, MOST_CELLS = 65_536, 200_000, 1 << 40


def ranked(rows: DataFrame, order: list[Column], sums: tuple[str, ...] = ()) -> DataFrame:
    """rows with rank (from 1 in the given order) and <column>_upto, the running sum of each of `sums`.

    Spark sorts by ranges; the sorted table is written, so that a row's range and place in it stand, and what comes before
    a range is added from one row of counts for each range. No task holds more than its range.
    """
    sorted_ = materialised(rows.orderBy(*order).withColumn("at_", F.monotonically_increasing_id()), "ranked").withColumn("range_", F.shiftright("at_", 33))
    parts = sorted_.groupBy("range_").agg(F.count("*").alias("n_"), *[F.sum(c).alias(f"{c}_n_") for c in sums])
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    parts = parts.select("range_", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0_") for c in ("n_", *[f"{x}_n_" for x in sums])])
    own = Window.partitionBy("range_").orderBy("at_")
    out = sorted_.join(parts, "range_").withColumn("rank", F.col("n_0_") + F.row_number().over(own))
    for c in sums:
        out = out.withColumn(f"{c}_upto", F.col(f"{c}_n_0_") + F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return out.drop("at_", "range_", "n_0_", *[f"{c}_n_0_" for c in sums])


def ranked_within(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """rows with their place (from 0) within a group: the place in one order of all less the place where the group begins. A group
    that holds most rows is ranked by ranges like any other."""
    d = ranked(rows, [F.col(group), *order])
    starts = d.groupBy(F.col(group).alias("group_")).agg(F.min("rank").alias("first_"))
    d = d.join(starts, F.col(group).eqNullSafe(F.col("group_")))
    return d.withColumn(name, F.col("rank") - F.col("first_")).drop("rank", "group_", "first_")


def first_records(rows: DataFrame, ordinal: str, n: int) -> DataFrame:
    """The first n records by ordinal: each task keeps n of its own before they meet."""
    return rows.orderBy(ordinal).limit(n)


def bounded_gain(rows: DataFrame, group: str, ordinal: str, gain: str, most: int) -> DataFrame:
    """group, best: the largest sum of 1 to `most` consecutive gains of a group, in the order of `ordinal` (0 at least)."""
    own = Window.partitionBy(group).orderBy(ordinal)
    d = rows.select(group, ordinal, F.sum(gain).over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.col(gain).alias("gain_"))
    low = F.min(F.col("upto") - F.col("gain_")).over(own.rowsBetween(1 - most, 0))  # the prefixes before each of the last `most`
    return d.select(group, (F.col("upto") - low).alias("x")).groupBy(group).agg(F.greatest(F.max("x"), F.lit(0)).alias("best"))


def select_text_records(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (place, file, ordinal, name) with header and problem: MISSING, UNTERMINATED (no closing line), DUPLICATE (its header
    stands in another record of the file too), MISMATCH (another name) or NULL. records: file, ordinal, value."""
    header = F.regexp_extract("value", r"(?m)^NAME +(.*?) *$", 1)
    own = records.select("file", "ordinal", header.alias("header"), F.col("value").rlike(r"\n//\s*$").alias("closed"))
    copies = own.groupBy("file", "header").agg((F.count("*") > 1).alias("copied"))
    own = own.join(copies, ["file", "header"])
    problem = F.when(F.col("header").isNull(), "MISSING").when(~F.col("closed"), "UNTERMINATED").when(F.col("copied"), "DUPLICATE").when(~F.col("header").eqNullSafe(F.col("name")), "MISMATCH")
    return wanted.join(own, ["file", "ordinal"], "left").select("place", "file", "ordinal", "header", problem.alias("problem"))


def work_routes(rows: DataFrame, targets: str, cells: str, most_targets: int = MOST_TARGETS, small_cells: int = SMALL_CELLS, most_cells: int = MOST_CELLS) -> DataFrame:
    """rows with batches (of most_targets at most) and route: REFUSED (more cells than a search may have), SPLIT (several batches), SMALL or WHOLE."""
    n, c = F.col(targets), F.col(cells)
    route = F.when(c > most_cells, "REFUSED").when(n > most_targets, "SPLIT").when(c <= small_cells, "SMALL").otherwise("WHOLE")
    return rows.withColumn("batches", F.ceil(n / most_targets)).withColumn("route", route)
