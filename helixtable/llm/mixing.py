"""Mixing sources to target weights: subset-sum budget fitting over exact token lengths.

Documents are counted by source and exact size. A source's target becomes whole rounds over all its documents and a
remaining budget; for that, a systematic share of the length counts is taken, and bounded-knapsack dynamic
programming fits what is left. The chosen number of each length is filled with its documents in a seeded hash order.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; rows that share a doc_id
are rows of their own, and rows equal in doc_id, source and size are interchangeable; a corpus without words takes
nothing; an empty table gives an empty result; columns of other names pass through `mixed` untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixtable.llm.common import WORD, nested, ranked, text_of, written

WEIGHTS, REPEATS, WINDOW, SEED = (5.0, 2.0, 1.0), 3, 1 << 16, 42


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size, at most counts, have the sum nearest to budget (below before above). Dynamic programming over sums as bit sets."""
    took = np.zeros(len(sizes), dtype=np.int64)
    most = budget + int(sizes.max(initial=0))
    reach, goal, full, steps = 1, 1 << budget, (1 << (most + 1)) - 1, []
    for i in np.argsort(-sizes, kind="stable"):
        spare = int(min(counts[i], most // sizes[i])) if sizes[i] > 0 else 0
        k = 1
        while spare > 0 and not reach & goal:
            k = min(k, spare)
            new = (reach | reach << int(k * sizes[i])) & full
            if new != reach:
                steps.append((i, k, reach))
                reach = new
            spare, k = spare - k, 2 * k
        if reach & goal:
            break
    at, above = (reach & (2 * goal - 1)).bit_length() - 1, reach >> (budget + 1)
    if above and budget + (above & -above).bit_length() - budget < budget - at:
        at = budget + (above & -above).bit_length()
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            took[i] += k
            at -= int(k * sizes[i])
    return took


def fit(sizes: np.ndarray, counts: np.ndarray, target: float, repeats: int = REPEATS) -> tuple[int, np.ndarray]:
    """Rounds over all documents, and how many of each size besides, whose sum comes nearest to the target."""
    total = int((sizes * counts).sum())
    if total == 0:
        return 0, np.zeros(len(sizes), dtype=np.int64)
    rounds, rest = divmod(min(round(target), repeats * total), total)
    if rounds >= repeats or rest == 0:
        return int(rounds), np.zeros(len(sizes), dtype=np.int64)
    upto = np.concatenate([[0], np.floor(np.cumsum(counts) * (max(0, rest - WINDOW) / total))]).astype(np.int64)
    extra = np.diff(upto)  # a systematic share of each length; the last WINDOW words are for the programme
    left = rest - int((sizes * extra).sum())
    for i in np.argsort(-sizes, kind="stable"):  # give back where the share went over the budget
        if left >= 0:
            break
        if extra[i] and sizes[i]:
            back = min(int(extra[i]), -(left // int(sizes[i])))
            extra[i] -= back
            left += back * int(sizes[i])
    for i in np.argsort(-sizes, kind="stable"):
        if left <= WINDOW:
            break
        if sizes[i]:
            more = min(int(counts[i] - extra[i]), (left - WINDOW) // int(sizes[i]))
            extra[i] += more
            left -= more * int(sizes[i])
    return int(rounds), extra + knapsack(sizes, counts - extra, int(left))  # over WINDOW only where every text left is longer than left - WINDOW


def _plan(frames: pd.DataFrame) -> pd.DataFrame:
    frames = frames.sort_values("size")
    rounds, extra = fit(frames["size"].to_numpy(), frames["n"].to_numpy(), float(frames["target"].iloc[0]))
    return frames.assign(rounds=rounds, extra=extra)[["null_", "source_", "size", "source_size", "target", "rounds", "extra"]]


def targets(totals: DataFrame) -> DataFrame:
    """totals (null_, source_, source_size: a row per source) with target.

    Targets are weight times one level, stopped at REPEATS times the source's size; the level that shares all sizes
    out is the largest that any source gives when those that stop earlier are taken out first.
    """
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy("null_", "source_")
    weights = F.array(*map(F.lit, WEIGHTS))
    d = totals.withColumn("weight_", F.get(weights, (F.row_number().over(order) - 1) % len(WEIGHTS))).withColumn("cap_", F.lit(float(REPEATS)) * F.col("source_size"))
    by = everything.orderBy(F.col("cap_") / F.col("weight_"), "null_", "source_")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    d = d.withColumn("level_", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap_").over(before), F.lit(0.0))) / F.sum("weight_").over(after))
    return d.withColumn("target", F.least("cap_", F.col("weight_") * F.max("level_").over(everything))).select("null_", "source_", "source_size", "target")


def mix(docs: DataFrame, seed: int = SEED, by: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, copies, taken (copies times size).

    by: a column of hashes that names the documents to take first, by default one of doc_id and size.
    """
    sized = docs.select(
        "doc_id", (F.col(by) if by else F.lit(None).cast("long")).alias("by_"), F.col("source").isNull().alias("null_"), F.coalesce("source", F.lit("")).alias("source_"),
        F.when(text_of() == "", F.lit(0)).otherwise(F.regexp_count(text_of(), F.lit(WORD))).cast("long").alias("size"),
    )
    sized = written(sized.withColumn("hash_", F.coalesce("by_", F.xxhash64(F.lit(seed), "doc_id", "size"))).drop("by_"), "sizes")
    key = ["null_", "source_"]
    counts = sized.groupBy(*key, "size").agg(F.count("*").alias("n"))
    goals = targets(counts.groupBy(*key).agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    plan = counts.join(goals, key).groupBy(*key).applyInPandas(_plan, "null_ boolean, source_ string, size long, source_size long, target double, rounds long, extra long")
    plan = written(plan, "mix")
    order = ranked(sized, [*key, "size"], "hash_")
    rows = order.join(plan, [*key, "size"])
    rows = rows.withColumn("copies", F.col("rounds") + (F.col("rank_") < F.col("extra")).cast("long"))
    source = F.when(~F.col("null_"), F.col("source_")).alias("source")
    return rows.select("doc_id", source, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs, each row as often as the mix takes it. Rows equal in doc_id, source and text are interchangeable, so runs agree."""
    keyed = written(nested(docs, uid=F.monotonically_increasing_id(), by=F.xxhash64(F.lit(seed), "doc_id", "source", "text")), "rows")
    took = mix(keyed.select(F.col("uid").alias("doc_id"), "row.source", "row.text", "by"), seed, "by").select(F.col("doc_id").alias("uid"), "copies").where("copies > 0")
    out = keyed.join(took, "uid").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
