"""Relational operators around the search: inventories, selection, seeds, regions, reports, telemetry and task planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixtable.functions import scores as S
from helixtable.operators.planning import ranked

QUANTILES = (0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)


# -- inventories -----------------------------------------------------------


def length_inventory(rows: DataFrame, group: str, length: str) -> DataFrame:
    """records, residues, shortest, longest, mean by group and for all (group NULL), in one pass of grouping sets."""
    g = rows.groupingSets([[F.col(group)], []], F.col(group))
    out = g.agg(F.count("*").alias("records"), F.sum(length).alias("residues"), F.min(length).alias("shortest"), F.max(length).alias("longest"), F.grouping(group).cast("int").alias("is_total"))
    return out.withColumn("mean", F.round(F.col("residues") / F.col("records"), 6))


def length_histogram(rows: DataFrame, length: str) -> DataFrame:
    return rows.groupBy(length).agg(F.count("*").alias("records")).withColumn("residues", F.col(length) * F.col("records"))


def quantile_records(rows: DataFrame, group: str, length: str, ordinal: str, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """The record at each nearest rank of length within a group (ties by ordinal).

    Ranks come from the histogram: a cumulative count by (group, length) finds the length that holds a rank; only the
    records of those lengths are then ordered, so no window holds a whole group.
    """
    h = rows.groupBy(group, length).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(length).rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy(group)))
    names = F.explode(F.array(*[F.struct(F.lit(S.quantile_name(q)).alias("quantile"), S.quantile_rank(q, F.col("total")).alias("rank")) for q in quantiles]))
    wanted = h.select(group, length, "before", "n", names.alias("q")).select(group, length, "before", "n", "q.*").where("rank >= before AND rank < before + n")
    wanted = wanted.select(F.col(group).alias("g_"), F.col(length).alias("l_"), "quantile", "rank", (F.col("rank") - F.col("before")).alias("place"))
    own = rows.join(wanted.select("g_", "l_").distinct(), (F.col(group).eqNullSafe(F.col("g_"))) & (F.col(length) == F.col("l_")), "left_semi")
    own = own.withColumn("place_", F.row_number().over(Window.partitionBy(group, length).orderBy(ordinal)) - 1)
    return own.join(wanted, (F.col(group).eqNullSafe(F.col("g_"))) & (F.col(length) == F.col("l_")) & (F.col("place_") == F.col("place"))).select(group, "quantile", "rank", ordinal, length)


def length_classes(rows: DataFrame, length: str, scale: float, word_scale: float) -> DataFrame:
    """The length model's terms once for each distinct length."""
    n, s, w = F.col(length), F.lit(scale), F.lit(word_scale)
    d = rows.where(n > 0).groupBy(length).agg(F.count("*").alias("records"))
    a, b = S.bias_length_terms(n)
    move = S.length_move(n.cast("double"), F.lit(1.0))
    return d.select(
        length, "records", F.round(S.null1_score(n), 6).alias("null1"), S.length_cost_byte(n, s).alias("tjb"), S.length_move_word(n, w, F.lit(1.0)).alias("move_word"),
        F.round(move, 9).alias("move"), F.round(1 - move, 9).alias("loop"), F.round(S.length_move(n.cast("double"), F.lit(0.0)), 9).alias("unihit_move"), F.round(a, 6).alias("bias_logp"), F.round(b, 6).alias("bias_log1mp"),
    )


def composition(rows: DataFrame, residues: str) -> DataFrame:
    """residue, n, share: counts of letters, summed in the scan before any shuffle."""
    per = rows.select(F.explode(F.split(residues, "")).alias("residue")).where("residue <> ''").groupBy("residue").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("residue", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"))  # one row


def degenerate_odds(profile: DataFrame, alphabet: DataFrame) -> DataFrame:
    """code, symbol, odds: of the profile's composition (residue, share) against equal frequencies; degenerate symbols by their members."""
    members = alphabet.select("code", "symbol", F.explode("members").alias("residue"))
    return members.join(F.broadcast(profile), "residue", "left").groupBy("code", "symbol").agg(F.round(F.sum(F.coalesce("share", F.lit(0.0))) / (F.count("*") * 0.05), 6).alias("odds"))


# -- selection ---------------------------------------------------------------


def unique_or_conflict(rows: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    """key, copies, values, conflict: repeated keys are one if all their values agree."""
    return rows.groupBy(*key).agg(F.count("*").alias("copies"), F.countDistinct(F.to_json(F.struct(*value), {"ignoreNullFields": "false"})).alias("values")).withColumn("conflict", F.col("values") > 1)


def select_records(records: DataFrame, wanted: DataFrame, key: list[str], identity: list[str]) -> DataFrame:
    """The wanted records in the wanted order (column place), each with a problem (MISSING, MISMATCH) or NULL. wanted: place, key, identity."""
    e = wanted.select("place", *key, *[F.col(c).alias(f"want_{c}") for c in identity])
    d = e.join(records.withColumn("there", F.lit(True)), key, "left")
    problem = F.when(F.col("there").isNull(), "MISSING")
    for c in identity:
        problem = problem.when(~F.col(c).eqNullSafe(F.col(f"want_{c}")), "MISMATCH")
    return d.withColumn("problem", problem).drop("there", *[f"want_{c}" for c in identity])


# -- candidates --------------------------------------------------------------


def candidate_lists(candidates: DataFrame) -> DataFrame:
    """profile_ordinal, start, n, targets (sorted): compressed rows of candidate pairs."""
    d = candidates.groupBy("profile_ordinal").agg(F.sort_array(F.collect_list("seq_ordinal")).alias("targets"), F.count("*").alias("n"))
    w = Window.orderBy("profile_ordinal").rowsBetween(Window.unboundedPreceding, -1)  # one row for each profile
    return d.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0)))


def words_of(rows: DataFrame, ordinal: str, residues: str, width: int) -> DataFrame:
    """ordinal, word: the distinct words of `width` residues of each row; a look-ahead yields the overlapping ones in one walk."""
    words = F.regexp_extract_all(residues, F.lit(f"(?=(.{{{width}}}))"), F.lit(1))
    return rows.select(ordinal, F.explode(F.array_distinct(words)).alias("word"))


def seed_pairs(profile_words: DataFrame, target_words: DataFrame) -> DataFrame:
    """profile_ordinal, seq_ordinal, shared: pairs that share a seed word. Seed words are few; the planner sees their size."""
    return target_words.join(profile_words, "word").groupBy("profile_ordinal", "seq_ordinal").agg(F.count("*").alias("shared"))


def false_rejects(required: DataFrame, kept: DataFrame) -> DataFrame:
    """Pairs that the exact score requires and the seeds missed: must be empty."""
    return required.join(kept, ["profile_ordinal", "seq_ordinal"], "left_anti")


def merged_filters(msv: DataFrame, bias: DataFrame, viterbi: DataFrame) -> DataFrame:
    """One record for each pair from the three filters' outcomes; a NULL Viterbi score asks for its computation."""
    key = ["profile_ordinal", "seq_ordinal"]
    d = msv.join(bias, key, "left").join(viterbi, key, "left")
    kind = F.when(F.col("msv_status") == "OVERFLOW", "RANGE").when(F.col("msv_status") != "OK", "EXACT_PATH").when(F.col("msv_pass"), "FINITE").otherwise("RAW_REJECT")
    facts = F.array_compact(F.array(F.when(kind == "RANGE", "MSV_OVERFLOW"), F.when(kind == "RAW_REJECT", "MSV_REJECT"), F.when(~F.col("bias_pass"), "BIAS_REJECT"), F.when(~F.col("viterbi_pass"), "VITERBI_REJECT")))
    return d.withColumn("kind", kind).withColumn("reasons", facts)


# -- regions -----------------------------------------------------------------


def atomic_fallback(regions: DataFrame, key: list[str], failed: str) -> DataFrame:
    """Regions whose row has any failed sibling go to the exact path as one."""
    return regions.withColumn("fallback", F.max(F.col(failed).cast("int")).over(Window.partitionBy(*key)) == 1)


def trace_faults(steps: DataFrame, key: list[str]) -> DataFrame:
    """Illegal steps of alignments (key, step, state, model, target): D never stands beside I, and places grow as the state says."""
    w = Window.partitionBy(*key).orderBy("step")
    d = steps
    for c in ("state", "model", "target"):
        d = d.withColumn(f"next_{c}", F.lead(c).over(w))
    pair = F.concat("state", "next_state")
    model = F.when(F.col("next_state") == "I", F.col("next_model") == F.col("model")).otherwise(F.col("next_model") == F.col("model") + 1)
    target = F.when((F.col("next_state") == "D") | (F.col("state") == "D"), F.lit(True)).otherwise(F.col("next_target") == F.col("target") + 1)
    legal = pair.isin("MM", "MI", "MD", "IM", "II", "DM", "DD") & model & target
    return d.where(F.col("next_state").isNotNull() & ~legal)


# -- accounting --------------------------------------------------------------


def stage_rates(rows: DataFrame, group: list[str], stages: list[str]) -> DataFrame:
    """group, stage, passed, share of rows (boolean columns `stages`)."""
    sums = rows.groupBy(*group).agg(F.count("*").alias("total"), *[F.sum(F.col(s).cast("long")).alias(s) for s in stages])
    return sums.unpivot([*group, "total"], stages, "stage", "passed").withColumn("share", F.round(F.col("passed") / F.col("total"), 9))


def certificates(rows: DataFrame, key: str, ordinal: str, exception: Column, size: str, stages: list[str]) -> DataFrame:
    """Spans between exceptions: key, segment, begin, end, targets, residues and what was passed in them.

    The certificate of a segment covers the rows after one exception and before the next; empty spans are not listed.
    """
    w = Window.partitionBy(key).orderBy(ordinal)
    d = rows.withColumn("exception", exception.cast("int"))
    d = d.withColumn("segment", F.sum("exception").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = d.where("exception = 0").groupBy(key, "segment")
    return own.agg(
        F.min(ordinal).alias("begin"), F.max(ordinal).alias("end"), F.count("*").alias("targets"), F.sum(size).alias("residues"), F.min("before").alias("residue_prefix"), *[F.sum(F.col(s).cast("long")).alias(s) for s in stages]
    )


def reason_totals(rows: DataFrame, stage: str, reasons: str, cells: str) -> DataFrame:
    """stage, reason, rows, logical_cells of multi-label rows."""
    d = rows.select(stage, F.explode(reasons).alias("reason"), cells)
    return d.groupBy(stage, "reason").agg(F.count("*").alias("rows"), F.sum(cells).alias("logical_cells"))


def missing_ordinals(expected: DataFrame, recorded: DataFrame, ordinal: str) -> DataFrame:
    return expected.select(ordinal).distinct().join(recorded.select(ordinal), ordinal, "left_anti")


def route_partition(rows: DataFrame, key: str, route: str, routes: list[str]) -> DataFrame:
    """key, targets, a count for each route, and whether routes partition the targets."""
    d = rows.groupBy(key).agg(F.count("*").alias("targets"), *[F.sum((F.col(route) == r).cast("long")).alias(r) for r in routes])
    return d.withColumn("complete", sum((F.coalesce(F.col(r), F.lit(0)) for r in routes), F.lit(0)) == F.col("targets"))


def pareto(rows: DataFrame, ordinal: str, cost: str) -> DataFrame:
    """rank by falling cost (ties by ordinal), cumulative cost, and the fraction as two whole numbers."""
    total = rows.agg(F.sum(cost).alias("denominator"))  # one row
    d = ranked(rows.select(ordinal, cost), [F.col(cost).desc(), F.col(ordinal)], (cost,)).crossJoin(total)
    return d.select(ordinal, cost, "rank", F.col(f"{cost}_upto").alias("numerator"), "denominator")


def replicate_statistics(runs: DataFrame, group: list[str], value: str) -> DataFrame:
    return runs.groupBy(*group).agg(
        F.count("*").alias("runs"), F.round(F.median(value), 6).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("stdev")
    )


def agreement(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """Counters of two yes/no judgements."""
    d = rows.select(a.alias("a"), b.alias("b"))
    return d.agg(F.count("*").alias("compared"), F.count_if(F.col("a") == F.col("b")).alias("agreed"), F.count_if(F.col("a") & ~F.col("b")).alias("only_first"), F.count_if(~F.col("a") & F.col("b")).alias("only_second"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("skipped"))


def set_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """only_first, only_second: rows that one table has and the other lacks, repeats counted."""
    left = a.exceptAll(b).agg(F.count("*").alias("only_first"))
    right = b.exceptAll(a).agg(F.count("*").alias("only_second"))
    return left.crossJoin(right)  # one row each


def common_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


# -- tasks ---------------------------------------------------------------------


def _cut(limit: str, room: str) -> str:
    """Fold of ordered weights into contiguous tasks: a task is closed before the weight that would exceed `limit`, or at `room` rows."""
    task = "array<struct<first:int,rows:int,weight:bigint>>"
    last = "element_at(a, -1)"
    step = f"""(a, x) -> CASE WHEN size(a) = 0 THEN array(named_struct('first', 0, 'rows', 1, 'weight', x.w))
        WHEN {last}.rows >= {room} OR {last}.weight + x.w > {limit} THEN concat(a, array(named_struct('first', {last}.first + {last}.rows, 'rows', 1, 'weight', x.w)))
        ELSE concat(slice(a, 1, size(a) - 1), array(named_struct('first', {last}.first, 'rows', {last}.rows + 1, 'weight', {last}.weight + x.w))) END"""
    return f"aggregate(items, cast(array() as {task}), {step})"


def balanced_tasks(rows: DataFrame, group: str, ordinal: str, weight: str, most: int = 8) -> DataFrame:
    """group, task, first, rows, weight: each group's rows cut into contiguous tasks of about equal weight, `most` rows at most."""
    d = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(weight).cast("bigint").alias("w")))).alias("items"), F.sum(weight).cast("bigint").alias("total"), F.count("*").alias("n"))
    d = d.withColumn("target", F.ceil(F.col("total") / F.ceil(F.col("n") / most)).cast("bigint"))
    d = d.withColumn("tasks", F.expr(_cut("target", str(most))))
    return d.select(group, "target", F.posexplode("tasks").alias("task", "t")).select(group, "task", "target", "t.first", "t.rows", "t.weight")


def sharded_tasks(tasks: DataFrame, parts: DataFrame, group: str, trigger: tuple[int, int] = (2, 1)) -> DataFrame:
    """Tasks of one row whose weight exceeds trigger times the target, cut at their parts (group, first, part, w) into shards."""
    heavy = S.exceeds_ratio(F.col("weight"), F.col("target"), *trigger) & (F.col("rows") == 1)
    d = tasks.withColumn("heavy", heavy)
    items = parts.groupBy(group, "first").agg(F.array_sort(F.collect_list(F.struct(F.col("part").alias("o"), F.col("w").cast("bigint").alias("w")))).alias("items"))
    cut = d.where("heavy").join(items, [group, "first"]).withColumn("shards", F.expr(_cut("target", "2147483647")))
    cut = cut.select(group, "task", F.size("shards").alias("n"), F.posexplode("shards").alias("shard", "s")).select(group, "task", "shard", "s.first", F.col("s.rows").alias("parts"), "s.weight", (F.col("shard") + 1 == F.col("n")).alias("last"))
    whole = d.join(cut.select(group, "task").distinct(), [group, "task"], "left_anti")
    return whole.select(group, "task", F.lit(-1).alias("shard"), "first", F.col("rows").alias("parts"), "weight", F.lit(True).alias("last")).unionByName(cut)


def chunked(rows: DataFrame, ordinal: str, size: int) -> DataFrame:
    return rows.withColumn("chunk", F.floor(F.col(ordinal) / size).cast("int"))
