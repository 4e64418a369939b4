"""Quality rules: learned decision lists of threshold conjunctions, with DataFrame functions only.

Statistics of a text are columns; a rule is a conjunction of thresholds on them, such as symbol_share > 0.01 AND
repeat_share <= 0.2. Rules are learned by sequential covering for the rows labelled 0: a rule grows literal by
literal, each the one of most information gain on the rows still uncovered; then its end is pruned where a shorter
rule is better on rows kept from growing; rows that it covers go, and the next rule grows from the rest. A rule that is
not PRECISION precise on the rows kept from growing is dropped, and none that starts with its statistic is tried for
the rows left; learning ends when none is left to try, or after RULES. The list is emitted as one ordered conditional expression, `number`, which names the first rule that a text meets, or 0.

The thresholds tried are quantiles of each statistic among the rows of each label (QUANTILES a label) and what lies
midway between two; of thresholds of equal gain in a row the middle one is taken, away from either kind of row. So a
labelled row is a few small integers, its places among the thresholds. A step of growing is one aggregation: counts by statistic, place and label
reach the driver, STATISTICS x places x 2 numbers whatever the input. All labelled rows take part. Which rows are kept
from growing hangs on a hash of the id (one in three).

Windows of five words are compared by their 64-bit hashes, within a text only; a text's arrays are as long as the text.

Defined cases: a null text is an empty one: 0 words, all statistics 0, base_failed; ids may be null (never labelled) or
repeat (rows of their own); labels that are neither 0 nor 1, have no id, or contradict each other are left out;
without labels of both kinds the list is empty and only the base rules count; an empty table gives an empty result;
other columns are ignored by `quality` and kept by `clean`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixtable.llm.common import forget, nested, text_of, written

SPACE, A_WORD, NO_SYMBOL = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", r"[^#*$%&|<>]+"
WINDOW, QUANTILES, RULES, LITERALS, PRECISION, KEPT_BACK = 5, 32, 12, 4, 0.95, 3
STATISTICS = ("n_words", "mean_word", "symbol_share", "upper_share", "mark_share", "dup_line_share", "repeat_share", "distinct_share", "line_words", "ended_share", "top_share")


@dataclass(frozen=True)
class Literal:
    """statistic > cut, or statistic <= cut."""

    statistic: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.statistic) > self.cut if self.above else F.col(self.statistic) <= self.cut

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Literal, ...]


def met(rule: Rule) -> Column:
    out = F.lit(True)
    for literal in rule:
        out = out & literal.column()
    return out


def number(rules: list[Rule]) -> Column:
    """The decision list: the number (from 1) of the first rule that a row meets, 0 if it meets none."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(met(rule), F.lit(k)).otherwise(out)
    return out


def _count(text: Column, others: str) -> Column:
    """How many characters are left without the runs of others: fast where they are few."""
    return F.length(F.regexp_replace(text, others, ""))


def _share(n: Column, of: Column) -> Column:
    return F.when(of > 0, n.cast("double") / of).otherwise(F.lit(0.0))


def statistics(rows: DataFrame) -> DataFrame:
    """rows (any columns and text_) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the STATISTICS, without text_."""
    others = [c for c in rows.columns if c != "text_"]
    text = F.col("text_")
    d = rows.withColumn("w_", F.array_remove(F.split(text, SPACE, -1), ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(A_WORD))
    ended = F.filter("lines_", lambda x: F.rtrim(x).rlike(r"[.!?:;…。！？।؟][\"'”’»)\]]*$"))
    d = d.select(
        *others, "w_", lines.alias("lines_"),
        _count(text, NO_SYMBOL).alias("n_symbols"), _count(text, r"\P{Lu}+").alias("upper_"), _count(text, r"\P{P}+").alias("marks_"),
    )
    d = d.withColumn("ended_", F.size(ended))
    d = d.withColumn("word_chars", F.length(F.array_join("w_", ""))).withColumn("x_", F.transform("w_", lambda x: F.xxhash64(x))).drop("w_")
    window = F.transform("x_", lambda x, i: F.xxhash64(x, *[F.get("x_", i + k) for k in range(1, WINDOW)]))
    d = d.withColumn("h_", F.slice(window, 1, F.greatest(F.lit(0), F.size("x_") - (WINDOW - 1)))).withColumn("id_", F.sort_array("x_"))
    # only where hashes repeat: (hash, place) in order, the places of those with an equal neighbour, and what windows there cover
    ordered = F.sort_array(F.transform("h_", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    d = d.withColumn("o_", F.when(F.size(F.array_distinct("h_")) < F.size("h_"), ordered))
    at = F.expr("sort_array(transform(filter(o_, (e, k) -> e.x = get(o_, k - 1).x OR e.x = get(o_, k + 1).x), e -> e.i))")
    d = d.withColumn("at_", at)
    covered = F.expr(f"aggregate(transform(at_, (p, k) -> coalesce(least({WINDOW}, get(at_, k + 1) - p), {WINDOW})), 0, (a, x) -> a + x)")
    # the longest run of one hash among the sorted hashes of words: how often the commonest word stands
    starts_at = F.expr("filter(transform(id_, (x, k) -> CASE WHEN k = 0 OR x <> get(id_, k - 1) THEN k END), x -> x IS NOT NULL)")
    d = d.withColumn("runs_", starts_at)
    longest = F.expr("array_max(transform(runs_, (p, k) -> coalesce(get(runs_, k + 1), size(id_)) - p))")
    n, chars = F.size("id_"), F.col("word_chars")
    return d.select(
        *others, n.cast("long").alias("n_words"), chars.cast("long").alias("word_chars"), F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        "upper_", "marks_", "ended_", F.size("lines_").alias("n_lines_"), F.size("runs_").alias("distinct_"), F.coalesce(longest, F.lit(0)).alias("top_"),
    ).select(
        *others, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        _share(chars, F.col("n_words")).alias("mean_word"), _share(F.col("n_symbols"), chars).alias("symbol_share"), _share(F.col("upper_"), chars).alias("upper_share"), _share(F.col("marks_"), chars).alias("mark_share"),
        _share(F.col("n_dup_lines"), F.col("n_lines_")).alias("dup_line_share"), _share(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_share"),
        _share(F.col("distinct_"), F.col("n_words")).alias("distinct_share"), _share(F.col("n_words"), F.col("n_lines_")).alias("line_words"), _share(F.col("ended_"), F.col("n_lines_")).alias("ended_share"), _share(F.col("top_"), F.col("n_words")).alias("top_share"),
    )


def agreed(labels: DataFrame) -> DataFrame:
    """doc_id_, bad (whether the label is 0) of the ids with one label, 0 or 1."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").alias("doc_id_")).agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    return known.where("low = high").select("doc_id_", (F.col("low") == 0).alias("bad"))


def thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """The cuts of each statistic: quantiles among the rows of either label."""
    at = [k / QUANTILES for k in range(QUANTILES)]
    of = rows.groupBy("bad").agg(*[F.percentile_approx(F.col(s).cast("double"), at, 10_000).alias(s) for s in STATISTICS]).collect()  # two rows
    cuts = {s: sorted({x for r in of for x in r[s]}) for s in STATISTICS}
    return {s: sorted({*x, *((a + b) / 2 for a, b in zip(x, x[1:], strict=False))}) for s, x in cuts.items()}


def placed(rows: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """bad, back (kept from growing), places: for each statistic how many of its cuts are below the value."""
    place = lambda s: F.size(F.filter(F.array(*map(F.lit, cuts[s])), lambda c: c < F.col(s)))
    return rows.select("bad", (F.pmod(F.xxhash64("doc_id"), F.lit(KEPT_BACK)) == 0).alias("back"), F.array(*map(place, STATISTICS)).alias("places"))


@dataclass(frozen=True)
class Step:
    """A literal by places: places[at] > place, or places[at] <= place."""

    at: int
    above: bool
    place: int

    def column(self) -> Column:
        x = F.col("places")[self.at]
        return x > self.place if self.above else x <= self.place


def gain(p: int, n: int, p1: int, n1: int) -> float:
    """The information that a literal adds about the p1 bad of p1 + n1 rows that it leaves of p and n."""
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p / (p + n))) if p1 else 0.0


def best_step(counts: list, cuts: dict[str, list[float]], but: frozenset[int] = frozenset()) -> tuple[Step, int] | None:
    """The step of most gain by counts (at, place, bad, n), on any statistic but those, and how many good rows it leaves. None if no step gains."""
    table: dict[int, dict[int, list[int]]] = {}
    for r in counts:
        table.setdefault(r["at"], {}).setdefault(r["place"], [0, 0])[r["bad"]] += r["n"]
    best, gained = None, 1e-9
    for at, places in sorted(table.items()):
        n, p = (sum(x[k] for x in places.values()) for k in (0, 1))
        if not p:
            return None
        if at in but:
            continue
        n1 = p1 = 0
        by: dict[tuple, list[int]] = {}
        for place in range(len(cuts[STATISTICS[at]])):
            n1, p1 = n1 + places.get(place, [0, 0])[0], p1 + places.get(place, [0, 0])[1]
            by.setdefault((False, p1, n1), []).append(place)
            by.setdefault((True, p - p1, n - n1), []).append(place)
        for (above, p2, n2), equal in by.items():
            if (g := gain(p, n, p2, n2)) > gained + 1e-9:
                best, gained = (Step(at, above, equal[len(equal) // 2]), n2), g
    return best


def pruned(rule: list[Step], rows: DataFrame) -> tuple[int, int, int]:
    """How many literals to keep, and the bad and good rows kept from growing that the shorter rule covers."""
    cond, sums = F.lit(True), []
    for k, step in enumerate(rule, 1):
        cond = cond & step.column()
        sums += [F.count_if(cond & F.col("bad")).alias(f"p{k}"), F.count_if(cond & ~F.col("bad")).alias(f"n{k}")]
    c = rows.agg(*sums).first()
    worth = lambda k: ((c[f"p{k}"] - c[f"n{k}"]) / max(1, c[f"p{k}"] + c[f"n{k}"]), -k)
    k = max(range(1, len(rule) + 1), key=worth)
    return k, c[f"p{k}"], c[f"n{k}"]


def learned(rows: DataFrame) -> list[Rule]:
    """The decision list for the bad among rows (doc_id, bad, STATISTICS)."""
    if rows.select("bad").distinct().count() < 2:
        return []
    cuts = thresholds(rows)
    left = table = written(placed(rows, cuts), "quality-places")
    rules: list[list[Step]] = []
    failed: frozenset[int] = frozenset()
    while len(rules) < RULES:
        rule: list[Step] = []
        growing = left.where(~F.col("back"))
        while len(rule) < LITERALS:
            counts = growing.select(F.col("bad").cast("int").alias("bad"), F.posexplode("places").alias("at", "place")).groupBy("at", "place", "bad").agg(F.count("*").alias("n")).collect()
            found = best_step(counts, cuts, frozenset() if rule else failed)
            if not found:
                break
            rule.append(found[0])
            growing = growing.where(found[0].column())
            if not found[1]:
                break
        if not rule:
            break
        k, p, n = pruned(rule, left.where("back"))
        if p < PRECISION * (p + n) or not p:
            failed |= {rule[0].at}
            continue
        rules.append(rule[:k])
        failed = frozenset()
        cond = F.lit(True)
        for step in rule[:k]:
            cond = cond & step.column()
        left = left.where(~cond)
    forget(table)
    return [tuple(Literal(STATISTICS[s.at], s.above, cuts[STATISTICS[s.at]][s.place]) for s in rule) for rule in rules]


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule (0: none), reason."""
    stats = written(statistics(docs.select("doc_id", text_of().alias("text_"))), "quality-statistics")
    rules = learned(stats.join(agreed(labels), F.col("doc_id") == F.col("doc_id_")))
    rule = number(rules)
    reason = F.element_at(F.array(F.lit(""), *[F.lit(" AND ".join(map(str, r))) for r in rules]), rule + 1)
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & (rule == 0)).alias("kept"), rule.alias("rule"), reason.alias("reason"),
    )


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with their columns. Texts are read again rather than kept with their statistics."""
    rows = nested(docs, text_=text_of())
    stats = statistics(docs.select("doc_id", text_of().alias("text_")))
    rules = learned(stats.join(agreed(labels), F.col("doc_id") == F.col("doc_id_")))
    return statistics(rows).where(~base_failed() & (number(rules) == 0)).select("row.*")
