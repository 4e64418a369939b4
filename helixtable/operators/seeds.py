"""Certified seeds: words of which every pair that reaches a cutoff must hold one, an index of them, and what it leaves.

A local segment of a pair is a run of one diagonal. Take one of the largest gain that starts as late as it can: each of
its proper prefixes is above zero, so it starts with a residue of positive gain, a hit. If the gain must be at least G
and no residue gains more than g, there are ceil(G / g) hits or more. So its first `hits` hits (that many or fewer)
form a core: residues at certain offsets, with anything between them. `cores` enumerates the cores of a profile by
branch and bound: a branch ends where the prefix cannot be above zero even if each residue between two hits is the
best of those that are none, or where prefix and suffix maxima together stay below the gain that `hits` hits stand for.
A branching of over LIMIT steps, or a core that spans over SPAN places, is no certificate: that profile stays open, and
its pairs go the way without seeds. So do pairs whose cutoff stands for fewer than the least of HITS hits, and targets
that hold other symbols than the 20 canonical ones, of which alone cores are made.

Targets are scanned once for the offsets that occur; a bitmap of BITS bits, whatever the number of profiles, drops what
no core has; the rest meets the index in a join. What is left of it are diagonals, not pairs, and only those are scored:
a pair that reaches its cutoff has its best diagonal among them, and any other pair stays below it either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixtable.functions import scores as S
from helixtable.functions.alphabet import CANONICAL, SYMBOLS, digits

HITS, LIMIT, SPAN, BITS = (3, 4, 5), 200_000, 60, 1 << 26
END = 31  # the code between two targets: no core has it
#: Odd factors of the two places of a core in the bitmap.
KEY_1, KEY_2, OFFSETS_1, OFFSETS_2, PRIME = 40503, 69061, 7919, 104729, 1_000_003


def required_gain(length: Column, tbm: Column, tec: Column, base: Column, bias: Column, scale: float, cutoff_bits: float) -> Column:
    """The smallest gain that the first filter may not reject: by its score, or because its status is no certain one.
    A whole unit below the rounded cutoff, so that rounding never rejects. 0: no gain is rejected."""
    tjb, null1 = S.length_cost_byte(length, F.lit(scale)), S.null1_score(length)
    by_score = F.ceil(F.lit(scale) * (F.lit(max(-1e6, min(1e6, cutoff_bits)) * S.LN2 + 3.0) + null1)) - 1 + 2 * tjb + tbm + tec
    by_status = F.least(tjb + tbm + tec + 1, F.lit(127) - bias, F.lit(255) - bias - base + tjb + tbm)
    return F.when(tjb + tbm + tec + bias >= 127, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(by_score, by_status))).cast("int")


def level(gain: Column, most: Column) -> Column:
    """The hits that a gain stands for, where no residue gains more than `most`; the largest of HITS at most."""
    return F.least(F.lit(HITS[-1]), F.ceil(gain / most)).cast("int")


def cores(gains: np.ndarray, hits: int, limit: int = LIMIT) -> list[tuple[int, int, int]] | None:
    """(first position, offsets as bits, key) of the cores of a profile (positions x symbols); None if there are too many."""
    m, gains = len(gains), gains[:, :CANONICAL]
    most, need = int(gains.max()), (hits - 1) * int(gains.max()) + 1
    if most <= 0:
        return []
    suffix = [0] * (m + 1)
    for j in range(m - 1, -1, -1):
        suffix[j] = max(0, int(gains[j].max()) + suffix[j + 1])
    up = [[(int(s), int(g[s])) for s in np.flatnonzero(g > 0)] for g in gains]
    between = [int(g[g <= 0].max()) if (g <= 0).any() else None for g in gains]
    out, steps = [], 0
    stack = [(j, j, 0, 0, 0, 0) for j in range(m)]  # first, position, prefix, hits so far, offsets, key
    while stack:
        first, j, prefix, n, offsets, key = stack.pop()
        steps += 1
        if steps > limit or j - first > SPAN:
            return None
        for symbol, gain in up[j]:
            p, o, k = prefix + gain, offsets | 1 << (j - first), key | symbol << 5 * n
            if p + suffix[j + 1] < need:
                continue
            if n + 1 == hits:
                out.append((first, o, k))
            elif j + 1 < m:
                stack.append((first, j + 1, p, n + 1, o, k))
        if n and j + 1 < m and between[j] is not None and prefix + between[j] > 0 and prefix + between[j] + suffix[j + 1] >= need:
            stack.append((first, j + 1, prefix + between[j], n, offsets, key))
    return out


def compiled(profiles: DataFrame, gains_of) -> DataFrame:
    """profile_ordinal, hits, first, offsets, key: the cores of each profile; a row without offsets says that a profile is open there."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for ordinal, consensus in zip(f["profile_ordinal"], f["consensus"], strict=True):
                for hits in HITS:
                    found = cores(gains_of(consensus), hits)
                    rows = [(None, None, None)] if found is None else found
                    d = pd.DataFrame(rows, columns=["first", "offsets", "key"], dtype=object)
                    yield d.assign(profile_ordinal=ordinal, hits=hits)[["profile_ordinal", "hits", "first", "offsets", "key"]]

    dealt = profiles.select("profile_ordinal", "consensus").repartition(max(8, profiles.sparkSession.sparkContext.defaultParallelism), "profile_ordinal")
    return dealt.mapInPandas(run, "profile_ordinal int, hits int, first int, offsets long, key long")


def places(key: Column, offsets: Column) -> tuple[Column, Column]:
    """The two places of a core in the bitmap."""
    at = offsets % PRIME
    return (key * KEY_1 + at * OFFSETS_1).bitwiseAND(F.lit(BITS - 1)), F.shiftright(key * KEY_2 + at * OFFSETS_2, 9).bitwiseAND(F.lit(BITS - 1))


def bitmap(index: DataFrame) -> np.ndarray:
    """BITS bits as bytes: those of the cores' places are set. Spark builds it in pieces of 4 KB, of which there are BITS / 32768 at most."""
    x = index.select("key", "offsets").distinct().select(F.explode(F.array(*places(F.col("key"), F.col("offsets")))).alias("x")).select((F.col("x") + 1).alias("x"))
    parts = x.groupBy(F.bitmap_bucket_number("x").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for r in parts.toLocalIterator():
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _found(codes: np.ndarray, offsets: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where residues at these offsets may be a core, and their keys."""
    at = [k for k in range(SPAN + 1) if offsets >> k & 1]
    n = len(codes) - at[-1]
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = codes[:n].copy()
    for k, o in enumerate(at[1:], 1):
        key |= codes[o : o + n] << 5 * k
    spots = np.arange(n)
    rest = offsets % PRIME
    for place in (lambda k: k * KEY_1 + rest * OFFSETS_1, lambda k: k * KEY_2 + rest * OFFSETS_2 >> 9):  # as `places` has them
        x = place(key) & (BITS - 1)
        on = np.flatnonzero(bits[x >> 3] >> (x & 7).astype(np.uint8) & 1)
        spots, key = spots[on], key[on]
    return spots, key


def scanned(targets: DataFrame, offsets: dict[int, list[int]], bits: np.ndarray) -> DataFrame:
    """seq_ordinal, length, hits, offsets, key, place of what may be cores. targets: seq_ordinal, length, residues, and low and high,
    the levels that a target's pairs may have. offsets: those that the index has, by level."""
    held = targets.sparkSession.sparkContext.broadcast((offsets, bits))  # BITS / 8 bytes

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_hits, own_bits = held.value
        for whole in frames:
            for start in range(0, len(whole), 256):
                f = whole.iloc[start : start + 256]
                for hits, patterns in by_hits.items():
                    part = f[(f["low"] <= hits) & (f["high"] >= hits)]
                    if not len(part):
                        continue
                    codes = [np.append(digits(r), END) for r in part["residues"]]
                    sizes = np.array([len(c) for c in codes])
                    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                    flat = np.concatenate(codes).astype(np.int64)
                    for o in patterns:
                        spots, key = _found(flat, o, own_bits)
                        if len(spots):
                            at = np.searchsorted(starts, spots, side="right") - 1
                            inside = spots + o.bit_length() < starts[at] + sizes[at]  # not into the next target
                            spots, key, at = spots[inside], key[inside], at[inside]
                            yield pd.DataFrame({"seq_ordinal": part["seq_ordinal"].to_numpy()[at], "length": sizes[at] - 1, "hits": hits, "offsets": o, "key": key, "place": spots - starts[at]})

    columns = targets.select("seq_ordinal", "residues", "low", "high")
    return columns.mapInPandas(run, "seq_ordinal long, length int, hits int, offsets long, key long, place int")


def diagonals(found: DataFrame, index: DataFrame, constants: DataFrame, wanted: Column) -> DataFrame:
    """profile_ordinal, seq_ordinal, diagonal (place in the target less position in the model) that share a core of the pair's own level."""
    met = found.join(index, ["offsets", "key", "hits"]).join(constants, "profile_ordinal").where(F.col("hits") == wanted)
    return met.select("profile_ordinal", "seq_ordinal", (F.col("place") - F.col("first")).alias("diagonal")).distinct()


def diagonal_gains(at: DataFrame, targets: DataFrame, profiles: DataFrame, gain: np.ndarray) -> DataFrame:
    """profile_ordinal, seq_ordinal, length, gain: the best segment of the given diagonals. gain: symbols of the model x symbols of the target.

    A diagonal takes only its own stretch of either sequence along, cut out where the join meets it.
    """
    d = at.join(targets.select("seq_ordinal", "length", "residues"), "seq_ordinal").join(profiles.select("profile_ordinal", "consensus"), "profile_ordinal")
    here, own = F.greatest(F.lit(0), F.col("diagonal")), F.greatest(F.lit(0), -F.col("diagonal"))
    n = F.least(F.col("length") - here, F.length("consensus") - own)
    d = d.select("profile_ordinal", "seq_ordinal", "length", F.substring("residues", here + 1, n).alias("there"), F.substring("consensus", own + 1, n).alias("model"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            sizes = f["model"].str.len().to_numpy() + 1
            ends = np.cumsum(sizes)
            one, two = (digits("X".join(f[c]) + "X") for c in ("model", "there"))
            x = gain[one, two].astype(np.int64)
            x[ends - 1] = -(1 << 32)  # falls below all before it, so no segment crosses from one diagonal to the next
            total = np.concatenate([[0], np.cumsum(x)])
            best = np.maximum.reduceat(total[1:] - np.minimum.accumulate(total)[:-1], ends - sizes)
            yield f[["profile_ordinal", "seq_ordinal", "length"]].assign(gain=np.maximum(best, 0).astype(np.int32))

    scored = d.mapInPandas(run, "profile_ordinal int, seq_ordinal long, length int, gain int")
    return scored.groupBy("profile_ordinal", "seq_ordinal", "length").agg(F.max("gain").alias("gain"))


def symbol_gains(gains_of) -> np.ndarray:
    """Gains of the symbols of a target against each symbol of a model."""
    return gains_of("".join(SYMBOLS))
