"""Scalar score functions as Spark columns: length models, score conversion, survival functions and saturating arithmetic."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = math.log(2.0)
#: Below this, 1 - exp(-x) is x in double precision's eyes.
SMALL = 5e-9
LONGEST = 100_000  # residues of the longest target that the engine takes


def null1_score(length: Column) -> Column:
    """Log-probability of a length under the null model, in nats: L ln p + ln(1 - p), p = L / (L + 1)."""
    p = length.cast("double") / (length + 1)
    return length * F.log(p) + F.log(1 - p)


def bias_length_terms(length: Column) -> tuple[Column, Column]:
    """L ln p and ln(1 - p) apart, as the composition filter adds them."""
    p = length.cast("double") / (length + 1)
    return length * F.log(p), F.log(1 - p)


def bit_score(numerator: Column, scale: Column, null1: Column) -> Column:
    """Bits of a scaled integer score."""
    return (numerator / scale - 3.0 - null1) / LN2


def length_cost_byte(length: Column, scale: Column) -> Column:
    """Cost of moving between segments of a target, in scaled byte units, at most 255."""
    return F.least(F.lit(255), (-F.round(scale * F.log(F.lit(3.0) / (length + 3)))).cast("int"))


def length_move_word(length: Column, scale: Column, loops: Column) -> Column:
    """Score of the length model's move in scaled 16-bit units. loops: expected number of further segments."""
    return clamp(F.round(scale * F.log((2.0 + loops) / (length + 2.0 + loops))), -32768, 32767).cast("int")


def length_move(length: Column, loops: Column) -> Column:
    """Probability of leaving the length model's loop; the loop itself has the rest."""
    return (2.0 + loops) / (length + 2.0 + loops)


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def add_u8(a: Column, b: Column) -> Column:
    return clamp(a + b, 0, 255)


def subtract_u8(a: Column, b: Column) -> Column:
    return clamp(a - b, 0, 255)


def subtract_i8(a: Column, b: Column) -> Column:
    return clamp(a - b, -128, 127)


def add_i16(a: Column, b: Column) -> Column:
    return clamp(a + b, -32768, 32767)


def gumbel_survival(x: Column, mu: Column, rate: Column) -> Column:
    """P(X > x) of a Gumbel distribution."""
    ey = F.exp(-rate * (x - mu))
    return F.when(ey < SMALL, ey).otherwise(1 - F.exp(-ey))


def exponential_survival(x: Column, tau: Column, rate: Column) -> Column:
    """P(X > x) of an exponential tail that starts at tau."""
    return F.when(x < tau, F.lit(1.0)).otherwise(F.exp(-rate * (x - tau)))


def ssv_status(gain: Column, tjb: Column, tbm: Column, tec: Column, base: Column, bias: Column) -> tuple[Column, Column]:
    """Status (OK, NO_RESULT where the multi-segment filter must decide, OVERFLOW) and numerator of a single-segment gain."""
    raw = 128 + F.least(gain, F.lit(127))
    adjusted = raw + base - tjb - tbm - 128
    best = adjusted - tec
    status = (
        F.when(tjb + tbm + tec + bias >= 127, "NO_RESULT")
        .when(raw >= 255 - bias, F.when(base - tjb - tbm < 128, "NO_RESULT").otherwise("OVERFLOW"))
        .when(adjusted >= 255 - bias, "OVERFLOW")
        .when(best > base, "NO_RESULT")
        .otherwise("OK")
    )
    return status, F.when(status == "OK", best - tjb - base)


def decision(p: Column, status: Column, threshold: float) -> Column:
    """Keep unless rejection is certain: NULL, NaN and any status but OK go on to the exact path."""
    certain = (status == "OK") & p.isNotNull() & ~F.isnan(p) & (p > threshold)
    return F.when(certain, "DEFINITE_REJECT").otherwise("KEEP")


def log_sum_with_zero(x: Column) -> Column:
    """ln(1 + e^x)."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def quantile_rank(q: float, n: Column) -> Column:
    """Zero-based nearest rank, halves to even."""
    return F.bround(F.lit(q) * (n - 1), 0).cast("long")


def quantile_name(q: float) -> str:
    return f"p{q * 100:g}"


def amdahl(fraction: Column, speedup: Column) -> Column:
    """Overall speed-up when a fraction of the time runs `speedup` times as fast."""
    return 1 / (1 - fraction + fraction / speedup)


def amdahl_ceiling(fraction: Column) -> Column:
    return F.when(fraction < 1, 1 / (1 - fraction)).otherwise(F.lit(float("inf")))


def exceeds_ratio(value: Column, reference: Column, numerator: int, denominator: int) -> Column:
    """value / reference > numerator / denominator, in whole numbers."""
    return value * denominator > reference * numerator


def ordered_key(x: float) -> int:
    """A whole number that orders binary32 values as they are ordered."""
    (bits,) = struct.unpack("<I", struct.pack("<f", x))
    return bits ^ 0xFFFFFFFF if bits >> 31 else bits | 0x80000000


def from_ordered_key(key: int) -> float:
    bits = key & 0x7FFFFFFF if key >> 31 else key ^ 0xFFFFFFFF
    return struct.unpack("<f", struct.pack("<I", bits))[0]


def compiled_cutoff(survival, threshold: float) -> tuple[str, float]:
    """The smallest binary32 score whose survival is at most the threshold, found by bisection over ordered keys.

    Returns (ALWAYS_PASS | ALWAYS_REJECT | SCORE, score). A filter on P-values becomes one comparison of scores.
    """
    low, high = ordered_key(-3.4028234663852886e38), ordered_key(3.4028234663852886e38)
    passes = lambda k: not survival(from_ordered_key(k)) > threshold  # noqa: E731  NaN passes
    if passes(low):
        return "ALWAYS_PASS", from_ordered_key(low)
    if not passes(high):
        return "ALWAYS_REJECT", from_ordered_key(high)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if passes(middle) else (middle, high)
    if passes(low) or not passes(high):
        raise ValueError("the decision is not monotone in the score")
    return "SCORE", from_ordered_key(high)


def gumbel(x: float, mu: float, rate: float) -> float:
    """gumbel_survival for one number."""
    y = rate * (x - mu)
    if y < -700:
        return 1.0
    ey = math.exp(-y)
    return ey if ey < SMALL else -math.expm1(-ey)


def exponential(x: float, tau: float, rate: float) -> float:
    return 1.0 if x < tau else math.exp(-rate * (x - tau))
