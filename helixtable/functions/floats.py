"""Exact doubles as columns: their hexadecimal text and back, neighbours, and intervals that certainly hold a rounded P-value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_EXPONENT, FRACTION = -1022, 52


def _power(e: Column) -> Column:
    """2^e, exact wherever it is a double."""
    return F.pow(F.lit(2.0), e.cast("double"))


def exponent(x: Column) -> Column:
    """The exponent e of a finite number that is not 0: 2^e <= |x| < 2^(e + 1), and -1022 for subnormal ones."""
    a = F.abs(x)
    e = F.greatest(F.lit(LEAST_EXPONENT), F.least(F.lit(1023), F.floor(F.log2(a)).cast("int")))  # off by one at most
    return F.when(e >= 1023, F.when(a < _power(e), e - 1).otherwise(e)).when(a >= _power(e + 1), e + 1).when((a < _power(e)) & (e > LEAST_EXPONENT), e - 1).otherwise(e)


def _scaled(x: Column, e: Column) -> Column:
    """x 2^e without an overflow on the way: in two steps that are each exact."""
    half = F.floor(e / 2)
    return x * _power(half) * _power(e - half)


def hex_text(x: Column) -> Column:
    """A double as C prints it with %a: sign, 0x1. or 0x0. (subnormal), fraction without trailing zeros, binary exponent; nan, inf and -inf."""
    e = exponent(x)
    whole = _scaled(F.abs(x), F.lit(FRACTION) - e).cast("long")  # 53 bits at most
    one = F.shiftright(whole, FRACTION)
    fraction = F.lower(F.lpad(F.hex(whole.bitwiseAND(F.lit((1 << FRACTION) - 1))), 13, "0"))
    digits = F.regexp_replace(fraction, "0+$", "")
    sign = F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise("")
    finite = F.concat(sign, F.lit("0x"), one.cast("string"), F.when(digits != "", F.concat(F.lit("."), digits)).otherwise(""), F.lit("p"), F.when(e >= 0, "+").otherwise(""), e.cast("string"))
    inf = float("inf")
    return F.when(x.isNull(), F.lit(None).cast("string")).when(F.isnan(x), "nan").when(x == inf, "inf").when(x == -inf, "-inf").when(x == 0, F.concat(sign, F.lit("0x0p+0"))).otherwise(finite)


def from_hex_text(text: Column) -> Column:
    """The double that hex_text wrote; NULL for other texts."""
    part = lambda k: F.regexp_extract(text, r"^(-?)0x([01])(?:\.([0-9a-f]{1,13}))?p([+-]\d+)$", k)
    whole = F.conv(F.concat(part(2), F.rpad(part(3), 13, "0")), 16, 10).cast("long").cast("double")
    value = _scaled(whole, F.nullif(part(4), F.lit("")).cast("int") - FRACTION)
    signed = F.when(part(1) == "-", -value).otherwise(value)
    known = F.when(text == "nan", F.lit(float("nan"))).when(text == "inf", F.lit(float("inf"))).when(text == "-inf", F.lit(float("-inf")))
    return F.when(text.isin("nan", "inf", "-inf"), known).when(part(4) != "", signed)


def next_above(x: Column) -> Column:
    """The smallest double above a finite one; infinity, NaN and NULL stay, and from -infinity it is the least finite one."""
    e, tiny, inf = exponent(x), F.lit(5e-324), float("inf")
    step = _power(e - FRACTION)
    # towards zero from a power of two the step is half as large
    down = F.when((F.abs(x) == _power(e)) & (e > LEAST_EXPONENT), step / 2).otherwise(step)
    return F.when(x.isNull() | F.isnan(x) | (x == inf), x).when(x == -inf, F.lit(-1.7976931348623157e308)).when(x == 0, tiny).when(x > 0, x + step).otherwise(x + down)


def next_below(x: Column) -> Column:
    return -next_above(-x)


def widened(p: Column, units: int) -> tuple[Column, Column]:
    """Ends of an interval around a probability that holds every value within `units` doubles of it, within 0 and 1. Above the next
    power of two doubles lie twice as far apart, so the upper end is that much further away."""
    unit = F.when(p > 0, _power(exponent(p) - FRACTION)).otherwise(F.lit(5e-324))
    return F.greatest(F.lit(0.0), p - units * unit), F.least(F.lit(1.0), p + 2 * units * unit)
