"""Scalar column expressions; all built-in functions, so all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitledger.constants import QUARTER_CUTS

# The code points of Unicode property White_Space. Spark's
# one-argument trim only strips the plain space.
WHITE_SPACE_POINTS = (
    *range(0x09, 0x0E),
    0x20,
    0x85,
    0xA0,
    0x1680,
    *range(0x2000, 0x200B),
    0x2028,
    0x2029,
    0x202F,
    0x205F,
    0x3000,
)
WHITE_SPACE = "".join(map(chr, WHITE_SPACE_POINTS))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c: Column | str) -> Column:
    """Strip any white space, not just blanks, from both ends."""
    return F.trim(_col(c), F.lit(WHITE_SPACE))


def squeeze_once(c: Column | str) -> Column:
    """Replace each pair of blanks by one, in one pass: three blanks leave two."""
    return F.replace(_col(c), F.lit("  "), F.lit(" "))


def first_word(c: Column | str) -> Column:
    """Text before the first blank; the whole text if there is none."""
    return F.substring_index(_col(c), " ", 1)


def base_id(c: Column | str) -> Column:
    """Identifier without its version suffix: the text before the first dot."""
    return F.substring_index(_col(c), ".", 1)


def money_sum(c: Column | str) -> Column:
    """Sum of amounts to a millionth, the same in whatever order they are added.

    Every amount is rounded to millionths, halves up, and these are added as whole
    numbers. NULL if there is no amount.
    """
    millionths = F.round(_col(c) * F.lit(1e6)).cast("bigint")
    return F.sum(millionths).cast("double") / F.lit(1e6)


def cents(c: Column | str) -> Column:
    """An amount rounded to cents, halves up: `round(c, 2)`, but fast where no half is near.

    Spark rounds doubles by way of their decimal text. Where an amount is clearly
    nearer to one cent than to the next, that many cents through 100 are the same double;
    the rest, and amounts too large to tell, go the slow way.
    """
    amount = _col(c)
    hundredfold = amount * F.lit(100.0)
    whole = F.floor(hundredfold + F.lit(0.5))
    clear = (F.abs(amount) < F.lit(1e9)) & (F.abs(hundredfold - whole) < F.lit(0.4999))
    return F.when(clear, whole / F.lit(100.0)).otherwise(F.round(amount, 2))


def normal_name(c: Column | str) -> Column:
    """Trimmed lower-case form, for joining names typed by hand."""
    return F.lower(trim_ws(c))


def quarter_hours(time_in: Column | str, time_out: Column | str) -> Column:
    """Hours between two timestamps, minutes rounded to quarter hours.

    Seconds are cut off. Spans over a day count all their hours, negative spans
    keep their sign on the whole hours, and a missing time gives NULL.
    """
    span = _col(time_out) - _col(time_in)
    hours = F.extract(F.lit("DAY"), span) * 24 + F.extract(F.lit("HOUR"), span)
    minutes = F.extract(F.lit("MINUTE"), span)
    credit = F.lit(1.0)
    for bound, value in reversed(QUARTER_CUTS):
        credit = F.when(minutes <= bound, value).otherwise(credit)
    return hours.cast("double") + credit


def half_even(c: Column | str) -> Column:
    """Whole number, halves to the even neighbour, never a negative zero."""
    return F.rint(_col(c)) + F.lit(0.0)
