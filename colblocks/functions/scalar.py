"""Scalar functions as Column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ten to the power of -e as the nearest double, e = 0 to 22.
FRACTIONS = [1.0, 0.1, 0.01, 0.001, 0.0001, 1e-05, 1e-06, 1e-07, 1e-08, 1e-09, 1e-10, 1e-11, 1e-12, 1e-13, 1e-14, 1e-15, 1e-16, 1e-17, 1e-18, 1e-19, 1e-20, 1e-21, 1e-22]
NO_EXPONENT = 23


def bits_needed(c: Column, width: int = 32) -> Column:
    """Bits of a value seen as unsigned; a negative one needs them all, zero needs one."""
    return F.when(c < 0, width).when(c == 0, 1).otherwise(F.length(F.bin(c.cast("long")))).cast("long")


def align_up(c: Column, to: int = 16) -> Column:
    return F.floor((c + (to - 1)) / to).cast("long") * to


@F.pandas_udf(T.LongType())
def _raw_bits(v: pd.Series) -> pd.Series:
    return pd.Series(v.to_numpy(np.float64).view(np.int64))


def double_bits(c: Column) -> Column:
    return F.when(c.isNotNull(), _raw_bits(F.coalesce(c, F.lit(0.0))))


def ieee_exponent(bits: Column) -> Column:
    """Unbiased exponent of the raw bits of a double."""
    return F.shiftright(bits, 52).bitwiseAND(F.lit(2047)) - 1023


def ieee_mantissa(bits: Column) -> Column:
    return bits.bitwiseAND(F.lit((1 << 52) - 1))


def ieee_sign(bits: Column) -> Column:
    return F.shiftrightunsigned(bits, 63)


def negative_zero(c: Column) -> Column:
    return (c == 0) & c.cast("string").startswith("-")


def float_exact(c: Column) -> Column:
    return c.cast("float").cast("double") == c


def trim_space(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def sanitise(c: Column, length: int = 100) -> Column:
    return F.regexp_replace(F.substring(c, 1, length), r"[\t\n]", " ")


def fixed6(c: Column) -> Column:
    return F.format_string("%.6f", c)


def percent(part: Column, whole: Column) -> Column:
    return F.round(100.0 * part.cast("double") / whole.cast("double"), 6)


def decimal_exponent(c: Column, max_bits: int = 31, largest: int = 22) -> Column:
    """The least e for which n = round(v / 10^-e) fits ``max_bits`` bits and n * 10^-e is v again; null if there is none.

    A chain of branches, so a value stops at its exponent. How halves are rounded makes no difference: n and n + 1/2 times
    a fraction are never the same value.
    """
    limit, out = float((1 << max_bits) - 1), None
    for e, f in enumerate(FRACTIONS[: largest + 1]):
        n = F.rint(c / F.lit(f))
        fits = (n * F.lit(f) == c) & (n >= 0) & (n <= limit)
        out = F.when(fits, e) if out is None else out.when(fits, e)
    return out


def _fraction(exponent: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, FRACTIONS)), (exponent + 1).cast("int"))


def decimal_number(c: Column, exponent: Column) -> Column:
    return F.rint(c / _fraction(exponent)).cast("long")


def decimal_value(n: Column, exponent: Column) -> Column:
    return n.cast("double") * _fraction(exponent)
