"""Doubles as integers of the same order, and back, in generated code.

A positive double becomes its exponent and mantissa side by side, as in its own
64 bits; a negative one the opposite number. All steps are exact: powers of two
are, and so are products with them while the result is a normal number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import col

_MANTISSA = 52
_BIAS = 1023
_ONE = 1 << _MANTISSA
INFINITE = (_BIAS + 1 + _BIAS) << _MANTISSA
NAN = INFINITE + 1  # sorts above everything, as Spark orders it
_HALF_LEAST = 2.0 ** -537  # its square is the smallest subnormal


def _power(e: Column) -> Column:
    return F.pow(F.lit(2.0), e)


def order_key(value: Column | str) -> Column:
    """A long that orders as the double does; both zeros give 0."""
    v = col(value).cast("double")
    m = F.abs(v)
    guess = F.greatest(F.least(F.floor(F.log2(m)), F.lit(_BIAS)), F.lit(1 - _BIAS)).cast("double")
    # The rounded logarithm may miss by one next to a power of two.
    e = guess - F.when(_power(guess) > m, 1.0).otherwise(0.0) + F.when(_power(guess + 1) <= m, 1.0).otherwise(0.0)
    normal = (e + _BIAS).cast("long") * _ONE + ((m / _power(e) - 1) * _ONE).cast("long")
    size = (F.when(m == float("inf"), F.lit(INFINITE)).when(m < 2.0 ** (1 - _BIAS), (m / _HALF_LEAST / _HALF_LEAST).cast("long"))
            .otherwise(normal))
    return F.when(F.isnan(v), F.lit(NAN)).when(v < 0, -size).when(v >= 0, size)


def from_order_key(key: Column | str) -> Column:
    """The double that `order_key` turned into this long."""
    k = col(key)
    m = F.abs(k)
    e, rest = F.shiftright(m, _MANTISSA), m.bitwiseAND(_ONE - 1).cast("double")
    size = (F.when(m == INFINITE, F.lit(float("inf"))).when(e == 0, rest * _HALF_LEAST * _HALF_LEAST)
            .otherwise((1 + rest / _ONE) * _power((e - _BIAS).cast("double"))))
    return F.when(k == NAN, F.lit(float("nan"))).when(k < 0, -size).otherwise(size)
