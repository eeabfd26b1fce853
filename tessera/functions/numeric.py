"""Integer arithmetic of predicates, and the size formula of adaptive partitions.

Integer arithmetic wraps around 64 bits, in ANSI mode too. In a predicate it is
true where the result is not 0, which with a literal can be told without computing
it. Division truncates; division by 0 gives 0.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_MIN = -(2**63)

#: Rows a key from which a range counts as dense, and up to which as sparse (fixed values).
DENSE, SPARSE = 8.0, 1.0


def _wrap(n: int) -> int:
    return (n + 2**63) % 2**64 - 2**63


def plus_is_true(col: Column, n: int) -> Column:
    return col != F.lit(_wrap(-n)).cast("long")


def minus_is_true(col: Column, n: int) -> Column:
    return col != F.lit(n).cast("long")


def times_is_true(col: Column, n: int) -> Column:
    """The product is 0 exactly if the factors' trailing zero bits add up to 64."""
    if n == 0:
        return F.lit(False)
    zeros = (n & -n).bit_length() - 1
    if zeros == 0:
        return col != 0
    return col.bitwiseAND(F.lit((1 << (64 - zeros)) - 1).cast("long")) != 0


def over_is_true(col: Column, n: int) -> Column:
    """col / n is not 0."""
    if n == 0:
        return F.lit(False)
    if n == _MIN:
        return col == F.lit(_MIN).cast("long")
    m = abs(n)
    return (col >= m) | (col <= -m)


def under_is_true(n: int, col: Column) -> Column:
    """n / col is not 0: the divisor is not 0 and not larger than n."""
    if n == 0:
        return F.lit(False)
    if n == _MIN:
        return col != 0
    m = abs(n)
    return (col != 0) & (col <= m) & (col >= -m)


def _flipped(x: Column) -> Column:
    """x moved by 2^63 towards 0: its sign bit turned."""
    return x.bitwiseXOR(F.lit(_MIN))


def wrapping_sum(a: Column, b: Column) -> Column:
    """a + b of BIGINTs. Where that overflows both have one sign, and moving both changes the sum by 2^64."""
    return F.coalesce(F.try_add(a, b), F.try_add(_flipped(a), _flipped(b)))


def wrapping_difference(a: Column, b: Column) -> Column:
    """a - b of BIGINTs. Where that overflows their signs differ, and moving both changes the difference by 2^64."""
    return F.coalesce(F.try_subtract(a, b), F.try_subtract(_flipped(a), _flipped(b)))


def wrapping_product(a: Column, b: Column) -> Column:
    """a * b of BIGINTs; an overflow is computed in decimals, whose 38 digits hold any product."""
    whole = F.lit(Decimal(2**64))
    rest = F.pmod(a.cast("decimal(19,0)") * b.cast("decimal(19,0)"), whole)
    return F.coalesce(F.try_multiply(a, b), F.when(rest >= F.lit(Decimal(2**63)), rest - whole).otherwise(rest).cast("long"))


def quotient(a: Column, b: Column) -> Column:
    """Truncating division; 0 if the divisor is 0. The one quotient that overflows wraps."""
    safe = F.when((b != 0) & (b != -1), b).otherwise(F.lit(1).cast("long"))
    return F.when(b == -1, wrapping_difference(F.lit(0).cast("long"), a)).when(b != 0, F.call_function("div", a, safe)).when(b == 0, F.lit(0).cast("long"))


def float_quotient(a: Column, b: Column) -> Column:
    """a / b of DOUBLEs as IEEE has it: infinite, or NaN for 0 / 0, if the divisor is 0."""
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(math.nan)).otherwise(F.signum(a) * F.lit(math.inf))
    return F.when(b != 0, F.try_divide(a, b)).when(b == 0, by_zero)


def adaptive_size(base: Column, rows: Column, keys: Column, smallest: int, largest: int) -> Column:
    """Keys for a partition: few where rows are dense, many where sparse, in proportion between."""
    ratio = rows / F.when(keys == 0, F.lit(1)).otherwise(keys)
    between = F.round(F.lit(float(smallest)) + (F.lit(DENSE) - ratio) / F.lit(DENSE - SPARSE) * F.lit(float(largest - smallest)))
    size = F.when(ratio >= DENSE, F.lit(smallest)).when(ratio <= SPARSE, F.lit(largest)).otherwise(between.cast("long"))
    return F.when(keys == 0, base).otherwise(F.least(F.greatest(size, F.lit(smallest)), F.lit(largest))).cast("long")
