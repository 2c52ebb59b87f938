"""Number rules: missing is NULL alone, rounding is half away from zero on the exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import col

_SPLIT = 134217729.0  # 2**27 + 1


def number(c: Column) -> Column:
    """As a double; what isn't a finite number is NULL."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def half_up(x: Column | str, digits: int) -> Column:
    """x rounded half away from zero. The error of the scaled product is found exactly (Dekker's two-product), so that only true ties count as ties.

    A name is used in place, inside generated code; another expression is bound to a lambda's variable, as it would else be written out twenty times."""
    if isinstance(x, str):
        return _half_up(col(x), digits)
    return F.get(F.transform(F.array(x), lambda v: _half_up(v, digits)), 0)


def _half_up(x: Column, digits: int) -> Column:
    scale = float(10**digits)
    b_high = scale * _SPLIT - (scale * _SPLIT - scale)
    b_low = scale - b_high
    a = F.abs(x)
    p = a * scale
    a_high = a * _SPLIT - (a * _SPLIT - a)
    a_low = a - a_high
    error = ((a_high * b_high - p) + a_high * b_low + a_low * b_high) + a_low * b_low
    k = F.floor(p).cast("double")
    up = ((p - k) > 0.5) | (((p - k) == 0.5) & (error >= 0))
    rounded = F.when(x < 0, -1.0).otherwise(1.0) * (k + F.when(up, 1.0).otherwise(0.0)) / scale + F.lit(0.0)
    return F.when(a >= 4503599627370496.0 / scale, x).otherwise(rounded)


def half_up_sql(x: str, digits: int) -> str:
    """The same rule as DuckDB SQL, for a column or short expression."""
    scale = float(10**digits)
    b_high = scale * _SPLIT - (scale * _SPLIT - scale)
    b_low = scale - b_high
    a = f"abs({x})"
    s, c = f"{scale!r}::DOUBLE", f"{_SPLIT!r}::DOUBLE"
    p = f"({a} * {s})"
    ah = f"({a} * {c} - ({a} * {c} - {a}))"
    al = f"({a} - {ah})"
    error = f"((({ah} * {b_high!r}::DOUBLE - {p}) + {ah} * {b_low!r}::DOUBLE + {al} * {b_high!r}::DOUBLE) + {al} * {b_low!r}::DOUBLE)"
    up = f"CASE WHEN {p} - floor({p}) > 0.5 OR ({p} - floor({p}) = 0.5 AND {error} >= 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    return f"(CASE WHEN {x} < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * (floor({p}) + {up}) / {s} + 0.0::DOUBLE)"


def floor_round(x: Column, digits: int) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits: ties go up, also below zero."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale
