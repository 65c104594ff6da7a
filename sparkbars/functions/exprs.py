"""Column helpers shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ieee_div(a, b) -> Column:
    """a / b with IEEE results for a zero divisor (±inf, NaN), null-propagating.

    Spark in ANSI mode raises on x/0; the specified semantics give inf/NaN.
    """
    a, b = col(a).cast("double"), col(b).cast("double")
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(b != 0, a / F.when(b != 0, b))
        .when(F.isnan(a), F.lit(NAN))
        .when(a > 0, F.lit(INF))
        .when(a < 0, F.lit(-INF))
        .otherwise(F.lit(NAN))
    )


def nan_to_zero(c) -> Column:
    """NaN -> 0, null and ±inf kept (fill_nan semantics)."""
    c = col(c)
    return F.when(F.isnan(c), F.lit(0.0)).otherwise(c)


def finite_or_zero(c) -> Column:
    """NaN, ±inf and null -> 0 (nan_to_num semantics for model inputs)."""
    c = col(c).cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(INF)), F.lit(0.0)).otherwise(c)


def no_nan(c) -> Column:
    """NaN -> null, for outputs compared by value."""
    c = col(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def roll(w: Window, k: int) -> Window:
    """Frame of the last k rows ending at the current one."""
    return w.rowsBetween(-(k - 1), 0)


def full_roll(agg, x, w: Window, k: int) -> Column:
    """Rolling aggregate over k rows, null unless all k values are present.

    This is the min_periods = window size rule: a null inside the frame, or
    a frame shorter than k (series start), gives null.
    """
    frame = roll(w, k)
    return F.when(F.count(col(x)).over(frame) == k, agg(col(x)).over(frame))


def pct_change(x, w: Window, k: int = 1) -> Column:
    prev = F.lag(col(x), k).over(w)
    return ieee_div(col(x) - prev, prev)


def clip_lower0(c) -> Column:
    """max(c, 0) keeping null (and NaN) as they are."""
    c = col(c)
    return F.when(c.isNull(), F.lit(None).cast("double")).when(c < 0, F.lit(0.0)).otherwise(c)


def two_pi() -> Column:
    return F.lit(2 * math.pi)


def rnd(c, d: int = 6) -> Column:
    """Round a double half up to d places for value comparison; NaN becomes null.

    Written as floor(x * 10^d + 0.5) / 10^d, plain IEEE arithmetic that any
    engine evaluates bit-identically (decimal-based rounding differs at
    exact half steps).
    """
    x = no_nan(col(c).cast("double"))
    s = F.lit(float(10 ** d))
    return F.when(F.abs(x) * s < F.lit(9e15), F.floor(x * s + F.lit(0.5)) / s).otherwise(x)
