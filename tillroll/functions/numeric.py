"""Exact numeric helpers.

The reported figures are rounded the way an exact NUMERIC engine rounds:
half away from zero on the decimal value.  Rounding a double directly is not
portable (4.225 is stored as 4.22499999... and rounds down in some engines),
so every figure is first brought to ``decimal(28,8)`` and rounded there; the
published column is then a ``double``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUND_TYPE = "decimal(28,8)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def exact_round(x, n: int = 2, as_type: str = "double") -> Column:
    """Half-away-from-zero rounding on the decimal value, published as ``as_type``."""
    return F.round(_c(x).cast(ROUND_TYPE), n).cast(as_type)


def exact_sum(df: DataFrame, name: str) -> Column:
    """``SUM`` of the exact numeric column ``name`` of ``df``, at the column's own scale.

    Spark keeps sum buffers of decimals wider than 18 digits (``decimal(12,2)``
    sums to ``decimal(22,2)``) as arbitrary-precision objects; decimals of up to
    18 digits are therefore summed as 64-bit unscaled values, the primitive fast
    path (with ANSI mode an overflow raises).  Wider decimals and integers use the
    plain sum.  Floats are refused: their sum depends on the order of the rows.
    Result: ``decimal(38, scale)`` for decimals; NULL for no non-NULL input.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, T.IntegralType):
        return F.sum(name)
    if not isinstance(kind, T.DecimalType):
        raise TypeError(f"{name} is {kind.simpleString()}; exact sums need a decimal or integer column")
    out = f"decimal(38,{kind.scale})"
    if kind.precision > 18:
        return F.sum(name).cast(out)
    unit = F.lit(10 ** kind.scale)
    return (F.sum((F.col(name) * unit).cast("long")).cast("decimal(38,0)") / unit).cast(out)


def safe_div(num, den) -> Column:
    """``num / NULLIF(den, 0)``: empty or zero denominators give NULL, never an error."""
    return _c(num) / F.nullif(_c(den), F.lit(0))


# Numbers of up to this many decimals enter ratios unchanged; more fail the job.
RATIO_SCALE = 6


def _units(x) -> Column:
    """Whole number of 10**-RATIO_SCALE in an exact number, which must be one."""
    held = _c(x).cast(f"decimal(38,{RATIO_SCALE})")
    cut = F.raise_error(F.lit(f"a ratio of a number with more than {RATIO_SCALE} decimals")).cast(f"decimal(38,{RATIO_SCALE})")
    return (F.when(F.round(_c(x), RATIO_SCALE) != _c(x), cut).otherwise(held) * F.lit(10 ** RATIO_SCALE)).cast("decimal(38,0)")


def ratio(num, den, n: int = 2, factor: int = 1) -> Column:
    """``ROUND(factor * num / den, n)`` as a double; NULL for an empty or zero ``den``.

    Rounded once, half away from zero, on whole numbers: with a and b the operands
    in units of their scale, floor((2 |a| factor 10^n + |b|) / (2 |b|)) is the
    rounded absolute value in units of 10^-n.  A decimal quotient would be cut to
    six digits before the rounding and could round twice.
    """
    a, b = _units(num), F.nullif(_units(den), F.lit(0))
    scaled = F.abs(a) * F.lit(2 * factor * 10 ** n) + F.abs(b)
    size = F.call_function("div", scaled, F.abs(b) * F.lit(2))
    sign = F.when((a < 0) != (b < 0), F.lit(-1)).otherwise(F.lit(1))
    return sign * size.cast("double") / F.lit(float(10 ** n))


def pct(part, whole, n: int = 2) -> Column:
    """``ROUND(100 * part / whole, n)`` with a NULL for an empty whole."""
    return ratio(part, whole, n, 100)


def share_of_total(x, n: int = 2) -> Column:
    """Rounded percentage of ``x`` in the sum of ``x`` over the whole (already aggregated) frame.

    Only ever applied to aggregated result rows (a handful of groups), where
    the single-partition window is harmless.
    """
    return pct(x, F.sum(_c(x)).over(Window.partitionBy()), n)
