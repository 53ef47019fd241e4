"""Date and duration helpers for zone-less timestamps (``timestamp_ntz``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fractional_days(later, earlier) -> Column:
    """Elapsed time ``later - earlier`` in fractional days (double).

    Equivalent of ``EXTRACT(EPOCH FROM later - earlier) / 86400``; computed
    from whole microseconds so the value is the same in every engine.
    NULL when either side is NULL.
    """
    micros = F.timestamp_diff("MICROSECOND", _c(earlier), _c(later))
    return micros.cast("double") / F.lit(MICROS_PER_DAY)


def whole_days(later, earlier) -> Column:
    """``EXTRACT(DAY FROM later - earlier)``: whole elapsed days, truncated toward zero."""
    return F.extract(F.lit("DAY"), _c(later) - _c(earlier)).cast("int")


def month_start(ts) -> Column:
    """``DATE_TRUNC('month', ts)::date``."""
    return F.trunc(_c(ts), "month")
