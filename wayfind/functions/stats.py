"""Intervals, bands and rounding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The least match rate of each price band, and its credits.
BANDS = ((0.15, 1), (0.06, 4), (0.0, 5))
#: The deviate of the one-sided bound that prices are quoted from.
QUOTE_Z = 0.84


def wilson(hits: Column, n: Column, z: float = 1.96, unread: tuple[float, float] = (0.0, 1.0)) -> tuple[Column, Column]:
    """Lower and upper bound, within 0 and 1; without observations: unread."""
    p = hits / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    lo, hi = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.when(n > 0, lo).otherwise(unread[0]), F.when(n > 0, hi).otherwise(unread[1])


def wilson_corrected(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """With continuity correction; a bound meets 0 without hits and 1 without misses."""
    share, weight = hits / n, n + z * z
    centre = (hits + z * z / 2) / weight
    spread = z * z - 1 / n + 4 * hits * (1 - share)
    half = lambda sign: (1 + z * F.sqrt(spread + sign * (4 * share - 2))) / (2 * weight)
    lower = F.when(hits > 0, F.greatest(centre - half(1), F.lit(0.0))).otherwise(0.0)
    upper = F.when(hits < n, F.least(centre + half(-1), F.lit(1.0))).otherwise(1.0)
    return F.when(n > 0, lower).otherwise(0.0), F.when(n > 0, upper).otherwise(1.0)


def band_credits(rate: Column) -> Column:
    out = F.lit(BANDS[-1][1])
    for least, credits in reversed(BANDS):
        out = F.when(rate >= least, credits).otherwise(out)
    return out


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percent, null without a whole."""
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), digits)
