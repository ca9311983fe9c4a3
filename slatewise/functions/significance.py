"""Tests of proportions, odds and stakes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The win rate that pays for standard odds of -110.
BREAK_EVEN = 0.524


def z_score(hits: Column, n: Column, p0: float = BREAK_EVEN) -> Column:
    """One-proportion z, 0 without trials."""
    return F.when(n > 0, (hits / n - p0) / F.sqrt(F.lit(p0 * (1 - p0)) / n)).otherwise(0.0)


def two_z(hits: Column, n: Column, hits_b: Column, n_b: Column) -> Column:
    """Pooled z of two proportions; 0 without trials or without spread."""
    pooled = F.try_divide(hits + hits_b, n + n_b)
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), n_b)))
    return F.when((n > 0) & (n_b > 0) & (error > 0), F.try_divide(hits / n - hits_b / n_b, error)).otherwise(0.0)


def p_value(z: Column) -> Column:
    """Two-tailed p of a normal z by a rational approximation of the error function (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def chi_square(hits: Column, n: Column, p0: float = BREAK_EVEN) -> tuple[Column, Column]:
    """Statistic of one degree of freedom against ``p0`` and its p, that of the z whose square it is; 0 and 1 without trials."""
    off = hits - n * p0
    x = F.when(n > 0, F.try_divide(off * off, n * p0) + F.try_divide(off * off, n * (1 - p0))).otherwise(0.0)
    return x, F.when(n > 0, p_value(F.sqrt(x))).otherwise(1.0)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson 95 % bounds within [0, 1]; all of it without trials."""
    p = F.try_divide(hits, n)
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    whole = 1 + z * z / n
    return F.when(n > 0, F.greatest((mid - half) / whole, F.lit(0.0))).otherwise(0.0), F.when(n > 0, F.least((mid + half) / whole, F.lit(1.0))).otherwise(1.0)


def sample_size(effect: Column) -> Column:
    """Trials that show an edge of ``effect`` over the break-even rate at 5 % with a power of 80 %."""
    p = effect + BREAK_EVEN
    spread = 1.96 * (BREAK_EVEN * (1 - BREAK_EVEN)) ** 0.5 + 0.84 * F.sqrt(p * (1 - p))
    return F.ceil(spread * spread / (effect * effect))


def variation(counts: str) -> Column:
    """Aggregate: standard deviation over mean of a column of season counts, 0 with fewer than two or a mean of 0."""
    return F.when((F.count(counts) < 2) | (F.avg(counts) == 0), 0.0).otherwise(F.stddev_pop(counts) / F.avg(counts))


def decimal_odds(american: Column) -> Column:
    return F.when(american > 0, 1 + american / 100).otherwise(1 + F.lit(100.0) / F.abs(american))


def implied_probability(american: Column) -> Column:
    return F.when(american > 0, F.lit(100.0) / (american + 100)).otherwise(F.abs(american) / (F.abs(american) + 100))


def kelly(p: Column, american: Column, cap: float | None = None) -> Column:
    """The Kelly share of a bankroll, at least 0 and at most ``cap``."""
    b = decimal_odds(american) - 1
    share = F.greatest((b * p - (1 - p)) / b, F.lit(0.0))
    return share if cap is None else F.least(share, F.lit(cap))
